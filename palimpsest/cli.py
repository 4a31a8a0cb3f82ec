"""Curation commands, from a script or the keyboard: python -m palimpsest.cli FILE [SCRIPT]."""

from __future__ import annotations

import shlex
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.catalog import Catalog, StoreError
from palimpsest.dataset import Dataset
from palimpsest.functions import text as T

HELP = "head [n] | count | drop-contains TEXT | dedup | near-dedup [t] | filter-length MIN MAX(0: none) | scan-pii | quality | replace OLD NEW | versions | rollback V | diff A B | export V FILE | save DIR | open DIR | stats | verify DIR | help | quit"


class Session:
    def __init__(self, spark: SparkSession, data: Dataset):
        self.spark, self.data = spark, data

    def run(self, line: str) -> str | None:
        """The answer to one line; blank lines and comments give nothing, quit gives None."""
        words = shlex.split(line, comments=True)
        if not words:
            return ""
        verb, args, d = words[0], words[1:], self.data
        if verb in ("quit", "exit"):
            return None
        if verb == "help":
            return HELP
        if verb == "head":
            return "\n".join(bytes(r["raw"]).decode("utf-8", "replace") for r in d.head(int(args[0]) if args else 5).collect())
        if verb == "count":
            return str(d.count())
        if verb == "drop-contains":
            return f"removed {d.drop_containing(args[0]).removed}"
        if verb == "dedup":
            return f"removed {d.dedup().removed}"
        if verb == "near-dedup":
            return f"removed {d.near_dedup(threshold=float(args[0]) if args else 0.80).removed}"
        if verb == "filter-length":
            return f"removed {d.filter_length(int(args[0]), int(args[1]) or None).removed}"
        if verb == "scan-pii":
            hit = d.at().withColumn("t", T.display(F.col("raw"))).where(T.has_pii(F.col("t")))
            shown = [r["t"] for r in hit.orderBy("ord").limit(3).collect()]
            return "\n".join([f"flagged {hit.count()}", *shown])
        if verb == "quality":
            return str(T.quality(d.at(), "raw").first().asDict())
        if verb == "replace":
            return d.replace(args[0], args[1]).detail
        if verb == "versions":
            return "\n".join(f"v{r['version']} {r['records']} records {r['bytes']} bytes" for r in d.versions_frame().orderBy("version").toLocalIterator())
        if verb == "rollback":
            return f"now v{d.rollback(int(args[0])).version_after}"
        if verb == "diff":
            return str(d.diff(int(args[0]), int(args[1])).first().asDict())
        if verb == "export":
            return f"{d.export(args[1], int(args[0]))} bytes"
        if verb == "save":
            d.save(args[0])
            return f"saved generation {Catalog(args[0]).generation()}"
        if verb == "open":
            self.data = Dataset.open(self.spark, args[0])
            return f"{self.data.count()} records"
        if verb == "stats":
            return d.summary()
        if verb == "verify":
            return {1: "sound", 0: "not a store", -1: "damaged"}.get(Catalog(args[0]).store_format(), "sound")
        return f"unknown command {verb!r}; {HELP}"


def main(argv: list[str]) -> int:
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    session = Session(spark, Dataset.from_jsonl(spark, argv[0]))
    for line in open(argv[1]) if len(argv) > 1 else sys.stdin:
        try:
            said = session.run(line)
        except (StoreError, ValueError, IndexError) as e:
            said = f"error: {e}"
        if said is None:
            break
        if said:
            print(said)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
