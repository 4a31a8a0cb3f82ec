"""Sources beyond Parquet: line records, meshes, vocabularies, video access units, nucleotide text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, raw) of non-empty lines; only \\n splits."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("raw")).where(F.octet_length("raw") > 0)


def obj_mesh(spark: SparkSession, path: str) -> DataFrame:
    """(idx, x, y, z) of the v lines of an OBJ file, in order; other lines are ignored, no vertex is an error."""
    from palimpsest.operators.ordering import global_rank

    v = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where(F.col("value").rlike("^v[ \\t]"))
    p = F.split(F.trim("value"), "[ \\t]+")
    out = global_rank(v.select("at", *[p[i + 1].cast("float").alias(a) for i, a in enumerate("xyz")]), [F.col("at")], "idx", 0).drop("at")
    if out.isEmpty():
        raise ValueError(f"{path!r} has no vertices")
    return out.select("idx", "x", "y", "z")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) from lines of id, tab, hex bytes."""
    p = F.split("value", "\t")
    return spark.read.text(path).where(F.col("value").contains("\t")).select(p[0].cast("bigint").alias("id"), F.unhex(p[1]).alias("text"))


def access_units(spark: SparkSession, path: str) -> DataFrame:
    """(video, idx, start, size, idr) of Annex-B streams. A unit ends before the first NAL after its picture that starts
    another picture or isn't one; a type 5 picture is a key frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path_, data in zip(b["path"], b["content"]):
                nals, at = [], data.find(b"\0\0\1")
                while at >= 0:
                    nals.append((at - 1 if at and data[at - 1] == 0 else at, data[at + 3] & 31 if at + 3 < len(data) else 0))
                    at = data.find(b"\0\0\1", at + 3)
                rows, start, picture, idr = [], None, False, False
                for pos, kind in nals:
                    vcl = 1 <= kind <= 5
                    if start is None:
                        start = pos
                    elif picture:
                        rows.append((start, pos - start, idr))
                        start, picture, idr = pos, False, False
                    picture |= vcl
                    idr |= kind == 5
                if start is not None:
                    rows.append((start, len(data) - start, idr))
                yield pd.DataFrame([(path_, i, *r) for i, r in enumerate(rows)], columns=["video", "idx", "start", "size", "idr"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "video string, idx bigint, start bigint, size bigint, idr boolean")
