"""Versioned byte objects: chunks by content, and per version a manifest of extents.

A manifest row (object, version, seq, cid, off, len) places a slice of a chunk. Splice, graft, cut and rollback write a
new manifest from the old one by expressions; bytes move only when new ones come in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.text import glued
from palimpsest.operators.chunking import chunks
from palimpsest.operators.merge import merge_bytes
from palimpsest.storage import Parts, saved

def placed(extents: DataFrame) -> DataFrame:
    """extents with start, the byte each begins at in its version."""
    before = F.coalesce(F.sum("len").over(Window.partitionBy("object", "version").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return extents.withColumn("start", before)


def window(extents: DataFrame, low: int, high: int) -> DataFrame:
    """The extents of placed versions that cover bytes [low, high), clipped to them."""
    hit = extents.where((F.col("start") < high) & (F.col("start") + F.col("len") > low))
    a, e = F.greatest("start", F.lit(low)), F.least(F.col("start") + F.col("len"), F.lit(high))
    return hit.withColumn("a", a).withColumn("e", e).withColumn("off", F.col("off") + F.col("a") - F.col("start")).withColumn("len", F.col("e") - F.col("a")).withColumn("start", F.col("a")).drop("a", "e")


def splice(old: DataFrame, offset: int, delete: int, new: DataFrame | None, version: int) -> DataFrame:
    """The manifest of version after replacing bytes [offset, offset + delete) of the placed old one by new extents."""
    cols = ["object", "cid", "off", "len"]
    head = window(old, 0, offset).select(F.lit(0).alias("side"), "start", *cols)
    tail = window(old, offset + delete, 2**62).select(F.lit(2).alias("side"), "start", *cols)
    out = head.unionByName(tail)
    if new is not None:
        out = out.unionByName(new.select(F.lit(1).alias("side"), "start", *cols))
    seq = F.row_number().over(Window.partitionBy("object").orderBy("side", "start")).cast("bigint") - 1
    return out.where("len > 0").select("object", F.lit(version).cast("bigint").alias("version"), seq.alias("seq"), "cid", "off", "len")


def assemble(extents: DataFrame, store: DataFrame, *by: str) -> DataFrame:
    """(by..., payload): the bytes of extents in order of start."""
    part = F.substr("payload", F.col("off").cast("int") + 1, F.col("len").cast("int"))
    rows = extents.join(store.select("cid", "payload"), "cid").select(*by, "start", part.alias("part"))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("p")).select(*by, glued("p", "part").alias("payload"))


def range_aggregate(extents: DataFrame, store: DataFrame, low: int, high: int, *by: str) -> DataFrame:
    """(by..., min, max, sum) of the bytes [low, high) of placed extents: each extent's part adds up in its task, so no
    object is put together; objects without a byte there are left out."""
    part = F.substr("payload", F.col("off").cast("int") + 1, F.col("len").cast("int"))

    @F.pandas_udf("low int, high int, total bigint")
    def fold(s: pd.Series) -> pd.DataFrame:
        each = [np.frombuffer(bytes(x), np.uint8) for x in s]
        return pd.DataFrame({"low": [int(x.min()) for x in each], "high": [int(x.max()) for x in each], "total": [int(x.sum(dtype=np.int64)) for x in each]})

    rows = window(extents, low, high).where("len > 0").join(store.select("cid", "payload"), "cid").select(*by, fold(part).alias("f"))
    return rows.groupBy(*by).agg(F.min("f.low").alias("min"), F.max("f.high").alias("max"), F.sum("f.total").alias("sum"))


class ByteStore:
    """Named byte objects with history."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._store = Parts(spark.createDataFrame([], "cid binary, payload binary, nbytes bigint"))
        self._extents = Parts(spark.createDataFrame([], "object string, version bigint, seq bigint, cid binary, off bigint, len bigint"))
        self.sizes: dict[str, list[int]] = {}

    @property
    def store(self) -> DataFrame:
        """(cid, payload, nbytes): the chunks, each once."""
        return self._store.all()

    @property
    def extents(self) -> DataFrame:
        return self._extents.all()

    def _keep(self, cut: DataFrame) -> DataFrame:
        """Adds the chunks that the store lacks; the extents of cut."""
        self._store.add(cut.dropDuplicates(["cid"]).join(self.store.select("cid"), "cid", "left_anti"))
        return cut.select("object", "start", "cid", F.lit(0).cast("bigint").alias("off"), F.col("nbytes").alias("len"))

    def _ingest(self, name: str, data: bytes, average: int, fixed: bool) -> DataFrame:
        return self._keep(saved(chunks(self.spark.createDataFrame([(name, bytearray(data))], "object string, data binary"), "object", "data", average, fixed), "chunks"))

    def create_all(self, df: DataFrame, name: str, payload: str, average: int = 4096, fixed: bool = False) -> int:
        """An object per row of df, cut where the rows lie; only names and sizes reach the driver. Returns how many."""
        rows = df.select(F.col(name).cast("string").alias("object"), F.coalesce(F.col(payload).cast("binary"), F.lit(bytearray())).alias("data"))
        sizes = {r["object"]: r["n"] for r in rows.groupBy("object").agg(F.max(F.octet_length("data")).alias("n"), F.count("*").alias("k")).where("k = 1").collect()}
        if len(sizes) < rows.count() or any(x is None or len(x.encode()) > 63 or x in self.sizes for x in sizes):
            raise ValueError("names must be new, distinct and of at most 63 bytes")
        cut = saved(chunks(rows, "object", "data", average, fixed), "chunks")
        self._extents.add(self._keep(cut).join(cut.select("object", "start", "seq"), ["object", "start"]).withColumn("version", F.lit(0).cast("bigint")))
        self.sizes |= {x: [n] for x, n in sizes.items()}
        return len(sizes)

    def create_files(self, path: str, average: int = 4096) -> int:
        """An object per file under path that has bytes (Spark's scan passes over empty ones), named by the last part of its path."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return self.create_all(files.withColumn("name", F.element_at(F.split("path", "/"), -1)), "name", "content", average)

    def save(self, path: str, raw: bool = False) -> int:
        """Writes the chunks and extents that path lacks and commits; returns the generation."""
        from palimpsest.catalog import Catalog

        cat, codec = Catalog(path), "none" if raw else "zstd"
        return cat.commit(cat.generation(), {"kind": "objects", "sizes": self.sizes, "store": self._store.store(path, codec), "extents": self._extents.store(path, codec)})

    @classmethod
    def open(cls, spark: SparkSession, path: str, generation: int | None = None) -> ByteStore:
        from palimpsest.catalog import Catalog, StoreError

        c = Catalog(path).read(generation)
        if c["kind"] != "objects":
            raise StoreError(f"{path!r} holds a {c['kind']}, not byte objects")
        out = cls(spark)
        out._store.load(path, c["store"])
        out._extents.load(path, c["extents"])
        out.sizes = c["sizes"]
        return out

    def create(self, name: str, data: bytes, average: int = 4096, fixed: bool = False) -> None:
        if len(name.encode()) > 63:
            raise ValueError("a name has at most 63 bytes")
        if name in self.sizes:
            raise ValueError(f"{name!r} exists")
        self.sizes[name] = []
        self._append(name, splice(placed(self.extents.where("false")), 0, 0, self._ingest(name, data, average, fixed), 0), len(data))

    def _append(self, name: str, rows: DataFrame, size: int) -> int:
        self._extents.add(rows)
        self.sizes[name].append(size)
        return len(self.sizes[name]) - 1

    def _version(self, name: str, version: int) -> int:
        if name not in self.sizes:
            raise KeyError(name)
        n = len(self.sizes[name])
        if not -n <= version < n:
            raise IndexError(f"version {version} out of range (have {n})")
        return version % n

    def at(self, name: str, version: int = -1) -> DataFrame:
        v = self._version(name, version)
        return placed(self.extents.where((F.col("object") == name) & (F.col("version") == v)))

    def read(self, name: str, offset: int = 0, length: int | None = None, version: int = -1) -> bytes:
        if offset < 0:
            raise ValueError("negative offset")
        size = self.sizes[name][self._version(name, version)]
        end = size if length is None else min(size, offset + length)
        if offset >= end:
            return b""
        return bytes(assemble(window(self.at(name, version), offset, end), self.store, "object").first()["payload"])

    def update(self, name: str, offset: int, delete: int = 0, insert: bytes = b"", average: int = 4096) -> int:
        """Replaces bytes; the new ones are cut by content too. Always a new version."""
        size = self.sizes[name][self._version(name, -1)]
        if offset < 0 or offset > size:
            raise ValueError(f"offset {offset} out of range (size {size})")
        delete = min(delete, size - offset)
        new = self._ingest(name, insert, average, False) if insert else None
        return self._append(name, splice(self.at(name), offset, delete, new, len(self.sizes[name])), size - delete + len(insert))

    def insert(self, name: str, offset: int, data: bytes) -> int:
        return self.update(name, offset, 0, data)

    def delete_range(self, name: str, offset: int, length: int) -> int:
        return self.update(name, offset, length)

    def append(self, name: str, data: bytes) -> int:
        return self.update(name, self.sizes[name][-1], 0, data)

    def rollback(self, name: str, version: int) -> int:
        v = self._version(name, version)
        rows = self.extents.where((F.col("object") == name) & (F.col("version") == v)).withColumn("version", F.lit(len(self.sizes[name])).cast("bigint"))
        return self._append(name, rows, self.sizes[name][v])

    def graft(self, target: str, at: int, source: str, offset: int, length: int, version: int = -1) -> int:
        """Inserts a slice of another object without moving bytes."""
        part = window(self.at(source, version), offset, offset + length).withColumn("object", F.lit(target))
        got = min(length, max(self.sizes[source][self._version(source, version)] - offset, 0))
        return self._append(target, splice(self.at(target), at, 0, part, len(self.sizes[target])), self.sizes[target][-1] + got)

    def cut(self, name: str, offset: int, length: int) -> int:
        return self.update(name, offset, length)

    def replace(self, name: str, old: bytes, new: bytes) -> int:
        """All non-overlapping occurrences, newlines included, as one version."""
        if not old:
            raise ValueError("`old` must be non-empty")
        data = self.read(name).replace(old, new)
        return self.update(name, 0, self.sizes[name][-1], data)

    def delete(self, name: str) -> None:
        self._version(name, -1)
        del self.sizes[name]
        self._extents.replace(self.extents.where(F.col("object") != name))

    def trim_history(self, name: str, keep: int) -> int:
        """Keeps the newest versions, renumbered from 0; returns how many went."""
        drop = max(len(self.sizes[name]) - max(keep, 1), 0)
        mine = F.col("object") == name
        self._extents.replace(self.extents.where(~mine | (F.col("version") >= drop)).withColumn("version", F.when(mine, F.col("version") - drop).otherwise(F.col("version"))))
        self.sizes[name] = self.sizes[name][drop:]
        return drop

    def vacuum(self) -> int:
        """Drops chunks no version uses."""
        before = self.store.count()
        self._store.replace(self.store.join(self.extents.select("cid").distinct(), "cid", "left_semi"))
        return before - self.store.count()

    def range_changed(self, name: str, a: int, b: int, offset: int, length: int) -> bool:
        """Whether bytes [offset, offset + length) differ in how they are made up; false only if they are equal."""
        def parts(v: int) -> DataFrame:
            w = window(self.at(name, v), offset, offset + length)
            return w.select("cid", "off", "len", (F.col("start") - offset).alias("rel"))
        x, y = parts(a), parts(b)
        return not (x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty())

    def range_history(self, name: str, offset: int, length: int, limit: int | None = None) -> list[int]:
        """Versions in which the range's make-up differs from the version before, in one pass over all manifests."""
        w = window(placed(self.extents.where(F.col("object") == name)), offset, offset + length)
        sig = w.groupBy("version").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct((F.col("start") - offset).alias("rel"), "cid", "off", "len")))).cast("binary"), 256).alias("h"))
        every = self.spark.range(len(self.sizes[name])).withColumnRenamed("id", "version").join(sig, "version", "left")
        order = Window.orderBy("version")  # one row per version of one object
        out = [r["version"] for r in every.withColumn("was", F.lag("h").over(order)).where("version > 0 and not (h <=> was)").orderBy("version").collect()]
        return out if limit is None else out[:limit]

    def merge(self, name: str, base: int, other: int) -> int:
        """Merges a version's change since base into the latest; raises MergeConflict and appends nothing on overlap."""
        head = self.read(name)
        out = merge_bytes(self.read(name, version=base), head, self.read(name, version=other))
        return self.update(name, 0, len(head), out)

    def search(self, needle: bytes, limit: int = 100_000) -> DataFrame:
        """(object, byte_off) of all overlapping hits in latest versions, by object and offset."""
        from palimpsest.functions.text import byte_offsets

        latest = self.spark.createDataFrame([(n, len(s) - 1) for n, s in self.sizes.items()] or [], "object string, version bigint")
        whole = assemble(placed(self.extents.join(F.broadcast(latest), ["object", "version"])), self.store, "object")
        return whole.select("object", F.explode(byte_offsets(F.col("payload"), needle)).alias("byte_off")).orderBy("object", "byte_off").limit(limit)

    def aggregate(self, name: str, offset: int, length: int, version: int = -1) -> tuple[int, int, int] | None:
        """Least byte, greatest byte and sum of a range of a version; None if it is empty. Ends needn't meet chunks."""
        r = range_aggregate(self.at(name, version), self.store, max(offset, 0), max(offset, 0) + length, "object").first()
        return (r["min"], r["max"], r["sum"]) if r else None

    def extent_counts(self, name: str) -> DataFrame:
        """(version, extents, fresh): the extents of each version, and those of chunks that the version before lacks."""
        mine = self.extents.where(F.col("object") == name).select("version", "cid")
        before = mine.select((F.col("version") + 1).alias("version"), "cid", F.lit(True).alias("had")).distinct()
        return mine.join(before, ["version", "cid"], "left").groupBy("version").agg(F.count("*").alias("extents"), F.count_if(F.col("had").isNull()).alias("fresh"))

    def cut_frames(self, name: str, frames: DataFrame, first: int, end: int) -> int:
        """Removes the frames [first, end) of a video of which frames (idx, start, nbytes, idr) are the table. end must be
        a key frame or lie past the last one: a cut inside a group would need its rest encoded anew."""
        edge = frames.where(F.col("idx").isin(first, end)).select("idx", "start", "idr").collect()
        at = {r["idx"]: r for r in edge}
        if first not in at or end <= first or (end in at and not at[end]["idr"]):
            raise ValueError(f"frames {first} to {end} don't end at a key frame")
        till = at[end]["start"] if end in at else frames.agg(F.max(F.col("start") + F.col("nbytes"))).first()[0]
        return self.cut(name, at[first]["start"], till - at[first]["start"])

    def objects(self) -> list[str]:
        return list(self.sizes)

    def stats(self) -> DataFrame:
        used = self.extents.agg(F.count("*").alias("extents"), F.count_distinct("cid").alias("live_chunks"))
        return used.join(self.store.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("nbytes"), F.lit(0)).alias("bytes_resident")))
