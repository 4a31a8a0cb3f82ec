"""Helpers shared by the training-data operators: scratch storage, locators, fold columns, Arrow maps, components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.storage import libc, saved, scratch_dir, small_batches, trim  # noqa: F401


def release(spark: SparkSession) -> None:
    """Lets the driver drop shuffle files of results that are written and no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(fn: Callable) -> Callable:
    """A function for mapInArrow that returns its memory at the task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            trim()

    return run


def lean_group(fn: Callable) -> Callable:
    """A function for applyInArrow that returns its memory after each group."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return fn(table)
        finally:
            trim()

    return run


def scanned(df: DataFrame) -> DataFrame:
    """df itself if it is a plain file scan, whose rows have places; any other is written first."""
    try:
        df.select(df.metadataColumn("_metadata").getField("row_index"))
        return df
    except AnalysisException:
        return saved(df, "located")


def located(df: DataFrame) -> DataFrame:
    """df with __loc = struct(file, row): where each row's content lies. df has no column __loc of its own; one named _metadata is left alone."""
    df = scanned(df)
    place = df.metadataColumn("_metadata")
    return df.select("*", F.struct(place.getField("file_path").alias("file"), place.getField("row_index").alias("row")).alias("__loc"))


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..., so that no name of theirs can clash with another."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string or binary column as raw UTF-8 bytes; null gives b''."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    return [v if v is not None else b"" for v in col.to_pylist()]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Nodes of which a task keeps a forest before it passes it on.
FOREST_NODES = 500_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as edges from each node to the least one it reaches over a task's edges: fewer, with the same components."""
    up: dict = {}
    schema = None

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def flush() -> pa.RecordBatch:
        rows = [(x, r) for x in list(up) if (r := root(x)) != x]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > FOREST_NODES:
            yield flush()
    if schema is not None:
        yield flush()


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: (a, b) of one orderable type, in any order, loops and repeats allowed. Returns (node, component), the
    component being its smallest node; nodes without edges are absent. Tasks first thin their edges to forests. Each round is two aggregations and joins on
    node with a checkpoint, so lineage stays short; the number of rounds is logarithmic in the longest path.
    """
    kind = edges.schema["a"].dataType.simpleString()
    edges = edges.select("a", "b").mapInArrow(lean(forest), f"a {kind}, b {kind}")
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    before = None
    for _ in count() if most_rounds is None else range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = small.where("a <> b").distinct().checkpoint()
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
