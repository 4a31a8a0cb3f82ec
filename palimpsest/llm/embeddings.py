"""Operator 6: embedding near-deduplication by collision-counting projections.

Each of G groups projects the vectors on k random hyperplanes, whose signs form a cell, and on one more line. Within a
cell the vectors are sorted by that line, and every vector collides with those in a window centred on it. Collisions
are counted per pair over all groups; pairs with at least COUNT of them are verified by the exact cosine in double
precision. The plain form of the method, without cells, counts a fixed share of all pairs on every line and so grows
with the square of the rows; the cells keep it near n log n. k grows with the logarithm of the number of distinct
vectors, and G follows from the recall wanted: a pair at the threshold collides in one group with probability
p = (1 - acos(t) / pi)^k * P(|N(0, 2 - 2t)| <= window), and G is the least for which COUNT or more collisions have
probability RECALL. Pairs closer than the threshold collide more often.

Windows are an equi-join on (group, cell, slot), slots being as wide as the window, so Spark sorts, spills and splits
them; no group is gathered in one task. Equal vectors are one node.

Vectors of several lengths are projected each on as many components as it has, share cells only with vectors of their
length, and so never link across lengths.

Cases: a null, empty or zero vector, or one with a null, NaN or infinite component, links with nothing; repeated rows link as equal vectors; the smallest id of a component is kept,
ties of id all; null ids are ordered first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, comb, erf, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import components, saved, small_batches

RECALL, COUNT = 0.998, 2
#: Half width of a window in standard deviations of the projected difference at the threshold.
WIDTH = 2.0
#: Distinct vectors a cell should hold on average.
CELL = 8


def calibrate(n: int, threshold: float) -> tuple[int, int, float]:
    """(k, G, window) for n distinct vectors."""
    k = max(0, round(log2(max(n, 1) / CELL)))
    window = WIDTH * sqrt(2 - 2 * threshold)
    p = (1 - acos(threshold) / pi) ** k * erf(WIDTH / sqrt(2))
    g = COUNT
    while sum(comb(g, i) * p**i * (1 - p) ** (g - i) for i in range(COUNT)) > 1 - RECALL:
        g += 1
    return k, g, window


def project(vectors: DataFrame, dim: int, k: int, groups: int, window: float, seed: int) -> DataFrame:
    """(node, dim, cell, slot, at) per vector and group; the cell includes the group, and neighbours look one slot up. dim
    is the greatest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((groups, dim, k + 1))
        weights = (1 << np.arange(k, dtype=np.int64)).astype(np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                units, nodes = b.column(1).to_pylist(), b.column(0).to_numpy()
                sizes = np.array([len(u) // 8 for u in units])
                for d in np.unique(sizes):
                    own = np.flatnonzero(sizes == d)
                    x = np.frombuffer(b"".join([units[i] for i in own]), np.float64).reshape(-1, d)
                    for g in range(groups):
                        y = x @ planes[g, :d]
                        cell = ((y[:, :k] > 0) @ weights) * groups + g
                        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(np.full(len(own), d, np.int32)), pa.array(cell), pa.array(np.floor(y[:, k] / window).astype(np.int32)), pa.array(y[:, k].astype(np.float32))], names=["node", "dim", "cell", "slot", "at"])

    return vectors.mapInArrow(run, "node bigint, dim int, cell bigint, slot int, at float")


def usable(vec: Column) -> Column:
    """Whether all components are finite numbers and not all are zero."""
    x = vec.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= 1.7976931348623157e308))
    return F.coalesce(x.isNotNull() & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and the unit vector as bytes of doubles; the scale by the largest component keeps squares finite."""
    for b in batches:
        out = []
        for v in b.column(1).to_pylist():
            if v is None:
                out.append(None)
                continue
            x = np.array(v, np.float64)
            x /= np.abs(x).max()
            out.append((x / np.sqrt((x * x).sum())).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "unit"])


def cosines(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            sizes, near = np.array([len(u) for u in left]), np.zeros(b.num_rows, bool)
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                x, y = (np.frombuffer(b"".join([c[i] for i in own]), np.float64).reshape(len(own), -1) for c in (left, right))
                near[own] = (x * y).sum(1) >= threshold
            yield b.select(["a", "b"]).filter(pa.array(near))


def near_dedup(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, seed: int = 5) -> DataFrame:
    """One row per row of table: id_col, n_links, component_id, kept."""
    small_batches(table.sparkSession)
    kind = table.schema[id_col].dataType.simpleString()
    vec = table[vector_col]
    rows = table.select(table[id_col].alias("id"), F.when(usable(vec), vec.cast("array<double>")).alias("v")).mapInArrow(normalise, f"id {kind}, unit binary")
    rows = saved(rows, "units")
    dim = (rows.agg(F.max(F.octet_length("unit"))).first()[0] or 8) // 8
    # Nodes by content; the hash is checked, and a collision would only need another salt.
    salt = 0
    while True:
        nodes = rows.where("unit is not null").groupBy("unit").agg(F.count("*").alias("copies"), F.min("id").alias("first")).withColumn("node", F.xxhash64(F.lit(salt), "unit"))
        nodes = saved(nodes, "nodes")
        n = nodes.count()
        if nodes.select("node").distinct().count() == n:
            break
        salt += 1
    k, groups, window = calibrate(n, threshold)
    points = project(nodes.select("node", "unit"), dim, k, groups, window, seed)
    left = points.select("dim", "cell", F.col("node").alias("a"), F.col("at").alias("at_a"), F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"), F.col("slot").alias("own"))
    right = points.select("dim", "cell", "slot", F.col("node").alias("b"), F.col("at").alias("at_b"))
    met = left.join(right, ["dim", "cell", "slot"]).where((F.abs(F.col("at_a") - F.col("at_b")) <= window) & ((F.col("own") < F.col("slot")) | (F.col("a") < F.col("b"))))
    counted = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= COUNT)
    units = nodes.select("node", "unit")
    pairs = counted.join(units.select(F.col("node").alias("a"), F.col("unit").alias("x")), "a").join(units.select(F.col("node").alias("b"), F.col("unit").alias("y")), "b").select("a", "b", "x", "y")
    edges = saved(pairs.mapInArrow(lambda it: cosines(it, threshold), "a bigint, b bigint"), "links")

    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    member = components(edges)
    lowest = member.join(nodes, "node").groupBy("component").agg(F.min("first").alias("lowest"))
    group = member.join(lowest, "component").select("node", "lowest")
    known = nodes.join(degree, "node", "left").join(group, "node", "left").select("unit", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("lowest", "first").alias("lowest"))
    out = rows.join(known.where("links > 0"), "unit", "left")
    component = F.coalesce("lowest", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
