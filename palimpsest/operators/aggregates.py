"""Aggregates over ranges of a sequence from per-chunk partials."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Monoid = dict[str, Callable[[Column], Column]]
STANDARD: Monoid = {"min": F.min, "max": F.max, "sum": F.sum}


def partials(seq: DataFrame, pos: str, value: str, chunk: int, monoid: Monoid = STANDARD) -> DataFrame:
    """(chunk, low, high, one column per monoid) with chunks of fixed length in positions."""
    c = F.floor(F.col(pos) / chunk).alias("chunk")
    return seq.groupBy(c).agg(F.min(pos).alias("low"), F.max(pos).alias("high"), *[f(F.col(value)).alias(n) for n, f in monoid.items()])


def range_aggregate(seq: DataFrame, chunks: DataFrame, pos: str, value: str, chunk: int, ranges: DataFrame, monoid: Monoid = STANDARD) -> DataFrame:
    """Per range (rid, low, high), half open: whole chunks come from partials, the two edge chunks from their rows.

    monoid's functions combine partials as they combine values (min, max, sum and the like)."""
    first, last = F.floor(F.col("low") / chunk), F.floor((F.col("high") - 1) / chunk)
    r = ranges.where("low < high").select("rid", "low", "high", first.alias("first"), last.alias("last"))
    inner = r.select("rid", F.explode(F.expr("filter(sequence(first, last), c -> c * {0} >= low and (c + 1) * {0} <= high)".format(chunk))).alias("chunk"))
    whole = inner.join(chunks, "chunk").select("rid", *monoid)
    edges = r.select("rid", "low", "high", F.explode(F.expr("filter(array_distinct(array(first, last)), c -> c * {0} < low or (c + 1) * {0} > high)".format(chunk))).alias("chunk"))
    rows = seq.withColumn("chunk", F.floor(F.col(pos) / chunk)).join(F.broadcast(edges) if ranges.count() <= 10_000 else edges, "chunk")
    rows = rows.where((F.col(pos) >= F.col("low")) & (F.col(pos) < F.col("high"))).groupBy("rid").agg(*[f(F.col(value)).alias(n) for n, f in monoid.items()])
    return whole.unionByName(rows).groupBy("rid").agg(*[f(F.col(n)).alias(n) for n, f in monoid.items()])


def user_monoid(df: DataFrame, by: list[str], value: str, identity: float, combine: Callable[[float, float], float]) -> DataFrame:
    """A Python monoid in two levels: Arrow batches fold on their own, then the partials of a group."""

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in by)

    def local(batches):
        for p in batches:
            if len(p):
                yield p.groupby(by, dropna=False, as_index=False)[value].agg(lambda s: reduce(combine, s, identity))

    part = df.select(*by, value).mapInPandas(local, f"{keys}, `{value}` double")

    @F.pandas_udf("double")
    def final(s: pd.Series) -> float:
        return float(reduce(combine, s, identity))

    return part.groupBy(*by).agg(final(value).alias("result"))


def unchanged_fraction(a: DataFrame, b: DataFrame, pos: str, word: str) -> DataFrame:
    """Share of words at equal positions that are equal."""
    return a.select(pos, F.col(word).alias("a")).join(b.select(pos, F.col(word).alias("b")), pos).agg(F.avg(F.col("a").eqNullSafe(F.col("b")).cast("double")).alias("unchanged"))
