"""Meshes, quantisation, Morton order, transforms, brush strokes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.codec import residual, restore

AXES = ("x", "y", "z")


def bounds(mesh: DataFrame) -> DataFrame:
    return mesh.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])


def grid_encode(c: Column, step: float) -> Column:
    """Nearest multiple of step, half away from zero."""
    return F.round(c.cast("double") / step).cast("bigint")


def grid_decode(q: Column, step: float) -> Column:
    return q * F.lit(step)


def byte_levels(c: Column, low: Column, span: Column) -> Column:
    """The residual in 255 levels of a span; a span of 0 counts as 1."""
    return F.round((c - low) / F.when(span == 0, 1.0).otherwise(span) * 255).cast("int")


def exact_encode(c: Column, step: float) -> Column:
    """The nearest multiple of step and the bits that make up the difference, so that decoding gives c bit for bit."""
    q = grid_encode(c, step)
    return F.struct(q.alias("q"), residual(c, grid_decode(q, step)).alias("bits"))


def exact_decode(e: Column, step: float) -> Column:
    return restore(grid_decode(e["q"], step), e["bits"])


def spread(v: Column) -> Column:
    """Bits of a 21-bit number three apart."""
    x = v.bitwiseAND(0x1FFFFF)
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(mesh: DataFrame, box: DataFrame | None = None) -> DataFrame:
    """mesh with its Morton key: 21 bits an axis over the bounds (an empty span counts as 1); order by (key, idx)."""
    box = F.broadcast(box if box is not None else bounds(mesh))  # one row
    def level(a: str) -> Column:
        span = F.col(f"max_{a}") - F.col(f"min_{a}")
        return F.floor((F.col(a).cast("double") - F.col(f"min_{a}")) / F.when(span == 0, 1.0).otherwise(span) * 2097151.0).cast("bigint")
    key = spread(level("x")).bitwiseOR(F.shiftleft(spread(level("y")), 1)).bitwiseOR(F.shiftleft(spread(level("z")), 2))
    return mesh.join(box).withColumn("key", key).drop(*[f"{n}_{a}" for a in AXES for n in ("min", "max")])


def max_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """The largest coordinate difference and the first vertex with it; -1 if the meshes differ in size."""
    both = a.select("idx", *[F.col(c).alias(f"a_{c}") for c in AXES]).join(b.select("idx", *AXES), "idx", "full")
    gap = F.greatest(*[F.abs(F.col(f"a_{c}").cast("double") - F.col(c)) for c in AXES])
    lost = F.count_if(F.col("x").isNull() | F.col("a_x").isNull())
    e = both.agg(F.max(gap).alias("e"), F.min_by("idx", F.struct(-gap, "idx")).alias("worst"), lost.alias("lost"))
    return e.select(F.when(F.col("lost") > 0, -1.0).otherwise(F.col("e")).alias("max_error"), F.when(F.col("lost") == 0, F.col("worst")).alias("worst"))


def translation(x: float, y: float, z: float) -> list[float]:
    m = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    m[3], m[7], m[11] = x, y, z
    return m


def transform(points: DataFrame, matrix: str = "m") -> DataFrame:
    """Vertices moved by a row-major 4x4 matrix column."""
    return points.withColumns({f"t{a}": sum((F.col(matrix)[4 * r + k] * F.col(c) for k, c in enumerate(AXES)), F.col(matrix)[4 * r + 3]) for r, a in enumerate(AXES)})


def stroke(mesh: DataFrame, center: tuple[float, float, float], radius: float, push: tuple[float, float, float]) -> DataFrame:
    """A brush stroke: push with smoothstep falloff inside radius."""
    d = F.sqrt(sum((F.col(a) - c) * (F.col(a) - c) for a, c in zip(AXES, center)))
    t = 1 - d / radius
    w = F.when(d < radius, t * t * (3 - 2 * t)).otherwise(0.0)
    return mesh.withColumns({a: F.col(a) + w * p for a, p in zip(AXES, push)})


def displacement(before: DataFrame, after: DataFrame) -> DataFrame:
    """The vertices that moved, with their differences."""
    both = before.select("idx", *[F.col(a).alias(f"b_{a}") for a in AXES]).join(after, "idx")
    d = {f"d{a}": F.col(a) - F.col(f"b_{a}") for a in AXES}
    return both.where(F.greatest(*[F.abs(v) for v in d.values()]) > 0).select("idx", *[v.alias(k) for k, v in d.items()])


def gops(frames: DataFrame) -> DataFrame:
    """frames (video, idx, idr) with the group each belongs to: its last key frame, and the next one."""
    w = Window.partitionBy("video").orderBy("idx")
    key = F.when(F.col("idr"), F.col("idx"))
    return frames.withColumn("gop", F.last(key, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next_gop", F.first(key, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def instances(placed: DataFrame, assets: DataFrame, on: str, instance: str, asset: str) -> DataFrame:
    """(instance, asset): the asset each placed instance refers to; instances without one are left out."""
    return placed.select(instance, on).join(assets.select(on, asset), on).select(F.col(instance).alias("instance"), F.col(asset).alias("asset"))
