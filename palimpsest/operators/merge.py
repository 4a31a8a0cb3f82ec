"""Three-way merge: of byte strings by one span per side, and of rows by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MergeConflict(ValueError):
    """Both sides changed the same bytes."""


@dataclass(frozen=True)
class Span:
    """A side's change: base[low:high] became what lies at side[low:low + size]."""

    low: int
    high: int
    size: int

    @property
    def empty(self) -> bool:
        return self.low == self.high and not self.size


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def span(base: bytes, side: bytes) -> Span:
    p = _common(base, side)
    most = min(len(base), len(side)) - p
    s = _common(base[len(base) - most :][::-1], side[len(side) - most :][::-1]) if most else 0
    return Span(p, len(base) - s, len(side) - s - p)


def merge_bytes(base: bytes, head: bytes, other: bytes) -> bytes:
    """head with other's change. Equal changes converge, touching ones don't conflict, overlapping ones raise."""
    h, o = span(base, head), span(base, other)
    if o.empty or head == other:
        return head
    new = other[o.low : o.low + o.size]
    if h.empty:
        return other
    if h.low < o.high and o.low < h.high:
        raise MergeConflict(f"both sides changed bytes {max(h.low, o.low)} to {min(h.high, o.high)}")
    shift = h.size - (h.high - h.low) if o.low >= h.high else 0
    return head[: o.low + shift] + new + head[o.high + shift :]


def merge_rows(base: DataFrame, head: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """(key, merged, status): changed on one side takes that side; equal changes converge; different ones conflict and
    keep head's. A row absent from a side counts as deleted there; status deleted means the merge has no such row."""
    def side(df: DataFrame, n: str) -> DataFrame:
        return df.select(key, F.struct(F.col(value).alias("v")).alias(n))
    j = side(base, "b").join(side(head, "h"), key, "full").join(side(other, "o"), key, "full")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    pick = F.when(same("h", "b"), F.col("o")).otherwise(F.col("h"))
    status = F.when(same("h", "b") & same("o", "b"), "unchanged").when(same("h", "o"), "converged").when(same("h", "b"), "other").when(same("o", "b"), "head").otherwise("conflict")
    return j.select(key, pick.alias("p"), status.alias("status")).select(key, F.col("p.v").alias("merged"), F.when(F.col("p").isNull() & (F.col("status") != "conflict"), "deleted").otherwise(F.col("status")).alias("status"))
