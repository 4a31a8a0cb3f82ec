"""Version ancestry: a version's visible changes are those made in the intervals of its lineage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

Intervals = tuple[tuple[int, int], ...]


@dataclass
class Lineage:
    """For each version, the closed intervals of versions whose changes it sees. Version 0 is the start."""

    roots: list[tuple[int, int]] = field(default_factory=list)  # (first version after a rollback, version rolled back to)
    latest: int = 0

    def advance(self, n: int) -> None:
        self.latest += n

    def rollback(self, to: int) -> int:
        self.check(to)
        self.latest += 1
        self.roots.append((self.latest, to))
        return self.latest

    def check(self, v: int) -> int:
        if v < 0:
            v += self.latest + 1
        if not 0 <= v <= self.latest:
            raise IndexError(f"version {v} out of range (latest is {self.latest})")
        return v

    def intervals(self, v: int) -> Intervals:
        v, out = self.check(v), []
        for start, to in reversed(self.roots):
            if v >= start:
                out.append((start, v))
                v = to
        out.append((0, v))
        return tuple(reversed(out))

    def sees(self, v: int, column: str | Column) -> Column:
        """Whether a change made in the column's version is seen in version v."""
        c = F.col(column) if isinstance(column, str) else column
        seen = F.lit(False)
        for low, high in self.intervals(v):
            seen |= c.between(low, high)
        return F.coalesce(seen, F.lit(False))
