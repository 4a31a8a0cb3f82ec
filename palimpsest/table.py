"""A versioned columnar table: a base DataFrame with row ids, a deletion vector, and column edits kept as expressions.

Every mutation appends a version. Column edits are stored as operations and rendered as one Column expression when a
version is read, so Catalyst prunes and folds them; compact_column and compact write them out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.lineage import Lineage
from palimpsest.operators.ordering import global_rank
from palimpsest.storage import saved


#: Hashes of repeated keys that are broadcast.
HASHES_SENT = 1_000_000


def value_map(c: Column, mapping: dict, dtype: T.DataType) -> Column:
    """All entries of mapping at once; other values and null stay. The type stays, if the new values fit it."""
    out = c
    if mapping:
        pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
        known = F.create_map(*pairs)
        hit = F.map_contains_key(known, c) if hasattr(F, "map_contains_key") else F.array_contains(F.map_keys(known), c)
        out = F.when(c.isNotNull() & hit, F.try_element_at(known, c)).otherwise(c)
    return out.cast(dtype)


@dataclass
class Op:
    """An edit of one column from version on: kind map, add, expr or set."""

    version: int
    column: str
    kind: str
    args: tuple


@dataclass
class State:
    """What a generation of base data holds; compaction starts a new one."""

    base: DataFrame
    first: int
    ops: list[Op] = field(default_factory=list)
    #: Changes where row ids change their meaning: only compact() does that.
    numbering: int = 0
    #: Where a store holds the base; set_column makes another one.
    stored: str | None = None


class Table:
    def __init__(self, df: DataFrame, row_id: str | None = None, order: list[Column] | None = None):
        """df's rows get a 0-based row_id by order (all columns, if none is given), or keep a column named by row_id."""
        self.spark = df.sparkSession
        if row_id:
            base = df.withColumn("row_id", F.col(row_id).cast("bigint"))
        else:
            base = saved(global_rank(df, order or [F.col(f"`{c}`") for c in df.columns], "row_id", 0), "base")
        self.states = [State(base, 0)]
        self.columns = [c for c in base.columns if c != "row_id"]
        self.lineage = Lineage()
        self.dead: DataFrame = self.spark.createDataFrame([], "row_id bigint, removed_v bigint, born bigint")
        #: (removed_v, born) of all rows in dead.
        self.drops: set[tuple[int, int]] = set()

    # sources
    @classmethod
    def from_arrow(cls, table) -> Table:
        spark = SparkSession.getActiveSession()
        df = spark.createDataFrame(table.append_column("row_id", __import__("pyarrow").array(range(table.num_rows), "int64")))
        return cls(df, "row_id")

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, order: list[Column] | None = None) -> Table:
        df = spark.read.parquet(path)
        return cls(df, order=order) if order else cls(df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r")), order=[F.col("__f"), F.col("__r")])._without("__f", "__r")

    @classmethod
    def from_jsonl(cls, spark: SparkSession, path: str, order: list[Column] | None = None) -> Table:
        return cls(spark.read.json(path), order=order)

    def _without(self, *cols: str) -> Table:
        self.states[0].base = self.states[0].base.drop(*cols)
        self.columns = [c for c in self.columns if c not in cols]
        return self

    # versions
    @property
    def versions(self) -> int:
        return self.lineage.latest + 1

    def _state(self, v: int) -> State:
        return [s for s in self.states if s.first <= v][-1]

    def _advance(self) -> int:
        self.lineage.advance(1)
        return self.lineage.latest

    def _render(self, name: str, v: int, dtype: T.DataType) -> Column:
        c = F.col(f"`{name}`")
        for op in self._state(v).ops:
            if op.column != name or op.version > v:
                continue
            if op.kind == "map":
                c = value_map(c, op.args[0], dtype)
            elif op.kind == "add":
                low, high, delta = op.args
                if isinstance(dtype, T.NumericType):
                    c = F.when(F.col("row_id").between(low, high - 1), c + F.lit(delta)).otherwise(c).cast(dtype)
            elif op.kind == "expr":
                c = op.args[0](c)
            else:
                c = F.col(f"`{op.args[0]}`")
        return c

    def physical(self, version: int = -1, columns: Iterable[str] | None = None) -> DataFrame:
        """All rows of a version, dropped ones too: row_id and columns."""
        v = self.lineage.check(version)
        base = self._state(v).base
        return base.select("row_id", *[self._render(c, v, base.schema[c].dataType).alias(c) for c in (columns or self.columns)])

    def _gone(self, v: int) -> DataFrame:
        return self.dead.where((F.col("removed_v") <= v) & (F.col("born") == self._state(v).first)).select("row_id")

    def rows(self, version: int = -1, columns: Iterable[str] | None = None) -> DataFrame:
        """Live rows of a version."""
        v = self.lineage.check(version)
        return self._live(self.physical(v, columns), v)

    def _drops(self, v: int) -> bool:
        return any(removed <= v and born == self._state(v).first for removed, born in self.drops)

    def _live(self, rows: DataFrame, v: int) -> DataFrame:
        """rows without those dropped by v; nothing is joined, and so nothing shuffled, before the first drop."""
        if not self._drops(v):
            return rows
        return rows.join(self._gone(v), "row_id", "left_anti")

    def column(self, name: str, version: int = -1, live_only: bool = True) -> DataFrame:
        return (self.rows if live_only else self.physical)(version, [name])

    def num_rows(self, version: int = -1) -> int:
        return self.rows(version, self.columns[:1]).count()

    def num_rows_physical(self, version: int = -1) -> int:
        return self._state(self.lineage.check(version)).base.count()

    # column edits
    def _push(self, column: str, kind: str, *args) -> int:
        if column not in self.columns:
            raise KeyError(column)
        v = self._advance()
        self.states[-1].ops.append(Op(v, column, kind, args))
        return v

    def relabel_lazy(self, column: str, mapping: dict) -> int:
        return self._push(column, "map", dict(mapping))

    def add_range(self, column: str, low: int, high: int, delta) -> int:
        return self._push(column, "add", max(low, 0), high, delta)

    def relabel(self, column: str, mapping: dict) -> int:
        """Maps values now; returns how many rows change."""
        n = self.physical(columns=[column]).where(F.col(f"`{column}`").isin([k for k, v in mapping.items() if k != v])).count()
        self._push(column, "map", dict(mapping))
        self.compact_column(column)
        return n

    def map_column(self, column: str, fn: Callable[[Column], Column]) -> int:
        return self._push(column, "expr", fn)

    def set_column(self, column: str, values: DataFrame) -> int:
        """values (row_id, value) for every physical row; ValueError if rows are missing or extra."""
        state = self.states[-1]
        have, got = state.base.count(), values.select("row_id").distinct().join(state.base, "row_id", "left_semi").count()
        if have != got or values.count() != have:
            raise ValueError(f"{values.count()} values for {have} rows")
        name = f"__set{self.versions}_{column}"
        state.base, state.stored = state.base.join(values.select("row_id", F.col("value").alias(name)), "row_id"), None
        return self._push(column, "set", name)

    def pending_ops(self, column: str) -> int:
        return sum(op.column == column for op in self.states[-1].ops)

    def compact_column(self, column: str) -> int:
        """Writes a column's edits into a base of a new generation; returns how many were folded. Older versions stay."""
        n = self.pending_ops(column)
        if n:
            v = self.lineage.latest
            state = self.states[-1]
            keep = [op for op in state.ops if op.column != column]
            base = saved(state.base.withColumn(column, self._render(column, v, state.base.schema[column].dataType)), "base")
            self.dead = self.dead.unionByName(self.dead.where((F.col("born") == state.first) & (F.col("removed_v") <= v)).withColumn("born", F.lit(v + 1).cast("bigint")))
            self.drops |= {(r, v + 1) for r, born in self.drops if born == state.first and r <= v}
            self._advance()
            self.states.append(State(base, v + 1, keep, state.numbering))
        return n

    # row edits
    def _drop(self, rows: DataFrame) -> int:
        gone = saved(self._live(rows.select("row_id"), self.lineage.latest), "dead")
        n = gone.count()
        v = self._advance()
        if not n:
            return n
        self.drops.add((v, self._state(v).first))
        self.dead = self.dead.unionByName(gone.select("row_id", F.lit(v).cast("bigint").alias("removed_v"), F.lit(self._state(v).first).cast("bigint").alias("born")))
        return n

    def drop_where(self, cond: Column) -> int:
        """Drops live rows whose condition is true; null is not true."""
        return self._drop(self.physical().where(F.coalesce(cond, F.lit(False))))

    def filter(self, cond: Column) -> int:
        """Keeps rows whose condition is true; null drops."""
        return self._drop(self.physical().where(~F.coalesce(cond, F.lit(False))))

    def drop_class(self, column: str, value) -> int:
        return self.drop_where(F.col(f"`{column}`").eqNullSafe(F.lit(value)))

    def drop_rows(self, mask: DataFrame) -> int:
        """mask (pos, drop): positions are of physical rows or, if there are as many as live rows, of live rows."""
        n = mask.count()
        if n == self.num_rows_physical():
            own = self.states[-1].base.select("row_id")
            return self._drop(own.join(mask.where("drop").select(F.col("pos").alias("row_id")), "row_id", "left_semi"))
        if n != self.num_rows():
            raise ValueError(f"mask of {n} rows for {self.num_rows_physical()} physical, {self.num_rows()} live")
        ranked = global_rank(self.rows(columns=self.columns[:1]).select("row_id"), [F.col("row_id")], "pos", 0)
        return self._drop(ranked.join(mask.where("drop"), "pos").select("row_id"))

    def dedup(self, on: list[str] | None = None) -> int:
        """Keeps the first live row of each key; null equals null and NaN equals NaN. Equal keys have equal hashes, so only
        rows whose hash occurs again are compared by their keys, unless most of them would be."""
        keys = on or self.columns
        rows = self.rows(columns=keys)
        cols = [F.col(f"`{k}`") for k in keys]
        again = saved(rows.select(F.xxhash64(*cols).alias("__h")).groupBy("__h").agg(F.count("*").alias("n")).where("n > 1").select("__h"), "again")
        n = again.count()
        if not n:
            return self._drop(rows.select("row_id").where(F.lit(False)))
        if n <= HASHES_SENT:
            rows = rows.withColumn("__h", F.xxhash64(*cols)).join(F.broadcast(again), "__h", "left_semi").drop("__h")
        first = rows.groupBy(*cols).agg(F.min("row_id").alias("row_id"))
        return self._drop(rows.select("row_id").join(first.select("row_id"), "row_id", "left_anti"))

    def compact(self) -> int:
        """Drops dead rows for good and folds all edits; row ids renumber. Returns the rows removed."""
        before = self.num_rows_physical()
        live = saved(global_rank(self.rows(), [F.col("row_id")], "new_id", 0).drop("row_id").withColumnRenamed("new_id", "row_id"), "base")
        v = self._advance()
        self.states.append(State(live, v, [], self.states[-1].numbering + 1))
        return before - live.count()

    # reports
    def diff(self, a: int, b: int, key: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows, cells): row_id with change removed or added; and row_id, column, old, new (as text) of rows in both.

        Across a compaction row ids mean different rows: then key is needed, and takes row_id's place."""
        a, b = self.lineage.check(a), self.lineage.check(b)
        if self._numbering(a) != self._numbering(b) and key is None:
            raise ValueError("the versions lie on both sides of a compaction; give a key")
        ident = key or "row_id"
        x, y = self.rows(a), self.rows(b)
        ids = lambda df: df.select(F.col(ident).alias("id"))
        if key is None:  # the same rows below both versions: only what was dropped differs
            x_gone, y_gone = (self._gone(v).select(F.col("row_id").alias("id")) for v in (a, b))
            first, second = (p if not self._drops(v) else p.join(q, "id", "left_anti") for p, q, v in ((y_gone, x_gone, a), (x_gone, y_gone, b)))
        else:
            first, second = ids(x).join(ids(y), "id", "left_anti"), ids(y).join(ids(x), "id", "left_anti")
        rows = first.withColumn("change", F.lit("removed")).unionByName(second.withColumn("change", F.lit("added")))
        cols = [c for c in self.columns if c != key]
        both = x.select(F.col(ident).alias("id"), *[F.col(f"`{c}`").alias(f"a_{c}") for c in cols]).join(y.select(F.col(ident).alias("id"), *[F.col(f"`{c}`").alias(f"b_{c}") for c in cols]), "id")
        cell = lambda c: F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").cast("string").alias("old"), F.col(f"b_{c}").cast("string").alias("new")))
        cells = both.select("id", F.explode(F.filter(F.array(*[cell(c) for c in cols]), lambda s: s.isNotNull())).alias("s")).select("id", "s.*")
        return rows, cells

    def _numbering(self, v: int) -> int:
        return self._state(v).numbering

    def touched_versions(self, row_id: int, column: str) -> list[int]:
        """The table versions in which a cell changed or its row went."""
        c = F.col(f"`{column}`")
        each = [self.rows(v, [column]).where(F.col("row_id") == row_id).select(F.lit(v).alias("v"), c.alias("x")) for v in range(self.versions)]
        rows = each[0]
        for r in each[1:]:
            rows = rows.unionByName(r)
        now = {r["v"]: ("is", r["x"]) for r in rows.collect()}  # one job; a row a version at most
        return [v for v in range(1, self.versions) if now.get(v) != now.get(v - 1)]

    def distinct_exact(self, column: str, version: int = -1) -> int:
        """Distinct values over physical rows, null counting as one."""
        c = F.col(f"`{column}`")
        r = self.physical(version, [column]).agg(F.count_distinct(c).alias("n"), F.max(c.isNull().cast("int")).alias("null")).first()
        return r["n"] + (r["null"] or 0)

    def column_report(self, column: str, version: int = -1) -> DataFrame:
        """(n, nulls, estimate) of a column's live rows; estimate is the sketched number of distinct values, null being one."""
        from palimpsest.operators import sketch

        rows = self.rows(version, [column])
        c = F.col(f"`{column}`")
        counts = rows.agg(F.count("*").alias("n"), F.count_if(c.isNull()).alias("nulls"))
        return counts.join(sketch.estimate(sketch.registers(rows.select(c.alias("v")), "v")))

    # persistence
    def save(self, path: str, raw: bool = False) -> int:
        """Commits the table under path: bases are written once, whatever the number of versions over them, and edits are
        kept as operations in the commit. Edits by a Column function have no lasting form and are folded first, which
        makes a version. Returns the generation."""
        from palimpsest.catalog import Catalog

        for c in {op.column for op in self.states[-1].ops if op.kind == "expr"}:
            self.compact_column(c)
        if any(op.kind == "expr" for s in self.states[:-1] for op in s.ops):
            self._forget_functions(path)
        cat, codec, n = Catalog(path), "none" if raw else "zstd", uuid.uuid4().hex
        for s in self.states:
            if s.stored is None or not s.stored.startswith(f"{path}/"):
                s.stored = f"{path}/base-{uuid.uuid4().hex}"
                s.base.write.option("compression", codec).parquet(s.stored)
        self.dead.write.option("compression", codec).parquet(f"{path}/dead-{n}")
        states = [{"base": s.stored.rpartition("/")[2], "first": s.first, "numbering": s.numbering, "ops": [[op.version, op.column, op.kind, [list(a.items()) if isinstance(a, dict) else a for a in op.args]] for op in s.ops]} for s in self.states]
        body = {"kind": "table", "columns": self.columns, "latest": self.lineage.latest, "roots": self.lineage.roots, "states": states, "dead": f"dead-{n}"}
        return cat.commit(cat.generation(), body)

    def _forget_functions(self, path: str) -> None:
        """Older generations that hold an edit by a function: versions with it become bases of their own."""
        out = []
        for i, s in enumerate(self.states):
            marks = sorted({op.version for op in s.ops if op.kind == "expr"})
            plain = [op for op in s.ops if op.kind != "expr" and (not marks or op.version < marks[0])]
            out.append(State(s.base, s.first, plain, s.numbering, s.stored))
            end = self.states[i + 1].first if i + 1 < len(self.states) else self.lineage.latest + 1
            for v in range(marks[0], end) if marks else ():
                out.append(State(saved(self.physical(v), "base"), v, [], s.numbering))
                born = self.dead.where((F.col("born") == s.first) & (F.col("removed_v") <= end)).withColumn("born", F.lit(v).cast("bigint"))
                self.dead = self.dead.unionByName(born)
                self.drops |= {(r, v) for r, b in self.drops if b == s.first and r <= end}
        self.states = out

    @classmethod
    def open(cls, spark: SparkSession, path: str, generation: int | None = None) -> Table:
        from palimpsest.catalog import Catalog, StoreError

        c = Catalog(path).read(generation)
        if c["kind"] != "table":
            raise StoreError(f"{path!r} holds a {c['kind']}, not a table")
        out = cls.__new__(cls)
        out.spark, out.columns, out.lineage = spark, c["columns"], Lineage([tuple(r) for r in c["roots"]], c["latest"])
        op = lambda v, column, kind, args: Op(v, column, kind, (dict(map(tuple, args[0])),) if kind == "map" else tuple(args))
        out.states = [State(spark.read.parquet(f"{path}/{s['base']}"), s["first"], [op(*x) for x in s["ops"]], s["numbering"], f"{path}/{s['base']}") for s in c["states"]]
        out.dead = spark.read.schema("row_id bigint, removed_v bigint, born bigint").parquet(f"{path}/{c['dead']}")
        out.drops = {tuple(r) for r in out.dead.select("removed_v", "born").distinct().collect()}
        return out

    def to_parquet(self, path: str, version: int = -1) -> None:
        self.rows(version).drop("row_id").write.parquet(path)

    def to_arrow(self, version: int = -1, live_only: bool = True):
        return (self.rows if live_only else self.physical)(version).orderBy("row_id").drop("row_id").toArrow()
