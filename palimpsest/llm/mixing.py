"""Operator 3: mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Targets share a multiple of all
sizes by weight, stop at max_copies times a source's size and reshare the excess. Capacity of each pattern is routed
to source quotas by a min-cost flow; its r-th repetition costs r, so cost is convex and repeats come last. Where no
document has two sources and there are more patterns than the solver takes, the optimum is known: the target itself. Documents are then selected in seeded
hash order: prefix sums over hash bins and, inside the one bin where a quota ends, over documents give a threshold
key per quota; later passes fill what is left with documents that still fit. A decision is a function of (pattern, key,
size), so no text is shuffled and a source holding most rows is never in one task.

Cases: null text has size 0; a null source is a source of its own, last in order; an empty array of sources is the
pattern of that null source; documents of size 0 are taken as often as the pattern's full copies; rows with the same
id, pattern and size share one decision; null ids are allowed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palimpsest.llm.common import saved

#: Rows of a per-pattern table up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000
#: Patterns and sources that the flow solver takes on the driver; more overlapping patterns raise an error.
SOLVER_NODES = 200_000
BINS_SHIFT = 52
PASSES = 3
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null gives 0."""
    t = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE, -1))).cast("bigint")


def source_key(source: Column) -> Column:
    """Sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("z"))


def pattern_of(docs: DataFrame, source_col: str) -> Column:
    c = docs[source_col]
    if not isinstance(docs.schema[source_col].dataType, T.ArrayType):
        return F.array(source_key(c))
    keys = F.array_sort(F.array_distinct(F.transform(c, source_key)))
    return F.when(F.coalesce(F.size(keys), F.lit(0)) <= 0, F.array(F.lit("z"))).otherwise(keys)


def narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *keep: Column) -> DataFrame:
    """id, pattern, size, h (the seeded order), and the columns of keep."""
    size, pattern = word_count(docs[text_col].cast("string")), pattern_of(docs, source_col)
    return docs.select(docs[id_col].alias("id"), pattern.alias("pattern"), size.alias("size"), F.xxhash64(F.lit(seed), docs[id_col].cast("string"), F.array_join(pattern, "\0")).alias("h"), *keep)


def with_small(df: DataFrame, small: DataFrame, rows: int, on: str, how: str = "inner") -> DataFrame:
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, 0-based by key, without one task seeing all: ranges first, then offsets per range."""
    ranged = saved(sources.repartitionByRange("source").withColumn("part", F.spark_partition_id()), "ranged")
    at, offsets = 0, []
    for r in sorted(ranged.groupBy("part").count().collect()):
        offsets.append((r["part"], at))
        at += r["count"]
    starts = sources.sparkSession.createDataFrame(offsets, "part int, at bigint")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(starts), "part").select("source", "source_size", (F.col("at") + F.col("inside")).alias("rank"))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, max_copies: int) -> DataFrame:
    """source, source_size, target: share of all sizes by weight, capped at max_copies times the size, excess reshared."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = ranked(sources).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_copies).alias("cap")).checkpoint()
    total = t.agg(F.sum("cap")).first()[0] or 0
    want, level = total / max_copies * share, 0.0
    while True:
        full = F.col("weight") * level > F.col("cap")
        used, free = t.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if not free:
            break
        new = (want - used) / free
        if new <= level * (1 + 1e-12):
            break
        level = new
    return t.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target"))


def solve_flow(capacity: dict[tuple[str, ...], int], quota: dict[str, int], max_copies: int) -> dict[tuple[str, ...], dict[str, int]]:
    """Routed amounts pattern -> source of a min-cost maximum flow, the r-th use of a pattern's capacity costing r.

    Costs lie on the patterns' supply arcs only, so opening the levels one after another and augmenting each time to a
    maximum (earlier levels stay full) is optimal. Augmenting paths are shortest, by breadth-first search.
    """
    flow: dict[tuple[str, ...], dict[str, int]] = {p: dict.fromkeys(p, 0) for p in capacity}
    users: dict[str, list[tuple[str, ...]]] = {}
    for p in capacity:
        for q in p:
            users.setdefault(q, []).append(p)
    left = dict(quota)
    for _ in range(max_copies):
        for start in sorted(capacity):
            supply = capacity[start]
            while supply:
                came: dict = {("p", start): None}
                todo, end = deque([("p", start)]), None
                while todo and end is None:
                    kind, x = todo.popleft()
                    for y in x if kind == "p" else users.get(x, ()):
                        node = ("q" if kind == "p" else "p", y)
                        if node not in came and (kind == "p" or flow[y][x] > 0):
                            came[node] = (kind, x)
                            if kind == "p" and left.get(y, 0) > 0:
                                end = node
                                break
                            todo.append(node)
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                steps = list(zip(path[1:], path))
                most = min([supply, left[end[1]], *[flow[b[1]][a[1]] for a, b in steps if a[0] == "q"]])
                for a, b in steps:
                    if a[0] == "p":
                        flow[a[1]][b[1]] += most
                    else:
                        flow[b[1]][a[1]] -= most
                supply -= most
                left[end[1]] -= most
    return flow


class Mix:
    """The plan of a mix: quotas, routed amounts and selection thresholds; apply() decides for documents."""

    def __init__(self, docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_copies: int = 2, seed: int = 17):
        self.source_col, self.id_col, self.text_col, self.seed, self.max_copies = source_col, id_col, text_col, seed, max_copies
        spark = docs.sparkSession
        self.rows = saved(narrow(docs, id_col, text_col, source_col, seed), "narrow")
        patterns = self.rows.groupBy("pattern").agg(F.sum("size").alias("mass"), F.count("*").alias("docs")).checkpoint()
        self.n_patterns = patterns.count()
        sources = patterns.select(F.explode("pattern").alias("source"), "mass").groupBy("source").agg(F.sum("mass").alias("source_size"))
        self.targets = targets(sources, weights, share, max_copies).checkpoint()
        nodes = self.n_patterns + self.targets.count()
        if nodes > SOLVER_NODES and patterns.where(F.size("pattern") > 1).isEmpty():
            one = F.col("pattern")[0]
            routed = patterns.join(self.targets, one == F.col("source")).select("pattern", "mass", F.round("target").cast("bigint").alias("amount"), "source")
            routed = routed.select("pattern", "mass", "amount", F.array(F.struct("source", F.col("amount").alias("till"))).alias("routes"))
        else:
            if nodes > SOLVER_NODES:
                raise ValueError(f"more than {SOLVER_NODES} patterns and sources")
            capacity = {tuple(r["pattern"]): r["mass"] for r in patterns.collect()}
            quota = {r["source"]: round(r["target"]) for r in self.targets.collect()}
            out = []
            for p, by in solve_flow(capacity, quota, max_copies).items():
                till, routes = 0, []
                for q in sorted(by):
                    if by[q]:
                        till += by[q]
                        routes.append((q, till))
                out.append((list(p), capacity[p], till, routes))
            routed = spark.createDataFrame(out, "pattern array<string>, mass bigint, amount bigint, routes array<struct<source:string,till:bigint>>")
        full = F.when(F.col("mass") > 0, F.least(F.floor(F.col("amount") / F.col("mass")), F.lit(max_copies))).otherwise(F.lit(1)).cast("int")
        plan = routed.withColumn("full", full).withColumn("rest", F.when(F.col("mass") > 0, F.col("amount") - F.col("full") * F.col("mass")).otherwise(F.lit(0)))
        self.plan = self._select(plan.checkpoint())

    def _cut(self, rows: DataFrame, cuts: DataFrame, nearest: bool) -> DataFrame:
        """For each (pattern, cut, pos): the last key of the seeded prefix whose sizes stay within pos, and their sum."""
        bins = rows.groupBy("pattern", F.shiftright("h", BINS_SHIFT).alias("bin")).agg(F.sum("size").alias("s"))
        before = F.coalesce(F.sum("s").over(Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("before", before)
        edge = bins.join(cuts, "pattern").where("before <= pos").groupBy("pattern", "cut", "pos").agg(F.max(F.struct("bin", "before")).alias("e")).select("pattern", "cut", "pos", F.col("e.bin").alias("bin"), F.col("e.before").alias("before"))
        inside = rows.withColumn("bin", F.shiftright("h", BINS_SHIFT)).join(F.broadcast(edge) if self.n_patterns <= BROADCAST_ROWS else edge, ["pattern", "bin"])
        till = F.sum("size").over(Window.partitionBy("pattern", "cut").orderBy("h", "id")) + F.col("before")
        inside = inside.withColumn("till", till)
        fits = F.col("till") <= F.col("pos")
        if nearest:
            fits |= F.col("till") - F.col("pos") < F.col("pos") - (F.col("till") - F.col("size"))
        low = F.struct(F.shiftleft(F.col("bin").cast("bigint"), BINS_SHIFT).alias("h"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"))
        hit = inside.where(fits).groupBy("pattern", "cut").agg(F.max(F.struct("h", "id")).alias("key"), F.max("till").alias("used"))
        return edge.join(hit, ["pattern", "cut"], "left").select("pattern", "cut", F.coalesce("key", low).alias("key"), F.coalesce("used", "before").alias("used"))

    def _select(self, plan: DataFrame) -> DataFrame:
        """Adds cuts (a threshold key per route end) and fills (a threshold key and size limit per pass)."""
        inner = plan.select("pattern", F.posexplode(F.expr("slice(routes, 1, greatest(size(routes) - 1, 0))")).alias("cut", "r"), "mass").where("mass > 0")
        key = F.struct("h", "id")
        if inner.isEmpty():
            plan = plan.withColumn("cuts", F.expr(f"cast(array() as array<struct<cut:int,key:struct<h:bigint,id:{self.rows.schema['id'].dataType.simpleString()}>>>)"))
        else:
            got = self._cut(self.rows, inner.select("pattern", "cut", (F.col("r.till") % F.col("mass")).alias("pos")), False)
            plan = plan.join(got.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("cut", "key"))).alias("cuts")), "pattern", "left").checkpoint()
        left, rows = plan.select("pattern", F.col("rest").alias("pos")), self.rows
        for n in range(PASSES):
            rows = with_small(rows, left.where("pos > 0"), self.n_patterns, "pattern").where("size > 0")
            if n:
                rows = rows.where("size <= pos")
            got = self._cut(rows.drop("pos"), left.where("pos > 0").withColumn("cut", F.lit(n)), n == PASSES - 1).checkpoint()
            fill = got.select("pattern", F.col("key").alias(f"key{n}"), F.col("used").alias(f"used{n}"))
            plan = plan.join(fill, "pattern", "left").withColumn(f"most{n}", F.lit(None).cast("bigint") if not n else F.col("pos")).drop("pos")
            plan = plan.join(left.join(fill, "pattern", "left").select("pattern", (F.col("pos") - F.coalesce(f"used{n}", F.lit(0))).alias("pos")), "pattern").checkpoint()
            left = plan.select("pattern", "pos")
            rows = with_small(rows.drop("pos"), got.select("pattern", F.col("key").alias("last")), self.n_patterns, "pattern").where(key > F.col("last")).drop("last")
        return plan.drop("pos")

    def _decided(self, rows: DataFrame) -> DataFrame:
        key, chosen = F.struct("h", "id"), F.lit(False)
        for n in range(PASSES):
            fits = (key <= F.col(f"key{n}")) & (F.col("size") > 0)
            chosen |= F.coalesce(fits & (F.col("size") <= F.col(f"most{n}")) if n else fits, F.lit(False))
        copies = F.least(F.col("full") + chosen.cast("int"), F.lit(self.max_copies))
        out = with_small(rows, self.plan, self.n_patterns, "pattern").withColumn("copies", copies)
        place = "x -> floor(x.till / mass) > r or (floor(x.till / mass) = r and struct(h, id) <= element_at(filter(cuts, c -> c.cut = array_position(routes, x) - 1), 1).key)"
        pick = F.expr(f"""transform(if(copies > 0, sequence(0, copies - 1), cast(array() as array<int>)), r -> substring(coalesce(
            if(size(routes) = 1, routes[0].source, get(filter(slice(routes, 1, greatest(size(routes) - 1, 0)), {place}), 0).source),
            element_at(routes, -1).source, pattern[0]), 2))""")
        return out.withColumn("sources", F.when(F.col("copies") > 0, pick).otherwise(F.expr("cast(array() as array<string>)")))

    def decisions(self) -> DataFrame:
        """id, pattern, size, copies, taken (size times copies) and sources (the source each copy counts for; null's is '')."""
        return self._decided(self.rows).select("id", "pattern", "size", "copies", (F.col("size") * F.col("copies")).alias("taken"), "sources")

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with each row repeated as often as the mix takes it; whole texts, no shuffle of them."""
        struct = F.struct(*[docs[c] for c in docs.columns]).alias("__doc")
        rows = self._decided(narrow(docs, self.id_col, self.text_col, self.source_col, self.seed, struct))
        return rows.where("copies > 0").select(F.explode(F.expr("sequence(1, copies)")), "__doc").select("__doc.*")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    d = mix.decisions().withColumn("source", F.col("pattern")[0])
    return with_small(d, mix.targets, mix.n_patterns, "source").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
