"""Dictionary tokens: learn units and merges, tokenize greedily with byte escapes, and the exact inverse.

Token ids are positive; id ESCAPE + b stands for the byte b of text outside the dictionary."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import PAIRS_HELD, UNIT, units
from palimpsest.storage import saved, small_batches, trim

ESCAPE = 0xFFFFFF00
MOST_UNITS, MOST_BYTES = 12, 64
#: Dictionary entries that are broadcast; tokenize refuses a dictionary with more entries of several units.
MOST_ENTRIES = 1_000_000
#: Items of a block, whose different ones are looked up together.
BLOCK_ITEMS = 5_000_000
_UNIT, _TEXT_UNIT = re.compile(UNIT.encode()), re.compile(UNIT)


def learn(df: DataFrame, text: str, known: DataFrame | None = None) -> DataFrame:
    """(id, text): the dictionary with all units of up to 64 bytes, old ids kept and new ones dense after them."""
    from palimpsest.operators.ordering import global_rank

    new = df.select(F.explode(units(F.col(text))).alias("text")).where(F.octet_length("text") <= MOST_BYTES).distinct()
    if known is None:
        return global_rank(new, [F.col("text")], "id").select("id", "text")
    start = (known.agg(F.max("id")).first()[0] or 0) + 1
    fresh = global_rank(new.join(known, "text", "left_anti"), [F.col("text")], "id", start)
    return known.select("id", "text").unionByName(fresh.select("id", "text"))


def train(df: DataFrame, text: str, merges: int = 1000, min_count: int = 4, rounds: int = 1) -> DataFrame:
    """The learned dictionary with frequent sequences of its entries as further ones. Each round cuts the texts greedily
    by the dictionary so far and adds the most frequent adjacent pairs of up to 12 units and 64 bytes, ties by text; it
    ends early when none is left. Only the new entries, `merges` a round at most, pass the driver."""
    from palimpsest.operators.ordering import global_rank

    known = saved(learn(df, text), "dictionary")
    for _ in range(rounds):
        entries = _broadcast(df, known)
        fresh = _entry_pairs(df, text, entries).where(F.col("n") >= min_count).orderBy(F.desc("n"), "text").limit(merges).select("text")
        fresh = saved(fresh, "merges")
        if fresh.isEmpty():
            break
        start = (known.agg(F.max("id")).first()[0] or 0) + 1
        known = saved(known.unionByName(global_rank(fresh, [F.col("text")], "id", start).select("id", "text")), "dictionary")
    return known


def _entry_pairs(df: DataFrame, text: str, entries) -> DataFrame:
    """(text, n): how often two adjacent entries make up a text that isn't one yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k.decode("utf-8", "replace") for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["text", "n"])
            counts.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                cut = list(_greedy(_UNIT.findall((t or "").encode()), entries.value))
                for (x, m, i), (y, n, j) in zip(cut, cut[1:]):
                    if i is not None and j is not None and m + n <= MOST_UNITS and len(x) + len(y) <= MOST_BYTES and x + y not in entries.value:
                        counts[x + y] += 1
                if len(counts) > PAIRS_HELD:
                    yield flush()
        yield flush()

    return df.select(F.col(text).cast("string")).mapInArrow(run, "text string, n bigint").groupBy("text").agg(F.sum("n").alias("n"))


def _greedy(u: list[bytes], ids: dict[bytes, int], most: int = MOST_UNITS) -> Iterator[tuple[bytes, int, int | None]]:
    """(bytes, units, id) of the longest entry of up to `most` units at each place; id None for a unit that isn't one."""
    i = 0
    while i < len(u):
        for n in range(min(most, MOST_UNITS, len(u) - i), 0, -1):
            x = b"".join(u[i : i + n])
            if (k := ids.get(x)) is not None:
                break
        yield x, n, k
        i += n


def _broadcast(df: DataFrame, dictionary: DataFrame):
    rows = dictionary.limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the dictionary has more than {MOST_ENTRIES} entries")
    return df.sparkSession.sparkContext.broadcast({(bytes(r["text"]) if not isinstance(r["text"], str) else r["text"].encode()): r["id"] for r in rows})


def ruled_out(dictionary: DataFrame, needle: str) -> bool:
    """Whether no text of which the dictionary was learned can hold needle: its inner units are whole units of such a
    text, so one that is short enough to be an entry and isn't rules it out."""
    inner = [x.decode() for x in _UNIT.findall(needle.encode())[1:-1] if len(x) <= MOST_BYTES]
    return bool(inner) and dictionary.where(F.col("text").isin(inner)).select("text").distinct().count() < len(set(inner))


def _encoded(df: DataFrame, column: str, cut: Callable[[object], list], kind: str, keep: list[str]) -> DataFrame:
    """df's columns of keep with __block, and in place of a row's items their places among the block's different ones
    (__cut); and a row for each block with these (__items). A block is consecutive rows of a task, about BLOCK_ITEMS items."""
    spark = df.sparkSession
    small_batches(spark)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "__block bigint", "__cut array<int>", f"__items array<{kind}>"])
    each = df.select(*keep, F.col(column).alias("__it"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, n = TaskContext.get().partitionId() << 32, 0
        places: dict = {}
        own = None

        def items() -> pa.RecordBatch:
            nonlocal block, n
            typed = pa.array([list(places)], pa.list_(pa.string() if kind == "string" else pa.int64()))
            out = pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in own), pa.array([block]), pa.nulls(1, pa.list_(pa.int32())), typed], names=names)
            places.clear()
            block, n = block + 1, 0
            return out

        names = [*keep, "__block", "__cut", "__items"]
        for b in batches:
            own = [c.type for c in b.columns[:-1]]
            cuts = []
            for v in b.column(len(keep)).to_pylist():
                cuts.append(array("i", [places.setdefault(x, len(places)) for x in cut(v)]))
                n += len(cuts[-1])
            ends = np.cumsum([0, *map(len, cuts)])
            flat = np.concatenate([np.frombuffer(c, np.int32) for c in cuts]) if len(cuts) else np.zeros(0, np.int32)
            at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([block] * len(b), pa.int64()), at, pa.nulls(len(b), pa.list_(pa.int64() if kind == "bigint" else pa.string()))], names=names)
            if n >= BLOCK_ITEMS:
                yield items()
        if places:
            yield items()
        trim()

    return saved(each.mapInArrow(run, schema), "encoded")


def _decoded(coded: DataFrame, known: DataFrame, keep: list[str], glue: Callable[[list, list, pa.ListArray], pa.Array], out: str, kind: str) -> DataFrame:
    """Rows of _encoded with what glue makes of the items and their values in known (__item, value): a block's different
    items meet known and come back to its rows, so that no item of a text travels by itself."""
    schema = ", ".join([*(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` {kind}"])
    items = coded.where(F.col("__items").isNotNull()).select("__block", F.posexplode("__items").alias("__i", "__item"))
    known = known.groupBy("__item").agg(F.max("value").alias("value"))  # one value each
    values = items.join(known, "__item", "left").select(F.col("__block").alias("__of"), "__i", "__item", "value")
    rows = coded.where(F.col("__cut").isNotNull()).select(*keep, "__block", "__cut")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        places = right.column("__i").to_numpy()
        order = np.argsort(places)
        items, found = (right.column(c).take(pa.array(order)).to_pylist() for c in ("__item", "value"))
        cuts = left.column("__cut").combine_chunks()
        done = pa.table([*(left.column(c) for c in keep), glue(items, found, cuts)], names=[*keep, out])
        trim()
        return done

    return rows.groupBy("__block").cogroup(values.groupBy("__of")).applyInArrow(run, schema)


def tokenize(df: DataFrame, text: str, dictionary: DataFrame, out: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """df, or its columns keep, with token ids: the longest dictionary entry over up to 12 units at each place, else the
    unit's bytes escaped. Only entries of several units decide where a text is cut: these are broadcast, and a dictionary
    with too many of them is refused. The others, which grow with the texts, are joined."""
    several = dictionary.where(F.size(units(F.col("text").cast("string"))) > 1)
    entries = _broadcast(df, several)
    most = max((len(_UNIT.findall(x)) for x in entries.value), default=1)

    def cut(t: str | None) -> list[str]:
        if most == 1:
            return _TEXT_UNIT.findall(t or "")
        return [x.decode() for x, _, _ in _greedy(_UNIT.findall((t or "").encode()), entries.value, most)]

    def glue(items: list, found: list, cuts: pa.ListArray) -> pa.ListArray:
        ids = [[k] if k is not None else [ESCAPE + b for b in x.encode()] for x, k in zip(items, found)]
        flat, ends = cuts.flatten().to_numpy(), cuts.offsets.to_numpy().astype(np.int64)
        size = np.array([len(x) for x in ids] or [0], np.int64)
        start = np.cumsum(size) - size
        pool = np.array([y for x in ids for y in x] or [0], np.int64)
        length = size[flat] if len(flat) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(length)])
        values = pool[np.repeat(start[flat] - total[:-1], length) + np.arange(total[-1])] if len(flat) else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(total[ends - ends[0]], pa.int32()), pa.array(values))

    names = [c for c in (df.columns if keep is None else keep) if c != out]
    coded = _encoded(df.withColumn("__t", F.col(text).cast("string")), "__t", cut, "string", names)
    return _decoded(coded, dictionary.select(F.col("text").cast("string").alias("__item"), F.col("id").alias("value")), names, glue, out, "array<bigint>")


def detokenize(df: DataFrame, key: str, tokens: str, dictionary: DataFrame) -> DataFrame:
    """(key, text as bytes): tokens put back as the dictionary's texts, in order; no tokens give no bytes."""
    def glue(items: list, found: list, cuts: pa.ListArray) -> pa.Array:
        words = [bytes([k & 255]) if k >= ESCAPE else w or b"" for k, w in zip(items, found)]
        return pa.array([b"".join([words[i] for i in c]) for c in cuts.to_pylist()], pa.binary())

    coded = _encoded(df, tokens, lambda ids: [k for k in ids or () if k is not None], "bigint", [key])
    return _decoded(coded, dictionary.select(F.col("id").alias("__item"), F.col("text").cast("binary").alias("value")), [key], glue, "text", "binary")


def absent(words: DataFrame, key: str, text: str, df: DataFrame, other: str) -> DataFrame:
    """(key, absent): how many distinct words of each text occur in no text of df; keys without such a word are left out."""
    cut = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    each = words.select(key, F.explode(cut(text)).alias("__w"))
    have = df.select(F.explode(cut(other)).alias("__w")).distinct()
    return each.join(have, "__w", "left_anti").groupBy(key).agg(F.count("*").alias("absent"))
