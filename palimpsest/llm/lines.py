"""Operator 1: line deduplication by winnowing over line hashes.

A document is its sequence of lines that aren't blank. A window is the shortest stretch of lines with `min_words` words
that starts at a line; of each window the line with the least hash is selected (the leftmost, on a tie). Any run of equal
lines with so many words in two places contains the window at its first line in both, so the places share a fingerprint:
that is guaranteed, whatever the lines of the run. Selected positions meet by fingerprint; only fingerprints selected at
two places go on. From each such position matches are extended both ways, window by window: every shortest window that
starts or ends at a line and holds the position is named by a 128-bit hash of its lines, and is a repeat if an equal one
lies earlier, in the order of (id, file, row, line). A run is the union of its windows, and each repeated window is part
of a repeated run, so the union of a document's repeated windows is its maximal repeated runs in full. They are deleted.

No pairs of places are formed: fingerprints are counted, and each window is compared with the first of its kind, both by
aggregates that combine before they shuffle, so a passage in a third of all documents stays one row a task.

Cases: null text has no lines and stays null; empty and blank lines take part in no run and stay; of repeated rows all but
the first (by id, then file and row) lose their runs; null ids come first; an empty table gives no rows; whole texts are
read, whatever their length; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import binary_column, located, numbered, saved, scanned, small_batches

MIN_WORDS = 10
#: Documents with lines to delete up to which their line numbers are broadcast, and numbers they may have together; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_LINES = 200_000, 2_000_000
#: Bytes of cleaned text in one Arrow batch.
BATCH_BYTES = 64 << 20


def lines_of(text: bytes) -> tuple[list[int], list[int], list[bytes]]:
    """Numbers, words and 128-bit hashes of the lines that aren't blank."""
    full = [(n, k, x) for n, x in enumerate(text.split(b"\n")) if (k := len(x.split()))]
    return [r[0] for r in full], [r[1] for r in full], [xxhash.xxh3_128_digest(r[2]) for r in full]


def starting(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest windows that start at each line."""
    out, j, held = [], -1, 0
    for i, k in enumerate(words):
        while held < min_words and j + 1 < len(words):
            j += 1
            held += words[j]
        if held < min_words:
            break
        out.append((i, j))
        held -= k
    return out


def ending(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest windows that end at each line."""
    last = len(words) - 1
    return [(last - j, last - i) for i, j in starting(words[::-1], min_words)]


def fingerprints(digests: list[bytes], spans: list[tuple[int, int]]) -> dict[int, int]:
    """Positions of the least hashes of the windows, with those hashes."""
    h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)[:, 0].tolist()
    return {at: h[at] for i, j in spans for at in [min(range(i, j + 1), key=h.__getitem__)]}


def describe(docs: DataFrame, min_words: int) -> DataFrame:
    """Per document with a window: fkey and row (its place), id, at and words (int32 of its lines), digests, and prints."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["fkey", "row", "id", "at", "words", "digests", "prints"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, rows = [], []
            for i, text in enumerate(binary_column(b, "text")):
                at, words, digests = lines_of(text)
                if spans := starting(words, min_words):
                    index.append(i)
                    rows.append((np.array(at, "<i4").tobytes(), np.array(words, "<i4").tobytes(), b"".join(digests), list(fingerprints(digests, spans).values())))
            same = [b.column(c).take(pa.array(index, pa.int64())) for c in range(3)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    return docs.select("fkey", "row", "id", "text").mapInArrow(run, f"fkey bigint, row bigint, id {kind}, at binary, words binary, digests binary, prints array<bigint>")


def extended(found: DataFrame, min_words: int) -> DataFrame:
    """One row per window that holds a position whose fingerprint is among the document's met ones: fkey, row, id, lines, key."""
    kind = found.schema["id"].dataType.simpleString()
    names = ["fkey", "row", "id", "lines", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, lines, keys = [], [], []
            for n, (at, words, digests, met) in enumerate(zip(*(b.column(i).to_pylist() for i in range(3, 7)))):
                at, words, met = np.frombuffer(at, "<i4").tolist(), np.frombuffer(words, "<i4").tolist(), set(met)
                spans = starting(words, min_words)
                cut = [digests[16 * i : 16 * i + 16] for i in range(len(at))]
                held = np.zeros(len(at) + 1, np.int64)
                held[[p + 1 for p, h in fingerprints(cut, spans).items() if h in met]] = 1
                held = np.cumsum(held).tolist()
                for i, j in sorted({*spans, *ending(words, min_words)}):
                    if held[j + 1] > held[i]:
                        index.append(n)
                        lines.append(at[i : j + 1])
                        keys.append(xxhash.xxh3_128_digest(digests[16 * i : 16 * j + 16]))
            same = [b.column(c).take(pa.array(index, pa.int64())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(lines, pa.list_(pa.int32())), pa.array(keys, pa.binary())], names=names)

    return found.mapInArrow(run, f"fkey bigint, row bigint, id {kind}, lines array<int>, key binary")


def repeated_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(fkey, row, gone): the 0-based numbers of the lines to delete, per document of docs (fkey, row, id, text) that has any."""
    known = saved(describe(docs, min_words), "lines")
    prints = known.select("fkey", "row", F.explode("prints").alias("fp"))
    twice = prints.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    met = prints.join(twice, "fp").groupBy("fkey", "row").agg(F.collect_set("fp").alias("met"))
    found = known.drop("prints").join(met, ["fkey", "row"]).select("fkey", "row", "id", "at", "words", "digests", "met")
    windows = saved(extended(found, min_words), "windows")
    place = F.struct("id", "fkey", "row", F.col("lines")[0].alias("line"))
    first = windows.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("key", "first")
    again = windows.join(first, "key").where(place > F.col("first"))
    return again.select("fkey", "row", F.explode("lines").alias("line")).groupBy("fkey", "row").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, report: tuple[str, str, str] = ("__lines", "__gone", "__words")) -> DataFrame:
    """docs with text_col cleaned, and columns named by report: the lines it had, the numbers of those deleted, and their
    words. A column of docs of one of these names is replaced."""
    spark, names = docs.sparkSession, docs.columns
    small_batches(spark)
    docs = located(numbered(scanned(docs)))
    text, ident = f"c{names.index(text_col)}", f"c{names.index(id_col)}"
    docs = docs.withColumns({"fkey": F.xxhash64("__loc.file"), "row": F.col("__loc.row")}).drop("__loc")
    gone = saved(repeated_lines(docs.select("fkey", "row", F.col(ident).alias("id"), F.col(text).alias("text")), min_words), "gone")
    rows, lines = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and lines <= BROADCAST_LINES
    joined = docs.join(F.broadcast(gone) if small else gone, ["fkey", "row"], "left").drop("fkey", "row")
    fields = joined.schema.fields[:-1]
    at = [f.name for f in fields].index(text)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString() if i != at else 'string'}" for i, f in enumerate(fields)), "n int, gone array<int>, words int"])
    out_names = [*(f.name for f in fields), "n", "gone", "words"]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            null = b.column(at).is_null().to_pylist()
            out: list[list] = [[], [], [], []]
            begun = held = 0

            def flush(end: int) -> pa.RecordBatch:
                same = list(b.slice(begun, end - begun).columns[: len(fields)])  # noqa: B023
                same[at] = pa.array(out[0], pa.string())  # noqa: B023
                kinds = [pa.int32(), pa.list_(pa.int32()), pa.int32()]
                return pa.RecordBatch.from_arrays([*same, *(pa.array(o, k) for o, k in zip(out[1:], kinds))], names=out_names)  # noqa: B023

            for i, (empty, text, lost) in enumerate(zip(null, binary_column(b, b.schema.names[at]), b.column(len(fields)).to_pylist())):
                lost = lost or []
                n = 0 if empty else text.count(b"\n") + 1
                words = 0
                if lost:
                    own, drop = text.split(b"\n"), set(lost)
                    words = sum(len(own[n].split()) for n in lost)
                    text = b"\n".join([x for n, x in enumerate(own) if n not in drop])
                if held + len(text) > BATCH_BYTES and out[0]:
                    yield flush(i)
                    out, begun, held = [[], [], [], []], i, 0
                held += len(text)
                for o, v in zip(out, (None if empty else text.decode("utf-8", "replace"), n, lost, words)):
                    o.append(v)
            if out[0]:
                yield flush(b.num_rows)

    cleaned = joined.mapInArrow(clean, schema)
    keep = [F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in report]
    return cleaned.select(*keep, *(F.col(c).alias(name) for c, name in zip(("n", "gone", "words"), report)))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return d.select("doc_id", F.col("__lines").cast("bigint").alias("n_lines"), F.size("__gone").cast("bigint").alias("n_removed"), F.col("__words").cast("bigint").alias("removed_words"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


_WORDS = r"len(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'))"
OP1_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents
), f AS (
  SELECT doc_id, p, line, {_WORDS.format("line")} AS k, row_number() OVER w AS q, sum({_WORDS.format("line")}) OVER w AS c
  FROM l WHERE regexp_matches(line, '[^\\x20\\x09\\x0B-\\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), s AS (
  SELECT doc_id, i, j FROM (SELECT a.doc_id, a.q AS i, min(b.q) AS j FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.q BETWEEN a.q AND a.q + {MIN_WORDS} - 1 AND b.c - a.c + a.k >= {MIN_WORDS} GROUP BY ALL)
  UNION SELECT doc_id, i, j FROM (SELECT b.doc_id, max(a.q) AS i, b.q AS j FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.q BETWEEN b.q - {MIN_WORDS} + 1 AND b.q AND b.c - a.c + a.k >= {MIN_WORDS} GROUP BY ALL)
), wins AS (
  SELECT s.doc_id, i, list(p ORDER BY q) AS ps, string_agg(line, chr(10) ORDER BY q) AS t FROM s JOIN f ON f.doc_id = s.doc_id AND q BETWEEN i AND j GROUP BY s.doc_id, i, j
), gone AS (
  SELECT DISTINCT doc_id, unnest(ps) AS p FROM (SELECT *, rank() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1
)
SELECT d.doc_id, count(l.p) AS n_lines, count(g.p) AS n_removed, coalesce(sum(CASE WHEN g.p IS NOT NULL THEN {_WORDS.format("l.line")} END), 0)::BIGINT AS removed_words,
       sha256(coalesce(string_agg(CASE WHEN g.p IS NULL THEN l.line END, chr(10) ORDER BY l.p), '')) AS clean_sha256
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p GROUP BY d.doc_id
"""
