"""Operator 8: language identification by multinomial naive Bayes over hashed character n-grams.

Training is one distributed pass: each task adds up bucket counts per label (a bounded matrix), Spark sums them, and
the log-probability matrix of labels x BUCKETS float32 goes to the executors as a broadcast. MAX_LABELS bounds it; more
labels raise an error. Scoring hashes the n-grams of whole texts in numpy and adds matrix columns per document.

Cases: null text, empty text or text without a letter predicts "und" with score 0; rows with null label don't train;
without any training row everything is "und"; repeated rows each give a row; ties go to the first label by code point.
Long texts are hashed in blocks, so memory stays bounded. lang, source and id never enter a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import binary_column, fold, lean, numbered, small_batches

BUCKETS = 1 << 15
MAX_LABELS = 512
#: Code points hashed at once.
BLOCK = 1 << 18
#: N-grams gathered before they are counted or scored at once.
POOL = 1 << 20
ORDERS = (1, 2, 3)


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all character n-grams of the lower-cased text, in blocks."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    longest = max(ORDERS)
    for at in range(0, len(points), BLOCK):
        p = points[at : at + BLOCK + longest - 1]
        h = np.zeros(len(p), np.uint32)
        for n in range(1, longest + 1):
            if len(p) < n:
                break
            h = h[: len(p) - n + 1] * np.uint32(0x01000193) + p[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
            if n in ORDERS and len(h):
                yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(17))[:BLOCK]


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode category L); digits, numerals and marks aren't."""
    return any(map(str.isalpha, text))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels by code point, log priors and the log-probability matrix (BUCKETS x labels)."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(labelled[label_col].isNotNull()).select(labelled[label_col].cast("string").alias("__label"), labelled[text_col].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        pool: dict[str, list[np.ndarray]] = {}
        waiting = 0

        def add() -> None:
            for label, xs in pool.items():
                if xs:
                    sums[label] += np.bincount(np.concatenate(xs), minlength=BUCKETS)
                    xs.clear()

        for b in batches:
            for label, raw in zip(b.column(0).to_pylist(), binary_column(b, "__text")):
                text = raw.decode("utf-8", "replace")
                if not has_letter(text):
                    continue
                if label not in sums:
                    if len(sums) >= MAX_LABELS:
                        raise ValueError(f"more than {MAX_LABELS} labels")
                    sums[label], n[label], pool[label] = np.zeros(BUCKETS, np.int64), 0, []
                n[label] += 1
                for x in ngram_buckets(text):
                    pool[label].append(x)
                    waiting += len(x)
                if waiting > POOL:
                    add()
                    waiting = 0
        add()
        for label, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([label] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(s[at], n[label]))], names=["label", "bucket", "n"])

    # One row per label with its counts: at most MAX_LABELS x BUCKETS numbers reach the driver.
    summed = rows.mapInArrow(lean(run), "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).cache()
    try:
        if summed.where("bucket = -1").limit(MAX_LABELS + 1).count() > MAX_LABELS:
            raise ValueError(f"more than {MAX_LABELS} labels")
        table = summed.toArrow()
    finally:
        summed.unpersist()
    labels = sorted(set(table["label"].to_pylist()))
    counts, docs = np.zeros((BUCKETS, len(labels))), np.zeros(len(labels))
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    of = np.array([labels.index(x) for x in table["label"].to_pylist()], np.int64)
    docs[of[bucket < 0]] = n[bucket < 0]
    counts[bucket[bucket >= 0], of[bucket >= 0]] = n[bucket >= 0]
    logp = np.log(counts + 1) - np.log(counts.sum(0) + BUCKETS)
    return labels, np.log(np.maximum(docs, 1) / max(docs.sum(), 1)), logp.astype(np.float32)


def scored(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """The columns of docs as c0, c1, ..., then lang_pred and score (the posterior, 0 to 1)."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    text_at = f"c{docs.columns.index(text_col)}"
    docs = numbered(docs)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, prior, logp = known.value
        columns = [np.ascontiguousarray(c, np.float64) for c in logp.T]
        for b in batches:
            totals: list[np.ndarray | None] = []
            pool: list[np.ndarray] = []
            owner: list[int] = []
            waiting = 0

            def score() -> None:
                """Adds the pooled blocks' log probabilities to their documents."""
                x, at = np.concatenate(pool), np.cumsum([0, *map(len, pool[:-1])])
                part = np.stack([np.add.reduceat(c[x], at) for c in columns], 1)
                for row, one in zip(owner, part):
                    totals[row] += one
                pool.clear()
                owner.clear()

            for raw in binary_column(b, text_at):
                text = raw.decode("utf-8", "replace")
                if not labels or not has_letter(text):
                    totals.append(None)
                    continue
                totals.append(prior.copy())
                for x in ngram_buckets(text):
                    pool.append(x)
                    owner.append(len(totals) - 1)
                    waiting += len(x)
                if waiting > POOL:
                    score()
                    waiting = 0
            if pool:
                score()
            best = [None if t is None else int(t.argmax()) for t in totals]
            langs = ["und" if k is None else labels[k] for k in best]
            scores = [0.0 if t is None else float(1 / np.exp(t - t[k]).sum()) for t, k in zip(totals, best)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(lean(run), f"{schema}, lang_pred string, score double")


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score instead of text_col; columns of those names are replaced."""
    keep = [(i, c) for i, c in enumerate(docs.columns) if c not in (text_col, "lang_pred", "score")]
    return scored(docs, model, text_col).select(*[F.col(f"c{i}").alias(c) for i, c in keep], "lang_pred", "score")


def identify(docs: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Learns from rows outside the held-out fold, predicts all: id_col, held_out, lang_pred, score."""
    out = fold(id_col, folds) == held
    model = fit(docs.where(~out), text_col, label_col)
    rows = docs.select(docs[id_col], out.alias("held_out"), docs[text_col].alias("__raw"))
    return predict(rows, model, "__raw")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
