"""Cutting byte objects into chunks, content addressing, manifests, dedup statistics and sync payloads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import glued


def _gear() -> np.ndarray:
    """256 mixing words from the SplitMix64 generator."""
    state, out = np.uint64(0x9E3779B97F4A7C15), []
    for _ in range(256):
        state = np.uint64((int(state) + 0x9E3779B97F4A7C15) % 2**64)
        z = int(state)
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


GEAR = _gear()


def cuts(data: bytes, average: int = 4096) -> list[int]:
    """Ends of content-defined chunks: after the least size a rolling sum of gear words starts at 0, each byte shifting it
    left once, and the chunk ends where its low bits are 0. Only the last few bytes matter to those bits, so the sums of
    whole windows are computed for all positions at once, and the few after a start one by one."""
    average = max(average, 64)
    bits = max(1, (average - 1).bit_length())
    low, high, mask = average // 4, average * 4, (1 << bits) - 1
    if not data:
        return []
    g = GEAR[np.frombuffer(data, np.uint8)] & np.uint64(mask)
    h = np.zeros(len(g), np.uint64)
    for k in range(min(bits, len(g))):
        h[k:] += g[: len(g) - k] << np.uint64(k)
    hits = np.flatnonzero((h & np.uint64(mask)) == 0)
    out, at = [], 0
    while at < len(data):
        first, limit = at + low, min(at + high, len(data))
        end = limit if first < len(data) else len(data)
        total, whole = 0, min(first + bits - 1, limit)
        for i in range(first, whole):
            total = (2 * total + int(g[i])) & mask
            if not total:
                end = i + 1
                break
        else:
            i = int(np.searchsorted(hits, whole))
            if first < len(data) and i < len(hits) and hits[i] < limit:
                end = int(hits[i]) + 1
        out.append(end)
        at = end
    return out


def chunks(objects: DataFrame, name: str, payload: str, average: int = 4096, fixed: bool = False) -> DataFrame:
    """(name, seq, start, nbytes, cid, payload) of each object; cid is the SHA-256 of the bytes."""
    kind = objects.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, seqs, starts, parts = [], [], [], []
            for n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = data or b""
                ends = [*range(average, len(data), average), *([len(data)] if data else [])] if fixed else cuts(data, average)
                for seq, (a, e) in enumerate(zip([0, *ends], ends)):
                    names.append(n)
                    seqs.append(seq)
                    starts.append(a)
                    parts.append(data[a:e])
            yield pa.RecordBatch.from_arrays([pa.array(names, b.column(0).type), pa.array(seqs, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())], names=[name, "seq", "start", "payload"])

    cut = objects.select(name, F.col(payload).cast("binary").alias("__p")).mapInArrow(run, f"`{name}` {kind}, seq bigint, start bigint, payload binary")
    return cut.select(name, "seq", "start", F.octet_length("payload").cast("bigint").alias("nbytes"), F.unhex(F.sha2("payload", 256)).alias("cid"), "payload")


def fixed_chunks(df: DataFrame, name: str, text: str, size: int) -> DataFrame:
    """Fixed cuts of a text column's bytes as plain expressions."""
    raw = F.col(text).cast("binary")
    each = df.where(F.octet_length(text) > 0).select(name, raw.alias("raw"), F.explode(F.sequence(F.lit(0), F.floor((F.octet_length(text) - 1) / size).cast("int"))).alias("seq"))
    part = F.substr("raw", F.col("seq") * size + 1, F.lit(size))
    return each.select(name, F.col("seq").cast("bigint").alias("seq"), (F.col("seq") * F.lit(size)).cast("bigint").alias("start"), part.alias("payload")).withColumns({"nbytes": F.octet_length("payload").cast("bigint"), "cid": F.sha2("payload", 256)})


def statistics(ch: DataFrame) -> DataFrame:
    """Chunks seen, created and deduplicated, and the bytes held."""
    per = ch.groupBy("cid").agg(F.count("*").alias("n"), F.min("nbytes").alias("b"))
    return per.agg(F.sum("n").alias("seen"), F.count("*").alias("created"), (F.sum("n") - F.count("*")).alias("deduped"), F.sum("b").alias("bytes_resident"))


def manifest(ch: DataFrame) -> DataFrame:
    """Unique chunk ids."""
    return ch.select("cid").distinct()


def lacking(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Chunk ids of one manifest that another lacks."""
    return wanted.select("cid").distinct().join(have.select("cid"), "cid", "left_anti")


def payload(ch: DataFrame, have: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a receiver needs: the missing chunks once each, and all extents."""
    missing = ch.join(have.select("cid"), "cid", "left_anti").groupBy("cid").agg(F.any_value("payload").alias("payload"))
    return missing, ch.drop("payload")


def payload_size(ch: DataFrame, have: DataFrame, extent_bytes: int = 16) -> DataFrame:
    missing = ch.select("cid", "nbytes").join(have.select("cid"), "cid", "left_anti").groupBy("cid").agg(F.min("nbytes").alias("b"))
    return missing.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("b"), F.lit(0)).alias("chunk_bytes")).join(ch.agg((F.count("*") * extent_bytes).alias("extent_bytes")))


def apply_payload(store: DataFrame, missing: DataFrame, extents: DataFrame, name: str) -> DataFrame:
    """Objects rebuilt from the receiver's chunks and the payload."""
    known = store.select("cid", "payload").unionByName(missing.select("cid", "payload")).dropDuplicates(["cid"])
    parts = extents.join(known, "cid").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("p"))
    return parts.select(name, glued("p", "payload").alias("payload"))


def verify(ch: DataFrame) -> DataFrame:
    """Chunks whose bytes don't match their id."""
    own = F.sha2("payload", 256)
    is_hex = dict(ch.dtypes)["cid"] == "string"
    return ch.where((own if is_hex else F.unhex(own)) != F.col("cid")).agg(F.count("*").alias("bad"))


def orphans(store: DataFrame, extents: DataFrame) -> DataFrame:
    """Chunks no extent refers to."""
    return store.select("cid").distinct().join(extents.select("cid"), "cid", "left_anti")
