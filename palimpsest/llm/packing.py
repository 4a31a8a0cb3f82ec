"""Operator 10: hierarchical multi-length packing.

Each scan task packs its own documents, so nothing is shuffled. A document's ids first fill whole windows of the
longest tier; its remainder is routed to the smallest tier (context size, a power of two) that holds it. Tiers are
packed from the longest: each piece opens a window of its tier, and the gap is filled best-fit from shorter tiers, at
the end by cutting a piece where the window ends. Pieces that no window can hold full wait for the next pool; at a
task's end they fill ever smaller tiers, so at most one sequence per task is padded. The sequences of a pool are spread
over step groups of equal tokens and near-equal attention cost, largest first.

Memory is bounded by POOL tokens and the longest document. Cases: null text is empty (it is just the end id); repeated
rows are packed each; null ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import binary_column, lean, small_batches
from palimpsest.llm.tokens import encoder, proof

TIERS = (4096, 2048, 1024, 512, 256, 128)
END_ID = 2
#: Tokens packed together.
POOL = 1 << 22
#: Tokens of a step group.
STEP = 1 << 16


@dataclass(slots=True)
class Piece:
    doc: object
    start: int
    ids: memoryview
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.doc_tokens), Piece(self.doc, self.start + n, self.ids[4 * n :], self.doc_tokens)


class Shelf:
    """Pieces by length; a bit mask of the lengths present answers best-fit questions."""

    def __init__(self, pieces: list[Piece]):
        self.by: dict[int, list[Piece]] = {}
        self.mask = 0
        for p in reversed(pieces):
            self.add(p)

    def add(self, p: Piece) -> None:
        self.by.setdefault(len(p), []).append(p)
        self.mask |= 1 << len(p)

    def take(self, n: int) -> Piece:
        p = self.by[n].pop()
        if not self.by[n]:
            self.mask ^= 1 << n
        return p

    def longest(self, most: int) -> int:
        """The greatest length up to most, or 0."""
        return max((self.mask & ((2 << most) - 1)).bit_length() - 1, 0)

    def shortest(self, over: int) -> int:
        """The least length above over, or 0."""
        m = self.mask >> (over + 1)
        return (m & -m).bit_length() + over if m else 0


def pack_pool(pieces: list[Piece], tiers: tuple[int, ...], last: bool) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Sequences (window, pieces) and the pieces left for the next pool (none if last)."""
    sequences: list[tuple[int, list[Piece]]] = []
    rest: list[Piece] = []
    for p in pieces:
        while len(p) >= tiers[0]:
            whole, p = p.cut(tiers[0])
            sequences.append((tiers[0], [whole]))
        if len(p):
            rest.append(p)
    shelf, left = Shelf(rest), []
    for k, window in enumerate(tiers):
        floor = tiers[k + 1] if k + 1 < len(tiers) else 0
        while (n := shelf.longest(window)) > floor:
            used, gap = [shelf.take(n)], window - n
            while gap:
                if n := shelf.longest(gap):
                    used.append(shelf.take(n))
                    gap -= n
                elif n := shelf.shortest(gap):
                    head, tail = shelf.take(n).cut(gap)
                    used.append(head)
                    shelf.add(tail)
                    gap = 0
                else:
                    break
            if gap:
                left += used
            else:
                sequences.append((window, used))
    if not last:
        return sequences, left
    for k, window in enumerate(tiers):
        while (total := sum(map(len, left))) >= window or (total and window == tiers[-1]):
            used, gap = [], window
            while gap and left:
                if len(left[0]) > gap:
                    head, left[0] = left[0].cut(gap)
                else:
                    head = left.pop(0)
                used.append(head)
                gap -= len(head)
            sequences.append((window if not gap else tiers[0], used))
    return sequences, []


def step_groups(sequences: list[tuple[int, list[Piece]]], step: int) -> list[int]:
    """A group per sequence: as many groups as steps of tokens, the fullest and costliest sequences placed first."""
    tokens = [sum(map(len, s)) for _, s in sequences]
    cost = [sum(len(p) ** 2 for p in s) for _, s in sequences]
    heap = [(0, 0, g) for g in range(max(1, round(sum(tokens) / step)))]
    out = [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: (-sequences[i][0], -cost[i], i)):
        t, c, g = heap[0]
        out[i] = g
        heapq.heapreplace(heap, (t + tokens[i], c + cost[i], g))
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, pool: int = POOL, step: int = STEP, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_id (and ids)."""
    small_batches(docs.sparkSession)
    known = proof(docs.sparkSession, tokenizer)
    end = end_id.to_bytes(4, "little")
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_id", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(tokenizer, known.value), TaskContext.get().partitionId() << 40
        waiting: list[Piece] = []
        held = seq = groups = 0
        id_type = None

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal waiting, held, seq, groups
            sequences, waiting = pack_pool(waiting, tiers, last)
            held = sum(map(len, waiting))
            rows = []
            for (window, pieces), g in zip(sequences, step_groups(sequences, step)):
                at = 0
                for p in pieces:
                    rows.append((p.doc, p.start, len(p), crc32(p.ids), p.doc_tokens, base + seq, at, window, base + groups + g, bytes(p.ids)))
                    at += len(p)
                seq += 1
            groups += max(1, len(sequences))
            if rows:
                cols = list(zip(*rows))
                arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:9]), *[pa.array(cols[9], pa.binary())] * with_ids]
                return pa.RecordBatch.from_arrays(arrays, names=names)
            return None

        for b in batches:
            id_type = b.column(0).type
            for doc, text in zip(b.column(0).to_pylist(), binary_column(b, "__text")):
                ids = enc.encode(text) + end
                waiting.append(Piece(doc, 0, memoryview(ids), len(ids) // 4))
                held += len(ids) // 4
                if held >= pool and (out := flush(False)):
                    yield out
        if id_type is not None and (out := flush(True)):
            yield out

    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, window bigint, step_id bigint" + ", ids binary" * with_ids
    return docs.select(docs[id_col].alias(id_col), docs[text_col].alias("__text")).mapInArrow(lean(run), schema)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
