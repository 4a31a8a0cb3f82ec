"""Operator 9: token-id and binary output with best-fit-decreasing packing.

Texts become token ids; documents longer than a row are split losslessly into row-sized pieces. Each scan task packs
its own pieces, longest first, each into the row with the least remaining capacity that holds it; a segment tree over
capacities finds that row in log(row length) steps. A packed row is an id vector padded to the row length, the cumulative
lengths of its segments, and position ids that start anew with each segment. Nothing is shuffled.

Memory is bounded by POOL tokens and the longest document. Cases: null text is empty, and a document without ids still
has one piece of length 0, in the row open at that time; repeated rows are packed each; null ids are kept; an empty
table gives no rows and no files; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import binary_column, saved, scratch_dir, small_batches
from palimpsest.llm.tokens import encoder, load, proof

ROW = 2048
POOL = 1 << 21
PAD_ID = 0


class CapacityTree:
    """Open rows by remaining capacity, in a segment tree of counts over 0..size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        i = self.leaves + capacity
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A row of the smallest capacity >= least, removed, with that capacity."""
        i = self.leaves + least
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._change(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of item numbers, each row's lengths within size."""
    tree, rows = CapacityTree(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = tree.take(lengths[i])
        if got is None:
            got = size, len(rows)
            rows.append([])
        rows[got[1]].append(i)
        tree.add(got[0] - lengths[i], got[1])
    return rows


def pack_rows(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", row: int = ROW, pool: int = POOL, pad_id: int = PAD_ID) -> DataFrame:
    """One row per packed row: sequence_id, ids (row little-endian unsigned 32-bit ids), cu_seqlens (from 0 to the used
    length), positions (as ids, 0 from each segment's start, also in the padding), and per segment docs, starts, doc_tokens."""
    small_batches(docs.sparkSession)
    known = proof(docs.sparkSession, tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"sequence_id bigint, ids binary, cu_seqlens array<int>, positions binary, docs array<{kind}>, starts array<bigint>, doc_tokens array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base, made = encoder(tokenizer, known.value), TaskContext.get().partitionId() << 40, 0
        pieces: list[tuple[object, int, memoryview, int]] = []
        held, id_type = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            packed = best_fit_decreasing([len(p[2]) // 4 for p in pieces], row)
            for at in range(0, len(packed), 512):
                cols: list[list] = [[] for _ in range(7)]
                for items in packed[at : at + 512]:
                    own = [pieces[i] for i in items]
                    ids, pos, cu = np.full(row, pad_id, "<u4"), np.zeros(row, "<u4"), [0]
                    for p in own:
                        n = len(p[2]) // 4
                        ids[cu[-1] : cu[-1] + n] = np.frombuffer(p[2], "<u4")
                        pos[cu[-1] : cu[-1] + n] = np.arange(n)
                        cu.append(cu[-1] + n)
                    pos[cu[-1] :] = np.arange(row - cu[-1])
                    for c, v in zip(cols, (base + made, ids.tobytes(), cu, pos.tobytes(), [p[0] for p in own], [p[1] for p in own], [p[3] for p in own])):
                        c.append(v)
                    made += 1
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["sequence_id", "ids", "cu_seqlens", "positions", "docs", "starts", "doc_tokens"])
            pieces.clear()
            held = 0

        for b in batches:
            id_type = b.column(0).type
            for doc, text in zip(b.column(0).to_pylist(), binary_column(b, "__text")):
                ids = memoryview(enc.encode(text))
                n = len(ids) // 4
                for start in range(0, max(n, 1), row):
                    pieces.append((doc, start, ids[4 * start : 4 * (start + row)], n))
                held += n
                if held >= pool:
                    yield from flush()
        if pieces:
            yield from flush()

    return docs.select(docs[id_col].alias(id_col), docs[text_col].alias("__text")).mapInArrow(run, schema)


def segments(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per segment, read back from packed rows: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, resets.

    resets tells whether the position ids count up from 0 over the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for seq, ids, cu, positions, docs, starts, totals in zip(*(b.column(i).to_pylist() for i in range(7))):
                pos = np.frombuffer(positions, "<u4")
                for k, doc in enumerate(docs):
                    a, e = cu[k], cu[k + 1]
                    row = (doc, starts[k], e - a, crc32(ids[4 * a : 4 * e]), totals[k], seq, a, bool((pos[a:e] == np.arange(e - a)).all()))
                    for c, v in zip(cols, row):
                        c.append(v)
            kinds = [b.column(4).type.value_type, *[pa.int64()] * 6, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "resets"])

    kind = packed.schema["docs"].dataType.elementType.simpleString()
    return packed.mapInArrow(run, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, resets boolean")


def table_schema(b: pa.RecordBatch) -> pa.Schema:
    """Of the columns that name a row's segments: sequence_id, docs, starts, doc_tokens."""
    return pa.schema([b.schema.field(i) for i in (0, 4, 5, 6)])


def write_binary(packed: DataFrame, folder: str, row: int = ROW, id_bytes: int = 4) -> DataFrame:
    """Writes each task's rows as ids-N.uW, a matrix of rows x row ids of id_bytes (2 or 4) bytes each, resets-N.bits, a
    bit per id that tells where the position ids start anew (each row takes whole bytes), cu_seqlens-N.i32 with its row
    offsets row_starts-N.i64, the segments' documents in segments-N.arrow, and meta-N.json. Files are written under a temporary name and renamed, so a repeated task
    leaves whole files. folder is a path or URI every executor can write. Returns (part, rows, tokens) per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        target, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        target.create_dir(path, recursive=True)
        ctx = TaskContext.get()
        part, suffix = ctx.partitionId(), f".tmp-{ctx.taskAttemptId()}"
        names = [f"ids-{part}.u{8 * id_bytes}", f"resets-{part}.bits", f"cu_seqlens-{part}.i32", f"row_starts-{part}.i64", f"segments-{part}.arrow"]
        rows = tokens = cut = 0
        out, table = None, None
        for b in batches:
            if b.num_rows and out is None:
                out = [target.open_output_stream(f"{path}/{n}{suffix}") for n in names]
                table = pa.ipc.new_stream(out[4], table_schema(b))
            for ids, cu, positions in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                out[0].write(np.frombuffer(ids, "<u4").astype(f"<u{id_bytes}", copy=False).tobytes())
                out[1].write(np.packbits(np.frombuffer(positions, "<u4") == 0).tobytes())
                out[2].write(np.array(cu, "<i4").tobytes())
                out[3].write(np.array([cut], "<i8").tobytes())
                rows, tokens, cut = rows + 1, tokens + cu[-1], cut + len(cu)
            if b.num_rows:
                table.write_batch(pa.RecordBatch.from_arrays([b.column(i) for i in (0, 4, 5, 6)], schema=table_schema(b)))
        if out is not None:
            out[3].write(np.array([cut], "<i8").tobytes())
            table.close()
            for f, n in zip(out, names):
                f.close()
                target.move(f"{path}/{n}{suffix}", f"{path}/{n}")
            with target.open_output_stream(f"{path}/meta-{part}.json") as f:
                f.write(json.dumps({"rows": rows, "row": row, "id_bytes": id_bytes, "tokens": tokens}).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, rows, tokens)], names=["part", "rows", "tokens"])

    return packed.mapInArrow(run, "part bigint, rows bigint, tokens bigint")


def positions_of(reset: np.ndarray) -> bytes:
    """Position ids from the bits that tell where they start anew."""
    at = np.arange(len(reset))
    return (at - np.maximum.accumulate(np.where(reset, at, 0))).astype("<u4").tobytes()


def read_binary(written: DataFrame, folder: str, like: DataFrame, row: int = ROW, id_bytes: int = 4) -> DataFrame:
    """Packed rows, as pack_rows made them (like has their schema), from the files that write_binary wrote for each part of written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        target, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for b in batches:
            for part in b.column(0).to_pylist():
                ids, resets, cuts, starts, table = (target.open_input_file(f"{path}/{n}") for n in (f"ids-{part}.u{8 * id_bytes}", f"resets-{part}.bits", f"cu_seqlens-{part}.i32", f"row_starts-{part}.i64", f"segments-{part}.arrow"))
                begun = int(np.frombuffer(starts.read(8), "<i8")[0])
                for own in pa.ipc.open_stream(table):
                    ends = np.frombuffer(starts.read(8 * own.num_rows), "<i8")
                    cu = np.frombuffer(cuts.read(4 * int(ends[-1] - begun)), "<i4")
                    at = np.concatenate([[begun], ends]) - begun
                    begun = int(ends[-1])
                    rows = [np.frombuffer(ids.read(id_bytes * row), f"<u{id_bytes}").astype("<u4").tobytes() for _ in range(own.num_rows)]
                    places = [positions_of(np.unpackbits(np.frombuffer(resets.read((row + 7) // 8), np.uint8), count=row)) for _ in range(own.num_rows)]
                    cols = [own.column(0), pa.array(rows, pa.binary()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(cu, pa.int32())), pa.array(places, pa.binary()), *own.columns[1:]]
                    yield pa.RecordBatch.from_arrays(cols, names=["sequence_id", "ids", "cu_seqlens", "positions", "docs", "starts", "doc_tokens"])

    return written.select("part").mapInArrow(run, like.schema)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments read back from the files that were written."""
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = pack_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    folder, width = f"{scratch_dir(spark)}/files", 2 if load(path).get_vocab_size() <= 65536 else 4
    written = saved(write_binary(packed, folder, id_bytes=width), "written")
    return segments(read_binary(written.repartition(max(1, written.count())), folder, packed, id_bytes=width))
