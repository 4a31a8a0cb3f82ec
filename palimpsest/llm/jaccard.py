"""Operator 5: n-gram Jaccard join by a universe-partition pigeonhole.

A document is the set of its distinct k-word shingles, hashed to 64 bits. Two sets of sizes x and y with Jaccard >= t
differ in at most H = (1 - t) / (1 + t) * (x + y) shingles. For each band of x + y the hash universe is cut into M > H
segments, so a linked pair agrees on one of the first H + 1 segments that either side indexes. The index holds one
signature per segment, and segments are allocated by cost:

* segments are ordered by their infrequent shingles, most first (a bounded list of frequent ones is made in the first
  pass), and a set indexes its first H + 1; the order depends on the segment's content alone, so of a pair's equal
  segments the first lies within both prefixes, and segments that match many unrelated sets come last;
* empty segments are never indexed; sets left with fewer than H + 1 enter a second index of the same segments with
  their one-deletion neighbourhoods, where a segment counts two (one, if it holds one shingle only);
* sets that still lack credit enter indexes of growing M, the last with one segment per shingle.

A pair is guaranteed where one side has the credit; where both lack it, both enter the next index. So nothing is lost.
Segments of one shingle have no one-deletion neighbour: it would be empty and the same for all sets.

Families of near copies grow with the table, and the index would meet each of their pairs at many signatures. So each set
has FAMILY_KEYS keys of two min-hashes, and a key of FAMILY sets or more makes a family. A pair that shares a family isn't
emitted by the index; it belongs to the first family it shares, whose sets meet whole in one task, or in a grid of tasks
for blocks of them, and are all compared by products of shingle incidences. No such pair travels before it is a link.
Signatures travel as packed bytes of signature, predecessor, set, size class and the set's least signature. A pair of
unequal size is never emitted; one whose least signatures are equal is emitted there only, any other at the start of each
run of consecutive segments that it matches on. Holders of a signature that many sets share
leave their task as pairs of blocks, which other tasks expand. Identical sets are one node, and copies never meet in
pairs. Candidates are filtered by parity bitmaps (one or two bits a shingle; the number of unequal bits never exceeds
that of differing shingles) and verified by intersecting the whole sets, which are shipped once per bucket of a shared
minimum hash; a bucket of more than SET_BYTES is split into a grid of tasks.

Exact up to collisions of 64-bit shingle hashes, and of 32-bit predecessors and least signatures once in 2^32 pairs. Sets that share the 40
bits of a node that travel are candidates of each other; nodes that collide on their whole id are found and the seed is changed.

Cases: null, empty and blank texts have no shingles, n_similar 0 and are their own component; repeated rows count as
other documents; null ids group as copies but never become a component id unless alone; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import binary_column, components, lean, lean_group, release, saved, shuffle_partitions, small_batches
from palimpsest.llm.hashing import U, mix, shingle_set

#: Frequent shingles: at least so many distinct sets of one task's pool, summed; and at most so many shingles, broadcast as 8 bytes each.
HOT_COUNT, HOT_MOST, HOT_POOL, HOT_LOCAL = 20, 300_000, 3_000_000, 4
BAND, FIRST_BAND, SPARE = 1.6, 8, 1.4
#: Bytes of a packed record: signature 6, predecessor 4, node 5, size class 1, least signature 4.
RECORD, FLUSH, PART_BYTES, SET_BYTES = 20, 400_000, 24 << 20, 8 << 20
#: Sizes of one class differ by less than this factor; class 255 holds all larger ones.
CLASS = 1.05
#: Holders of one signature up to which their task pairs them; more are cut into blocks of half as many.
HOLDERS = 2048
#: Pairs of one bucket that one task filters, and that one verifies.
CELL_PAIRS, VERIFY_PAIRS = 1_000_000, 100_000
#: A family has so many sets at least; each set has so many keys. A task compares two blocks of at most so many sets and shingles, about.
FAMILY, FAMILY_KEYS, BLOCK_SETS, BLOCK_SHINGLES = 64, 6, 2048, 1 << 20
#: Shingles that at least one in so many pairs of a cell share are multiplied, so many at once; the others' pairs are listed, so many at once.
COMMON, COLUMNS, LISTED = 64, 1024, 4_000_000
SLICE = 1 << 16
#: Rows up to which a list of ids (8 bytes each) or of sets with their sizes or families (32 bytes) is broadcast; a longer one is joined
#: by shuffle, and of families only the larger are formed.
BROADCAST_IDS = 500_000
LAST_CHANNEL = 4


class Threshold:
    """Jaccard >= num / den in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def differing(self, total: int) -> int:
        """The most that two linked sets of total size can differ in."""
        return total * (self.den - self.num) // (self.den + self.num)

    @property
    def classes(self) -> int:
        """The most size classes that two linked sets lie apart."""
        return int(log(self.den / self.num) / log(CLASS)) + 1 if self.num else 255

    def partners(self, n: int) -> tuple[int, int]:
        """The least and greatest size of a set linked with one of n."""
        return -(-n * self.num // self.den), n * self.den // self.num


@cache
def bands(top: int) -> list[int]:
    """Upper ends of the bands of x + y."""
    out = [FIRST_BAND]
    while out[-1] < top:
        out.append(int(out[-1] * BAND) + 1)
    return out


@cache
def segments(band: int, channel: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m segments' lower ends in the hash universe and a seed for each."""
    low = np.array([-(-(i << 64) // m) for i in range(m)], U)
    return low, mix(np.arange(m, dtype=U) + U((band * 8 + channel) << 40) + U(0x51ED270B))


def set_ids(h: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent ids of a set, of 63 bits."""
    a = int(mix(h + U(seed * 2 + 1)).sum()) + len(h)
    b = int(mix(h ^ U(0xA5A5A5A5DEADBEEF + seed)).sum()) + len(h)
    return int(mix(np.array([a % 2**64], U))[0] >> U(1)), int(mix(np.array([b % 2**64], U))[0] >> U(1))


def signatures(h: np.ndarray, cold: np.ndarray, t: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signature, predecessor) arrays of one set over all its bands and channels; predecessor 0 means none."""
    n = len(h)
    least, most = t.partners(n)
    own = mix(h ^ U(0xC2B2AE3D27D4EB4F))
    total = np.zeros(n + 1, U)
    np.cumsum(own, out=total[1:])
    colds = np.zeros(n + 1, np.int64)
    np.cumsum(cold, out=colds[1:])
    for k, top in enumerate(bands(n + most)):
        if top < n + least:
            continue
        need = t.differing(min(top, n + most)) + 1
        m = max(1, int(SPARE * (t.differing(top) + 1)) + 1)
        low, seed = segments(k, 0, m)
        at = np.append(np.searchsorted(h, low), n)
        sums, size, n_cold = total[at[1:]] - total[at[:-1]], at[1:] - at[:-1], colds[at[1:]] - colds[at[:-1]]
        used = np.flatnonzero(size)
        best = used[np.argsort(-n_cold[used], kind="stable")[:need]]
        yield chain(mix(sums[best] + seed[best]))
        if len(used) >= need:
            continue
        _, seed = segments(k, 1, m)
        exact = mix(sums[used] + seed[used])
        of = np.repeat(np.arange(m), size)
        many = size[of] > 1
        of, own_many = of[many], own[many]
        both = np.concatenate([exact, mix(sums[of] - own_many + seed[of])])
        yield both, np.zeros(len(both), U)
        if len(used) + int((size > 1).sum()) >= need:
            continue
        for channel in range(2, LAST_CHANNEL + 1):
            if channel == LAST_CHANNEL:
                yield chain(mix(own + U((k * 8 + channel) << 40))[:need])
                break
            low, seed = segments(k, channel, m * 4 ** (channel - 2))
            at = np.append(np.searchsorted(h, low), n)
            used = np.flatnonzero(at[1:] > at[:-1])
            yield chain(mix(total[at[1:]][used] - total[at[:-1]][used] + seed[used])[:need])
            if len(used) >= need:
                break


def parity(h: np.ndarray) -> bytes:
    """A bit per bucket of the low hash bits, at least one bucket a shingle: whether an odd number fell into it."""
    size = 1 << max(6, (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & U(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def unequal(x: bytes, y: bytes) -> int:
    """Unequal bits of two parity bitmaps, the longer one folded."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    size = 8 * min(len(x), len(y))
    if len(x) != len(y):
        long, short = (a, b) if len(x) > len(y) else (b, a)
        width = 8 * max(len(x), len(y))
        while width > size:
            width //= 2
            long = (long >> width) ^ (long & ((1 << width) - 1))
        a, b = long, short
    return (a ^ b).bit_count()


def chain(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prev = np.zeros(len(sig), U)
    prev[1:] = sig[:-1]
    return sig, prev


_salts = mix(np.arange(1, 2 * FAMILY_KEYS + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def family_keys(h: np.ndarray) -> np.ndarray:
    """The set's keys, none of them 0: each of two min-hashes, the elements nearest to fixed points."""
    low = (h[:, None] ^ _salts).min(0) if len(h) < 4096 else np.array([(h ^ x).min() for x in _salts], U)
    return (mix(low[::2] + mix(low[1::2])) >> U(33)).astype(np.int32) | 1


class Families:
    """The families of sets that have any, by the upper 40 bits of nodes; sets with none have the last row."""

    def __init__(self, short: np.ndarray, keys: np.ndarray):
        order = np.argsort(short)
        self.short, self.keys = short[order], np.concatenate([keys[order], np.zeros((1, FAMILY_KEYS), np.int32)])

    def of(self, short: np.ndarray) -> np.ndarray:
        if not len(self.short):
            return np.zeros(len(short), np.int64)
        at = np.minimum(np.searchsorted(self.short, short), len(self.short) - 1)
        return np.where(self.short[at] == short, at, len(self.short))

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether rows i and j have a family in common."""
        out = np.zeros(np.broadcast_shapes(i.shape, j.shape), bool)
        for k in self.keys.T:
            out |= (k[i] == k[j]) & (k[i] != 0)
        return out


NO_FAMILIES = Families(np.zeros(0, U), np.zeros((0, FAMILY_KEYS), np.int32))

NAMES = ["kind", "id", "n", "node", "check", "least", "bits", "keys"]


def describe(docs: DataFrame, id_col: str, text_col: str, k: int, seed: int) -> DataFrame:
    """kind 0: id, n, node, check, least (hash), bits, keys per row; kind 1: shingles frequent in a task's pool with their counts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0
        id_type = pa.int64()

        def frequent() -> pa.RecordBatch:
            x = np.concatenate(pool)
            pool.clear()
            seen.clear()
            x.sort()
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            c = np.diff(np.append(at, len(x)))
            x, c = x[at[c >= HOT_LOCAL]], c[c >= HOT_LOCAL]
            none = pa.nulls(len(x), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(x), np.int32)), pa.nulls(len(x), id_type), pa.array(c), pa.array(x.view(np.int64)), none, none, pa.nulls(len(x), pa.binary()), pa.nulls(len(x), pa.list_(pa.int32()))], names=NAMES)

        for b in batches:
            id_type = b.column(0).type
            rows, bits, keys = [], [], []
            for text in binary_column(b, "__text"):
                h = shingle_set(text, k)
                node, check = set_ids(h, seed)
                rows.append((len(h), node, check, int(h[0] >> U(1)) if len(h) else 0))
                bits.append(parity(h))
                keys.append(family_keys(h) if len(h) else None)
                if len(h) and node not in seen:
                    seen.add(node)
                    pool.append(h)
                    held += len(h)
                    if held > HOT_POOL:
                        yield frequent()
                        held = 0
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int32)), b.column(0), *cols, pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int32()))], names=NAMES)
        if pool:
            yield frequent()

    cols = docs.select(docs[id_col].alias("id"), docs[text_col].alias("__text"))
    return cols.mapInArrow(lean(run), f"kind int, id {kind}, n bigint, node bigint, check bigint, least bigint, bits binary, keys array<int>")


def index(docs: DataFrame, text_col: str, k: int, seed: int, t: Threshold, hot: np.ndarray, parts: int) -> DataFrame:
    """(part, data): packed records of all signatures; a set is packed once per task."""
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = known.value
        sigs: list[np.ndarray] = []
        prevs: list[np.ndarray] = []
        leasts: list[np.ndarray] = []
        nodes: list[int] = []
        counts: list[int] = []
        sizes: list[int] = []
        seen: set[int] = set()
        held = 0

        def flush() -> pa.RecordBatch:
            sig, prev = np.concatenate(sigs) >> U(16), np.concatenate(prevs) >> U(32)
            own = (np.array(nodes, np.int64).view(U) >> U(23)) << U(24) | np.array(sizes, U)
            data = np.stack([sig << U(16) | prev >> U(16), np.repeat(own, counts) | (prev & U(0xFFFF)) << U(8)], 1).astype("<u8", copy=False)
            part = (sig % U(parts)).astype(np.uint16 if parts < 65536 else np.uint32)
            order = np.argsort(part, kind="stable")
            data, part = data[order], part[order]
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = np.append(at[1:], len(part))
            least = np.concatenate(leasts)[order]
            for x in (sigs, prevs, leasts, nodes, counts, sizes):
                x.clear()
            blobs = pa.array([data[a:e].tobytes() + least[a:e].tobytes() for a, e in zip(at, ends)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), blobs], names=["part", "data"])

        for b in batches:
            for text in binary_column(b, "__text"):
                h = shingle_set(text, k)
                if not len(h) or (node := set_ids(h, seed)[0]) in seen:
                    continue
                seen.add(node)
                if len(hot):
                    cold = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] != h
                else:
                    cold = np.ones(len(h), bool)
                n = 0
                for sig, prev in signatures(h, cold, t):
                    if not len(sig):
                        continue
                    sigs.append(sig)
                    prevs.append(prev)
                    leasts.append(np.full(len(sig), sig.min() >> U(32), "<u4"))
                    n += len(sig)
                nodes.append(node)
                counts.append(n)
                sizes.append(min(int(log(len(h)) / log(CLASS) + 1e-9), 255))
                held += n
                if held > FLUSH:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return docs.select(docs[text_col].alias("__text")).mapInArrow(lean(run), "part int, data binary")


class Records:
    """Packed records, in columns: signatures, nodes, predecessors, size classes, least signatures."""

    def __init__(self, pair: np.ndarray, least: np.ndarray):
        self.pair, self.least = pair, least
        low = pair[:, 1]
        self.sig, self.node, self.size = pair[:, 0] >> U(16), low >> U(24), (low & U(0xFF)).astype(np.int16)
        self.prev = ((pair[:, 0] & U(0xFFFF)) << U(16) | (low >> U(8)) & U(0xFFFF)).astype(np.uint32)
        self.first = (self.sig >> U(16)).astype(np.uint32) == least

    def __getitem__(self, at: np.ndarray | slice) -> Records:
        return Records(self.pair[at], self.least[at])

    def pack(self) -> bytes:
        return self.pair.tobytes() + self.least.tobytes()

    @classmethod
    def read(cls, blobs: list[bytes]) -> Records:
        counts = [len(x) // RECORD for x in blobs]
        pair = b"".join([memoryview(x)[: 16 * n] for x, n in zip(blobs, counts)])
        least = b"".join([memoryview(x)[16 * n :] for x, n in zip(blobs, counts)])
        return cls(np.frombuffer(pair, "<u8").reshape(-1, 2), np.frombuffer(least, "<u4"))

    def meets(self, i, other: Records, j, classes: int) -> np.ndarray:
        """Whether records i of self and j of other, of one signature, are where their sets' pair is emitted."""
        where = np.where(self.least[i] == other.least[j], self.first[i], (self.prev[i] != other.prev[j]) | (self.prev[i] == 0))
        return where & (np.abs(self.size[i] - other.size[j]) <= classes)


def packed_pairs(found: list[np.ndarray], slots: int) -> Iterator[tuple[int, bytes]]:
    """(slot, data) of distinct pairs of two nodes, a < b: per slot of a, sorted, five byte planes of a's steps and five of b."""
    pairs = np.sort(np.concatenate(found), axis=1) if found else np.zeros((0, 2), U)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    slot = pairs[:, 0] % U(slots)
    order = np.lexsort((pairs[:, 1], pairs[:, 0], slot))
    pairs, slot = pairs[order], slot[order]
    if len(pairs):
        fresh = np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])
        pairs, slot = pairs[fresh], slot[fresh]
        at = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        for i, e in zip(at, np.append(at[1:], len(slot))):
            both = np.stack([np.diff(pairs[i:e, 0], prepend=U(0)), pairs[i:e, 1]]).astype("<u8")
            yield int(slot[i]), np.ascontiguousarray(both.view(np.uint8).reshape(2, -1, 8)[:, :, :5].transpose(0, 2, 1)).tobytes()


def distinct_pairs(table: pa.Table) -> pa.Table:
    """The distinct pairs (a, b) of one slot."""
    found = []
    for data in table.column("data").to_pylist():
        wide = np.zeros((2, len(data) // 10, 8), np.uint8)
        wide[:, :, :5] = np.frombuffer(data, np.uint8).reshape(2, 5, -1).transpose(0, 2, 1)
        both = wide.view("<u8")[:, :, 0]
        found.append(np.stack([np.cumsum(both[0], dtype=U), both[1]], 1))
    pairs = np.concatenate(found)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])]
    return pa.table({"a": pairs[:, 0].astype(np.int64), "b": pairs[:, 1].astype(np.int64)})


def matches(t: Threshold, slots: int, known=None):
    """Of one part of the index the candidate pairs (the upper 40 bits of nodes) by slot, and pairs of blocks (left, right).
    known is a broadcast of families, whose pairs are left out."""

    def run(table: pa.Table) -> pa.Table:
        rec = Records.read(table.column("data").to_pylist())
        order = np.argsort(rec.sig, kind="stable")
        s = rec.sig[order]
        again = np.concatenate([[False], s[1:] == s[:-1]])
        rec = rec[order[again | np.concatenate([again[1:], [False]])]]
        del order, s, again
        families = known.value if known else NO_FAMILIES
        first = families.keys[families.of(rec.node), 0]
        order = np.lexsort((rec.node, first, rec.sig))
        rec = rec[order]
        if len(rec.sig):
            rec = rec[np.concatenate([[True], (rec.sig[1:] != rec.sig[:-1]) | (rec.node[1:] != rec.node[:-1])])]
        sig, own = rec.sig, families.of(rec.node)
        first = families.keys[own, 0]
        # The first holder that may make a pair with each: of those of one first family, the one after the last.
        after = np.flatnonzero(np.concatenate([(sig[1:] != sig[:-1]) | (first[1:] != first[:-1]) | (first[1:] == 0), [True]])) + 1 if len(sig) else np.zeros(0, np.int64)
        after = np.repeat(after, np.diff(after, prepend=0))
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        held = np.diff(np.append(start, len(sig)))
        blocks = []
        for at, n in zip(start[held > HOLDERS], held[held > HOLDERS]):
            cuts = [(i, min(i + HOLDERS // 2, at + n)) for i in range(at, at + n, HOLDERS // 2)]
            data = [rec[i:e].pack() for i, e in cuts]
            blocks += [(x, data[k + m]) for k, x in enumerate(data) for m, (_, e) in enumerate(cuts[k:]) if after[cuts[k][0]] < e]
        found, waiting, d = [], 0, 0
        live = np.flatnonzero(np.repeat(held <= HOLDERS, held))
        while len(live := live[after[live] + d < len(sig)]) and len(live := live[sig[live] == sig[after[live] + d]]):
            to = after[live] + d
            on = np.flatnonzero(rec.meets(live, rec, to, t.classes))
            on = on[~families.shared(own[live[on]], own[to[on]])]
            met, to = live[on], to[on]
            if len(met):
                found.append(np.stack([rec.node[met], rec.node[to]], 1))
                waiting += len(met)
            if waiting > 1_000_000:
                found, waiting = [np.unique(np.sort(np.concatenate(found), axis=1).view("V16")).view(U).reshape(-1, 2)], 0
            d += 1
        rows = [(slot, data, None, None) for slot, data in packed_pairs(found, slots)] + [(None, None, x, y) for x, y in blocks]
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("slot", "data", "left", "right"), cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))})

    return run


def expand(t: Threshold, slots: int, known=None):
    """Candidate pairs by slot of pairs of blocks of holders of one signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families = known.value if known else NO_FAMILIES
        for batch in batches:
            for left, right in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                x, y = Records.read([left]), Records.read([right])
                i, j = np.nonzero(x.meets((slice(None), None), y, slice(None), t.classes))
                on = ~families.shared(families.of(x.node)[i], families.of(y.node)[j])
                i, j = i[on], j[on]
                rows = list(packed_pairs([np.stack([x.node[i], y.node[j]], 1)], slots))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slot", "data"])

    return run


def kept(edges: pa.Table, rule) -> pa.Table:
    """The edges (a, b) that a rule accepts; only SLICE of them are Python numbers at once."""
    out = np.zeros(edges.num_rows, bool)
    for at in range(0, edges.num_rows, SLICE):
        some = edges.slice(at, SLICE)
        out[at : at + SLICE] = [rule(a, b) for a, b in zip(some.column("a").to_pylist(), some.column("b").to_pylist())]
    return edges.filter(pa.array(out))


def filtered(t: Threshold):
    """Of one bucket the pairs whose parity bitmaps don't rule them out."""

    def run(table: pa.Table) -> pa.Table:
        full, edge = table.filter(table.column("b").is_null()), table.filter(table.column("b").is_valid())
        order = np.argsort(full.column("a").to_numpy())
        node, n, bits = full.column("a").to_numpy()[order], full.column("n").to_numpy()[order], full.column("bits").take(order)
        i, j = (np.searchsorted(node, edge.column(c).to_numpy()) for c in "ab")
        length = pc.binary_length(bits).to_numpy()
        width, most = np.minimum(length[i], length[j]), t.differing(n[i] + n[j])
        near = np.zeros(edge.num_rows, bool)
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            some, of = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
            maps = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, w // 8), 0) for x in bits.take(some).to_pylist()])
            step = max(1, 8 * SLICE // int(w))
            for low in range(0, len(at), step):
                on, x, y = at[low : low + step], of[: len(at)][low : low + step], of[len(at) :][low : low + step]
                near[on] = np.bitwise_count(maps[x] ^ maps[y]).sum(1) <= most[on]
        return edge.filter(pa.array(near)).select(["a", "b", "bucket"])

    return run


def packed(h: np.ndarray) -> bytes:
    """Sorted hashes as eight byte planes of their steps, the lowest first; the high ones are nearly all 0 and compress."""
    return np.ascontiguousarray(np.diff(h, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=U)


def common(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each of xs shares with each of ys."""
    out = np.zeros((len(xs), len(ys)), np.int64)
    h = np.concatenate(xs)
    vocabulary, of_x = np.unique(h, return_inverse=True)
    row_x, h = np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.concatenate(ys)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    on = vocabulary[at] == h
    of_y, row_y = at[on], np.repeat(np.arange(len(ys)), [len(y) for y in ys])[on]
    n_x, n_y = (np.bincount(of, minlength=len(vocabulary)) for of in (of_x, of_y))
    dense = n_x * n_y >= max(2, out.size // COMMON)
    column = np.cumsum(dense) - 1
    for low in range(0, int(dense.sum()), COLUMNS):
        sides = []
        for of, row, n in ((of_x, row_x, len(xs)), (of_y, row_y, len(ys))):
            some = np.flatnonzero(dense[of] & (column[of] >= low) & (column[of] < low + COLUMNS))
            side = np.zeros((n, COLUMNS), np.float32)
            side[row[some], column[of[some]] - low] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    order = np.argsort(of_y, kind="stable")
    row_y, start = row_y[order], np.cumsum(n_y) - n_y
    rest = np.flatnonzero(~dense[of_x] & (n_y[of_x] > 0))
    ends = np.cumsum(n_y[of_x[rest]])
    at = 0
    while at < len(rest):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LISTED)))
        some = rest[at:to]
        n = n_y[of_x[some]]
        j = row_y[np.repeat(start[of_x[some]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        out += np.bincount(np.repeat(row_x[some], n) * len(ys) + j, minlength=out.size).reshape(out.shape)
        at = to
    return out


def linked_in_family(t: Threshold, families: Families, k: int, left: dict[int, np.ndarray], right: dict[int, np.ndarray] | None) -> pa.Table:
    """The linked pairs of two blocks of a family by key k, or of one if right is None, that share no family of an earlier key."""
    x = np.array(list(left), np.int64)
    y = x if right is None else np.array(list(right), np.int64)
    xs = list(left.values())
    ys = xs if right is None else list(right.values())
    i, j = (families.of(z.view(U) >> U(23)) for z in (x, y))
    open_ = np.triu(np.ones((len(x), len(y)), bool), 1) if right is None else np.ones((len(x), len(y)), bool)
    for q in families.keys.T[:k]:
        open_ &= (q[i][:, None] != q[j]) | (q[i] == 0)[:, None]
    if open_.any():
        both = common(xs, ys)
        total = np.array([len(z) for z in xs])[:, None] + np.array([len(z) for z in ys])
        open_ &= t.den * both >= t.num * (total - both)
    i, j = np.nonzero(open_)
    return pa.table({"a": np.minimum(x[i], y[j]), "b": np.maximum(x[i], y[j])})


def verify(t: Threshold, known=None):
    """The links among the pairs of a bucket, or of two blocks of a family: its bucket is negative, side says which block."""

    def run(table: pa.Table) -> pa.Table:
        edge = table.filter(table.column("data").is_null())
        full = table.filter(table.column("data").is_valid())
        sides: dict[int, dict[int, np.ndarray]] = {}
        for node, side, data in zip(full.column("a").to_pylist(), full.column("side").to_pylist(), full.column("data").to_pylist()):
            sets = sides.setdefault(side, {})
            if node not in sets:
                sets[node] = unpacked(data)
        bucket, x, y = (table.column(c)[0].as_py() for c in ("bucket", "x", "y"))
        if bucket < 0:
            if x != y and len(sides) < 2:
                return edge.select(["a", "b"])
            return linked_in_family(t, known.value, -(bucket + 1) >> 32, sides[x], sides[y] if x != y else None)
        sets = sides.get(0, {})

        def linked(a: int, b: int) -> bool:
            x, y = sorted((sets[a], sets[b]), key=len)
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            return t.den * both >= t.num * (len(x) + len(y) - both)

        return kept(edge, linked).select(["a", "b"])

    return run


def family_sets(nodes: DataFrame, twins: DataFrame) -> tuple[DataFrame, Families]:
    """(bucket, x, y, side, node): the sets of each cell of a family's grid of blocks; and the families. Sets that share the
    upper bits of a node with another one have no family. If too many sets had one, only larger families are formed."""
    single = nodes.join(F.broadcast(twins.select(F.col("a").alias("twin"))), F.shiftright("node", 23) == F.col("twin"), "left_anti")
    each = single.select("node", "n", F.posexplode("keys").alias("k", "key"))
    groups = each.groupBy("k", "key").agg(F.count("*").alias("sets"), F.sum("n").alias("mass")).where(F.col("sets") >= FAMILY)
    groups = groups.select("k", "key", "sets", F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("mass") / BLOCK_SHINGLES)).cast("int").alias("blocks")).checkpoint()
    least = FAMILY
    while True:
        large = groups.where(F.col("sets") >= least)
        some = each.join(F.broadcast(large) if large.count() <= BROADCAST_IDS else large, ["k", "key"]).select("node", "k", "key", "blocks").checkpoint()
        of = some.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("k", "key"))).alias("keys"))
        of = of.select("node", *[F.coalesce(F.col("keys")[k], F.lit(0)).alias(f"k{k}") for k in range(FAMILY_KEYS)])
        if some.select("node").distinct().count() <= BROADCAST_IDS:
            break
        least *= 2
    table = of.toArrow()
    families = Families(table.column("node").to_numpy().view(U) >> U(23), np.stack([table.column(f"k{k}").to_numpy() for k in range(FAMILY_KEYS)], 1).astype(np.int32))
    side = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    cells = some.select("node", "k", "key", side.alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    bucket = -F.lit(1) - F.shiftleft(F.col("k").cast("bigint"), 32) - F.col("key")
    return cells.select(bucket.alias("bucket"), F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "node"), families


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, k: int, seed: int, wanted: DataFrame) -> DataFrame:
    """(node, data): the packed hashes of the sets of the wanted (id, node) rows."""
    wanted = wanted.checkpoint()
    ids = wanted.select(F.col("id").alias("wanted_id")).distinct()
    few = wanted.count() <= BROADCAST_IDS
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("__text")).join(F.broadcast(ids) if few else ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x, k) for x in binary_column(b, "__text")]
            yield pa.RecordBatch.from_arrays([pa.array([set_ids(h, seed)[0] for h in sets], pa.int64()), pa.array([packed(h) for h in sets], pa.binary())], names=["node", "data"])

    return texts.mapInArrow(lean(run), "node bigint, data binary")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 70, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows, edges): rows has id, n and node per row of docs; edges the linked pairs (a, b) of different sets."""
    spark, t, seed = docs.sparkSession, Threshold(num, den), 0
    small_batches(spark)
    while True:
        both = saved(describe(docs, id_col, text_col, k, seed), "sets")
        rows = both.where("kind = 0")
        nodes = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("least").alias("least"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("n").alias("n0"), F.any_value("bits").alias("bits"), F.any_value("keys").alias("keys"))
        nodes = saved(nodes, "nodes")
        if nodes.where("c0 <> c1 or n <> n0").isEmpty():
            break
        seed += 1
    hot = both.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_COUNT).orderBy(F.desc("n"), "node").limit(HOT_MOST).select("node").toArrow()
    hot = np.sort(hot.column("node").to_numpy().view(U))
    mass = nodes.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_partitions(spark), mass * RECORD // PART_BYTES)
    short = nodes.select(F.shiftright("node", 23).alias("short"), "node", "n", "least")
    twins = short.groupBy("short").agg(F.count("*").alias("holders")).where("holders > 1").select(F.col("short").alias("a"), F.col("short").alias("b")).checkpoint()
    members, families = family_sets(nodes, twins)
    families = spark.sparkContext.broadcast(families)
    records = index(docs, text_col, k, seed, t, hot, parts).repartition(parts, "part")
    met = saved(records.groupBy("part").applyInArrow(lean_group(matches(t, parts, families)), "slot int, data binary, left binary, right binary"), "matches")
    del records
    release(spark)
    packed = met.where("slot is not null").select("slot", "data")
    blocks = met.where("left is not null").select("left", "right")
    n_blocks = blocks.count()
    if n_blocks:
        packed = packed.unionByName(blocks.repartition(max(shuffle_partitions(spark), n_blocks // 8)).mapInArrow(lean(expand(t, parts, families)), "slot int, data binary"))
    pairs = packed.repartition(parts, "slot").groupBy("slot").applyInArrow(lean_group(distinct_pairs), "a bigint, b bigint")
    ends = [short.select(F.col("short").alias(x), F.col("node").alias(f"{x}_node"), F.col("n").alias(f"{x}_n"), F.col("least").alias(f"{x}_least")) for x in "ab"]
    near = F.greatest("a_n", "b_n") * num <= F.least("a_n", "b_n") * den
    if nodes.count() <= BROADCAST_IDS:
        ends = [F.broadcast(e) for e in ends]
    pairs = pairs.unionByName(twins).join(ends[0], "a").join(ends[1], "b").where(((F.col("a") != F.col("b")) | (F.col("a_node") < F.col("b_node"))) & near)
    buckets = max(shuffle_partitions(spark), mass * 8 // SET_BYTES)
    bucket = F.pmod(F.xxhash64(F.least("a_least", "b_least")), F.lit(buckets)).cast("int")
    pairs = saved(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), bucket.alias("bucket")), "met")
    release(spark)
    # Pairs and the bitmaps of their sets meet by bucket, so a bitmap travels once a bucket and not once a pair.
    full = pairs.groupBy("bucket").agg(F.ceil(F.count("*") / CELL_PAIRS).cast("int").alias("cells")).where("cells > 1").checkpoint()
    cell = F.lit(0)
    if not full.isEmpty():  # a bucket with many pairs is cut by its pairs' second set
        pairs, cell = pairs.join(full, "bucket", "left"), F.pmod(F.xxhash64("b"), F.coalesce("cells", F.lit(1))).cast("int")
    pairs = pairs.select("bucket", cell.alias("cell"), "a", "b")
    ends = pairs.select("bucket", "cell", F.col("a").alias("node")).unionByName(pairs.select("bucket", "cell", F.col("b").alias("node"))).distinct()
    shipped = ends.join(nodes.select("node", "n", "bits"), "node").select("bucket", "cell", F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), "n", "bits")
    work = shipped.unionByName(pairs.select("bucket", "cell", "a", "b", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("bits"))).repartition(buckets, "bucket", "cell")
    pairs = saved(work.groupBy("bucket", "cell").applyInArrow(lean_group(filtered(t)), "a bigint, b bigint, bucket int"), "candidates")
    release(spark)
    ends = pairs.select("bucket", F.col("a").alias("node")).unionByName(pairs.select("bucket", F.col("b").alias("node"))).distinct()
    weight = ends.join(nodes.select("node", "n"), "node").groupBy("bucket").agg(F.sum("n").alias("mass"))
    grid = F.greatest(F.ceil(F.col("mass") * 8 / (4 * SET_BYTES)), F.ceil(F.sqrt(F.col("held") / VERIFY_PAIRS))).cast("int")
    heavy = pairs.groupBy("bucket").agg(F.count("*").alias("held")).join(weight, "bucket").select("bucket", grid.alias("grid")).where("grid > 1").checkpoint()
    x, y = F.lit(0), F.lit(0)
    if not heavy.isEmpty():  # a bucket's sets are cut by node, and each cell of the grid has two of the cuts
        cut = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.coalesce("grid", F.lit(1))).cast("int")
        pairs, x, y = pairs.join(heavy, "bucket", "left"), F.least(cut("a"), cut("b")), F.greatest(cut("a"), cut("b"))
    pairs = saved(pairs.select(F.col("bucket").cast("bigint").alias("bucket"), x.alias("x"), y.alias("y"), "a", "b"), "cells")
    cell = ["bucket", "x", "y"]
    placed = pairs.select(*cell, F.lit(0).alias("side"), F.col("a").alias("node")).unionByName(pairs.select(*cell, F.lit(0).alias("side"), F.col("b").alias("node"))).distinct()
    placed = placed.unionByName(members).checkpoint()
    wanted = placed.select("node").distinct().join(nodes, "node").select("id", "node")
    sets = shingle_sets(docs, id_col, text_col, k, seed, wanted)
    shipped = sets.join(F.broadcast(placed) if placed.count() <= BROADCAST_IDS else placed, "node").select(*cell, "side", F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), "data")
    work = shipped.unionByName(pairs.select(*cell, F.lit(0).alias("side"), "a", "b", F.lit(None).cast("binary").alias("data"))).repartition(buckets, *cell)
    edges = saved(work.groupBy(*cell).applyInArrow(lean_group(verify(t, families)), "a bigint, b bigint"), "links")
    return rows.select("id", "n", "node"), edges


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 70, den: int = 100) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, n_similar (rows linked directly), component_id (smallest id reachable)."""
    rows, edges = links(docs, id_col, text_col, k, num, den)
    nodes = rows.where("n > 0").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Links to sets without copies are counted where they lie; only sets with copies are looked up.
    many = nodes.where("copies > 1").select(F.col("node").alias("b"), "copies").checkpoint()
    counted = both.join(F.broadcast(many) if many.count() <= BROADCAST_IDS else many, "b", "left")
    degree = counted.groupBy(F.col("a").alias("node")).agg(F.sum(F.coalesce("copies", F.lit(1))).alias("others"))
    member = components(edges)
    first = member.join(nodes, "node").groupBy("component").agg(F.min("first").alias("lowest"))
    group = member.join(first, "component").select("node", "lowest")
    known = nodes.join(degree, "node", "left").join(group, "node", "left").where("copies > 1 or lowest is not null").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("similar"), F.coalesce("lowest", "first").alias("lowest"))
    joined = rows.withColumn("key", F.when(F.col("n") > 0, F.col("node"))).join(known.withColumnRenamed("node", "key"), "key", "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("similar", F.lit(0)).cast("bigint").alias("n_similar"), F.coalesce("lowest", "id").alias("component_id"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
