"""Operator 7: n-gram scoring by the longest matching context of any length.

The training corpus is indexed like a suffix array cut by key ranges: every n-gram that can matter is a key in a sorted
array, an array shard holds one range of keys, and queries find their key's range by binary search; counts of the sorted
pieces that tasks contribute are summed. A token is scored from the longest context before it, in its document, that the
training texts contain: P = (c(context, token) + MU * p(token)) / (c(context) + MU), p being the add-one unigram. That
context is exact at any length. With M(t) the length and C(t) the count of the longest n-gram ending at t that occurs in
training, the context of t is the one of M(t - 1), and it goes on with the token if M(t) = M(t - 1) + 1, C(t) times.

Lengths 1 to 4 are counted over whole texts in two rounds. A bitmap tells after each which n-grams may still matter -
held by a queried text and found, or found at two training places - and only what lies behind them goes on. What is left
are stretches of texts all of whose 4-grams matter; every longer match lies within them. There M is found digit by digit
in base RADIX, the highest first, each round asking for the next digit's lengths; training stretches count the lengths
that a bitmap of the questions holds. Those rounds read stretches all of whose 4-grams are held by a queried text and found,
as no match of one goes beyond; they are deleted after the last round. A training text contains itself, so its longest context is all that goes before;
one round counts the prefixes of all lengths: a text's own in one step, others from places whose shorter prefix was asked for.
Queries ask for sets of keys per block of rows; answers are written to the shared folder by block and read by the
task that scores that block, so texts are never shuffled and no table is broadcast whole.

Exact up to collisions of 48-bit keys of 64-bit hashes. Cases: null and empty texts are the end token alone; rows repeat
as documents of their own; null ids count as the empty text in the fold; an empty table gives no rows; without training
rows every count is 0; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import binary_column, fold, lean, lean_group, located, release, scratch_dir, shuffle_partitions, small_batches
from palimpsest.llm.hashing import BASE, U, joined_hashes

MU = 2.0
BLOCK_ROWS = 2048
#: Bytes of texts, and words of stretches, that are laid end to end and worked on at once.
GROUP_BYTES, GROUP_WORDS = 1_500_000, 300_000
FLUSH_KEYS = 4_000_000
PART_KEYS = 2_000_000
#: Keys of one batch that a task passes on, and the files of a round's bitmap.
BATCH_KEYS, BITMAP_FILES = 400_000, 16
#: Bitmaps have a bit a word, within these bounds of their logarithm.
LEAST_BITS, MOST_BITS = 20, 29
#: By how much the logarithm is less for the keys that held-out texts ask for.
SHARED_BITS = 2
#: Bits of a key in a bitmap of questions.
PROBES = 3
#: The length up to which all n-grams are counted by the rounds over whole texts, and the base of longer lengths' digits.
WHOLE, RADIX = 4, 8
END = U(0x5BF03635DCD1F867)
BIT = U(1).astype(np.uint8) << np.arange(8, dtype=np.uint8)
#: Odd factors of keys, and by probe of bits after the first.
MIXERS, PROBERS = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)), (U(1), U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_pow = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) <= n:
        size = 1 << n.bit_length()
        for i, b in enumerate((BASE, pow(BASE, -1, 2**64))):
            _pow[i] = np.multiply.accumulate(np.concatenate([[U(1)], np.full(size, b, U)]))
    return _pow[0], _pow[1]


class Texts:
    """Token hashes of texts, or stretches of them, laid end to end: where each begins, whether it is held out, and the
    keys of n-grams by their last token."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, held: np.ndarray):
        self.tokens, self.lengths, self.starts = tokens, lengths, np.cumsum(lengths) - lengths
        self.held = np.repeat(held, lengths)
        #: Tokens from the text's first to this one: the longest n-gram that ends here.
        self.room = np.arange(1, len(tokens) + 1) - np.repeat(self.starts, lengths)
        up, self.down = powers(len(tokens))
        self.sums = np.zeros(len(tokens) + 1, U)
        np.cumsum(tokens * up[: len(tokens)], out=self.sums[1:])

    def keys(self, end: np.ndarray, order: int | np.ndarray, base: int = 0) -> np.ndarray:
        """48-bit keys of the n-grams of an order with their last token at end; the lowest bit marks the base order."""
        after = end + 1
        start = after - order
        h = self.sums[after]
        h -= self.sums[start]
        h *= self.down[start]
        h += np.asarray(order, U) * U(0x9E37)
        h ^= h >> U(30)
        h *= MIXERS[0]
        h ^= h >> U(27)
        h *= MIXERS[1]
        h >>= U(16)
        h &= U(2**48 - 2)
        if base > 0 and order == base:
            h |= U(1)
        return h

    def alive(self, bits: np.ndarray, order: int) -> np.ndarray:
        """Whether the n-gram of an order that ends at each token is marked."""
        out = self.room >= order
        at = np.flatnonzero(out)
        out[at] = alive(bits, self.keys(at, order, order))
        return out


def ladder(longest: int) -> list[list[int]]:
    """The context lengths up to that of the longest document, none left out, as they are counted: two rounds, and the rest."""
    return [[1, 2], [3, 4], list(range(WHOLE + 1, longest + 1))]


def places(keys: np.ndarray, width: int, probe: int) -> np.ndarray:
    """Bits of keys in a bitmap of 2 ** width: the first probe keeps their order, later ones that of their first 12 bits."""
    if not probe:
        return keys >> U(48 - width)
    at = keys * PROBERS[probe]
    at >>= U(76 - width)
    at |= (keys >> U(36)) << U(width - 12)
    return at


def alive(bits: np.ndarray, keys: np.ndarray, probes: int = 1) -> np.ndarray:
    out, width = None, len(bits).bit_length() + 2
    for probe in range(probes):
        at = places(keys if out is None else keys[out], width, probe)
        on = np.flatnonzero(bits[(at >> U(3)).view(np.int64)] & BIT[(at & U(7)).view(np.int64)])
        out = on if out is None else out[on]
    got = np.zeros(len(keys), bool)
    got[out] = True
    return got


def planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def groups(b: pa.RecordBatch) -> Iterator[tuple[int, Texts]]:
    """(block, texts) of consecutive rows of a batch, in their order: a block's texts up to GROUP_BYTES."""

    def made() -> Texts:
        words, n = joined_hashes(texts)
        tokens = np.full(len(words) + len(n), END)
        tokens[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
        return Texts(tokens, n + 1, np.array(flags))

    own, flags, texts, size = None, [], [], 0
    for block, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), binary_column(b, "__text")):
        if texts and (block != own or size + len(text) > GROUP_BYTES):
            yield own, made()
            flags, texts, size = [], [], 0
        own = block
        flags.append(held)
        texts.append(text)
        size += len(text) + 1
    if texts:
        yield own, made()


class Pools:
    """Keys by kind: 0 n-grams of training texts, 1 and 2 what held-out and training texts of one block ask for."""

    def __init__(self, parts: int):
        self.parts, self.block, self.keys, self.held = parts, None, {0: [], 1: [], 2: []}, {0: 0, 1: 0, 2: 0}

    def add(self, kind: int, keys: np.ndarray) -> None:
        if len(keys):
            self.keys[kind].append(keys)
            self.held[kind] += len(keys)

    def enter(self, block: int) -> Iterator[pa.RecordBatch]:
        """What is full, or asked by another block than the one that follows."""
        for kind in self.keys:
            if self.held[kind] > FLUSH_KEYS or kind and block != self.block:
                yield from self.flush(kind)
        self.block = block

    def flush(self, kind: int) -> Iterator[pa.RecordBatch]:
        """Sorted, delta-coded key sets by part; kind 0 with counts."""
        if not self.keys[kind]:
            return
        key = np.concatenate(self.keys[kind])
        self.keys[kind].clear()
        self.held[kind] = 0
        key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n, key = np.diff(at, append=len(key)), key[at]
        part = (key * U(self.parts)) >> U(48) if self.parts < 65536 else (key >> U(16)) * U(self.parts) >> U(32)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        end = np.append(at[1:], len(key))
        cut = np.flatnonzero(np.diff(at // BATCH_KEYS, prepend=-1))
        for i, j in zip(cut, np.append(cut[1:], len(at))):
            yield self.batch([(int(part[a]), kind, self.block, e - a, planes(np.diff(key[a:e], prepend=U(0)), 6), planes(n[a:e], 4) if kind == 0 else b"") for a, e in zip(at[i:j], end[i:j])])

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.binary()), pa.array(c[5], pa.binary())], names=["part", "kind", "block", "n", "keys", "counts"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        for kind in self.keys:
            yield from self.flush(kind)


KEYS = "part int, kind int, block bigint, n bigint, keys binary, counts binary"
ANSWERS = "block bigint, n bigint, keys binary, counts binary"


def ends(t: Texts, order: int, marks: np.ndarray | None, before: int) -> np.ndarray:
    """Whether an n-gram of an order ends at each token, all of whose shorter ones of the order before are marked."""
    out = t.room >= order
    if marks is not None:
        for back in range(order - before + 1):
            out[back:] &= marks[: len(marks) - back]
    return out


def emit(docs: DataFrame, depths: list[int], bits, parts: int) -> DataFrame:
    """Counts and questions of a round over whole texts."""
    before = depths[0] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools = Pools(parts)
        for b in batches:
            for block, t in groups(b):
                yield from pools.enter(block)
                marks = t.alive(bits.value, before) if bits is not None else None
                for d in depths:
                    here = ends(t, d, marks, before)
                    ask = ~t.held if d == 1 else (t.room == d) & ~t.held  # a training text asks for its words and its prefixes
                    at = np.flatnonzero(here)
                    k = t.keys(at, d, depths[-1])
                    pools.add(0, k[~t.held[at]])
                    pools.add(1, k[t.held[at]])
                    pools.add(2, k[ask[at]])
        yield from pools.rest()

    return docs.mapInArrow(lean(run), KEYS)


class Stretches(Texts):
    """Runs of tokens all of whose n-grams of the order WHOLE are marked: at is their place in the texts, lead whether a
    run begins with its text."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, held: np.ndarray, lead: np.ndarray, at: np.ndarray | None = None):
        super().__init__(tokens, lengths, held)
        self.lead, self.at = lead, at

    @classmethod
    def of(cls, t: Texts, marks: np.ndarray) -> Stretches:
        mark = np.concatenate([[False], marks, [False]])
        first, last = np.flatnonzero(mark[1:] & ~mark[:-1]), np.flatnonzero(mark[:-1] & ~mark[1:])
        long = last - first > 1
        first, length = first[long] - WHOLE + 1, (last - first)[long] + WHOLE - 1
        at = np.arange(int(length.sum())) + np.repeat(first - (np.cumsum(length) - length), length)
        return cls(t.tokens[at], length, t.held[first], t.room[first] == 1, at)

    def prefixes(self) -> np.ndarray:
        """Places where a prefix of a training text longer than WHOLE ends."""
        return np.flatnonzero(np.repeat(self.lead, self.lengths) & ~self.held & (self.room > WHOLE))

    def lifted(self, steps: list[int], look: Callable, path: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of held-out texts where an n-gram longer than WHOLE ends, the greatest length known to match, its
        count or 0 for WHOLE) after the rounds of these steps; path gets the lengths after each."""
        at = np.flatnonzero(self.held & (self.room > WHOLE))
        length, count, room = np.full(len(at), WHOLE), np.zeros(len(at), np.int64), self.room[at]
        for step in steps:
            i = np.arange(len(at))
            for _ in range(RADIX - 1):
                i = i[length[i] + step <= room[i]]
                c = look(self.keys(at[i], length[i] + step), 0)
                i, c = i[c > 0], c[c > 0]
                length[i] += step
                count[i] = c
            if path is not None:
                path.append(length.copy())
        return at, length, count


    def asked(self, bits: np.ndarray, step: int, top: int) -> Iterator[np.ndarray]:
        """Keys of all n-grams longer than WHOLE that a round's bitmap of questions holds."""
        at = np.flatnonzero(self.room >= WHOLE + max(step, 1))
        n, most = WHOLE, int(self.room[at].max(initial=0))
        if not step:  # prefixes: a text asked for all of its own; elsewhere the first tokens of the n-grams whose shorter ones were asked for
            own = self.prefixes()
            yield self.keys(own, self.room[own])
            at -= WHOLE
            inside = self.room > 1
            inside[self.starts] = ~self.lead
            at = at[inside[at]]
            at = at[alive(bits, self.keys(at + WHOLE, WHOLE + 1), PROBES)]
            yield from self.within(bits, at)
            return
        yield from self.below(bits, at, WHOLE, top, step)

    def within(self, bits: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """Keys of all prefixes that begin at these places, of which the shortest was asked for. Where a length was asked
        for, so were all shorter ones: the greatest is found by leaps."""
        room = np.repeat(self.starts + self.lengths, self.lengths)[at] - at
        n = np.full(len(at), WHOLE + 1)
        for leap in (RADIX**3, RADIX**2, RADIX, 1):
            i = np.arange(len(at))
            while len(i := i[n[i] + leap <= room[i]]):
                n[i] += leap
                on = alive(bits, self.keys(at[i] + n[i] - 1, n[i]), PROBES)
                n[i[~on]] -= leap
                i = i[on]
        n -= WHOLE
        total = np.cumsum(n)
        cut = np.flatnonzero(np.diff(total // BATCH_KEYS, prepend=-1))
        for a, e in zip(cut, np.append(cut[1:], len(at))):
            first, own = np.repeat(at[a:e], n[a:e]), np.arange(n[a:e].sum()) - np.repeat(total[a:e] - n[a:e] - (total[a] - n[a]), n[a:e])
            yield self.keys(first + own + WHOLE, own + WHOLE + 1)

    def below(self, bits: np.ndarray, at: np.ndarray, n: int, big: int, step: int) -> Iterator[np.ndarray]:
        """Keys of the n-grams ending at these places, whose n-gram is known to match in the rounds above step big: their
        longer ones are looked at by digits as questions are, so only lengths that questions came by are tested."""
        if big > step:
            yield from self.below(bits, at, n, big // RADIX, step)
        for longer in range(n + big, n + RADIX * big, big):
            at = at[self.room[at] >= longer]
            if not len(at):
                break
            k = self.keys(at, longer)
            on = alive(bits, k, PROBES)
            if big == step:
                yield k[on]
            elif on.any():
                yield from self.below(bits, at[on], longer, big // RADIX, step)


STRETCHES = "block bigint, longest bigint, lengths binary, held binary, lead binary, tokens binary, use int"


def reduced(docs: DataFrame, bits, shared) -> DataFrame:
    """STRETCHES of texts, two rows or fewer for each group of them: use 0, those of training texts, for prefixes; use 1,
    those all of whose 4-grams are in the bitmap of what held-out texts ask for and training texts have, for the digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, t in groups(b):
                marks = t.alive(bits.value, WHOLE)
                at = np.flatnonzero(marks)
                both = np.zeros(len(marks), bool)
                both[at] = alive(shared.value, t.keys(at, WHOLE, WHOLE))
                for use, on in enumerate((marks & ~t.held, both)):
                    s = Stretches.of(t, on)
                    if len(s.lengths):
                        flags = s.held[s.starts]
                        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([int(s.lengths.max())]), *(pa.array([x.tobytes()], pa.binary()) for x in (s.lengths.astype("<i8"), flags, s.lead, s.tokens.astype("<u8"))), pa.array([use], pa.int32())], names=["block", "longest", "lengths", "held", "lead", "tokens", "use"])

    return docs.mapInArrow(lean(run), STRETCHES)


def emit_long(stretches: DataFrame, step: int, steps: list[int], folders: list[str], bits, parts: int) -> DataFrame:
    """Questions of a round over stretches, and with a bitmap of them the counts it needs. Step 0 is that of prefixes.
    Without a bitmap the lengths found after each round before count as questions too, so that it holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools, known, waiting, words = Pools(parts), Known(folders), [], 0

        def count() -> Iterator[pa.RecordBatch]:
            s = Stretches(*map(np.concatenate, zip(*waiting)))
            waiting.clear()
            for k in s.asked(bits.value, step, steps[0] if steps else step):
                pools.add(0, k)
                if pools.held[0] > FLUSH_KEYS:
                    yield from pools.flush(0)

        for b in batches:
            for block, _, lengths, held, lead, tokens in zip(*(c.to_pylist() for c in b.columns[:6])):
                yield from pools.enter(block)
                own = np.frombuffer(tokens, "<u8"), np.frombuffer(lengths, "<i8"), np.frombuffer(held, bool), np.frombuffer(lead, bool)
                s = Stretches(*own)
                if not step:
                    at = s.prefixes()
                    pools.add(2, s.keys(at, s.room[at]))
                else:
                    path: list = []
                    at, length, _ = s.lifted(steps, known.of(block), path)
                    for known_to in path if bits is None else []:
                        on = known_to > WHOLE
                        pools.add(1, s.keys(at[on], known_to[on]))
                    for digit in range(1, RADIX):
                        i = length + digit * step <= s.room[at]
                        pools.add(1, s.keys(at[i], length[i] + digit * step))
                if bits is not None:
                    train = ~own[2]
                    waiting.append((own[0][~s.held], own[1][train], own[2][train], own[3][train]))
                    words += len(waiting[-1][0])
                    if words > GROUP_WORDS:
                        yield from count()
                        words = 0
        if waiting:
            yield from count()
        yield from pools.rest()

    return stretches.mapInArrow(lean(run), KEYS)


def bitmap_row(key: np.ndarray, width: int, probes: int = 1, block: int = -1) -> tuple[int, int, bytes, bytes] | None:
    """Block, the first byte and the bytes of a bitmap of keys."""
    if not len(key):
        return None
    at = np.concatenate([places(key, width, probe) for probe in range(probes)])
    low = int(at.min()) // 8
    seg = np.zeros(int(at.max()) // 8 - low + 1, np.uint8)
    np.bitwise_or.at(seg, (at >> U(3)).astype(np.int64) - low, U(1).astype(np.uint8) << (at & U(7)).astype(np.uint8))
    return block, len(key), np.array([low], "<i8").tobytes(), seg.tobytes()


def answered(rows: list[tuple]) -> pa.Table:
    c = list(zip(*rows)) if rows else [[]] * 4
    return pa.table({n: pa.array(x, k) for n, x, k in zip(("block", "n", "keys", "counts"), c, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))})


def questions(width: int):
    """A bitmap of the keys that one shard is asked for."""

    def run(table: pa.Table) -> pa.Table:
        key = [np.cumsum(unplanes(k, n, 6), dtype=U) for n, k in zip(table.column("n").to_pylist(), table.column("keys").to_pylist())]
        row = bitmap_row(np.unique(np.concatenate(key)), width, PROBES)
        return answered([row] if row else [])

    return run


def answer(width: int):
    """Answers of one shard: per block the sorted keys found and their counts; block -1 with a bitmap of the base order,
    block -2 with the number and sum of the counted keys of another order, block -3 with a bitmap of those of the base order
    that held-out texts ask for."""

    def run(table: pa.Table) -> pa.Table:
        kind_of, block_of, sizes = (table.column(x).to_numpy() for x in ("kind", "block", "n"))
        at, keys, counts = 0, np.zeros(int(sizes.sum()), U), np.zeros(int(sizes.sum()), np.uint32)
        for kind, n, k, c in zip(kind_of, sizes.tolist(), table.column("keys"), table.column("counts")):
            np.cumsum(unplanes(k.as_py(), n, 6), dtype=U, out=keys[at : at + n])
            if kind == 0:
                counts[at : at + n] = unplanes(c.as_py(), n, 4)
            at += n
        order = np.argsort(keys, kind="stable")
        key, count, of = keys[order], counts[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        kind = kind_of.astype(np.int8)[of]
        del keys, counts, order
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(count, start, dtype=np.int64)
        queried = np.maximum.reduceat((kind == 1).astype(np.int8), start) > 0
        distinct = key[start]
        base, shared = distinct & U(1) == 1, queried & (total >= 1)
        rows = [bitmap_row(distinct[base & ((total >= 2) | shared)], width), bitmap_row(distinct[base & shared], width - SHARED_BITS, 1, -3)]
        other = total[~base & (total > 0)]
        rows = [r for r in rows if r] + [(-2, len(other), np.array([int(other.sum())], "<i8").tobytes(), b"")]
        each = np.repeat(total, np.diff(np.append(start, len(key))))
        got = ((kind == 1) & (each >= 1)) | ((kind == 2) & (each >= 2))
        key, each, block = key[got], each[got], block_of[of[got]]
        order = np.argsort(block, kind="stable")
        key, each, block = key[order], each[order], block[order]
        at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
        for a, e in zip(at, np.append(at[1:], len(block)) if len(block) else []):
            rows.append((int(block[a]), int(e - a), planes(np.diff(key[a:e], prepend=U(0)), 6), planes(each[a:e], 5)))
        return answered(rows)

    return run


class Known:
    """Answers from the shared folder, of one block at a time."""

    def __init__(self, folders: list[str]):
        self.folders, self.block, self.key, self.count = folders, None, None, None

    def of(self, block: int) -> Callable[[np.ndarray, int], np.ndarray]:
        """look(keys, default) gives counts."""
        from pyarrow import fs

        if self.block != block or self.key is None:
            keys, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for folder in self.folders:
                target, path = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
                for f in target.get_file_info(fs.FileSelector(f"{path}/block={block}", allow_not_found=True)):
                    if f.path.endswith(".parquet"):
                        t = pq.ParquetFile(target.open_input_file(f.path)).read()
                        for n, k, c in zip(*(t.column(x).to_pylist() for x in ("n", "keys", "counts"))):
                            keys.append(np.cumsum(unplanes(k, n, 6), dtype=U))
                            counts.append(unplanes(c, n, 5).astype(np.int64))
            key, count = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            self.block = block
            self.set(key[order], count[order])
        return self.look

    def set(self, key: np.ndarray, count: np.ndarray) -> None:
        """Sorted keys with their counts, and where those of the same first bits begin."""
        width = max(1, len(key).bit_length() - 1)
        self.shift = U(48 - width)
        n = np.bincount((key >> self.shift).astype(np.int64), minlength=1 << width)
        self.key, self.count, self.first = np.append(key, U(2**48)), np.append(count, 0), np.append(0, np.cumsum(n)).astype(np.int32)

    def look(self, keys: np.ndarray, default: int) -> np.ndarray:
        """Keys are hashes: their first bits lead to within a few places of where they are."""
        at = self.first[(keys >> self.shift).astype(np.int64)]
        on = np.flatnonzero(self.key[at] < keys)
        while len(on):
            at[on] += 1
            on = on[self.key[at[on]] < keys[on]]
        return np.where(self.key[at] == keys, self.count[at], default)


def score_texts(t: Texts, look: Callable, marks: list, steps: list[int], n_all: int, n_types: int) -> list[np.ndarray]:
    """(tokens, those with a count, base score, score) of each text; marks are the bitmaps after the rounds."""
    every = np.arange(len(t.tokens))
    c = look(t.keys(every, 1, 2), 0)
    c[~t.held] = np.maximum(c[~t.held], 1)
    p = (c + 1) / (n_all + n_types + 1)
    # Length and count of the longest n-gram that ends at each token and occurs in training.
    length, count = np.where(t.held, 0, t.room), np.where(t.held, 0, 1)
    found = (c > 0) & (t.held | (t.room == 1))
    length[found], count[found] = 1, c[found]
    for depths, bits in zip(([2], [3, 4]), (None, *marks)):
        before = t.alive(bits, depths[0] - 1) if bits is not None else None
        for d in depths:
            at = np.flatnonzero(ends(t, d, before, depths[0] - 1) & (t.held | (t.room == d)))
            x = look(t.keys(at, d, d // 2 * 2), 0)
            at, x = at[x > 0], x[x > 0]
            length[at], count[at] = d, x
    if len(marks) == 2:
        s = Stretches.of(t, t.alive(marks[1], WHOLE))
        at = s.prefixes()
        count[s.at[at]] = look(s.keys(at, s.room[at]), 1)
        at, m, x = s.lifted(steps, look)
        at, m, x = s.at[at[x > 0]], m[x > 0], x[x > 0]
        length[at], count[at] = m, x
    context, both = np.append(0, count[:-1]), np.where(length == np.append(0, length[:-1]) + 1, count, 0)
    prob = np.where((t.room > 1) & (context > 0), (both + MU * p) / (context + MU), p)
    return [t.lengths, *(np.add.reduceat(x, t.starts) for x in ((c > 0).astype(np.int64), np.log10(p), np.log10(prob)))]


def ngram_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = located(docs.select(docs[id_col].alias("id"), docs[text_col].alias("__text")))
    rows = docs.select(F.xxhash64("__loc.file", F.floor(docs["__loc.row"] / BLOCK_ROWS)).bitwiseAND(F.lit(2**63 - 1)).alias("block"), (fold(docs["id"], folds) == held_fold).alias("held"), "__text", "id")
    mass = rows.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    width = min(MOST_BITS, max(LEAST_BITS, (mass // 6).bit_length() + 1))
    parts = max(shuffle_partitions(spark), int(mass / 6 * 2 / PART_KEYS))
    folders: list[str] = []
    spread = F.when(F.col("block").isin(-1, -3), F.pmod(F.xxhash64("keys"), F.lit(BITMAP_FILES))).otherwise(0)

    def told(keys: DataFrame, rule: Callable, width: int = width) -> str:
        folder = f"{scratch_dir(spark)}/round"
        keys.groupBy("part").applyInArrow(lean_group(rule(width)), ANSWERS).repartition("block", spread).write.partitionBy("block").parquet(folder)
        release(spark)
        return folder

    def drop(folder: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def bitmap(folder: str, width: int = width, block: int = -1):
        """A broadcast of the round's bitmap, None if it is empty. Its rows are read once and then deleted."""
        out = np.zeros(1 << (width - 3), np.uint8)
        for r in special(spark, folder, block).toLocalIterator():
            low, seg = int(np.frombuffer(r["keys"], "<i8")[0]), np.frombuffer(r["counts"], np.uint8)
            out[low : low + len(seg)] |= seg
        drop(f"{folder}/block={block}")
        return spark.sparkContext.broadcast(out) if out.any() else None

    marks: list = []
    n_types = n_all = 0
    for depths in ladder(WHOLE)[:2]:
        folders.append(told(emit(rows, depths, marks[-1] if marks else None, parts), answer))
        if not marks:
            for r in special(spark, folders[0], -2).toLocalIterator():
                n_types, n_all = n_types + r["n"], n_all + int(np.frombuffer(r["keys"], "<i8")[0])
            drop(f"{folders[0]}/block=-3")
        found = bitmap(folders[-1])
        if found is None:
            break
        marks.append(found)
    steps: list[int] = []
    if len(marks) == 2:
        store, long_folders = f"{scratch_dir(spark)}/stretches", []
        shared = bitmap(folders[1], width - SHARED_BITS, -3) or spark.sparkContext.broadcast(np.zeros(1 << (width - SHARED_BITS - 3), np.uint8))
        reduced(rows, marks[1], shared).write.partitionBy("use").parquet(store)
        shared.destroy()
        left = spark.read.schema(STRETCHES).parquet(store)
        sizes = {use: (longest, size) for use, longest, size in left.groupBy("use").agg(F.max("longest"), F.sum(F.octet_length("tokens"))).collect()}
        longest = sizes.get(1, (0, 0))[0]
        for step in [0, *reversed([RADIX**i for i in range(longest.bit_length()) if RADIX**i <= longest - WHOLE])]:
            use = int(step > 0)
            own, small = left.where(F.col("use") == use), min(width, max(LEAST_BITS, (sizes.get(use, (0, 0))[1] // 8).bit_length() + 2 + use))
            asked = bitmap(told(emit_long(own, step, steps, long_folders, None, parts), questions, small), small)
            if asked is not None:
                folders.append(told(emit_long(own, step, steps, long_folders, asked, parts), answer))
                long_folders = [*long_folders, folders[-1]] if step else []
                asked.destroy()
            steps = [*steps, step] if step else steps
            drop(f"{store}/use=0")  # only the prefixes need them
        drop(store)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(folders)
        for b in batches:
            if not b.num_rows:
                continue
            out = [score_texts(t, known.of(block), [m.value for m in marks], steps, n_all, n_types) for block, t in groups(b)]
            n, c, base, score = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(1), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(np.full(len(n), n_all), pa.int64()), pa.array(base), pa.array(score)], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def special(spark: SparkSession, folder: str, block: int) -> DataFrame:
    """A round's rows that answer no block."""
    return spark.read.schema("n bigint, keys binary, counts binary, block bigint").parquet(folder).where(F.col("block") == block)


def op7_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
