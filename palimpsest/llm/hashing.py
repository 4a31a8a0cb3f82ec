"""Vectorised 64-bit hashes of words and word shingles over UTF-8 bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes hashed at once; words may span blocks.
BLOCK = 1 << 18
_rng = np.random.default_rng(20240229)
TABLE = _rng.integers(1, 2**64 - 1, 256, dtype=U)
TABLE[65:91] = TABLE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
POWER = np.multiply.accumulate(np.concatenate([[U(1)], np.full(BLOCK, BASE, U)]))
INVERSE = np.multiply.accumulate(np.concatenate([[U(1)], np.full(BLOCK, pow(BASE, -1, 2**64), U)]))
PLACES = _rng.integers(1, 2**64 - 1, 64, dtype=U) | U(1)
#: Bytes of texts that are hashed end to end, and of a word that are read by eights.
JOINED, EIGHTS = 1 << 21, 64
GAP, GAPS = SPACE.tobytes(), re.compile(rb"[\t-\r ]")
#: Masks of the first bytes of eight.
FIRST = np.array([2 ** (8 * n) - 1 for n in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of each maximal run of bytes other than ASCII white space, A-Z taken as a-z."""
    out: list[np.ndarray] = []
    carry, carried = 0, 0  # a word that the last block broke off: its sum and length
    for at in range(0, len(text), BLOCK):
        b = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at)
        gap = SPACE[b]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        if not gap[-1]:
            edge = np.concatenate([edge, [len(b)]])
        start, end = edge[0::2], edge[1::2]
        total = np.zeros(len(b) + 1, U)
        np.cumsum(TABLE[b] * POWER[: len(b)], out=total[1:])
        raw, n = (total[end] - total[start]) * INVERSE[start], (end - start).astype(U)
        if carried and gap[0]:
            out.append(mix(np.array([(carry + carried) % 2**64], U)))
        elif carried:
            raw[0] = U((pow(BASE, carried, 2**64) * int(raw[0]) + carry) % 2**64)
            n[0] += U(carried)
        carry = carried = 0
        if not gap[-1] and at + len(b) < len(text):
            carry, carried = int(raw[-1]), int(n[-1])
            raw, n = raw[:-1], n[:-1]
        out.append(mix(raw + n))
    return np.concatenate(out) if out else np.zeros(0, U)


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """A text cut at white space, into pieces of that many bytes and the word they end in."""
    at = 0
    while len(text) - at > most and (gap := GAPS.search(text, at + most)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def joined_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, as word_hashes cuts them but of other values, laid end to end, and each text's number."""
    lengths = np.array([len(x) for x in texts])
    if lengths.sum() > JOINED and (len(texts) > 1 or GAPS.search(texts[0], JOINED)):
        each = [[joined_hashes([x])[0] for x in pieces(text, JOINED // 2)] for text in texts]
        return np.concatenate([x for parts in each for x in parts]), np.array([sum(map(len, parts)) for parts in each])
    data = b" ".join([b"", *texts, b" " * 8])
    gap = np.frombuffer(data.translate(GAP), bool)
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    data = data.lower()
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = mix((eights[start] & FIRST[np.minimum(size, 8)]) + size.astype(U) * PLACES[0])
    at = np.arange(len(start))
    for more in range(8, EIGHTS, 8):
        at = at[size[at] > more]
        if not len(at):
            break
        out[at] = mix(out[at] * PLACES[1] + (eights[start[at] + more] & FIRST[np.minimum(size[at] - more, 8)]))
    at = at[size[at] > EIGHTS]
    if len(at):
        out[at] = word_hashes(b" ".join(data[i : i + n] for i, n in zip(start[at].tolist(), size[at].tolist())))
    return out, np.diff(np.searchsorted(start, np.append(np.cumsum(lengths + 1) - lengths, len(data))))


def shingle_set(text: bytes, k: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words the whole sequence is one; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < k:
        return mix(np.array([int((w * PLACES[: len(w)]).sum()) + len(w) & 2**64 - 1], U))
    h = w[: len(w) - k + 1] * PLACES[0]
    for i in range(1, k):
        h += w[i : len(w) - k + 1 + i] * PLACES[i]
    return np.unique(mix(h))
