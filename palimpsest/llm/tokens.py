"""Operator 2: token counts with a whole-token shortcut, and the token ids that packing uses.

Offline proof: every vocabulary string that the tokenizer encodes, alone, as exactly one token is listed once on the
driver (the list is bounded by the vocabulary). Texts are cut at ASCII white space, which no token of a recognised
tokenizer crosses, and each distinct piece into pre-tokens; pre-tokens on the list count one directly and only the
rest go through the merges. Pieces already seen are remembered by each worker in a table of bounded size.

Tokenizers whose pipeline is not recognised, and sentencepiece models, are run whole by their library.
Cases: null and empty text count 0; text_col of any length is read whole; repeated rows each give a row; extra
columns, whatever their names, are ignored unless listed in keep.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import binary_column, small_batches

#: Entries a worker remembers before it forgets all but the proven list.
MEMO = 600_000
ASCII_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Pieces of printable ASCII and Latin letters, in which normalisation is lower-casing alone; others go to the library whole.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
CONTROL = re.compile(rb"[^!-~]")
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u017e]+")
_state: dict[str, Encoder] = {}


def splits_at_space(path: str) -> bool:
    """Whether the tokenizer file drops white space and lower-cases before merging word by word (the recognised pipeline)."""
    if not path.endswith(".json"):
        return False
    with open(path) as f:
        t = json.load(f)
    norm = [x["type"] for x in (t.get("normalizer") or {}).get("normalizers", [])]
    pre = (t.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (
        norm == ["NFC", "Replace", "Lowercase"] and t["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
        and len(pre) == 2 and pre[0]["type"] == "Split" and pre[0]["pattern"] == {"Regex": pattern} and pre[0]["invert"] and not pre[1]["add_prefix_space"]
        and not any(set(x["content"]) & set(" \t\n\r\v\f") or x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in t["added_tokens"])
    )


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def prove_whole_tokens(path: str) -> dict[bytes, int]:
    """Lower-case ASCII vocabulary strings, as one pre-token, that encode alone as one token, with that token's id."""
    t, end = load(path), json.load(open(path))["model"]["end_of_word_suffix"]
    names = [v[: -len(end)] for v in t.get_vocab(with_added_tokens=False) if v.endswith(end)]
    names = [v for v in names if v.isascii() and (m := ASCII_WORDS.match(v.encode())) and m.end() == len(v)]
    return {v.encode(): e.ids[0] for v, e in zip(names, t.encode_batch(names, add_special_tokens=False)) if len(e.ids) == 1}


class Words(dict):
    """Packed ids of plain pre-tokens: the proven ones from the start, others merged when first asked for."""

    def __init__(self, tok, proven: dict[bytes, int]):
        super().__init__()
        self.tok, self.start = tok, {w: struct.pack("<I", i) for w, i in proven.items()}
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in kept]
        self.names = {**{b: chr(b) for b in kept}, **{b: chr(256 + n) for n, b in enumerate(moved)}}
        self.update(self.start)

    def __missing__(self, w: bytes) -> bytes:
        if len(self) > MEMO:
            self.clear()
            self.update(self.start)
        name = w.decode() if w.isascii() else w.decode("latin-1").translate(self.names)
        ids = [t.id for t in self.tok.model.tokenize(name)]
        self[w] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


class Encoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids, or counts them."""

    def __init__(self, path: str, proven: dict[bytes, int] | None):
        self.path, self.known, self.tok = path, proven is not None, load(path)
        self.batch = getattr(self.tok, "encode_batch_fast", None) or getattr(self.tok, "encode_batch", None)
        if self.known:
            self.special = [s.content.encode() for s in self.tok.get_added_tokens_decoder().values()]
            self.words = Words(self.tok, proven)
            self.memo: dict[bytes, bytes] = {}

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        if self.path.endswith(".model"):
            ids = self.tok.encode(texts, num_threads=1)
        else:
            ids = [e.ids for e in self.batch(texts, add_special_tokens=False)]
        return [struct.pack(f"<{len(x)}I", *x) for x in ids]

    def _learn(self, pieces: set[bytes], special: bool) -> None:
        """Adds distinct pieces to the memo: plain ones by pre-token, others (and special strings) by the library."""
        memo, word, whole, ascii_ = self.memo, self.words.__getitem__, [], []
        if special:
            whole = [p for p in pieces if any(s in p for s in self.special)]
            pieces = pieces.difference(whole)
        for p in pieces:
            if p.isascii():
                ascii_.append(p)
            elif PLAIN.fullmatch(t := p.decode("utf-8", "replace")):
                memo[p] = b"".join([word(w.encode()) for w in LATIN_WORDS.findall(t.lower())])
            else:
                whole.append(p)
        if CONTROL.search(b"".join(ascii_)):
            whole += [p for p in ascii_ if CONTROL.search(p)]
            ascii_ = [p for p in ascii_ if not CONTROL.search(p)]
        split = ASCII_WORDS.findall
        for p in ascii_:
            memo[p] = b"".join(map(word, split(p.lower())))
        if whole:
            memo.update(zip(whole, self._merge(whole)))

    def encode(self, text: bytes) -> bytes:
        if not self.known:
            return self._merge([text])[0]
        pieces, memo = text.split(), self.memo
        try:
            return b"".join(map(memo.__getitem__, pieces))
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            self._learn({p for p in pieces if p not in memo}, any(s in text for s in self.special))
            return b"".join(map(memo.__getitem__, pieces))

    def count(self, text: bytes) -> int:
        return len(self.encode(text)) // 4


def encoder(path: str, proven: dict[bytes, int] | None) -> Encoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    if path not in _state:
        _state[path] = Encoder(path, proven)
    return _state[path]


def proof(spark: SparkSession, path: str):
    """The broadcast proof for a recognised tokenizer, at most as long as its vocabulary; None for others."""
    return spark.sparkContext.broadcast(prove_whole_tokens(path) if splits_at_space(path) else None)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    small_batches(docs.sparkSession)
    known = proof(docs.sparkSession, tokenizer)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, known.value)
        for b in batches:
            texts = binary_column(b, "__text")
            n = [enc.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    cols = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("__text"))
    return cols.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
