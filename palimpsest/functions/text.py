"""Record text: content extraction, PII rule, quality, byte-exact search and replace, units."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.storage import small_batches, trim

UNIT = "[A-Za-z0-9_]+|[^A-Za-z0-9_]+"
#: Up to four distinct characters.
FEW = r"(?s)^(.)\1*+(?:(.)(?:\1|\2)*+(?:(.)(?:\1|\2|\3)*+(?:(.)(?:\1|\2|\3|\4)*+)?)?)?$"
#: Distinct pairs a task counts before it passes them on.
PAIRS_HELD = 500_000


def display(raw: Column) -> Column:
    """Bytes as text, invalid UTF-8 replaced."""
    return F.make_valid_utf8(raw.cast("string"))


def content(raw: Column, field: str = "text") -> Column:
    """The field of a JSON record, if it is there and not null, else the whole line. Strings come as they are, other
    values as JSON text with sorted keys. Records whose field may be another value than a string are parsed in Python;
    all others stay in the JVM: Python is called for every row, whatever the condition around it, so they reach it as null."""
    text = display(raw)

    @F.pandas_udf("string")
    def parsed(s: pd.Series) -> pd.Series:
        def value(line: str | None) -> str | None:
            try:
                v = json.loads(line)[field]
            except (ValueError, TypeError, KeyError):
                return line
            return v if isinstance(v, str) else line if v is None else json.dumps(v, sort_keys=True)

        try:
            return s.map(value)
        finally:
            trim()

    small_batches(SparkSession.active())
    found = F.get_json_object(F.when(F.trim(text).startswith("{"), text), f"$.{field}")
    other = found.rlike(r"(?s)^(?:[\[{].*|true|false|-?[0-9][0-9.eE+-]*)$")
    return F.when(F.coalesce(other, F.lit(False)), parsed(F.when(other, text))).otherwise(F.coalesce(found, text))


def glued(parts: str, field: str) -> Column:
    """The bytes of a field of an array of structs, joined in order."""
    return F.unhex(F.array_join(F.transform(F.col(parts), lambda p: F.hex(p[field])), ""))


def content_raw(raw: Column) -> Column:
    """The value of the first "text" key that a quoted string follows, still escaped, else the whole record. It ends at
    the first quote without a backslash before it; an unterminated value runs to the end."""
    text = display(raw)
    pattern = r'(?s)"text"[ :]*"((?:[^"]*+(?<=\\)")*+[^"]*+)'
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def has_pii(text: Column) -> Column:
    """An @ inside the text with a dot after it, or nine digits in a row."""
    mail = text.rlike("(?s)^.+@.+$") & (F.instr(F.substr(text, F.instr(text, "@")), ".") > 0)
    return text.rlike("[0-9]{9,}") | mail


def byte_offsets(raw: Column, needle: bytes) -> Column:
    """All overlapping byte offsets of needle, ascending; none for an empty needle. Rows without it never leave the JVM;
    the others are searched in Arrow batches, which beats comparing at every position in an interpreted expression."""
    none = F.expr("cast(array() as array<int>)")
    if not needle:
        return none

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        def hits(data: bytes) -> list[int]:
            out, at = [], data.find(needle)
            while at >= 0:
                out.append(at)
                at = data.find(needle, at + 1)
            return out

        return s.map(lambda x: hits(bytes(x)) if x is not None else [])

    return F.when(F.contains(raw, F.lit(bytearray(needle))), run(raw)).otherwise(none)


def occurrences(text: Column, old: str) -> Column:
    """Number of non-overlapping occurrences, left to right."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(old)))) / len(old.encode())).cast("bigint")


def quality(df: DataFrame, raw: str) -> DataFrame:
    """n, min/max/mean byte length, empty, short (under 10) and repetitive (10 or more bytes, under 5 distinct) records."""
    size = F.octet_length(raw)
    few = lambda c: F.decode(c, "ISO-8859-1").rlike(FEW)
    head = F.substr(F.col(raw).cast("binary"), F.lit(1), F.lit(64))
    repetitive = F.when(few(head), few(F.col(raw).cast("binary"))).otherwise(F.lit(False))
    return df.agg(
        F.count("*").alias("n"), F.min(size).alias("min_bytes"), F.max(size).alias("max_bytes"), F.floor(F.sum(size) / F.count("*")).alias("mean_bytes"),
        F.count_if(size == 0).alias("empty"), F.count_if((size > 0) & (size < 10)).alias("short"), F.count_if((size >= 10) & repetitive).alias("repetitive"),
    )


def units(text: Column) -> Column:
    """Maximal runs of word and of other characters; joined they give the text."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def pair_counts(df: DataFrame, text: str) -> DataFrame:
    """Frequency of adjacent unit pairs (a, b, n) inside rows: each task cuts its texts once and adds pairs up before
    they are shuffled. Null has none."""
    cut = re.compile(UNIT).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            a, b = zip(*counts) if counts else ((), ())
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(counts.values(), pa.int64())], names=["a", "b", "n"])
            counts.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    u = cut(t)
                    counts.update(zip(u, u[1:]))
                    if len(counts) > PAIRS_HELD:
                        yield flush()
        yield flush()

    return df.select(F.col(text).cast("string")).mapInArrow(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def fnv1a(df: DataFrame, raw: str, out: str = "fnv") -> DataFrame:
    """The 64-bit FNV-1a hash of a binary column as an unsigned decimal, vectorised over rows, one byte position at a time."""
    @F.pandas_udf("decimal(20,0)")
    def run(s: pd.Series) -> pd.Series:
        from decimal import Decimal

        order = s.map(len).to_numpy().argsort(kind="stable")[::-1]
        data = [np.frombuffer(s.iloc[i], np.uint8) for i in order]
        sizes = np.array([len(d) for d in data])
        flat, start = np.concatenate(data) if len(data) else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h = np.full(len(data), 14695981039346656037, np.uint64)
        live = len(data)
        for at in range(int(sizes.max()) if len(sizes) else 0):
            while live and sizes[live - 1] <= at:
                live -= 1
            h[:live] = (h[:live] ^ flat[start[:live] + at]) * np.uint64(1099511628211)
        result = np.empty(len(data), object)
        result[order] = [Decimal(int(x)) for x in h]
        return pd.Series(result)

    return df.withColumn(out, run(F.coalesce(F.col(raw).cast("binary"), F.lit(bytearray()))))
