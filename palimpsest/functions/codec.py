"""Column codecs: compressed bytes, bitmaps of row validity, exact residuals of quantised numbers."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.storage import small_batches, trim


def _each(fn: Callable[[bytes], bytes]):
    """A column function of bytes, null staying null; batches are bounded in bytes and their memory is given back."""
    small_batches(SparkSession.active())

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        try:
            return s.map(lambda x: None if x is None else fn(bytes(x)))
        finally:
            trim()

    return run


def compress(raw: Column, level: int = 6) -> Column:
    """LZ-compressed bytes; null stays null."""
    return _each(lambda x: zlib.compress(x, level))(raw.cast("binary"))


def decompress(data: Column) -> Column:
    """The bytes before compression."""
    return _each(zlib.decompress)(data)


def bitmaps(rows: DataFrame, row_id: str, live: Column, size: int = 1 << 16) -> DataFrame:
    """(block, bits): a bit per row id, lowest first, size ids a block; ids without a row are 0."""
    each = rows.select(F.floor(F.col(row_id) / size).cast("bigint").alias("block"), (F.col(row_id) % size).cast("int").alias("at"), live.alias("live"))

    def run(table: pa.Table) -> pa.Table:
        bits = np.zeros(size, bool)
        bits[table.column("at").to_numpy()] = table.column("live").fill_null(False).to_numpy(zero_copy_only=False)
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return each.groupBy("block").applyInArrow(run, "block bigint, bits binary")


def live_ids(bits: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(row_id): the ids whose bit is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
                yield pa.RecordBatch.from_arrays([pa.array(at + block * size)], names=["row_id"])

    return bits.select("block", "bits").mapInArrow(run, "row_id bigint")


def residual(x: Column, near: Column) -> Column:
    """The bits in which a double differs from its quantised value."""
    @F.pandas_udf("bigint")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(a.to_numpy(np.float64).view(np.int64) ^ b.to_numpy(np.float64).view(np.int64))

    return run(x.cast("double"), near.cast("double"))


def restore(near: Column, bits: Column) -> Column:
    """The double from its quantised value and the residual."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((a.to_numpy(np.float64).view(np.int64) ^ b.to_numpy(np.int64)).view(np.float64))

    return run(near.cast("double"), bits)
