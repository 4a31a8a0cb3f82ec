"""Scratch storage that all executors share, and cutting of lineage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Arrow batches of at most so many rows and bytes, unless the session has its own settings: whole texts make them
    large, and Spark's 10,000 rows are held by the JVM and by Python at once."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


@cache
def libc():
    try:
        return ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None
    except (OSError, TypeError):
        return None


def trim() -> None:
    """Returns freed memory to the system. Python workers live on between tasks and would keep the peak of each."""
    pa.default_memory_pool().release_unused()
    if libc() is not None:
        libc().malloc_trim(0)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor shares. The setting is read from the session; only a
    local master may lack it, and there a temporary folder is set once."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="scratch-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class Parts:
    """A table that only grows: each addition is written once, and many small parts are merged into one."""

    MOST = 16

    def __init__(self, empty: DataFrame):
        self.schema, self.spark = empty.schema, empty.sparkSession
        #: (rows, the name of their copy in a store or None).
        self.parts: list[tuple[DataFrame, str | None]] = []

    def all(self) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema)
        for rows, _ in self.parts:
            out = out.unionByName(rows)
        return out

    def add(self, rows: DataFrame) -> DataFrame:
        rows = saved(rows.select(*self.schema.names), "part")
        self.parts.append((rows, None))
        fresh = [i for i, (_, name) in enumerate(self.parts) if name is None]
        if len(fresh) > self.MOST:
            merged = self.parts[fresh[0]][0]
            for i in fresh[1:]:
                merged = merged.unionByName(self.parts[i][0])
            self.parts = [p for p in self.parts if p[1] is not None] + [(saved(merged, "part"), None)]
        return rows

    def replace(self, rows: DataFrame) -> None:
        self.parts = [(saved(rows.select(*self.schema.names), "part"), None)]

    def store(self, path: str, codec: str = "zstd") -> list[str]:
        """Writes what path lacks and returns the names of all parts, for a commit."""
        for i, (rows, name) in enumerate(self.parts):
            if name is None or not name.startswith(f"{path}/"):
                name = f"{path}/part-{uuid.uuid4().hex}"
                rows.write.option("compression", codec).parquet(name)
                self.parts[i] = (rows, name)
        return [name.rpartition("/")[2] for _, name in self.parts]

    def load(self, path: str, names: list[str]) -> Parts:
        self.parts = [(self.spark.read.schema(self.schema).parquet(f"{path}/{n}"), f"{path}/{n}") for n in names]
        return self


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet to shared scratch storage and read back."""
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
