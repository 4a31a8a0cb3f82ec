"""An append-only operation log replayed as a stream: in order, once, into a table of current values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "lsn bigint, generation bigint, key bigint, value double, crc bigint"


def record_crc() -> Column:
    return F.crc32(F.concat_ws("|", "lsn", "generation", "key", "value").cast("binary"))


def replay(spark: SparkSession, folder: str, state: str, generation: int) -> DataFrame:
    """The last value per key of the log's whole records of a generation.

    Each batch appends its records, idempotently by batch number; the result stops before the first torn record."""
    stream = spark.readStream.schema(SCHEMA).json(folder)

    def add(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/log/batch={n}")

    stream.writeStream.option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    log = spark.read.schema(SCHEMA).parquet(f"{state}/log").where(F.col("generation") == generation)
    torn = log.where(~F.col("crc").eqNullSafe(record_crc())).agg(F.min("lsn").alias("torn"))
    good = log.join(F.broadcast(torn)).where(F.col("torn").isNull() | (F.col("lsn") < F.col("torn")))
    return good.groupBy("key").agg(F.max_by("value", "lsn").alias("value"), F.max("lsn").alias("lsn"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per event-time window and type, for a stream or a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
