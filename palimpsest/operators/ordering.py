"""Global order without a single task: ranges, ranks inside them, and an offset per range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.storage import saved


def global_rank(df: DataFrame, keys: list[Column], name: str = "rank", start: int = 1, weight: Column | None = None) -> DataFrame:
    """df with its position in the order of keys, or with the running sum of weight before and including each row.

    The rows are range-partitioned and sorted once and written, so partition numbers and places in files hold: a position
    is the place in its file and what lies before the file, and only running sums of weight shuffle the rows again. What
    reaches the driver is one number per partition. Keys should be unique; rows with equal keys get an arbitrary order
    among themselves.
    """
    spark = df.sparkSession
    if weight is None:
        ranged = df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(*keys)
        part = saved(ranged, "ranged")
        place = part.metadataColumn("_metadata")
        part = part.select("*", place.getField("file_name").alias("__file"), place.getField("row_index").alias("__row"))
        sums = [(r["__file"], r["n"]) for r in sorted(part.groupBy("__part", "__file").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["__part"], len(r["__file"]), r["__file"]))]
        offsets = spark.createDataFrame(_before(sums, start), "__file string, __at bigint")
        return part.join(F.broadcast(offsets), "__file").withColumn(name, F.col("__row") + F.col("__at") + 1).drop("__part", "__file", "__row", "__at")
    part = saved(df.withColumn("__step", weight.cast("bigint")).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "ranged")
    sums = sorted((r["__part"], r["n"]) for r in part.groupBy("__part").agg(F.sum("__step").alias("n")).collect())
    offsets = spark.createDataFrame(_before(sums, start), "__part int, __at bigint")
    within = F.sum("__step").over(Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return part.join(F.broadcast(offsets), "__part").withColumn(name, within + F.col("__at")).drop("__part", "__at", "__step")


def _before(sums: list[tuple], start: int) -> list[tuple]:
    """(part, what comes before its first row) from (part, its sum) in order."""
    rows, at = [], start - 1
    for p, n in sums:
        rows.append((p, at))
        at += n or 0
    return rows
