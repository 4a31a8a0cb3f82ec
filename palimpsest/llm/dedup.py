"""Operator 4: exact deduplication as a stateful stream over a digest log.

Each batch of documents adds (digest, identifier, content locator) rows to a log. A streaming aggregation keyed by
digest keeps, without expiry and in disk-backed (RocksDB) state, how many rows had that digest and the identifier and
locator of the row to keep. Full bytes are checked on hits: the texts of digests that more than one row has are read
again, and one aggregation over (digest, text), combined before it shuffles so a hot group leaves each task as one row,
finds digests that stand for more than one text; such rows are regrouped by their text. Up to BROADCAST_KEYS such digests
are broadcast, so texts of other rows never leave their task.

Cases: null text equals empty text; of equal texts the row with the largest id stays, of several rows with that id the
one that lies last (file, row), so one row always stays; a null id is smaller than any other; an empty table gives no
rows; other columns are ignored, whatever their names. Texts are compared byte for byte without normalisation.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import located, saved, scratch_dir

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}
#: Digests of hits up to which they are broadcast (8 bytes of each); more are joined by shuffle.
BROADCAST_KEYS = 500_000
LOG_SCHEMA = "key binary, sha binary, id {id}, file string, row bigint"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextmanager
def session_conf(spark: SparkSession, conf: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class DedupState:
    """A digest log and the keyed state over it, both in folder; documents may arrive in any number of batches."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint", digest: Callable[[Column], Column] = sha256):
        self.spark, self.folder, self.digest = spark, folder, digest
        self.schema = LOG_SCHEMA.format(id=id_type)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Appends rows that carry __loc (see located) to the log and streams what is new into the state."""
        text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
        log = docs.select(self.digest(text).alias("key"), sha256(text).alias("sha"), docs[id_col].alias("id"), docs["__loc.file"].alias("file"), docs["__loc.row"].alias("row"))
        log.write.mode("append").parquet(f"{self.folder}/log")
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/log")
        seen = stream.groupBy("key").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("n"))

        def emit(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.folder}/groups/batch={batch_id}")

        with session_conf(self.spark, STATE_CONF):
            query = seen.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).foreachBatch(emit).start()
            query.awaitTermination()

    def log(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/log")

    def groups(self) -> DataFrame:
        """key, keep (id, file, row) and n, as of the last batch; both only ever grow."""
        schema = f"key binary, keep struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in self.log().schema if f.name in ('id', 'file', 'row'))}>, n bigint"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/groups").groupBy("key").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, with_loc: bool = False) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256 (and __loc, if asked)."""
    spark = docs.sparkSession
    docs = located(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    state = DedupState(spark, scratch_dir(spark), docs.schema["id"].dataType.simpleString(), digest)
    state.add(docs, "id", "text")

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(digest(text).alias("key"), text.alias("text"), "id", docs["__loc.file"].alias("file"), docs["__loc.row"].alias("row"))
    many = saved(state.groups().where("n > 1"), "hits")
    hits = many.select(F.xxhash64("key").alias("short")).distinct()
    rows = rows.join(F.broadcast(hits) if hits.count() <= BROADCAST_KEYS else hits, F.xxhash64("key") == F.col("short"), "left_semi")
    texts = rows.groupBy("key", "text").agg(F.count("*").alias("n"))
    collided = texts.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key").checkpoint()

    log = state.log()
    if collided.isEmpty():
        named = log.join(many, "key", "left")
    else:
        own = rows.join(collided, "key", "left_semi")
        by_text = own.groupBy("key", "text").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("n"))
        own = own.join(by_text, ["key", "text"]).select("file", "row", "keep", "n")
        split = log.join(collided, "key", "left_semi").join(own, ["file", "row"]).select(*log.columns, "keep", "n")
        named = log.join(collided, "key", "left_anti").join(many, "key", "left").unionByName(split)
    alone = F.col("keep").isNull()
    same = (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))
    out = [
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | same).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    ]
    return named.select(*out, *[F.struct("file", "row").alias("__loc")] * with_loc)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
