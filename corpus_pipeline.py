"""The corpus pipeline: stages over documents, each an operator of palimpsest.llm.

Each stage takes (spark, docs, sf_dir); all but the last return rows of docs with its columns. Rows are told apart by
where they lie in the stage's input, so repeated or null ids never make a stage drop more than its decision. Extra
columns of documents are carried along. Null and empty texts have no letter and go in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import fold, located, numbered, saved, scanned
from palimpsest.llm.dedup import exact_dedup
from palimpsest.llm.jaccard import jaccard_groups
from palimpsest.llm.langid import fit, scored
from palimpsest.llm.mixing import Mix
from palimpsest.llm.packing import pack

#: A document whose language is less likely than this is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or with an uncertain language; learns from four of five documents' labels."""
    model = fit(docs.where(fold("doc_id", 5) != 0))
    known = scored(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return known.drop("lang_pred", "score").toDF(*docs.columns)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs, a file scan, without the rows at the places in dropped."""
    return located(numbered(docs)).join(dropped, "__loc", "left_anti").drop("__loc").toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text stays, that with the largest doc_id."""
    docs = scanned(docs)
    found = exact_dedup(docs, with_loc=True)
    return without(docs, found.where(~F.col("kept")).select("__loc").checkpoint())


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 3-word shingle Jaccard >= 0.7 stays, the first by (doc_id, place)."""
    docs = scanned(docs)
    placed = located(docs.select("doc_id", "text")).select(F.struct("doc_id", F.col("__loc.file").alias("file"), F.col("__loc.row").alias("row")).alias("doc"), "text")
    groups = jaccard_groups(placed, "doc")
    dropped = groups.where(F.col("component_id") != F.col("doc")).select(F.struct("doc.file", "doc.row").alias("__loc"))
    return without(docs, dropped.checkpoint())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return Mix(docs).apply(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of up to 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", packing)]
#: Hashes select documents and tokenizers make ids, which SQL can't express; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = saved(docs)
    return docs
