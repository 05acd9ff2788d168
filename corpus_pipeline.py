"""From raw documents to packed training sequences, in four stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read back as the next one's ``docs``.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import jaccard_join, lsa_decontaminate, packing, quality
from docweave.llm.common import settle, table
from docweave.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Bytes of rows that travel to Python at once.  Spark's own bounds, 10,000 rows and 64 MB, put
#: most of a partition of long texts into one batch, which JVM and Python then hold at once.
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go; a null or empty text has no words, so it goes.  Rows are judged each, whatever their ids; an empty table gives none; other columns are left out."""
    bound_batches(spark)
    return quality.judge_quality(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays.

    Rows are told apart by the SHA-256 of id and text, so rows that share an id are judged each
    by its own text; of rows alike in both the first by lang, source and n_chars stays, nulls
    first.  Rows without an id stay; null and empty texts are like no other.  An empty table
    gives no rows; other columns are left out.
    """
    bound_batches(spark)
    docs = docs.select(COLUMNS)
    rows = docs.where("doc_id is not null").withColumn("_row", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), 256))
    found = jaccard_join.similar_components(rows.select("_row", "text"), "_row")
    named = found.select("_row", "component_id").distinct().join(rows.select("_row", "doc_id").distinct(), "_row")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("_row")).select("_row")
    alike = rows.join(first, "_row", "left_semi").groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("_r"))
    return alike.select("doc_id", "text", "_r.lang", "_r.source", "_r.n_chars").unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give away a benchmark item go; null and empty texts give away nothing.  Rows are judged each; an empty table gives none; other columns are left out."""
    bound_batches(spark)
    return lsa_decontaminate.remove_leaks(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their token ids; a null text is an empty document, an empty table gives no pieces."""
    bound_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express the latent space nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
