"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import chat_format, ctw, divergence, html_extract, jaccard_join, license_scan, lsa_decontaminate, minhash, packing, quality, repair, url_filter, warc
from docweave.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are; operators take a path."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ctw.score_texts(docs, learn=~ctw.held_out(F.col("doc_id")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge_quality(docs).drop("text")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql("SELECT -1L AS conv_id, stack(2, 0L, 'user', 1L, 'assistant') AS (turn, role)")
    planted = planted.selectExpr("conv_id", "turn", "role", f"'{chat_format.PLANTED}' AS text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.digests(turns)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json")).drop("ids")


def op7_lsa_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsa_decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_records(index, payloads=False).drop("payload", "url")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.RULES)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op12_minhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.repair_digests(turns, repair.damage(turns))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_ctw_score, op2_license_scan, op3_html_extract, op4_compression_bands, op5_chat_format, op6_packing, op7_lsa_decontaminate, op8_warc, op9_jaccard_join, op10_url_filter, op11_source_divergence, op12_minhash_duplicates, op13_conversation_repair)
}

ORACLES: dict[str, str] = {
    "op2_license_scan": license_scan.ORACLE_SQL,
    "op5_chat_format": chat_format.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op10_url_filter": url_filter.ORACLE_SQL,
    "op11_source_divergence": divergence.ORACLE_SQL,
    "op13_conversation_repair": repair.oracle_sql(),
}
