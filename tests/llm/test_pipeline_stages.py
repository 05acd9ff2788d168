"""The pipeline's stages on odd tables, and its near-duplicate stage against a plain computation."""

import importlib.util

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline is gone", allow_module_level=True)
import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BASE = " ".join(f"w{i}" for i in range(80))


def test_near_duplicates_keep_one_of_each_group(spark):
    near = BASE.replace("w40 ", "other ")
    rows = [
        (5, BASE, "en", "s", 1), (3, near, "en", "s", 1), (9, BASE, "en", "s", 1), (3, "alone " * 3 + "text of the same id", "en", "s", 1), (7, None, None, None, None), (8, "", "en", "s", 0),
        (2, "twice the same row", "fr", "b", 1), (2, "twice the same row", "en", "z", 2), (2, "twice the same row", None, "z", 2), (None, BASE, "en", "s", 1), (None, BASE, "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, docs.selectExpr("*", "'clash' AS _row", "1 AS component_id"), "")
    got = sorted(map(tuple, kept.collect()), key=str)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert got == sorted([(3, near, "en", "s", 1), rows[3], rows[4], rows[5], rows[8], rows[9], rows[10]], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_quality_and_packing_take_odd_rows(spark):
    words = " ".join(f"word{i % 37}x{i}" for i in range(120)) + "."
    docs = spark.createDataFrame([(1, words, "en", "s", 9), (2, None, "en", "s", 0), (None, words, None, None, None), (1, words, "en", "s", 9), (3, "short", "en", "s", 5)], SCHEMA).selectExpr("*", "1 AS kept", "2 AS ids")
    judged = corpus_pipeline.quality_rules(spark, docs, "")
    assert judged.columns == corpus_pipeline.COLUMNS and sorted(str(r.doc_id) for r in judged.collect()) == ["1", "1", "None"]
    assert corpus_pipeline.quality_rules(spark, docs.limit(0), "").count() == 0 == corpus_pipeline.pack(spark, docs.limit(0), "").count()
    packed = corpus_pipeline.pack(spark, docs.select(*corpus_pipeline.COLUMNS), "").collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0) and len({str(r.doc_id) for r in packed}) == 4
