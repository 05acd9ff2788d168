"""Items, validation, trees and conditions on small and odd tables."""

import pytest
from pyspark.sql import functions as F

from docweave.operators import items, labels, search, store, summaries, tree


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_items_take_what_is_given(spark):
    sections = frame(spark, [("d", "s", "T", None)], "doc_id string, id string, title string, content string")
    clauses = frame(spark, [("d", "c", None, "APPENDIX")], "doc_id string, id string, content string, region string")
    below = frame(spark, [("d", "i", "c", None, "x"), ("d", "j", "c", "OTHER", "y")], "doc_id string, id string, clause_id string, role string, content string")
    got = {r.section_id or r.item_id or r.clause_id: r for r in items.structure_items(sections, clauses, below).collect()}
    assert (got["s"].role, got["s"].content, got["s"].section_title, got["s"].doc_name) == ("NON_CLAUSE", "", "T", "document_d")
    assert (got["c"].role, got["c"].region) == ("CLAUSE", "APPENDIX") and [got[k].role for k in "ij"] == ["CLAUSE", "OTHER"]
    assert items.structure_items(sections.limit(0), clauses.limit(0), below.limit(0)).count() == 0


def test_hits_without_clause_or_spans(spark):
    hits = frame(spark, [(1, "c", None), (2, "c", "i"), (3, "gone", "i"), (4, "bare", None)], "hit int, clause_id string, item_id string")
    clauses = frame(spark, [("c", 7), ("bare", None)], "clause_id string, page int")
    spans = frame(spark, [("CLAUSE_ITEM", "i", 5, "y"), ("CLAUSE_ITEM", "i", 2, "x"), ("CLAUSE", "c", 1, "z")], "owner_type string, owner_id string, seq int, span_id string")
    got = {r.hit: (r.page, r.span_ids, r.block_id) for r in items.hydrate(hits, clauses, spans).collect()}
    assert got == {1: (7, ["z"], "block-c-1"), 2: (7, ["x", "y"], "block-c-2"), 3: (None, [], None), 4: (None, [], "block-bare")}


def test_what_is_wrong_with_documents(spark):
    docs = [
        (1, '{"metadata": {"id": "d"}, "structure": {"id": "s", "title": "t"}}'),
        (2, '{"structure": {"children": [{"id": "a", "content": "x", "children": 5}, {"title_tags": [], "content_tags": {"b": 1, "a": 2, "score": 1.5}}]}}'),
        (3, "{}"),
        (4, '{"metadata": {"id": 1, "type": null}, "structure": {"id": "s", "content": ""}, "vectorization": "no"}'),
    ]
    got = {r.k: r.errors for r in tree.validate(frame(spark, docs, "k int, j string"), "k", "j").collect()}
    assert got[1] == [] and got[3] == ["metadata is missing", "structure is missing"]
    assert got[2] == [
        "metadata is missing", "id is missing", "neither title nor content", "children is no list", "id is missing", "neither title nor content",
        "title_tags is no object", "content_tags: unknown tag a", "content_tags: unknown tag b", "content_tags.score is no whole number",
    ]
    assert got[4] == ["metadata.type is no text", "vectorization is no boolean"]


def test_tree_of_items(spark):
    rows = frame(spark, [("d", 1, None), ("d", 2, 1), ("d", 3, 2), ("d", 4, 99), ("e", 2, 1), ("d", 8, 9), ("d", 9, 8)], "d string, i int, up int")
    got = sorted((r.d, r.i, r.depth, r.path) for r in tree.item_tree(rows, "d", "i", "up").collect())
    assert got == [("d", 1, 0, "1"), ("d", 2, 1, "1/2"), ("d", 3, 2, "1/2/3"), ("d", 4, 0, "4"), ("e", 2, 0, "2")]
    assert tree.item_tree(rows.limit(0), "d", "i", "up").count() == 0


def test_items_need_a_clause(spark):
    rows = frame(spark, [("d", 1, "（1） early"), ("d", 2, "第一条"), ("d", 3, "2. 　late "), ("d", 4, "plain"), ("e", 1, "3. alone"), ("d", 5, None)], "d string, o int, text string")
    got = sorted((r.o, r.title, r.content, r.clause) for r in tree.items_by_pattern(rows, "d", "o", "text", F.col("text").startswith("第")).collect())
    assert got == [(1, "（1）", "early", 2), (3, "2. ", "late", 2)]


def test_conditions(spark):
    rows = frame(spark, [(1, "it's"), (2, "b"), (3, None)], "a int, b string")
    assert [r.a for r in store.expression_filter(rows, "a >= 2 and b is not null", ("a", "b")).collect()] == [2]
    assert store.expression_filter(rows, "b in ('delete x', 'b')", ("b",)).count() == 1
    for bad in ("c = 1", "a = length(b)", "a(1) = 2", "a = 1; drop", "b = (select 1)", 'a = "x"', "reflect('x', 'y') = 1"):
        with pytest.raises(ValueError):
            store.expression_filter(rows, bad, ("a", "b"))


def test_maps_zips_replies_and_vectors(spark):
    one = frame(spark, [(["a", "b"], ["x"], {"k": "1", "m": "2"}, {"k": "3"})], "a array<string>, b array<string>, m map<string,string>, o map<string,string>")
    r = one.select(items.zip_shortest(F.col("a"), F.col("b")).alias("z"), items.overlay(F.col("m"), F.col("o")).alias("m")).first()
    assert [tuple(z) for z in r.z] == [("a", "x")] and r.m == {"k": "3", "m": "2"}
    replies = frame(spark, [(None,), ("",), ("[1]",), ('{"spans": [{"start": 1}]}',)], "r string").select(labels.reply_spans(F.col("r")).alias("s")).collect()
    assert [len(r.s) for r in replies] == [0, 0, 0, 1]
    vectors = search.unit_vectors(frame(spark, [(1, [3.0, 4.0]), (2, [0.0, 0.0])], "i int, v array<float>"), "v").collect()
    assert vectors[0].v == pytest.approx([0.6, 0.8]) and vectors[1].v is None
    texts = frame(spark, [("A. B!  ！C",), ("",), (None,)], "t string").select(summaries.key_points(F.col("t"), 2).alias("p")).collect()
    assert [r.p for r in texts] == [["A", "B"], [], None]


def test_rows_come_again(spark):
    table = frame(spark, [("d", 1), ("d", 2), ("e", 3)], "doc string, x int")
    new = frame(spark, [("d", 9)], "doc string, x int")
    once = store.reprocess(table, new, "doc")
    assert sorted(map(tuple, once.collect())) == [("d", 9), ("e", 3)] == sorted(map(tuple, store.reprocess(once, new, "doc").collect()))
    assert store.delete_rows(table, new, "doc").count() == 1
    spans = frame(spark, [(1, "A", "B", None, "t")], "id int, role string, region string, nc_type string, text string")
    changes = frame(spark, [(1, None, "C", "D", "other")], "id int, role string, region string, nc_type string, text string")
    assert tuple(store.relabel(spans, changes, "id").first()) == (1, "A", "C", "D", "t")


def test_hits_have_all_fields(spark):
    hits = frame(spark, [("c", None, None)], "clause_id string, lang string, content string")
    r = items.hit_records(hits).first()
    assert len(r) == 21 and (r.clause_id, r.lang, r.content, r.section_id, r.score) == ("c", "zh", "", None, 1)
    shown = items.project_hits(frame(spark, [("de", None, "x", "y")], "lang string, region string, content string, title string"), include_content=False).first()
    assert shown.metadata == {"lang": "de"} and shown.content is None and shown.title is None
