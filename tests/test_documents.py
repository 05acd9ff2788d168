"""Contract rules on small fixtures; expected values follow from the rule tables."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions import rules, text
from docweave.operators import chunk, joins, labels, segments, store, summaries, tree
from docweave.plans import documents
from docweave.sources import parsers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


ELEMENTS = [
    ("第一章 总则", "section", 1), ("第一条 总则", "clause", 1), ("1.1 本协议", "section", 4), ("1. 甲方", "section", 4), ("一、总则", "section", 4),
    ("(1) x", "section", 6), ("A. x", "section", 7), ("12：x", "clause", 3), ("（1） x", "clause_item", 1), ("（一） 甲方", "clause_item", 1), ("12) x", "clause_item", 3),
    ("a) x", "clause_item", 4), ("① x", "clause_item", 5), ("（一）甲方权利和义务", "clause", 0), ("1) x", "clause", 0), ("第三百条 x", "clause", 0),
]


def test_elements(spark):
    df = frame(spark, [(i, t) for i, (t, _, _) in enumerate(ELEMENTS)], "o int, text string").withColumn("role", F.lit("CLAUSE")).withColumn("nc_type", F.lit("CLAUSE_BODY"))
    got = tree.classify_elements(df).orderBy("o").collect()
    assert [(r.text, r.element_type, r.level_hint) for r in got] == ELEMENTS
    assert got[0].title == "总则" and got[7].number_token == "12"


def test_parents(spark):
    levels = frame(spark, [(1, i + 1, v) for i, v in enumerate([2, 4, 1, 4, 6, 4])], "d int, o int, level int")
    assert [r.parent for r in tree.parent_by_level(levels, "d", "o", "level", 7).orderBy("o").collect()] == [None, 1, None, 3, 4, 3]
    numbers = frame(spark, [(1, i + 1, v) for i, v in enumerate(["第一条", "2", "2.1", "2.1.3", "3.1", None, ""])], "d int, o int, number string")
    assert [r.parent for r in tree.parent_by_prefix(numbers, "d", "o", "number").orderBy("o").collect()] == [None, 1, 2, 3, 1, None, None]
    items = frame(spark, [(1, i + 1, v) for i, v in enumerate(["（一）", "1)", "(2)", "a)", "3)", None])], "d int, o int, number string")
    assert [r.parent for r in tree.parent_item(items, "d", "o", "number").orderBy("o").collect()] == [None, 1, None, 3, 3, None]


def test_scores(spark):
    grid = frame(spark, [("MAIN", "TITLE", "NON_CLAUSE"), ("COVER", "CLAUSE_BODY", "NON_CLAUSE"), ("TOC", None, "CLAUSE"), ("?", "PARTIES", "CLAUSE"), ("MAIN", "CLAUSE_BODY", "CLAUSE")], "r string, n string, c string")
    assert [x[0] for x in grid.select(labels.score_a(F.col("r"), F.col("n"), F.col("c"))).collect()] == [2, 2, 2, 2, 4]
    grid = frame(spark, [("MAIN", "CLAUSE_BODY", "CLAUSE"), ("APPENDIX", "CLAUSE_BODY", "CLAUSE"), ("MAIN", "TITLE", "CLAUSE"), ("MAIN", None, "NON_CLAUSE")], "r string, n string, c string")
    got = grid.select(labels.score_b(F.col("r"), F.col("n"), F.col("c")).alias("s")).collect()
    assert [(r.s.score_float, r.s.score) for r in got] == [(3.6, "4"), (3.4, "3"), (2.4, "2"), (0.8, "1")]


def test_contract_labels(spark):
    lines = ["股权转让合同", "目录", "第一条 双方应当履行义务", "甲方签字：张三", "附件一"]
    df = frame(spark, [(i + 1, t, "paragraph") for i, t in enumerate(lines)], "order_index int, text string, block_type string")
    got = labels.annotate_structure(df).orderBy("order_index").collect()
    assert [r.region for r in got] == ["COVER", "MAIN", "MAIN", "SIGN", "APPENDIX"]
    assert [r.role for r in got] == ["NON_CLAUSE", "NON_CLAUSE", "CLAUSE", "NON_CLAUSE", "NON_CLAUSE"]
    assert [r.boundary for r in got] == ["O", "O", "B", "O", "O"] and got[2].clause_number == "一"
    got = labels.label_segments(df).orderBy("order_index").collect()
    assert [r.region for r in got] == ["COVER", "TOC", "MAIN", "COVER", "APPENDIX"] and got[2].role == "CLAUSE"


def test_text_functions(spark):
    df = frame(spark, [("　第一条　 ",)], "t string")
    assert df.select(text.strip(F.col("t"))).first()[0] == "第一条"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.detect_language(F.lit("甲方abc"))) == "zh" and one(text.detect_language(F.lit(""))) == "unknown"
    assert one(text.infer_document_type(F.lit("第一条"), F.lit(""), F.lit(""))) == "合同" and one(text.infer_document_type(F.lit(""), F.lit("公司章程"), F.lit(""))) == "章程"
    assert one(text.block_type(F.lit("第二条 x"))) == ("heading", 1) and one(text.block_type(F.lit("a. x"))) == ("list", 1) and one(text.block_type(F.lit("a\tb"))) == ("table", 1)
    assert one(text.file_type(F.lit("a/b.DOCX"))) == "docx" and one(text.file_type(F.lit("b"))) == "unknown"
    sample = "甲方：张三公司，签订于2023年12月1日，金额人民币100万元"
    assert one(text.extract_tags(F.lit(sample), rules.TAG_PATTERNS["party"])) == ["张三公司"]
    assert one(text.extract_tags(F.lit(sample), rules.TAG_PATTERNS["date"])) == ["12月1日", "2023年12月", "2023年12月1日"]
    assert str(one(text.to_date(F.lit("2023年2月3日")))) == "2023-02-03" and one(text.to_date(F.lit("2023-02-31"))) is None
    assert one(tree.split_number(F.lit("1.1 x"))) == ("1", "1 x") and one(tree.split_number(F.lit("x"))) == (None, "x")


def test_timeline_and_nodes(spark):
    df = frame(spark, [("d", 1, "于2023年12月1日签署，2024-01-05生效")], "doc string, c int, t string")
    got = {(r.raw_date, r.pattern, str(r.date)) for r in summaries.timeline(df, "doc", "c", "t").collect()}
    assert got == {("2023年12月1日", "ymd", "2023-12-01"), ("12月1日", "md", "None"), ("2024-01-05", "dash", "2024-01-05")}
    json = '{"id":"r","title":"公司章程","children":[{"id":"a","title":"第一章 总则","children":[{"id":"b","title":"第一条 名称","content_tags":{"role":"CLAUSE"}}]},{"id":"c","content":"x"}]}'
    rows = tree.flatten_json(frame(spark, [(1, json)], "d int, j string"), "d", "j").orderBy("order_index")
    typed = rows.withColumn("k", tree.node_type(F.col("title"), F.col("content"), F.col("role"), F.col("region"))).collect()
    assert [(r.id, r.parent_id, r.order_index, r.level, r.k) for r in typed] == [("r", None, 1, 1, "section"), ("a", "r", 2, 2, "section"), ("b", "a", 3, 3, "clause"), ("c", "r", 4, 2, "section")]


def test_parsers(spark):
    md = frame(spark, [(1, "# 第一章 总则\n\ntext\nmore\n\n## 第二条\n- a\n- b")], "k int, c string")
    assert [(r.text, r.block_type, r.level) for r in parsers.parse(md, "k", "c", "markdown").orderBy("pos").collect()] == [("第一章 总则", "heading", 1), ("text more", "paragraph", 1), ("第二条", "heading", 2), ("- a - b", "list", 1)]
    page = frame(spark, [(1, "<html><body><h1>A</h1><div>x<p>y</p></div><script>z</script></body></html>"), (2, None)], "k int, c string")
    assert [(r.text, r.block_type) for r in parsers.parse(page, "k", "c", "html").orderBy("k", "pos").collect()] == [("A", "heading"), ("xy", "paragraph"), ("y", "paragraph")]
    plain = frame(spark, [(1, "第一章 总则\n\n这是第一条内容。\n\n第二条 权利")], "k int, c string")
    assert [r.block_type for r in parsers.parse(plain, "k", "c", "txt").orderBy("pos").collect()] == ["heading", "paragraph", "heading"]
    with pytest.raises(ValueError):
        parsers.parse(plain, "k", "c", "pdf")


def test_store(spark):
    t = frame(spark, [(1, "a", False), (2, None, False), (3, "c", True)], "id int, v string, deleted boolean")
    assert [r.id for r in store.find(t, null=["v"]).collect()] == [2]
    new = store.replace_by_id(t, frame(spark, [(1, "z")], "id int, v string"), "id")
    assert sorted((r.id, r.v, r.deleted) for r in new.collect() if r.id == 1) == [(1, "a", True), (1, "z", False)]
    assert store.insert_absent(t, frame(spark, [(1, "x", False), (9, "y", False)], t.schema), "id").count() == 4
    with pytest.raises(ValueError):
        store.safe_filter(t, {"doc_id": {"a": 1}})


def test_band_and_structure(spark):
    left = frame(spark, [(1, "d", 10), (2, "d", 100)], "i int, d string, o int")
    right = frame(spark, [("d", 14, 0, "a"), ("d", 11, 1, "b")], "d string, o int, place int, v string")
    assert {r.i: r.hit for r in joins.band_first(left, right, "d", "o", "place", "v", "hit", 5, "i").collect()} == {1: "a", 2: None}
    lines = ["第一章 总则", "第一条 名称", "（一） 甲", "第二条 住所", "a) 乙"]
    df = frame(spark, [("d", i, t, "CLAUSE", "CLAUSE_BODY") for i, t in enumerate(lines)], "d string, o int, text string, role string, nc_type string")
    sections, clauses, items = documents.structure(df, "d", "o")
    assert sections.count() == 1 and {r.o: r.section for r in clauses.collect()} == {1: 0, 3: 0} and {r.o: r.clause for r in items.collect()} == {2: 1, 4: 3}


@given(st.integers(0, 30_000))
@settings(max_examples=15, deadline=None)
def test_char_windows_cover(spark, n):
    got = spark.range(1).select(segments.char_windows(F.lit(n)).alias("w")).first().w or []
    assert (not got) == (n == 0)
    assert all(a.end - 200 == b.start for a, b in zip(got, got[1:])) and (not got or (got[0].start == 0 and got[-1].end == n))  # noqa: B905


@given(st.lists(st.tuples(st.floats(-3, 3), st.floats(-3, 3)), min_size=1, max_size=9))
@settings(max_examples=50, deadline=None)
def test_decode_is_best(scores):
    import itertools

    cfg = rules.CHUNK_DEFAULTS
    start, go_on = np.array([s for s, _ in scores]), np.array([c for _, c in scores])
    cost = {(1, 1): cfg["pen_SS"], (1, 0): cfg["pen_SC"], (0, 1): cfg["pen_CS"], (0, 0): cfg["pen_CC"]}
    value = lambda s: sum(start[i] if x else go_on[i] for i, x in enumerate(s)) + sum(cost[a, b] for a, b in zip(s, s[1:]))  # noqa: B905, E731
    best = max(value((1, *rest)) for rest in itertools.product((0, 1), repeat=len(scores) - 1))
    assert abs(value(tuple(map(int, chunk.decode(start, go_on, cfg)))) - best) < 1e-9


def test_mended_starts():
    same, other = [1.0, 0.0], [0.0, 1.0]
    mend = lambda starts, vectors, heading=(), enum=(): np.flatnonzero(chunk.mend_starts(np.array(starts, bool), *[np.isin(np.arange(len(starts)), x) for x in (heading, enum)], np.array(vectors))).tolist()
    assert mend([1, 0, 0], [same] * 3, heading=[0]) == [0]  # the heading is cut off, but so like the rest that it comes back
    assert mend([1, 0, 0], [other, same, same], heading=[0]) == [0, 1]
    assert mend([1, 0, 0], [other, same, same], heading=[0], enum=[1]) == [0]
    assert mend([1, 0, 1, 1, 0], [same, same, same, other, other]) == [0, 3]  # joins the left
    assert mend([1, 0, 1, 1, 0], [same, same, other, other, other]) == [0, 2]  # joins the right
    assert mend([1], [same]) == [0]


def test_classes_of_contract_texts(spark):
    df = spark.createDataFrame([(1, "Lease agreement: rental of real estate. Payment is due."), (2, "nothing")], "d int, t string")
    got = df.select("d", labels.classify(F.col("t"), rules.DOCUMENT_TYPES).alias("kind"), labels.classify(F.col("t"), rules.CONTRACT_DOMAINS).alias("domain"), labels.rank_classes(F.col("t"), rules.CLAUSE_CATEGORIES).alias("ranked")).orderBy("d").collect()
    assert (got[0].kind.label, got[0].kind.score, got[0].domain.label, got[0].domain.score) == ("CONTRACT", 1, "PROPERTY", 3)
    assert got[0].ranked and got[0].ranked[0].share == 1.0 and got[1].ranked == [] and got[1].kind.score == 0


def test_chunks_partition_blocks(spark):
    df = frame(spark, [(1, "TITLE:\n1. first item,\n  goes on\n2. second item\n\nplain text here"), (2, "")], "d int, t string")
    got = chunk.chunk_texts(df, "d", "t").orderBy("chunk").collect()
    assert sum(r.n for r in got) == 5 and "".join(r.text for r in got).replace("\n", "").startswith("TITLE:")


def test_streaming(spark, sf_dir, tmp_path):
    from docweave.streaming.ingest import stream_segments

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.write.parquet(str(tmp_path / "in"))
    stream_segments(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == segments.split_segments(docs, "doc_id", "text").count()


def test_all_entities_of_a_document_are_linked(spark):
    rows = [(1, f"e{k:03}") for k in range(130)] + [(2, "e000"), (2, "e129"), (2, "e129"), (3, "e001"), (None, "e000"), (None, "e129"), (4, None)]
    edges = {(r.source, r.target): r.n_docs for r in summaries.cooccurrence(frame(spark, rows, "d int, e string"), "d", "e").collect()}
    assert len(edges) == 130 * 129 // 2 and edges.pop(("e000", "e129")) == 2 and set(edges.values()) == {1}


def test_deep_json_is_flattened_whole(spark):
    json = '{"id": "n25"}'
    for k in range(24, 0, -1):
        json = f'{{"id": "n{k}", "children": [{json}]}}'
    rows = tree.flatten_json(frame(spark, [(1, json)], "d int, j string"), "d", "j").orderBy("order_index").collect()
    assert [(r.level, r.id) for r in rows] == [(k, f"n{k}") for k in range(1, 26)]


def test_repeated_turns_all_lie_in_windows(spark, tmp_path):
    from docweave.plans.registry import QUERIES

    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 1, "user", "c"), (1, 2, "user", "d")]
    frame(spark, rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(r.turn for r in QUERIES["row_windows"](spark, str(tmp_path)).collect()) == [0, 1, 1, 2]
