"""Nested documents, folds, plugs, places and searches on small and odd tables, against plain Python."""

import collections
import json
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.operators import chunk, items, joins, labels, matches, once, plugs, search, segments, store, structure, summaries, tree
from docweave.plans.registry import QUERIES


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- nested documents -----------------------------------------------------------------------------


def chain(depth):
    node = {"id": f"n{depth}", "content": "end"}
    for i in range(depth - 1, 0, -1):
        node = {"id": f"n{i}", "title": f"t{i}", "children": [{"id": f"leaf{i}"}, node]}
    return json.dumps(node)


def test_depth_costs_nothing_and_bad_text_is_a_row(spark):
    docs = frame(spark, [(1, chain(200)), (2, '{"id": "a", "children": [{"id": 5}, null, "x"]}'), (3, '{"id": "a"'), (4, None), (5, "[1]"), (None, '{"id": "k"}'), (6, "[" * 200_000)], "k int, j string")
    began = time.perf_counter()
    got = collections.defaultdict(list)
    for r in tree.flatten_json(docs, "k", "j").orderBy("k", "order_index").collect():
        got[r.k].append(r)
    assert time.perf_counter() - began < 10
    assert len(got[1]) == 399 and max(r.level for r in got[1]) == 200 and [r.order_index for r in got[1]] == list(range(1, 400))
    assert [(r.level, r.id, r.parent_id) for r in got[1][:4]] == [(1, "n1", None), (2, "leaf1", "n1"), (2, "n2", "n1"), (3, "leaf2", "n2")]
    assert [(r.id, r.level, r.error) for r in got[2]] == [("a", 1, None), ("5", 2, None), (None, 2, None), (None, 2, None)]
    assert [(r.order_index, r.error) for r in got[3]] == [(None, "is no JSON")] and got[6][0].error in ("is no JSON", "is nested too deeply")
    assert [(r.level, r.id) for r in got[4] + got[5]] == [(1, None)] * 2 and got[None][0].id == "k"
    wrong = {r.k: r.errors for r in tree.validate(docs, "k", "j").collect()}
    assert wrong[3] == ["is no JSON"] and wrong[4] == ["metadata is missing", "structure is missing"] == wrong[5]
    assert tree.flatten_json(docs.limit(0), "k", "j").count() == 0 == tree.validate(docs.limit(0), "k", "j").count()


def random_node(rng, depth=0):
    node = {"id": rng.choice([f"i{rng.randint(0, 99)}", 'q"\\\n', "é"])}
    node |= {f: rng.choice(["x", "", 'a "b" \\ {[']) for f in ("title", "content") if rng.random() < 0.6}
    if rng.random() < 0.4:
        node["content_tags"] = {t: rng.choice(["CLAUSE", "MAIN"]) for t in ("role", "region") if rng.random() < 0.8} or {"role": "X"}
    node["children"] = [random_node(rng, depth + 1) for _ in range(rng.randint(0, 3) if depth < 6 else 0)]
    return node


def test_flattened_documents_come_back_equal(spark):
    rng = random.Random(4)
    docs = [(i, random_node(rng)) for i in range(30)]
    flat = tree.flatten_json(frame(spark, [(i, json.dumps(d)) for i, d in docs], "k int, j string"), "k", "j")
    got = {r.k: json.loads(r.json) for r in tree.assemble_json(flat.orderBy(F.rand(3)), "k").collect()}
    assert got == dict(docs)
    tops = frame(spark, [(1, 1, 1, "a"), (1, 2, 2, "b"), (1, 3, 1, "c")], "k int, order_index int, level int, id string")
    for c in ("title", "content", "role", "region"):
        tops = tops.withColumn(c, F.lit(None).cast("string"))
    assert json.loads(tree.assemble_json(tops, "k").first().json) == {"children": [{"id": "a", "children": [{"id": "b", "children": []}]}, {"id": "c", "children": []}]}
    assert tree.assemble_json(flat.limit(0), "k").count() == 0


def test_trees_with_repeats_null_keys_and_circles(spark):
    rows = [("d", 1, None), ("d", 2, 1), ("d", 2, 1), (None, 1, None), (None, 2, 1), ("d", None, 1), ("c", 1, 2), ("c", 2, 1), ("c", 3, 2), ("c", 4, None), ("s", 1, 1)]
    deep = [("e", i, i - 1 if i else None) for i in range(150)]
    got = sorted((str(r.d), str(r.i), r.depth, r.path) for r in tree.item_tree(frame(spark, rows + deep, "d string, i int, up int").withColumn("x", F.lit(1)), "d", "i", "up").collect() if r.d != "e")
    assert got == [("None", "1", 0, "1"), ("None", "2", 1, "1/2"), ("c", "4", 0, "4"), ("d", "1", 0, "1"), ("d", "2", 1, "1/2"), ("d", "2", 1, "1/2"), ("d", "None", 0, None)]
    far = {r.i: (r.depth, r.path) for r in tree.item_tree(frame(spark, deep, "d string, i int, up int"), "d", "i", "up").collect()}
    assert far == {i: (i, "/".join(map(str, range(i + 1)))) for i in range(150)}


# -- stores ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text",
    [
        r"""b = '\' or b = ' or java_method("java.lang.System", "getProperty", "user.name") = "root" -- '""", "b = 'x' -- '", "b = \"x\"", "b = 'x' /* ' */", "java_method('java.lang.System', 'exit') = b",
        "b = r'\\'", "b = r'x'", "b = date '2020-01-01'", "b('x') = 'y'", "`b` = 'x'", "c = 1", "b = 'x'; drop table t", "like('a', 'b')", "b = 'x' 'y'", "b in (select b from t)", "b = 'x' or (b)(b)", "b = @v", "b = ${x}", "b[0] = 1",
    ],
)
def test_conditions_that_are_refused(spark, text):
    with pytest.raises(ValueError, match="condition not allowed"):
        store.expression_filter(frame(spark, [("x", 1)], "b string, a int"), text, ("a", "b"))


def test_conditions_that_are_taken(spark):
    rows = frame(spark, [("x", 1), ("it y", 2), (None, 3), ("date", 4)], "b string, a int")
    count = lambda text: store.expression_filter(rows, text, ("a", "b")).count()
    assert count("b = 'x' AND a = 1") == 1 and count("b IN ('x', 'it y') or not (a < 3)") == 4 and count("b is null and a between 1 and 3") == 1
    assert count("b like '%y'") == 1 and count("b = 'java_method(1)'") == 0 and count("(a + 1) * 2 >= 8") == 2


def test_updates_double_no_row_and_can_clear(spark):
    table = frame(spark, [(1, "a", 5), (2, "b", 6), (3, None, 7)], "k int, s string, n int")
    changes = frame(spark, [(1, "z", None, False), (1, "y", None, True), (3, "c", 8, None), (9, "q", 1, True)], "k int, s string, n int, no_n boolean")
    got = sorted(map(tuple, store.update(table, changes, "k", clear={"n": "no_n"}).collect()), key=str)
    assert got == [(1, "z", None), (2, "b", 6), (3, "c", 8)]


def test_reruns_clear_what_they_do_not_yield(spark, tmp_path):
    table = frame(spark, [("a", 1), ("b", 2), ("c", 3)], "doc string, n int")
    redone, rows = frame(spark, [("a",), ("b",), ("b",)], "doc string"), frame(spark, [("a", 9)], "doc string, n int")
    assert sorted(map(tuple, store.reprocess(table, rows, "doc", redone=redone).collect())) == [("a", 9), ("c", 3)]
    path = f"file://{tmp_path}/t"
    store.rewrite_partitions(path, table, table, "doc")
    for _ in range(2):
        store.rewrite_partitions(path, rows, redone, "doc")
        assert sorted((r.doc, r.n) for r in store.live(spark.read.parquet(path)).collect()) == [("a", 9), ("c", 3)]


# -- chunks ---------------------------------------------------------------------------------------

LINES = ["第一条 总则", "1. 甲方应当：", "(1) 支付费用，", "  (a) first;", "", "   plain words follow", "TITLE HERE", "a" * 70, "•  bullet (open", "closed)", "x", "1) one", "第二条：", "é ü ß", "\ttabbed", "Short:", "i. roman"]


@pytest.mark.parametrize("mode", ["contract", "summary", "single"])
def test_folds_decide_as_the_loop_does(spark, mode):
    rng = random.Random(mode)
    docs = [(i, "\n".join(" " * rng.choice([0, 0, 4, 20]) + rng.choice(LINES) for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(100, None), (101, ""), (102, " \n "), (103, "one"), (104, "\n".join(rng.choices(LINES, k=1500)))]
    df = frame(spark, docs, "k int, t string")
    native = sorted(map(tuple, chunk.chunk_texts(df, "k", "t", mode).collect()))
    assert native == sorted(map(tuple, chunk.chunk_texts(df, "k", "t", mode, embed=chunk.hashed_embedding).collect()))
    assert {r[0] for r in native} == {i for i, t in docs if (t or "").strip(" \n")}


def test_pairs_are_counted_text_by_text_whatever_is_counted_together():
    texts = ["ab", "a", "\U0001f600é", "x" * 3000, "  ", "ab"] * 3 + ["y" * ((1 << 20) + 5), "z"]
    want = np.zeros((len(texts), chunk.SLOTS), int)
    for i, t in enumerate(texts):
        for a, b in zip(t, t[1:] + " ", strict=True):
            want[i, (ord(a) * 31 + ord(b)) % chunk.SLOTS] += 1
    assert (chunk.pair_counts(texts) == want).all() and chunk.pair_counts([]).shape == (0, chunk.SLOTS)


def test_chunks_take_one_shuffle_and_no_row_per_character(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    got = plan(chunk.chunk_texts(frame(spark, [(1, "a\nb")], "k int, t string"), "k", "t"))
    assert got.count("Exchange ") == 1 and "Join" not in got and got.count("Generate") == 1


def test_chunk_items_cuts_documents_once(spark, sf_dir):
    got = QUERIES["chunk_items"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in got and "Scan ExistingRDD" in got


def test_a_fold_emits_in_order_whatever_the_length(spark):
    step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["sum"] + x).alias("emit"))
    for n in (0, 1, 255, 256, 257, 1000):
        row = frame(spark, [(list(range(n)),)], "a array<int>").select(chunk.fold(F.col("a"), {"sum": F.lit(0)}, step, "int").alias("f")).first().f
        assert [x for piece in row["all"] for x in piece] == np.cumsum(range(n)).tolist() and row["sum"] == sum(range(n))


def test_chunks_and_labels_meet_by_place(spark):
    chunks = frame(spark, [(1, 0, 0, 2, "a\nb"), (1, 1, 2, 1, "c"), (2, 0, 0, 1, "d"), (None, 0, 4, 1, "e")], "k int, chunk int, first int, n int, text string")
    tags = frame(spark, [(1, 7, "CLAUSE", None, "TITLE"), (2, 1, None, "SIGN", None), (2, 9, "CLAUSE", "MAIN", None), (None, 3, "X", "TOC", None), (3, 0, "CLAUSE", "MAIN", None)], "k int, order int, role string, region string, nc_type string")
    got = sorted(((r.k, r.clause_order_index, r.unit_type, r.role, r.region, r.content, r.loc.chunk_span) for r in items.chunk_items(chunks, tags, "k").collect()), key=str)
    assert got == [(1, 0, "CLAUSE", "CLAUSE", "MAIN", "a\nb", [0, 1]), (2, 0, "CLAUSE_ITEM", "NON_CLAUSE", "SIGN", "d", [0]), (None, 0, "CLAUSE_ITEM", "X", "TOC", "e", [4])]
    assert items.chunk_items(chunks, tags.limit(0), "k").count() == 0


# -- models ---------------------------------------------------------------------------------------


def test_a_bad_text_costs_no_other_its_answer(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [None if t == "mute" else t.upper() for t in texts]

    rows = [(i, t) for i, t in enumerate(["a", "bad one", None, "", "mute", "b" * 5000, "bad two", "c"])]
    got = {r.i: (r.v.value, r.v.error) for r in frame(spark, rows, "i int, t string").coalesce(1).select("i", plugs.ask(F.col("t"), model, 2000).alias("v")).collect()}
    assert got == {0: ("A", None), 1: (None, "RuntimeError: refused"), 2: (None, "no text"), 3: ("", None), 4: (None, "no answer"), 5: ("B" * 5000, None), 6: (None, "RuntimeError: refused"), 7: ("C", None)}
    short = frame(spark, [(1, "x"), (2, "y")], "i int, t string").coalesce(1).select(plugs.ask(F.col("t"), lambda texts: texts[:1]).alias("v"))
    assert [r.v.value for r in short.collect()] == ["x", "y"]  # too few answers: asked one by one
    ruled = plugs.ask_or_rule(frame(spark, rows, "i int, t string"), "t", model, F.lit("rule"), "label", allowed=["A", "C"])
    assert {r.i: r.label for r in ruled.collect()} == {0: "A", 1: "rule", 2: "rule", 3: "rule", 4: "rule", 5: "rule", 6: "rule", 7: "C"}
    assert plugs.ask_or_rule(frame(spark, rows, "i int, t string"), "t", None, F.lit("rule"), "label").where("label_by = 'rule' and label_error is null").count() == len(rows)


def test_calls_are_bounded_by_bytes():
    assert [len(b) for b in plugs._calls(["é" * 40, "b" * 30, "c" * 200, "d", "e"], 100)] == [1, 1, 1, 2]
    calls = list(plugs._calls(["x" * 60] * 5, 130))
    assert [len(c) for c in calls] == [2, 2, 1] and list(plugs._calls([], 10)) == []


# -- places and spans -----------------------------------------------------------------------------


def test_matches_have_their_places(spark):
    texts = ["2020-01-02 and 2020-01-02, é 1999-9-9", "", None, "no date", "ü2000-1-1" * 300, "aXbXX"]
    got = matches.find_all(frame(spark, list(enumerate(texts)), "k int, t string"), ["k"], "t", [("day", r"\d{4}-\d{1,2}-\d{1,2}"), ("x", "X(?=X|b)")], 5).collect()
    want = set()
    for k, t in enumerate(texts):
        for name, p in (("day", r"\d{4}-\d{1,2}-\d{1,2}"), ("x", "X(?=X|b)")):
            want |= {(k, name, n, m.start(), m.end(), m[0], t[max(0, m.start() - 5) : m.end() + 5]) for n, m in enumerate(re.finditer(p, t or ""), 1)}
    assert {(r.k, r.pattern, r.n, r.start, r.end, r.value, r.context) for r in got} == want and len(got) == len(want)


def test_timeline_is_in_order_with_every_place(spark):
    rows = [("d", "c1", "on 2021-05-01, then 2020年1月2日 and 2021-05-01"), ("d", "c2", "13月40日"), ("e", "c1", None)]
    got = summaries.timeline(frame(spark, rows, "d string, c string, t string"), "d", "c", "t").orderBy("place").collect()
    assert [(r.place, str(r.date), r.c, r.start) for r in got][:3] == [(1, "2020-01-02", "c1", 20), (2, "2021-05-01", "c1", 3), (3, "2021-05-01", "c1", 34)]
    assert all(r.date is None for r in got[3:])


def test_overlaid_spans_do_not_overlap(spark):
    rng = random.Random(2)
    names = ["A", "B", "C"]
    spans = [(d, w, s, s + rng.randint(-1, 12), rng.choice([*names, "?", None])) for d in (1, 2, None) for w in range(4) for s in [rng.randint(0, 15) for _ in range(5)]]
    got = segments.overlay_spans(frame(spark, spans, "d int, window int, start int, end int, l string"), "d", "l", names, window="window", step=10).collect()
    for d in (1, 2, None):
        at = {}
        for x in range(80):
            votes = collections.Counter(lab for key, w, s, e, lab in spans if key == d and lab in names and s + w * 10 <= x < e + w * 10)
            if votes:
                at[x] = min(votes, key=lambda name: (-votes[name], names.index(name)))
        own = [r for r in got if r.d == d]
        assert {x: r.label for r in own for x in range(r.start, r.end)} == at and sum(r.end - r.start for r in own) == len(at)
        assert all(a.end < b.start or a.label != b.label for a, b in zip(sorted(own, key=lambda r: r.start), sorted(own, key=lambda r: r.start)[1:], strict=False))


# -- searches -------------------------------------------------------------------------------------


def test_searches_take_any_ids_and_lengths(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("long", [1.0, 0.0, 0.0]), ("none", None), (None, [1.0, 0.0]), ("hole", [1.0, None]), ("zero", [0.0, 0.0])]
    df = frame(spark, rows, "id string, v array<double>")
    got = [(r.query_id, r.rank, r.id, r.score) for r in search.search_all(df.where("id in ('a', 'long')"), df, "id", "v", 2).orderBy("query_id", "rank").collect()]
    assert got == [("a", 1, "a", 1.0), ("a", 2, "b", 1.0), ("long", 1, "long", 1.0)]
    assert search.search_all(df, df.limit(0), "id", "v", 2).count() == 0


@pytest.mark.parametrize("cells", [1, 12])
def test_clustered_index_finds_what_the_whole_search_finds(spark, cells):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 6)) * 4
    vectors = [(f"v{i}", (centres[i % 10] + rng.normal(size=6) * 0.3).tolist()) for i in range(600)] + [("far", [30.0] * 6), ("none", None)]
    df = frame(spark, vectors, "id string, v array<double>")
    asked = df.where("id like 'v1%'")
    found, read = search.ClusteredIndex(df, "id", "v", cells=cells).search(asked, 5)
    rows = lambda hits: sorted((r.query_id, r["rank"], r.id, r.score) for r in hits.collect())
    assert rows(found) == rows(search.search_all(asked, df, "id", "v", 5))
    share = read.agg(F.avg("share")).first()[0]
    assert share == 1 if cells == 1 else share < 0.9


def test_whole_search_is_shared_among_tasks_and_ranks_few_rows(spark):
    # blocks of one size used to meet in one task, and to give k rows per query each
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(9000, 2)), 1)  # many equals
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
    found = search.search_all(df.where("id % 900 = 0"), df, "id", "v", 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "q_size" in plan
    want = set()
    for q in range(0, 9000, 900):
        scores = np.round(vectors @ vectors[q], 6)
        want |= {(q, rank, int(i), float(scores[i])) for rank, i in enumerate(np.lexsort((np.arange(9000), -scores))[:7], 1)}
    assert {(r.query_id, r["rank"], r.id, r.score) for r in found.collect()} == want


def test_a_block_of_queries_gives_k_rows_however_many_blocks_it_meets():
    rng = np.random.default_rng(6)
    queries, rows = rng.normal(size=(300, 4)), rng.integers(-3, 3, size=(5000, 4)).astype(float)
    pairs = pa.RecordBatch.from_pylist([
        {"q": 0, "q_ids": list(range(300)), "q_m": queries.tobytes(), "ids": list(range(at, at + 500)), "m": rows[at : at + 500].tobytes()} for at in rng.permutation(10) * 500
    ])
    found = list(search._best_of(iter([pairs]), 5, "id"))
    assert sum(b.num_rows for b in found) == 300 * 5
    got = {(r["query_id"], r["id"], r["score"]) for b in found for r in b.to_pylist()}
    scores = np.round(queries @ rows.T, 6)
    assert got == {(q, int(i), float(scores[q, i])) for q in range(300) for i in np.lexsort((np.arange(5000), -scores[q]))[:5]}


def test_join_on_few_values_is_shared_among_tasks(spark):
    many = spark.range(1000).select("id", (F.col("id") % 2).alias("kind"))
    few = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "kind long, name string")
    out = joins.join_spread(many, few, "kind", "id")
    assert sorted(map(tuple, out.select("id", "name").collect())) == sorted((i, n) for i in range(1000) for n in ("ab" if i % 2 == 0 else "c"))
    assert len({r[0] for r in out.select(F.spark_partition_id()).collect()}) > 8


def test_a_cell_of_many_vectors_is_read_in_blocks_by_several_tasks(spark, monkeypatch):
    # a cell was a task, and every query and vector of it a row
    monkeypatch.setattr(search, "BLOCK_ROWS", 100)
    monkeypatch.setattr(search, "PART_BLOCKS", 2)
    rng = np.random.default_rng(8)
    vectors = [(i, [1.0, 0.0, 2.0] if i % 2 else rng.normal(size=3).tolist()) for i in range(3000)]
    df = frame(spark, vectors, "id long, v array<double>")
    index = search.ClusteredIndex(df, "id", "v", cells=3)
    parts = index.blocks.groupBy("cell").agg(F.count_distinct("part").alias("n"), F.sum(F.size("ids")).alias("held")).collect()
    assert max(r.n for r in parts) > 5 and sum(r.held for r in parts) == 3000
    asked = df.where("id % 60 < 2")
    found, read = index.search(asked, 4)
    rows = lambda hits: sorted((r.query_id, r["rank"], r.id, r.score) for r in hits.collect())
    assert rows(found) == rows(search.search_all(asked, df, "id", "v", 4))
    assert read.where("share <= 0 or share > 1").count() == 0


def test_documents_are_taken_apart_once_for_a_structure(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    text = json.dumps({"id": "r", "title": "第1章 a", "children": [{"id": "c", "title": "第1条 b"}]})
    docs = frame(spark, [(i, text) for i in range(20)], "k long, j string").select("k", seen.asNondeterministic()("j").alias("j"))
    built = structure.build(tree.flatten_json(docs, "k", "j"), "k")
    assert built.clauses.where("section_id = 'r'").count() == 20
    assert read.value == 20


def test_errors_of_documents_are_passed_on_as_they_are_found(spark, monkeypatch):
    docs = frame(spark, [(i, None if i % 3 else "{") for i in range(50)], "k long, j string")
    got = {}
    monkeypatch.setattr(tree, "ROWS", 7)
    schema = type("Docs", (), {"schema": docs.schema, "select": lambda self, *c: self, "mapInArrow": lambda self, run, kind: run})()
    batch = pa.RecordBatch.from_pydict({"k": list(range(50)), "j": [None if i % 3 else "{" for i in range(50)]})
    parts = list(tree.validate(schema, "k", "j")(iter([batch])))
    assert len(parts) > 5
    for part in parts:
        got |= {r["k"]: r["errors"] for r in part.to_pylist()}
    assert got == {r.k: r.errors for r in tree.validate(docs, "k", "j").collect()}


def test_texts_are_lowered_once_for_all_words(spark):
    classes = [("a", ["one", "two"]), ("b", ["three"]), ("c", ["none"])]
    df = frame(spark, [("ONE and Three, two",), ("three",), ("",), (None,)], "t string")
    out = df.select(labels.rank_classes(F.col("t"), classes).alias("r"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [r.r and [(h.label, h.share) for h in r.r] for r in out.collect()] == [[("a", 1.0), ("b", 0.5)], [("b", 1.0)], [], []]


def test_little_to_read_is_shared_among_cores(spark):
    rows = once.share_out(spark.range(1000).coalesce(1))
    assert len({r[0] for r in rows.select(F.spark_partition_id()).collect()}) > 4


def test_prefixes_are_sorted_in_a_stage_of_their_own(spark):
    # what numbers the rows sorts them too; both sorts in one task held their memory at once
    rows = frame(spark, [(1, i, n) for i, n in enumerate(["1", "1.2", "2", None, "1.2.3"])], "k long, at long, number string")
    rows = rows.withColumn("o", F.row_number().over(Window.partitionBy("k").orderBy("at")))
    out = tree.parent_by_prefix(rows, "k", "o", "number")
    assert sorted((r.o, r.parent) for r in out.collect()) == [(1, None), (2, 1), (3, None), (4, None), (5, 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(k#\d+L?, _p#\d+", plan)


def plain_nest(hits):
    clauses, alone = {}, []
    for h in sorted(hits, key=lambda h: h["rank"]):
        if h["unit"] == "CLAUSE":
            if h["clause"] not in clauses or h["score"] > clauses[h["clause"]]["score"]:
                place = list(clauses).index(h["clause"]) if h["clause"] in clauses else None
                clauses[h["clause"]] = {**h, "sub": []}
                assert place is None or list(clauses)[place] == h["clause"]
        elif h["clause"] in clauses:
            clauses[h["clause"]]["sub"].append(h["item"])
        else:
            alone.append({**h, "sub": []})
    return [(h["unit"], h["clause"], h["item"], h["sub"]) for h in sorted([*clauses.values(), *alone], key=lambda h: -h["score"])]


def test_hits_nest_as_they_come(spark):
    rng = random.Random(8)
    hits = [{"q": q, "rank": i, "unit": rng.choice(["CLAUSE", "CLAUSE_ITEM"]), "clause": rng.choice(["x", "y", "z", None]), "item": f"i{i}", "score": rng.choice([0.1, 0.5, 0.9])} for q in range(8) for i in range(12)]
    df = frame(spark, [tuple(h.values()) for h in hits], "query_id int, rank int, unit_type string, clause string, item string, score double")
    got = collections.defaultdict(list)
    for r in search.nest_hits(df).orderBy("query_id", "place").collect():
        got[r.query_id].append((r.unit_type, r.clause, r.item, [s.item for s in r.sub_items]))
    assert got == {q: plain_nest([h for h in hits if h["q"] == q]) for q in range(8)}
    rolled = search.roll_up(df, "unit_type", "clause", "item", "score", within=("query_id",))
    assert rolled.where("best_item is not null").count() > 0  # ids are texts


def test_hits_of_clauses_with_several_rows_stay_single(spark):
    hits = frame(spark, [(1, "c", None), (1, "c", None)], "hit int, clause_id string, item_id string")
    clauses = frame(spark, [("c", 9), ("c", 7)], "clause_id string, page int")
    spans = frame(spark, [], "owner_type string, owner_id string, seq int, span_id string")
    assert [(r.hit, r.page) for r in items.hydrate(hits, clauses, spans).collect()] == [(1, 7)] * 2


# -- structures read back -------------------------------------------------------------------------


def random_element(rng, depth=0):
    pick = lambda *values: rng.choice(values)
    node = {"id": pick(None, *[f"n{i}" for i in range(9)]), "title": pick(None, "", "第1章 a", "第2条 b", "1.1 c", "1.1.2 d", "1 e", "第x条 f"), "content": pick(None, "（1）g", "1) h", "(2) i", "a) j", "k", "l")}
    if rng.random() < 0.5:
        node["content_tags"] = {"role": pick("CLAUSE", "NON_CLAUSE"), "score": pick(1, "x")}
    if depth < 4:
        node["children"] = [random_element(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return node


def plain_structure(flat, tokens):
    """Elements of one document by kind, with their parents, from its flat rows; kind and number as given by order."""
    rows = [{"id": r.id, "at": r.order_index, "up": r.parent_id, "kind": tokens[r.order_index][0], "number": tokens[r.order_index][1]} for r in sorted(flat, key=lambda r: r.order_index) if r.id is not None]
    held = collections.defaultdict(list)
    for r in rows:
        held[r["id"]].append(r["kind"])
    digits = lambda r: re.findall(r"\d+", r["number"]) if r["number"] else None
    found = {"section": {}, "clause": {}, "clause_item": {}}
    for i, r in enumerate(rows):
        before = rows[:i][::-1]
        up = min(held[r["up"]]) if r["up"] in held else None
        own = lambda kind, r=r, up=up: r["up"] if up == kind else None
        last = lambda fits, before=before: next((b["id"] for b in before if fits(b)), None)
        if r["kind"] == "section":
            links = (own("section"),)
        elif r["kind"] == "clause":
            d = digits(r)
            prefix = last(lambda b: b["kind"] == "clause" and digits(b) is not None and len(digits(b)) < len(d) and d[: len(digits(b))] == digits(b)) if d is not None else None
            links = (own("section") or last(lambda b: b["kind"] == "section"), own("clause") or prefix)
        else:
            n, item = r["number"] or "", lambda b, pattern: b["kind"] == "clause_item" and re.search(pattern, b["number"] or "")
            bracket = last(lambda b: item(b, r"[（(]")) if re.match(r"\d+\)", n) else last(lambda b: item(b, r"^\(\d+\)")) if re.match(r"[a-zA-Z]\)", n) else None
            links = (own("clause") or last(lambda b: b["kind"] == "clause"), own("clause_item") or bracket)
        found[r["kind"]][r["at"]] = (r["id"], *links)
    return found


def plain_back(found):
    """Ids in arrays in arrays: sections with clauses with items, clauses of no section, items of no clause."""
    under = lambda children, id: [c for _, c in sorted(children.items()) if c[1] == id]
    loose = lambda children, parents: [c for _, c in sorted(children.items()) if c[1] not in {p[0] for p in parents.values()}]
    clause = lambda c: (c[0], [i[0] for i in under(found["clause_item"], c[0])])
    sections = [(s[0], [clause(c) for c in under(found["clause"], s[0])]) for _, s in sorted(found["section"].items())]
    return sections, [clause(c) for c in loose(found["clause"], found["section"])], [i[0] for i in loose(found["clause_item"], found["clause"])]


def parents_of(built):
    kinds = zip(built, [("parent_id",), ("section_id", "parent_clause_id"), ("clause_id", "parent_item_id")], strict=True)
    out = collections.defaultdict(lambda: {"section": {}, "clause": {}, "clause_item": {}})
    for kind, (rows, links) in zip(("section", "clause", "clause_item"), kinds, strict=True):
        for r in rows.collect():
            assert r.order_index not in out[r.k][kind]
            out[r.k][kind][r.order_index] = (r.id, *[r[c] for c in links])
    return out


def ids_of(back):
    clause = lambda c: (c.id, [i.id for i in c["items"]])
    return {r.k: ([(s.id, [clause(c) for c in s.clauses]) for s in r.sections], [clause(c) for c in r.clauses], [i.id for i in r["items"]]) for r in back.collect()}


def test_parents_and_nesting_of_random_documents(spark):
    rng = random.Random(4)
    docs = [(k, json.dumps(random_element(rng))) for k in [None, *range(12)]]
    flat = tree.flatten_json(frame(spark, docs, "k int, j string"), "k", "j")
    built = structure.build(flat, "k")
    rows, tokens = collections.defaultdict(list), collections.defaultdict(dict)
    for r in flat.collect():
        rows[r.k].append(r)
    for kind, table in zip(("section", "clause", "clause_item"), built, strict=True):
        for r in table.collect():
            tokens[r.k][r.order_index] = (kind, r.number_token)
    expected = {k: plain_structure(rows[k], tokens[k]) for k in tokens}
    once_through, in_steps = structure.build_related(flat, "k"), structure.relate(built, "k")
    assert parents_of(once_through) == expected == parents_of(in_steps)
    assert [t.columns for t in once_through] == [t.columns for t in built] == [t.columns for t in in_steps]
    assert sum(len(e["clause"]) for e in expected.values()) > 50 < sum(len(e["clause_item"]) for e in expected.values())
    assert ids_of(structure.read_back(once_through, "k")) == {k: plain_back(e) for k, e in expected.items()}
    # rows that were deleted leave children without parents
    marked = structure.Structure(*[t.withColumn("deleted", F.col("order_index") % 3 == 0) for t in structure.relate(structure.Structure(*[t.withColumn("extra", F.lit(i)) for i, t in enumerate(built)]), "k")])
    live = {k: {kind: {at: r for at, r in e[kind].items() if at % 3} for kind in e} for k, e in expected.items()}
    live = {k: e for k, e in live.items() if any(e.values())}
    got = ids_of(structure.read_back(marked, "k"))
    assert got == {k: plain_back(e) for k, e in live.items()} and any(b[1] for b in got.values()) and any(b[2] for b in got.values())


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_document_is_dealt_out_once_to_be_structured_and_once_to_be_read_back(spark, monkeypatch):
    # every join dealt all rows out again, 73 exchanges in the registered query
    docs = frame(spark, [(k, chain(3)) for k in range(3)], "k int, j string")
    written, settle = [], structure.settle
    monkeypatch.setattr(structure, "settle", lambda df: written.append(df) or settle(df))
    built = structure.build_related(tree.flatten_json(docs, "k", "j"), "k")
    assert len(written) == 1 and exchanges(written[0]) == 1
    assert exchanges(structure.read_back(built, "k")) == 1
    structure.relate(built, "k")
    assert len(written) == 2 and exchanges(written[1]) == 1
