"""Parsers, sources, uploads and composed pipelines on small and odd inputs."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from docweave.functions import text
from docweave.operators import labels, search, store, structure, tree
from docweave.plans import documents
from docweave.sources import parsers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_pages_are_read_in_time_linear_in_their_length():
    def seconds(n):
        page = "".join(f"<div>text {i} " for i in range(n))
        began = time.perf_counter()
        texts, elements = parsers.html_elements(page)
        assert len(texts) == n == len(elements) and elements[0][:2] == (0, n) and elements[-1][:2] == (n - 1, n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4000), 0.005)
    closing = "<div>" * 20_000 + "</p>" * 20_000  # nothing that these could close
    began = time.perf_counter()
    assert len(parsers.html_elements(closing)[1]) == 20_000 and time.perf_counter() - began < 3


def plain_blocks(content):
    """Every open element takes each text: the plain way."""
    from html.parser import HTMLParser

    kinds, out, open_ = parsers._Blocks.KINDS, [], []
    silent = 0

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            nonlocal silent
            if tag in ("script", "style"):
                silent += 1
            elif tag in kinds:
                if tag == "p" and open_ and open_[-1][0] == "p":
                    self.handle_endtag("p")
                own = [tag, []]
                out.append(own)
                open_.append(own)

        def handle_endtag(self, tag):
            nonlocal silent
            if tag in ("script", "style"):
                silent = max(0, silent - 1)
            elif any(o[0] == tag for o in open_):
                while open_.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            if not silent:
                for o in open_:
                    o[1].append(data)

    reader = Reader(convert_charrefs=True)
    reader.feed(content)
    reader.close()
    blocks = [(" ".join("".join(parts).split()), *kinds[tag]) for tag, parts in out]
    return [b for b in blocks if b[0]]


def test_ranges_give_the_texts_of_every_element(spark):
    rng = random.Random(5)
    bits = ["<div>", "</div>", "<p>", "</p>", "<h2>", "</h2>", "<ul>", "<li>", "</ul>", "<script>x</script>", "<style>", "</style>", " a ", "é&amp;b", "\n", "<b>bold</b>", "</table>", "<table>", "&lt;p&gt;", "<!-- c -->"]
    pages = [(i, "".join(rng.choices(bits, k=rng.randint(0, 40)))) for i in range(300)] + [(900, None), (901, ""), (902, "no tags")]
    for _, page in pages:
        assert parsers.html_blocks(page or "") == plain_blocks(page or "")
    df = frame(spark, pages, "k int, html string")
    ranges = parsers.parse_html_ranges(df, "k", "html").select("k", "texts", F.posexplode("elements").alias("p", "e"))
    joined = F.array_join(F.slice("texts", F.col("e.begin") + 1, F.col("e.end") - F.col("e.begin")), "")
    got = ranges.select("k", "p", F.trim(F.regexp_replace(joined, r"(?U)\s+", " ")).alias("t"), "e.block_type", "e.level").where("t <> ''").orderBy("k", "p").collect()
    want = parsers.parse(df, "k", "html", "html").orderBy("k", "pos").collect()
    assert [(r.k, r.t, r.block_type, r.level) for r in got] == [(r.k, r.text, r.block_type, r.level) for r in want]


def test_formats_are_added_and_sources_chosen(spark, tmp_path):
    parsers.register_parser("csv", lambda c: [(line, "table", 1) for line in c.split("\n") if line])
    assert [r.text for r in parsers.parse(frame(spark, [(1, "a,b\nc,d"), (2, None)], "k int, t string"), "k", "t", "csv").collect()] == ["a,b", "c,d"]
    with pytest.raises(ValueError, match="no parser for pdf"):
        parsers.parse(frame(spark, [(1, "x")], "k int, t string"), "k", "t", "pdf")
    rows = frame(spark, [("<p>x", "u"), ("", "u"), (None, None), ("", "")], "rich string, url string").select(parsers.choose_source(F.col("rich"), F.col("url")).alias("s"))
    assert [(r.s.kind, r.s.value) if r.s else None for r in rows.collect()] == [("rich_content", "<p>x"), ("file_url", "u"), None, None]
    bare = frame(spark, [("<style>p{}</style><p>one  two</p>\n\n <b> three </b><SCRIPT>x\ny</SCRIPT>",), (None,)], "h string").select(parsers.html_text(F.col("h")).alias("t")).collect()
    assert [r.t for r in bare] == ["one\ntwo\nthree", None]
    (tmp_path / "a.bin").write_bytes(b"abc")
    file = parsers.read_binary_files(spark, f"file://{tmp_path}").first()
    assert (file.length, bytes(file.content)) == (3, b"abc") and file.checksum.startswith("ba7816bf")
    listed = [(1, json.dumps([{"id": "a", "order_index": 2, "text": "x", "page": None}, {"id": "b"}])), (2, "{broken"), (3, None)]
    assert sorted((r.k, r.id, r.order_index) for r in parsers.read_segments(frame(spark, listed, "k int, j string"), "k", "j").collect()) == [(1, "a", 2), (1, "b", None)]


def test_uploads_that_are_refused(spark):
    rows = frame(spark, [(5, "text/plain"), (200 << 20, "text/html"), (5, "image/png"), (5, None)], "size bigint, mime string")
    assert [r.e for r in rows.select(store.upload_errors(F.col("size"), F.col("mime")).alias("e")).collect()] == [None, "413 too large", "400 type not allowed", "400 type not allowed"]


def test_accounts_of_an_ingestion(spark):
    items = frame(spark, [("a", "x", 1), ("b", "", 1), ("c", "y", None), ("d", "z", 1)], "id string, content string, v int")
    got = store.ingest(items, "id", "content", "v", 2)
    assert sorted((r.item_index, r.id, r.batch, r.reason) for r in got.collect()) == [(0, "a", 0, None), (1, "b", 0, "empty content"), (2, "c", 1, "no embedding"), (3, "d", 1, None)]
    assert tuple(store.ingest_summary(got).first()) == (4, 2, 2, "partial_failed")
    whole = {r.id: r.reason for r in store.ingest(items, "id", "content", "v", 2, whole=True).collect()}
    assert whole == {"a": None, "b": "empty content", "c": "no embedding", "d": "batch failed"}
    assert store.ingest(items.limit(0), "id", "content", "v").count() == 0


def test_units_and_their_vectors(spark):
    docs = frame(spark, [("d", "第一条 双方应当履行义务\n双方有权解除，应当承担责任"), ("e", None), ("f", "")], "k string, t string")
    units = documents.labelled_units(docs, "k", "t")
    rows = documents.ingest_items(units, "k")
    made = documents.embed(rows, "content", lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert {r.k for r in made} == {"d"} and all(r.embedding == [float(len(r.content)), 1.0] and r.unit_type == "CLAUSE" and len(r.item_id) == 64 for r in made)
    documents.register_model("lengths", lambda texts: [[float(len(t))] for t in texts])
    assert documents.embed(frame(spark, [(None,)], "content string"), "content", "lengths").first().embedding == [0.0]
    with pytest.raises(ValueError, match="no model other: register it; known: lengths"):
        documents.embed(docs, "t", "other")
    parts = frame(spark, [("1.", None, "c"), ("", "t", ""), (None, None, None)], "n string, t string, c string")
    assert [r.v for r in parts.select(search.vector_text("n", "t", "c").alias("v")).collect()] == ["1. c", "t", ""]


def test_headings_become_sections(spark):
    rows = [("d", 1, " A ", "NON_CLAUSE", "heading", 2, 7), ("d", 2, "b", "NON_CLAUSE", "paragraph", 1, 7), ("d", 3, "C", "NON_CLAUSE", "heading", None, None), ("d", 4, "e", "CLAUSE", "heading", 1, 8)]
    df = frame(spark, rows, "k string, o int, text string, role string, block_type string, level int, page int")
    assert [(r.section_index, r.title, r.level, r.loc.segment, r.loc.page) for r in tree.sections_from_headings(df, "k", "o").collect()] == [(1, "A", 2, 1, 7), (2, "C", 1, 3, None)]
    assert tree.sections_from_headings(df.drop("level", "page"), "k", "o").count() == 2


def test_domains_need_a_contract(spark):
    rows = frame(spark, [("Loan Agreement", "property lease"), ("Privacy policy", "loan funding"), (None, None), ("关于房屋的规定", "办法")], "t string, c string")
    got = [r.x for r in rows.select(labels.classify_document(F.col("t"), F.col("c")).alias("x")).collect()]
    assert [(x.type, x.domain) for x in got] == [("CONTRACT", "PROPERTY"), ("POLICY", "OTHER"), ("CONTRACT", "PROPERTY"), ("REGULATION", "OTHER")]
    assert got[1].domain_confidence == 0 and got[2].type_confidence == 0
    tags = {k: c.alias(k) for k, c in text.business_tags(F.col("t")).items()}
    found = frame(spark, [("北京市，" + "很" * 20 + "市。市",)], "t string").select(tags["location"]).first().location
    assert found == ["北京市"]  # neither one of 1 nor one of 21 characters


def test_documents_structured_saved_and_read_back(spark):
    nested = {"id": "r", "title": "第一章 总则", "children": [
        {"id": "i0", "content": "（1）早", "content_tags": {"role": "CLAUSE"}},
        {"id": "c1", "title": "第1条 甲", "children": [{"id": "i1", "content": "（1）乙", "children": [{"id": "i2", "content": "1) 丙"}]}]},
        {"id": "c2", "title": "1.1 丁", "content_tags": {"nc_type": "TITLE", "score": "x"}}, {"title": "no id"}, {"id": "i3", "content": "（2）戊"},
    ]}
    docs = frame(spark, [("d", json.dumps(nested), "completed", None), ("e", "{", "completed", None), ("f", "{}", "completed", None), ("g", "{}", "pending", None), ("h", None, "completed", "processing")], "k string, j string, parse_status string, structure_status string")
    after, built = structure.structure_documents(docs, "j", "k")
    got = {r.k: (r.error, r.structure_status, r.total_sections, r.total_clauses, r.total_items) for r in after.collect()}
    assert got == {"d": (None, "completed", 1, 2, 4), "e": ("is no JSON", "failed", 0, 0, 0), "f": ("no parse result", "failed", 0, 0, 0), "g": ("parse_status not completed", "failed", 0, 0, 0), "h": ("processing", "failed", 0, 0, 0)}
    clauses = {r.id: r for r in built.clauses.collect()}
    assert (clauses["c1"].section_id, clauses["c1"].number_token, clauses["c1"].title, clauses["c1"].score) == ("r", "第1条", "甲", 2)
    assert (clauses["c2"].number_token, clauses["c2"].parent_clause_id, clauses["c2"].nc_type, clauses["c2"].score) == ("1", None, "TITLE", 2)
    items = {r.id: (r.clause_id, r.parent_item_id) for r in built.items.collect()}
    assert items == {"i0": (None, None), "i1": ("c1", None), "i2": ("c1", "i1"), "i3": ("c2", None)}
    back = {r.k: r for r in structure.read_back(built, "k").collect()}
    assert [c.id for c in back["d"].sections[0].clauses] == ["c1", "c2"] and [i.id for i in back["d"].sections[0].clauses[0]["items"]] == ["i1", "i2"] and [i.id for i in back["d"]["items"]] == ["i0"]
    redone = docs.where("k in ('d', 'e')").select("k")
    none = structure.Structure(*[t.limit(0) for t in built])
    saved, tables = structure.save(docs, built, none, "k", redone)
    assert all(t.count() == 0 for t in tables) and {r.k: r.total_items for r in saved.collect()} == {"d": 0, "e": 0, "f": None, "g": None, "h": None}
