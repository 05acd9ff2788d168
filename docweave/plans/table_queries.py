"""Registered queries: parsers and sources, snapshots and filters, units with vectors, overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import rules, text
from docweave.operators import items, labels, search, store, summaries, tree
from docweave.plans import documents
from docweave.plans.item_queries import _NUMBERED
from docweave.plans.registry import _LABELLED, _LEVEL, _ROW_WINDOWS, SEGMENTS, _case, _row_windows, _segments, query
from docweave.sources import parsers

_BLOCK = r"""CASE WHEN regexp_matches(text, '^第[一二三四五六七八九十0-9]+[章节条款部分]') THEN 'heading1'
  WHEN regexp_matches(text, '^[0-9]+\.') OR regexp_matches(text, '^[一二三四五六七八九十]+[、．]') OR regexp_matches(text, '^[（(][0-9]+[）)]') OR regexp_matches(text, '^[（(][一二三四五六七八九十]+[）)]') THEN 'heading3'
  WHEN regexp_matches(text, '^[•·○●□■▪▫]') OR regexp_matches(text, '^[a-zA-Z]\.\s') THEN 'list1' ELSE 'paragraph1' END"""


@query(rf"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^[\s]+|[\s]+$', '', 'g')), lambda x: x <> '') AS xs FROM documents),
b AS (SELECT doc_id, unnest(range(CAST(len(xs) AS INT)))::INT AS pos, unnest(xs) AS text FROM p)
SELECT doc_id, pos, md5(text) AS digest, {_BLOCK} AS kind FROM b""")
def parse_plain_text(t) -> DataFrame:
    blocks = parsers.parse(t("documents"), "doc_id", "text", "txt")
    return blocks.select("doc_id", "pos", F.md5("text").alias("digest"), F.concat("block_type", F.col("level").cast("string")).alias("kind"))


_TYPES = "CASE page_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/MSWORD' WHEN 2 THEN 'application/vnd.ms-excel' WHEN 3 THEN 'Text/HTML; charset=utf-8' WHEN 4 THEN 'text/plain' END"


@query(f"""
WITH p AS (SELECT page_id, url, {_TYPES} AS t FROM pages), l AS (SELECT page_id, lower(coalesce(t, '')) AS t, lower(coalesce(url, '')) AS u FROM p)
SELECT page_id, CASE WHEN contains(t, 'pdf') THEN 'pdf' WHEN contains(t, 'word') OR contains(t, 'docx') THEN 'docx' WHEN contains(t, 'excel') OR contains(t, 'xlsx') THEN 'xlsx' WHEN contains(t, 'html') THEN 'html' WHEN contains(t, 'text') THEN 'text'
  WHEN ends_with(u, '.pdf') THEN 'pdf' WHEN ends_with(u, '.docx') THEN 'docx' WHEN ends_with(u, '.xlsx') THEN 'xlsx' WHEN ends_with(u, '.html') THEN 'html' ELSE 'text' END AS kind FROM l""")
def sniff_content_types(t) -> DataFrame:
    return t("pages").select("page_id", text.sniff_type(F.expr(_TYPES), F.col("url")).alias("kind"))


@query(r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g') AS x FROM pages),
l AS (SELECT page_id, list_transform(string_split(x, chr(10)), lambda s: string_split(regexp_replace(s, '^[\s]+|[\s]+$', '', 'g'), '  ')) AS ls FROM b)
SELECT page_id, md5(array_to_string(list_filter(list_transform(flatten(ls), lambda s: regexp_replace(s, '^[\s]+|[\s]+$', '', 'g')), lambda s: s <> ''), chr(10))) AS digest FROM l""")
def html_to_text(t) -> DataFrame:
    return t("pages").select("page_id", F.md5(parsers.html_text(F.col("html"))).alias("digest"))


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'rich_content' WHEN url <> '' THEN 'file_url' END AS kind, md5(CASE WHEN page_id % 3 <> 0 THEN html ELSE url END) AS digest FROM pages")
def route_sources(t) -> DataFrame:
    chosen = parsers.choose_source(F.when(F.col("page_id") % 3 != 0, F.col("html")).when(F.col("page_id") % 3 == 0, F.lit("")), F.col("url"))
    return t("pages").select("page_id", chosen.alias("s")).select("page_id", "s.kind", F.md5("s.value").alias("digest"))


@query("SELECT conv_id, turn::VARCHAR AS id, CAST(turn AS INT) AS order_index, md5(text) AS digest FROM conversations WHERE conv_id % 9 <> 0")
def json_segments(t) -> DataFrame:
    each = F.struct(F.col("turn").cast("string").alias("id"), F.col("turn").alias("order_index"), "text")
    listed = t("conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(each)).alias("j"))
    broken = listed.withColumn("j", F.when(F.col("conv_id") % 9 == 0, F.left("j", F.length("j") - 2)).otherwise(F.col("j")))
    return parsers.read_segments(broken, "conv_id", "j").select("conv_id", "id", "order_index", F.md5("text").alias("digest"))


@query("""
WITH t AS (SELECT c_custkey AS id, c_name AS name, c_custkey % 5 = 0 AS deleted FROM customer),
a AS (SELECT * FROM t UNION ALL SELECT 1000000 + s_suppkey, s_name, false FROM supplier),
r AS (SELECT id, name, deleted OR id % 7 = 1 AS deleted FROM a UNION ALL SELECT id, 'again ' || id, false FROM a WHERE id % 7 = 1),
i AS (SELECT * FROM r UNION ALL SELECT 2000000 + n_nationkey, n_name, false FROM nation)
SELECT id, name, count(*) AS n FROM i WHERE NOT deleted GROUP BY ALL""")
def snapshot_writes(t) -> DataFrame:
    table = t("customer").selectExpr("c_custkey as id", "c_name as name", "c_custkey % 5 = 0 as deleted")
    table = store.append(table, t("supplier").selectExpr("1000000 + s_suppkey as id", "s_name as name", "false as deleted"))
    again = table.where("id % 7 = 1").selectExpr("id", "concat('again ', id) as name")
    table = store.replace_by_id(table, again, "id")
    # created only where absent: half of these are there already
    nations = t("nation").selectExpr("2000000 + n_nationkey as id", "n_name as name", "false as deleted")
    table = store.insert_absent(store.insert_absent(table, nations, "id"), nations, "id")
    return store.live(table).groupBy("id", "name").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND lang IN ('en', 'de') AND contains(text, ' der ')")
def filters_composed(t) -> DataFrame:
    rows = t("documents").join(t("labels"), "doc_id", "left")
    kept = store.safe_filter(rows, {"lang": ["en", "de"], "unknown": "x", "source": None}, ("lang", "source"))
    return store.search(store.find(kept, null=["quality"]), ["text"], " der ").select("doc_id", "source")


@query("""
SELECT doc_id, CASE WHEN n_chars > 5000 THEN '413 too large' WHEN lang NOT IN ('en', 'fr') THEN '400 type not allowed' END AS error FROM documents""")
def upload_guards(t) -> DataFrame:
    mime = F.when(F.col("lang") == "en", "text/plain").when(F.col("lang") == "fr", "text/markdown").otherwise("image/png")
    return t("documents").select("doc_id", store.upload_errors(F.col("n_chars"), mime, 5000).alias("error"))


@query(f"""
WITH {_NUMBERED}, k AS (SELECT l_orderkey, o, CASE o % 5 WHEN 0 THEN '（' || (l_partkey % 10) || '）' WHEN 1 THEN (l_partkey % 10) || ')' WHEN 2 THEN '(' || (l_partkey % 10) || ')' WHEN 3 THEN 'a)' END AS number FROM n)
SELECT a.l_orderkey, CAST(a.o AS INT) AS o, CAST(CASE WHEN a.o % 5 = 1 THEN (SELECT max(b.o) FROM k b WHERE b.l_orderkey = a.l_orderkey AND b.o < a.o AND b.o % 5 IN (0, 2)) WHEN a.o % 5 = 3 THEN (SELECT max(b.o) FROM k b WHERE b.l_orderkey = a.l_orderkey AND b.o < a.o AND b.o % 5 = 2) END AS INT) AS parent FROM k a""")
def parent_items(t) -> DataFrame:
    rows = t("lineitem").selectExpr("*", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o")
    number = "CASE o % 5 WHEN 0 THEN '（' || (l_partkey % 10) || '）' WHEN 1 THEN (l_partkey % 10) || ')' WHEN 2 THEN '(' || (l_partkey % 10) || ')' WHEN 3 THEN 'a)' END"
    return tree.parent_item(rows.selectExpr("l_orderkey", "o", f"{number} AS number"), "l_orderkey", "o", "number").select("l_orderkey", "o", "parent")


_UNITS = f"""{_LABELLED},
k AS (SELECT * FROM sc WHERE {_LEVEL} >= '2'),
u AS (SELECT *, sum(CASE WHEN nc_type = 'TITLE' OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seg_id) - 1 AS unit
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_id) AS rn FROM k)),
m AS (SELECT doc_id, CAST(unit AS BIGINT) AS unit, CAST(min(seg_id) AS INT) AS first, count(*) AS n, string_agg(text, chr(10) ORDER BY seg_id) AS content, CAST(min(score_float) AS DOUBLE) AS score FROM u GROUP BY doc_id, unit)"""
_NEUTRAL = {"regions": rules.NEUTRAL_REGIONS, "nc_types": rules.NEUTRAL_NC_TYPES, "role_words": rules.NEUTRAL_ROLE_WORDS, "pattern": r"\A(?!)", "least": 4}


def _lengths(texts: list[str]) -> list[list[float]]:
    """Stands for an embedding model."""
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query(f"""
WITH {_UNITS}
SELECT doc_id, unit, sha256(doc_id || '|' || unit) AS item_id, substr(content, 1, 50) AS clause_title, md5(content) AS digest, first, n, score,
       CASE WHEN score >= 3.5 THEN '4' WHEN score >= 2.5 THEN '3' WHEN score >= 1.5 THEN '2' WHEN n > 1 AND score < 0.5 THEN '0' ELSE '1' END AS level,
       CAST(length(content) AS DOUBLE) AS v0, CAST(length(content) - length(replace(content, 'e', '')) AS DOUBLE) AS v1 FROM m""")
def embedded_units(t) -> DataFrame:
    units = documents.labelled_units(t("documents"), "doc_id", "text", "2", **_NEUTRAL)
    made = documents.embed(documents.ingest_items(units, "doc_id"), "content", _lengths)
    graded = made.withColumn("level", labels.regrade(F.col("score"), F.col("loc.n")))
    return graded.select("doc_id", "unit", "item_id", "clause_title", F.md5("content").alias("digest"), "loc.first", "loc.n", "score", "level", F.get("embedding", 0).alias("v0"), F.get("embedding", 1).alias("v1"))


@query("SELECT p_partkey, trim(concat_ws(' ', CASE WHEN p_partkey % 2 = 0 THEN p_partkey || '.' END, CASE WHEN p_partkey % 3 > 0 THEN p_name END, p_type)) AS whole FROM part")
def vector_texts(t) -> DataFrame:
    rows = t("part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat("p_partkey", F.lit("."))).alias("number"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).otherwise("").alias("title"), F.col("p_type").alias("content"))
    return rows.select("p_partkey", search.vector_text("number", "title", "content").alias("whole"))


@query(f"""
WITH {SEGMENTS}, s AS (SELECT doc_id, substr(string_agg('【无标题】' || text, chr(10) || chr(10) ORDER BY seg_id), 1, 15000) AS text FROM seg GROUP BY doc_id), f AS (SELECT * FROM s ORDER BY doc_id LIMIT 8)
SELECT substr(string_agg(text, chr(10) || chr(10) ORDER BY doc_id), 1, 500) AS overview, count(*) AS n_docs FROM f""")
def overview(t) -> DataFrame:
    return summaries.overview(summaries.summarize(_segments(t).withColumn("title", F.lit("")), "doc_id", "seg_id", "title", "text"), "doc_id", "text")


@query("""
SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS place FROM lineitem) WHERE place BETWEEN 3 AND 4""")
def spans_of_owners(t) -> DataFrame:
    # the second page of two spans of every owner
    return store.page_of_owners(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], 2, 2).select("l_orderkey", "l_linenumber", "l_partkey", "place")


_ROLE = f"CASE WHEN {' + '.join(f"CAST(contains(lower(whole), '{w}') AS INT)" for w in rules.NEUTRAL_ROLE_WORDS)} >= 4 THEN 'CLAUSE' ELSE 'NON_CLAUSE' END"
_RICH = "CASE WHEN turn % 2 = 0 THEN '<p>' || text || '</p>' ELSE text END"


@query(f"""
WITH {_ROW_WINDOWS},
w AS (SELECT conv_id, k, string_agg(text, ' ' ORDER BY i) AS whole FROM rw GROUP BY conv_id, k),
v AS (SELECT conv_id, i, {_ROLE} AS role, count(*) AS n FROM rw JOIN w USING (conv_id, k) GROUP BY ALL),
b AS (SELECT conv_id, i, arg_min(role, (-n, role)) AS role FROM v GROUP BY ALL),
g AS (SELECT conv_id, turn, i, text, {_case(rules.NEUTRAL_REGIONS, "'MAIN'")} AS region FROM c),
t AS (SELECT *, CASE region {' '.join(f"WHEN '{k}' THEN {_case(v, 'NULL')}" for k, v in rules.NEUTRAL_NC_TYPES.items())} END AS nc_type FROM g JOIN b USING (conv_id, i)),
sc AS (SELECT conv_id, turn, region, nc_type, role, (CASE role WHEN 'CLAUSE' THEN 4 ELSE 0 END * 4 + CASE region WHEN 'MAIN' THEN 2 WHEN 'APPENDIX' THEN 1 ELSE 0 END * 2 + CASE WHEN nc_type = 'CLAUSE_BODY' THEN 4 WHEN nc_type = 'TITLE' THEN 1 WHEN nc_type IS NULL THEN 1 ELSE 0 END * 4) / 10.0 AS score_float FROM t)
SELECT conv_id, turn, region, nc_type, role, CAST(score_float AS DOUBLE) AS score_float, {_LEVEL} AS score FROM sc""")
def label_rich_rows(t) -> DataFrame:
    # rows with tags: stripped, put into windows, labelled, voted, scored
    rich = t("conversations").withColumn("text", F.expr(_RICH))
    stripped = rich.withColumn("text", F.when(text.sniff_rich_text(F.col("text")) == "html", text.strip_tags(F.col("text"))).otherwise(F.col("text")))
    labelled = labels.label_windows(_row_windows(lambda name: stripped if name == "conversations" else t(name)), "conv_id", "turn", "text", rules.NEUTRAL_REGIONS, rules.NEUTRAL_NC_TYPES, rules.NEUTRAL_ROLE_WORDS, r"\A(?!)", 4)
    return labelled.withColumn("_s", labels.score_b(F.col("region"), F.col("nc_type"), F.col("role"))).select("conv_id", "turn", "region", "nc_type", "role", "_s.score_float", "_s.score")


@query("""
WITH s AS (SELECT o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_custkey FROM orders)
SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (i <= 3) AS first_orders, count(*) AS n FROM s GROUP BY o_custkey""")
def capped_children(t) -> DataFrame:
    found = items.with_children(t("customer").select("c_custkey"), t("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["o_orderkey"], [], "orders").where(F.size("orders") > 0)
    first = F.transform(F.slice("orders", 1, 3), lambda o: o["o_orderkey"].cast("string"))
    return found.select(F.col("c_custkey").alias("o_custkey"), F.array_join(first, ",").alias("first_orders"), F.size("orders").cast("bigint").alias("n"))


_FOUND = """
v AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS a, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS b FROM documents WHERE text <> ''),
u AS (SELECT doc_id, a / sqrt(a * a + b * b) AS a, b / sqrt(a * a + b * b) AS b FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.doc_id AS query_id, t.doc_id, round(q.a * t.a + q.b * t.b, 6) AS score FROM u q, u t WHERE q.doc_id % 50 = 0)),
h AS (SELECT query_id, rank, doc_id, doc_id % 25 AS clause, CASE WHEN doc_id % 3 = 0 THEN 'CLAUSE' ELSE 'CLAUSE_ITEM' END AS unit_type, score FROM r WHERE rank <= 30),
f AS (SELECT query_id, clause, min(rank) AS first, arg_min(rank, (-score, rank)) AS best FROM h WHERE unit_type = 'CLAUSE' GROUP BY ALL),
p AS (SELECT h.*, f.first, f.best FROM h LEFT JOIN f USING (query_id, clause)),
s AS (SELECT query_id, clause, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS sub FROM p WHERE unit_type = 'CLAUSE_ITEM' AND rank > best GROUP BY ALL),
e AS (SELECT p.*, 0 AS alone, first AS met FROM p WHERE unit_type = 'CLAUSE' AND rank = best UNION ALL SELECT p.*, 1, rank FROM p WHERE unit_type = 'CLAUSE_ITEM' AND (first IS NULL OR rank < first))"""


@query(f"""
WITH {_FOUND}
SELECT e.query_id, CAST(row_number() OVER (PARTITION BY e.query_id ORDER BY score DESC, alone, met) AS INT) AS place, unit_type, e.clause, doc_id, score, CASE WHEN alone = 0 THEN coalesce(sub, '') ELSE '' END AS sub_items
FROM e LEFT JOIN s USING (query_id, clause)""")
def search_texts(t) -> DataFrame:
    docs = t("documents").where("text <> ''")
    table = documents.embed(docs, "text", _lengths).select("doc_id", "embedding", F.when(F.col("doc_id") % 3 == 0, "CLAUSE").otherwise("CLAUSE_ITEM").alias("unit_type"), (F.col("doc_id") % 25).alias("clause"))
    found = documents.search_texts(docs.where("doc_id % 50 = 0"), table, "doc_id", "text", _lengths, 30)
    return found.withColumn("sub_items", F.array_join(F.transform("sub_items", lambda s: s["item"].cast("string")), ","))
