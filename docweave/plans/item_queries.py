"""Registered queries: items, their places, trees and validation; hits and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import rules
from docweave.operators import items, labels, search, store, summaries, tree
from docweave.plans.registry import _NUMBERS, _ROW_WINDOWS, _case, _numbers, _row_windows, query


@query("""
SELECT 'SECTION' AS unit_type, c_nationkey::VARCHAR AS doc_id, 'document_' || c_nationkey AS doc_name, c_custkey::VARCHAR AS section_id, NULL AS clause_id, NULL AS item_id,
       c_name AS section_title, NULL AS clause_order_index, 'NON_CLAUSE' AS role, 'MAIN' AS region, c_mktsegment AS content FROM customer
UNION ALL SELECT 'CLAUSE', (o_custkey % 25)::VARCHAR, 'document_' || (o_custkey % 25), o_custkey::VARCHAR, o_orderkey::VARCHAR, NULL, NULL, o_orderkey % 100, 'CLAUSE', o_orderstatus, '' FROM orders
UNION ALL SELECT 'CLAUSE_ITEM', l_suppkey::VARCHAR, 'document_' || l_suppkey, NULL, l_orderkey::VARCHAR, l_partkey::VARCHAR, NULL, NULL, CASE WHEN l_returnflag = 'N' THEN 'CLAUSE' ELSE l_returnflag END, 'MAIN', l_linestatus FROM lineitem""")
def structure_items(t) -> DataFrame:
    sections = t("customer").selectExpr("c_nationkey as doc_id", "c_custkey as id", "c_name as title", "c_mktsegment as content")
    clauses = t("orders").selectExpr("o_custkey % 25 as doc_id", "o_orderkey as id", "o_custkey as section_id", "o_orderkey % 100 as order_index", "o_orderstatus as region")
    below = t("lineitem").selectExpr("l_suppkey as doc_id", "l_partkey as id", "l_orderkey as clause_id", "nullif(l_returnflag, 'N') as role", "l_linestatus as content")
    return items.structure_items(sections, clauses, below).select("unit_type", "doc_id", "doc_name", "section_id", "clause_id", "item_id", "section_title", "clause_order_index", "role", "region", "content")


@query("""
SELECT event_id, unit_type, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::VARCHAR AS embedding_id
FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'SECTION' WHEN 1 THEN 'CLAUSE' ELSE 'CLAUSE_ITEM' END AS unit_type FROM events)
WHERE unit_type <> 'SECTION' AND event_type <> 'error'""")
def batch_vectorize(t) -> DataFrame:
    rows = t("events").selectExpr("event_id", "user_id", "CASE event_id % 3 WHEN 0 THEN 'SECTION' WHEN 1 THEN 'CLAUSE' ELSE 'CLAUSE_ITEM' END AS unit_type", "nullif(event_type, 'error') AS content")
    return items.batch_vectorize(rows, "user_id", ["event_id"]).select("event_id", "unit_type", "embedding_id")


@query("""
WITH h AS (SELECT o_orderkey AS hit, o_custkey AS clause_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS item_id FROM orders),
s AS (SELECT 'CLAUSE_ITEM' AS owner_type, l_orderkey AS owner_id, CAST(l_linenumber AS BIGINT) AS seq, l_partkey AS span_id FROM lineitem UNION ALL SELECT 'CLAUSE', o_custkey, o_orderkey, o_orderkey + 7 FROM orders WHERE o_orderkey % 5 = 0),
g AS (SELECT owner_type, owner_id, string_agg(span_id::VARCHAR, ',' ORDER BY seq, span_id) AS ids, min(seq) AS first FROM s GROUP BY ALL)
SELECT hit, c_nationkey AS page, CASE WHEN c_custkey IS NULL THEN '' ELSE coalesce(ids, '') END AS span_ids, CASE WHEN c_custkey IS NOT NULL THEN 'block-' || clause_id || coalesce('-' || first, '') END AS block_id
FROM h LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON clause_id = c_custkey
LEFT JOIN g ON owner_type = CASE WHEN item_id IS NULL THEN 'CLAUSE' ELSE 'CLAUSE_ITEM' END AND owner_id = coalesce(item_id, clause_id)""")
def hydrate_hits(t) -> DataFrame:
    hits = t("orders").selectExpr("o_orderkey as hit", "o_custkey as clause_id", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END as item_id")
    spans = t("lineitem").selectExpr("'CLAUSE_ITEM' as owner_type", "l_orderkey as owner_id", "cast(l_linenumber as bigint) as seq", "l_partkey as span_id")
    own = t("orders").where("o_orderkey % 5 = 0").selectExpr("'CLAUSE' as owner_type", "o_custkey as owner_id", "o_orderkey as seq", "o_orderkey + 7 as span_id")
    clauses = t("customer").where("c_acctbal > 0").selectExpr("c_custkey as clause_id", "c_nationkey as page")
    return items.hydrate(hits, clauses, spans.unionByName(own)).select("hit", "page", F.array_join("span_ids", ",").alias("span_ids"), "block_id")


@query("SELECT p_partkey, array_to_string(list_transform(list_zip(string_split(p_name, ' '), string_split(p_type, ' '), true), lambda x: x[1] || '=' || x[2]), ',') AS pairs FROM part")
def positional_zip(t) -> DataFrame:
    words = t("part").select("p_partkey", F.split("p_name", " ").alias("a"), F.split("p_type", " ").alias("b"))
    pairs = F.transform(items.zip_shortest(F.col("a"), F.col("b")), lambda x: F.concat_ws("=", x["a"], x["b"]))
    return words.select("p_partkey", F.array_join(pairs, ",").alias("pairs"))


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k=even,new=1,type=' || event_type ELSE 'k=' || coalesce(json_extract_string(props, '$.k'), '') || ',type=' || event_type END AS merged FROM events""")
def overlay_maps(t) -> DataFrame:
    under = F.create_map(F.lit("k"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), F.lit("type"), F.col("event_type"))
    over = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("even"), F.lit("new"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>"))
    entries = F.array_sort(F.transform(F.map_entries(items.overlay(under, over)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return t("events").select("event_id", F.array_join(entries, ",").alias("merged"))


_NESTED = """'{"metadata": {' || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '"id": "d", ' END || '"title": ' || CASE WHEN o_orderkey % 5 = 0 THEN '5' ELSE '"t"' END || ', "drafters": ' || CASE WHEN o_orderkey % 11 = 0 THEN '"n"' ELSE '[]' END
 || '}, "structure": {"id": "s", "title": "' || o_orderpriority || '", "children": [{"content": "c", "content_tags": {"role": "CLAUSE", ' || CASE WHEN o_orderkey % 4 = 0 THEN '"colour": "red", ' ELSE '' END || '"score": ' || CASE WHEN o_orderkey % 3 = 0 THEN '"2"' ELSE '2' END
 || '}}]}, "vectorization": ' || CASE WHEN o_orderkey % 13 = 0 THEN '"yes"' ELSE 'true' END || '}'"""


@query(f"""
WITH d AS (SELECT o_orderkey, {_NESTED} AS j FROM orders),
n AS (SELECT o_orderkey, j, json_extract(j, '$.structure.children[0]') AS c FROM d)
SELECT o_orderkey, array_to_string(list_filter([
  CASE WHEN json_extract(j, '$.metadata.id') IS NULL THEN 'metadata.id is missing' END,
  CASE WHEN json_type(j, '$.metadata.drafters') <> 'ARRAY' THEN 'metadata.drafters is no list' END,
  CASE WHEN json_type(j, '$.metadata.title') <> 'VARCHAR' THEN 'metadata.title is no text' END,
  CASE WHEN json_type(j, '$.vectorization') <> 'BOOLEAN' THEN 'vectorization is no boolean' END,
  CASE WHEN json_extract(c, '$.id') IS NULL THEN 'id is missing' END,
  CASE WHEN list_contains(json_keys(c, '$.content_tags'), 'colour') THEN 'content_tags: unknown tag colour' END,
  CASE WHEN json_type(c, '$.content_tags.score') NOT IN ('UBIGINT', 'BIGINT') THEN 'content_tags.score is no whole number' END], lambda x: x IS NOT NULL), '; ') AS errors FROM n""")
def validate_documents(t) -> DataFrame:
    docs = t("orders").select("o_orderkey", F.expr(_NESTED).alias("j"))
    return tree.validate(docs, "o_orderkey", "j").select("o_orderkey", F.array_join("errors", "; ").alias("errors"))


@query(f"""
WITH RECURSIVE {_NUMBERS},
p AS (SELECT a.l_orderkey, a.o, (SELECT max(b.o) FROM r b WHERE b.l_orderkey = a.l_orderkey AND b.o < a.o AND b.number IS NOT NULL AND starts_with(a.number, b.number || '.')) AS parent FROM r a),
x AS (SELECT l_orderkey, o, 0 AS depth, o::VARCHAR AS path FROM p WHERE parent IS NULL
      UNION ALL SELECT p.l_orderkey, p.o, x.depth + 1, x.path || '/' || p.o FROM p JOIN x ON p.l_orderkey = x.l_orderkey AND p.parent = x.o)
SELECT l_orderkey, CAST(o AS INT) AS o, CAST(depth AS INT) AS depth, path FROM x""")
def item_tree(t) -> DataFrame:
    rows = tree.parent_by_prefix(_numbers(t), "l_orderkey", "o", "number").select("l_orderkey", "o", "parent")
    return tree.item_tree(rows, "l_orderkey", "o", "parent").select("l_orderkey", "o", "depth", "path")


_LINES = """CASE o % 4 WHEN 1 THEN '第' || o || '条 ' || l_returnflag WHEN 2 THEN '（' || (l_partkey % 10) || '） part' WHEN 3 THEN (l_partkey % 10) || '. supplier ' || l_suppkey ELSE 'plain ' || l_partkey END"""
_NUMBERED = f"""
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o FROM lineitem),
r AS (SELECT l_orderkey, o, {_LINES} AS text FROM n)"""


@query(f"""
WITH {_NUMBERED}, k AS (SELECT *, regexp_extract(text, '^([（\\(][一二三四五六七八九十\\d]+[）\\)]|\\d+\\.\\s)', 1) AS title FROM r),
f AS (SELECT l_orderkey, o, title, trim(substr(text, length(title) + 1)) AS content, (SELECT arg_min(b.o, (abs(b.o - a.o), b.o)) FROM r b WHERE b.l_orderkey = a.l_orderkey AND b.text LIKE '第%') AS clause FROM k a WHERE title <> '')
SELECT l_orderkey, CAST(o AS INT) AS o, title, content, CAST(clause AS INT) AS clause FROM f WHERE clause IS NOT NULL""")
def items_by_pattern(t) -> DataFrame:
    rows = t("lineitem").selectExpr("*", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o").selectExpr("l_orderkey", "o", f"{_LINES} AS text")
    return tree.items_by_pattern(rows, "l_orderkey", "o", "text", F.col("text").startswith("第")).select("l_orderkey", "o", "title", "content", "clause")


@query("""
WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.e, v.e) / (q.n * v.n), 6) AS score FROM u q, u v WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def cosine_topk(t) -> DataFrame:
    rows = search.unit_vectors(t("embeddings").select("vec_id", "embedding"), "embedding")
    return search.search_all(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 10)


@query("""
SELECT doc_id::VARCHAR AS doc_id, coalesce(CASE WHEN lang <> 'en' THEN lang END, 'zh') AS lang, coalesce(source, '') AS region, coalesce(quality, 1) AS score, '' AS id, '' AS unit_type, '' AS doc_name, 0 AS section_level, '{}' AS loc, 0.0::DOUBLE AS distance,
       md5(coalesce(text, '')) AS digest FROM documents LEFT JOIN labels USING (doc_id)""")
def hit_records(t) -> DataFrame:
    rows = t("documents").join(t("labels"), "doc_id", "left").selectExpr("cast(doc_id as string) as doc_id", "nullif(lang, 'en') as lang", "source as region", "quality as score", "text as content")
    return items.hit_records(rows).select("doc_id", "lang", "region", "score", "id", "unit_type", "doc_name", "section_level", "loc", "distance", F.md5("content").alias("digest"))


@query("""
SELECT doc_id, array_to_string(list_filter(['lang=' || CASE WHEN lang <> 'en' THEN lang END, 'region=' || source, 'nc_type=' || quality], lambda x: x IS NOT NULL), ',') AS metadata, true AS bare
FROM documents LEFT JOIN labels USING (doc_id)""")
def hit_projection(t) -> DataFrame:
    rows = t("documents").join(t("labels"), "doc_id", "left").selectExpr("doc_id", "nullif(lang, 'en') as lang", "source as region", "quality as nc_type", "text as content")
    shown = items.project_hits(rows, include_content=False)
    return shown.select("doc_id", F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("metadata"), F.col("content").isNull().alias("bare"))


@query("""
SELECT c_custkey, c_name, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name""")
def detail_with_children(t) -> DataFrame:
    found = items.with_children(t("customer"), t("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["o_orderkey"], ["o_orderstatus"], "orders")
    return found.select("c_custkey", "c_name", F.array_join(F.transform("orders", lambda o: F.concat_ws(":", o["o_orderkey"].cast("string"), o["o_orderstatus"])), ",").alias("orders"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND NOT o_totalprice < 100000")
def expression_filter(t) -> DataFrame:
    return store.expression_filter(t("orders"), "o_orderstatus IN ('F', 'O') AND NOT o_totalprice < 100000", ("o_orderstatus", "o_totalprice")).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 7 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE NOT (o_custkey % 7 = 0 AND o_orderstatus = 'P')")
def reprocess_rows(t) -> DataFrame:
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    again = rows.where("o_custkey % 7 = 0")
    return store.reprocess(rows, again.where("o_orderstatus <> 'P'").withColumn("o_orderstatus", F.lit("N")), "o_custkey", redone=again)


@query("SELECT doc_id, lang AS role, CASE WHEN quality = 1 THEN 'SIGN' ELSE source END AS region, CASE WHEN quality = 0 THEN 'TITLE' END AS nc_type, n_chars FROM documents LEFT JOIN labels USING (doc_id)")
def relabel_spans(t) -> DataFrame:
    spans = t("documents").selectExpr("doc_id", "lang as role", "source as region", "cast(null as string) as nc_type", "n_chars")
    changes = t("labels").selectExpr("doc_id", "cast(null as string) as role", "CASE WHEN quality = 1 THEN 'SIGN' END as region", "CASE WHEN quality = 0 THEN 'TITLE' END as nc_type", "cast(0 as bigint) as n_chars")
    return store.relabel(spans, changes, "doc_id")


_REPLY = """CASE event_id % 3 WHEN 0 THEN 'no spans here' WHEN 1 THEN '{"spans": [{"start": 0, "end": ' || event_id || ', "region": "' || event_type || '"}, {"start": 1, "end": 2, "role": "CLAUSE"}]}' ELSE '{"spans": []}' END"""


@query(f"""
WITH r AS (SELECT event_id, {_REPLY} AS reply FROM events), v AS (SELECT event_id, CASE WHEN json_valid(reply) THEN json_extract(reply, '$.spans') END AS s FROM r)
SELECT event_id, CAST(coalesce(json_array_length(s), 0) AS INT) AS n_spans, CAST(json_extract(s, '$[0].end') AS BIGINT) AS first_end, json_extract_string(s, '$[0].region') AS first_region, json_extract_string(s, '$[1].role') AS second_role FROM v""")
def reply_spans(t) -> DataFrame:
    spans = t("events").select("event_id", labels.reply_spans(F.expr(_REPLY)).alias("s"))
    return spans.select("event_id", F.size("s").alias("n_spans"), F.get("s", 0)["end"].alias("first_end"), F.get("s", 0)["region"].alias("first_region"), F.get("s", 1)["role"].alias("second_role"))


_ROLE = f"CASE WHEN {' + '.join(f"CAST(contains(lower(whole), '{w}') AS INT)" for w in rules.NEUTRAL_ROLE_WORDS)} >= 4 THEN 'CLAUSE' ELSE 'NON_CLAUSE' END"


@query(f"""
WITH {_ROW_WINDOWS},
w AS (SELECT conv_id, k, string_agg(text, ' ' ORDER BY i) AS whole FROM rw GROUP BY conv_id, k),
v AS (SELECT conv_id, i, {_ROLE} AS role, count(*) AS n FROM rw JOIN w USING (conv_id, k) GROUP BY ALL),
b AS (SELECT conv_id, i, arg_min(role, (-n, role)) AS role FROM v GROUP BY ALL),
g AS (SELECT conv_id, turn, i, text, {_case(rules.NEUTRAL_REGIONS, "'MAIN'")} AS region FROM c)
SELECT conv_id, turn, region, CASE region {' '.join(f"WHEN '{k}' THEN {_case(v, 'NULL')}" for k, v in rules.NEUTRAL_NC_TYPES.items())} END AS nc_type, role FROM g JOIN b USING (conv_id, i)""")
def label_row_windows(t) -> DataFrame:
    return labels.label_windows(_row_windows(t), "conv_id", "turn", "text", rules.NEUTRAL_REGIONS, rules.NEUTRAL_NC_TYPES, rules.NEUTRAL_ROLE_WORDS, r"\A(?!)", 4)


@query(r"""
SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？]'), lambda s: regexp_replace(s, '^[\s]+|[\s]+$', '', 'g')), lambda s: s <> '')[1:5], ' | ') AS points FROM documents""")
def key_points(t) -> DataFrame:
    return t("documents").select("doc_id", F.array_join(summaries.key_points(F.col("text")), " | ").alias("points"))
