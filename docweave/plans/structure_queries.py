"""Registered queries: documents structured, saved, read back; what is stored and found by conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import text
from docweave.operators import labels, search, store, structure, tree
from docweave.operators.structure import Structure
from docweave.plans.registry import _NUMBERS, _numbers, query

# Lines of an order as a nested document: every second one inside the one before it.
_O = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"
_KIND = "CASE WHEN o % 4 = 1 THEN 'clause' WHEN o % 4 = 2 OR o % 8 = 3 THEN 'clause_item' ELSE 'section' END"
_NODE = """'{"id":"n' || o || '",' || CASE o % 4 WHEN 1 THEN '"title":"第' || o || '条 ' || l_returnflag || '","content":"' || l_linestatus || '"' WHEN 2 THEN '"content":"（' || (l_partkey % 10) || '） part"'
 WHEN 3 THEN '"content":"' || (l_partkey % 10) || '. supplier ' || l_suppkey || '"' || CASE WHEN o % 8 = 3 THEN ',"content_tags":{"role":"CLAUSE","score":3}' ELSE '' END ELSE '"content":"plain"' END"""
_DOCS = f"""
n AS (SELECT *, {_O} AS o FROM lineitem),
e AS (SELECT l_orderkey, o, {_KIND} AS kind, l_partkey % 10 AS p, l_suppkey AS s, l_returnflag AS f, l_linestatus AS st FROM n),
r AS (SELECT DISTINCT l_orderkey FROM lineitem),
sec AS (SELECT l_orderkey, 'root' AS id, 1 AS order_index, '第1章' AS number_token, 'order ' || l_orderkey AS title, '' AS content, NULL AS parent_id FROM r
        UNION ALL SELECT l_orderkey, 'n' || o, o + 1, NULL, '', CASE WHEN o % 4 = 3 THEN p || '. supplier ' || s ELSE 'plain' END, CASE WHEN o % 2 = 1 THEN 'root' WHEN o % 8 = 0 THEN 'n' || (o - 1) END FROM e WHERE kind = 'section'),
cl AS (SELECT l_orderkey, 'n' || o AS id, o + 1 AS order_index, '第' || o || '条' AS number_token, f AS title, st AS content, 'root' AS section_id FROM e WHERE kind = 'clause'),
it AS (SELECT l_orderkey, 'n' || o AS id, o + 1 AS order_index, CASE WHEN o % 4 = 2 THEN '（' || p || '）' ELSE '' || p END AS number_token, CASE WHEN o % 4 = 2 THEN 'part' ELSE 'supplier ' || s END AS title,
              CASE WHEN o % 4 = 2 THEN '（' || p || '） part' ELSE p || '. supplier ' || s END AS content, CASE WHEN o % 8 = 3 THEN 3 ELSE 2 END AS score, 'n' || ((o - 1) // 4 * 4 + 1) AS clause_id FROM e WHERE kind = 'clause_item')"""


def _nested_orders(t) -> DataFrame:
    lines = t("lineitem").selectExpr("*", f"{_O} AS o")
    opened = lines.select("l_orderkey", "o", F.expr(_NODE).alias("node"))
    pairs = opened.groupBy("l_orderkey", F.floor((F.col("o") - 1) / 2).alias("pair")).agg(F.array_sort(F.collect_list(F.struct("o", "node"))).alias("p"))
    nested = F.concat(F.get("p", 0)["node"], F.when(F.size("p") == 2, F.concat(F.lit(',"children":['), F.get("p", 1)["node"], F.lit("}]"))).otherwise(""), F.lit("}"))
    docs = pairs.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair", nested.alias("n")))), lambda x: x["n"]), ",").alias("c"))
    return docs.select("l_orderkey", F.concat(F.lit('{"id":"root","title":"第1章 order '), "l_orderkey", F.lit('","children":['), "c", F.lit("]}")).alias("json"))


def _built(t) -> Structure:
    return structure.build_related(tree.flatten_json(_nested_orders(t), "l_orderkey", "json"), "l_orderkey")


@query(f"""
WITH {_DOCS}
SELECT 'section' AS kind, l_orderkey, id, CAST(order_index AS INT) AS order_index, number_token, title, content, 'NON_CLAUSE' AS role, NULL AS nc_type, NULL::INT AS score, parent_id AS up FROM sec
UNION ALL SELECT 'clause', l_orderkey, id, CAST(order_index AS INT), number_token, title, content, 'CLAUSE', 'CLAUSE_BODY', 2, section_id FROM cl
UNION ALL SELECT 'clause_item', l_orderkey, id, CAST(order_index AS INT), number_token, title, content, 'CLAUSE', 'CLAUSE_BODY', score, clause_id FROM it""")
def build_structure(t) -> DataFrame:
    own = _built(t)
    columns = ["l_orderkey", "id", "order_index", "number_token", "title", "content", "role", "nc_type", "score"]
    part = lambda kind, rows, up: rows.select(F.lit(kind).alias("kind"), *columns, F.col(up).alias("up"))
    return part("section", own.sections, "parent_id").unionByName(part("clause", own.clauses, "section_id")).unionByName(part("clause_item", own.items, "clause_id"))


_BACK = f"""{_DOCS},
i AS (SELECT l_orderkey, clause_id, string_agg(id, ',' ORDER BY order_index) AS items FROM it GROUP BY ALL),
c AS (SELECT cl.l_orderkey, section_id, string_agg(id || '[' || coalesce(items, '') || ']', ';' ORDER BY order_index) AS clauses FROM cl LEFT JOIN i ON i.l_orderkey = cl.l_orderkey AND i.clause_id = cl.id GROUP BY ALL)"""


@query(f"""
WITH {_BACK}
SELECT sec.l_orderkey, string_agg(id || '(' || coalesce(clauses, '') || ')', '|' ORDER BY order_index) AS shape, 0 AS loose
FROM sec LEFT JOIN c ON c.l_orderkey = sec.l_orderkey AND c.section_id = sec.id GROUP BY sec.l_orderkey""")
def structured_read_back(t) -> DataFrame:
    back = structure.read_back(_built(t), "l_orderkey")
    items = lambda xs: F.array_join(F.transform(xs, lambda i: i["id"]), ",")
    clauses = lambda xs: F.array_join(F.transform(xs, lambda c: F.concat(c["id"], F.lit("["), items(c["items"]), F.lit("]"))), ";")
    sections = F.array_join(F.transform("sections", lambda s: F.concat(s["id"], F.lit("("), clauses(s["clauses"]), F.lit(")"))), "|")
    return back.select("l_orderkey", sections.alias("shape"), (F.size("clauses") + F.size("items")).alias("loose"))


@query(f"""
WITH {_DOCS}, o AS (SELECT o_orderkey, o_orderkey % 5 = 0 AS redone FROM orders),
k AS (SELECT l_orderkey, count(*) AS n FROM it GROUP BY ALL), c AS (SELECT l_orderkey, count(*) AS n FROM cl GROUP BY ALL), s AS (SELECT l_orderkey, count(*) AS n FROM sec GROUP BY ALL)
SELECT o_orderkey, CASE WHEN redone THEN 'completed' ELSE 'pending' END AS structure_status, CASE WHEN redone THEN coalesce(s.n, 0) END AS total_sections, CASE WHEN redone THEN coalesce(c.n, 0) END AS total_clauses,
       CASE WHEN redone THEN coalesce(k.n, 0) END AS total_items, CASE WHEN redone THEN coalesce(k.n, 0) ELSE 1 END AS kept_items
FROM o LEFT JOIN s ON s.l_orderkey = o_orderkey LEFT JOIN c ON c.l_orderkey = o_orderkey LEFT JOIN k ON k.l_orderkey = o_orderkey""")
def save_structure(t) -> DataFrame:
    key = "o_orderkey"
    built = Structure(*[x.withColumnRenamed("l_orderkey", key) for x in _built(t)])
    redone = t("orders").where("o_orderkey % 5 = 0").select(key)
    # before, every order had one item
    old = Structure(built.sections.limit(0), built.clauses.limit(0), t("orders").select(key, F.lit("old").alias("id")))
    mine = Structure(*[x.join(redone, key, "left_semi") for x in built])
    docs, after = structure.save(t("orders").select(key, F.lit("pending").alias("structure_status")), old, mine, key, redone)
    kept = after.items.groupBy(key).agg(F.count("*").alias("kept_items"))
    return docs.join(kept, key, "left").withColumn("kept_items", F.coalesce("kept_items", F.lit(0)))


@query(f"""
WITH {_DOCS}, o AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'parse_status not completed' WHEN 1 THEN 'processing' WHEN 2 THEN 'is no JSON' WHEN 3 THEN 'no parse result' END AS error FROM orders SEMI JOIN r ON l_orderkey = o_orderkey),
k AS (SELECT l_orderkey, count(*) AS n FROM it GROUP BY ALL)
SELECT o_orderkey, error, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS structure_status, CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END AS total_items FROM o LEFT JOIN k ON l_orderkey = o_orderkey""")
def structure_driver(t) -> DataFrame:
    kind = F.col("o_orderkey") % 7
    docs = t("orders").select("o_orderkey").join(_nested_orders(t).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    docs = docs.withColumns({
        "parse_status": F.when(kind == 0, "failed").otherwise("completed"), "structure_status": F.when(kind == 1, "processing").otherwise("pending"),
        "json": F.when(kind == 2, F.lit("{")).when(kind == 3, F.lit("{}")).otherwise(F.col("json")),
    })
    return structure.structure_documents(docs, "json", "o_orderkey")[0].select("o_orderkey", "error", "structure_status", "total_items")


@query(f"""
WITH {_DOCS},
x AS (SELECT l_orderkey, order_index, '## ' || number_token || ' ' || title AS line, NULL AS body FROM sec WHERE id = 'root'
  UNION ALL SELECT l_orderkey, order_index, '### ' || number_token || ' ' || title, content FROM cl UNION ALL SELECT l_orderkey, order_index, '- ' || content, NULL FROM it
  UNION ALL SELECT l_orderkey, order_index, NULL, content FROM sec WHERE id <> 'root')
SELECT l_orderkey, md5(string_agg(concat_ws(chr(10) || chr(10), line, body), chr(10) || chr(10) ORDER BY order_index)) AS digest FROM x GROUP BY l_orderkey""")
def structure_to_text(t) -> DataFrame:
    flat = tree.flatten_json(_nested_orders(t), "l_orderkey", "json")
    return structure.structure_text(flat, "l_orderkey").select("l_orderkey", F.md5("text").alias("digest"))


@query("SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, coalesce(text, ''))) AS digest FROM conversations GROUP BY conv_id")
def segments_to_text(t) -> DataFrame:
    return structure.segments_text(t("conversations"), "conv_id", "turn").select("conv_id", F.md5("text").alias("digest"))


@query(f"""
WITH {_NUMBERS}, q AS (SELECT r.*, CASE WHEN o % 3 = 0 THEN NULL ELSE o // 3 END AS page FROM r), k AS (SELECT l_orderkey, o, coalesce(number, 'unknown') AS number, page FROM q)
SELECT l_orderkey, number, string_agg(o::VARCHAR, ',' ORDER BY o) AS segments, coalesce(array_to_string(list_sort(list(DISTINCT page) FILTER (page IS NOT NULL)), ','), '') AS pages FROM k GROUP BY l_orderkey, number""")
def numbered_pages(t) -> DataFrame:
    rows = _numbers(t).withColumns({"body": F.col("o").cast("string"), "page": F.when(F.col("o") % 3 != 0, F.floor(F.col("o") / 3))})
    grouped = tree.group_by_number(rows, "l_orderkey", "o", "number", "body", page="page")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return grouped.select("l_orderkey", "number", text("segments").alias("segments"), text("pages").alias("pages"))


def _scores(words: list[tuple[str, list[str]]], c: str) -> str:
    return "[" + ", ".join(f"{{'s': {' + '.join(f"CAST(contains({c}, '{w}') AS INT)" for w in ws)}, 'p': {-i}, 'l': '{n}'}}" for i, (n, ws) in enumerate(words)) + "]"


_DOMAINS = [("FIRST", ["steel", "brass"]), ("SECOND", ["small", "large"]), ("THIRD", ["ring"])]
_TYPES = [("CONTRACT", ["economy"]), ("AGREEMENT", ["standard", "promo"]), ("LAW", ["medium", "plated"])]


@query(f"""
WITH t AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS x FROM part),
b AS (SELECT p_partkey, list_max({_scores(_TYPES, 'x')}) AS k, list_max({_scores(_DOMAINS, 'x')}) AS d FROM t)
SELECT p_partkey, k.l AS type, least(k.s / 5.0, 1.0)::DOUBLE AS type_confidence, CASE WHEN k.l IN ('CONTRACT', 'AGREEMENT') THEN d.l ELSE 'OTHER' END AS domain,
       CASE WHEN k.l IN ('CONTRACT', 'AGREEMENT') THEN least(d.s / 5.0, 1.0) ELSE 0 END::DOUBLE AS domain_confidence FROM b""")
def classify_documents(t) -> DataFrame:
    found = labels.classify_document(F.col("p_name"), F.col("p_type"), _TYPES, _DOMAINS)
    return t("part").select("p_partkey", found.alias("c")).select("p_partkey", "c.*").withColumns({c: F.col(c).cast("double") for c in ("type_confidence", "domain_confidence")})


@query("""
WITH s AS (SELECT doc_id, sha256(text) AS checksum FROM documents), k AS (SELECT checksum, min(doc_id) AS stored FROM s WHERE doc_id % 3 = 0 AND doc_id % 2 = 0 GROUP BY checksum),
n AS (SELECT * FROM s WHERE doc_id % 3 <> 0), f AS (SELECT checksum, min(doc_id) AS first FROM n GROUP BY checksum)
SELECT doc_id, coalesce(stored, CASE WHEN first <> doc_id THEN first END) AS duplicate_of FROM n JOIN f USING (checksum) LEFT JOIN k USING (checksum)""")
def dedup_against_stored(t) -> DataFrame:
    docs = t("documents").select("doc_id", "text")
    known = docs.where("doc_id % 3 = 0").select("doc_id", F.sha2("text", 256).alias("checksum"), (F.col("doc_id") % 2 != 0).alias("deleted"))
    return store.deduplicate_uploads(docs.where("doc_id % 3 <> 0"), "doc_id", "text", F.lit(".txt"), known).select("doc_id", "duplicate_of")


@query("""
WITH i AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey || '') - 1 AS i, CASE WHEN o_orderkey % 11 = 0 THEN 'empty content' WHEN o_orderkey % 301 = 0 THEN 'no embedding' END AS own FROM orders),
b AS (SELECT DISTINCT i // 50 AS batch FROM i WHERE own = 'no embedding')
SELECT o_orderkey, CAST(i AS BIGINT) AS item_index, CAST(i // 50 AS BIGINT) AS batch, coalesce(own, CASE WHEN b.batch IS NOT NULL THEN 'batch failed' END) AS reason, CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE 0 END AS section_level FROM i LEFT JOIN b ON i // 50 = b.batch""")
def ingest_whole_batches(t) -> DataFrame:
    key = F.col("o_orderkey")
    rows = t("orders").select(
        "o_orderkey", key.cast("string").alias("text_id"), F.when(key % 11 == 0, "").otherwise("x").alias("content"), F.when((key % 301 != 0) | (key % 11 == 0), F.lit(1)).alias("vector"), F.when(key % 2 == 0, 7).alias("section_level"),
    )
    return store.ingest(rows, "text_id", "content", "vector", 50, whole=True).select("o_orderkey", "item_index", "batch", "reason", "section_level")


@query("""
SELECT unit_type, id, 1.0::DOUBLE AS relevance FROM (
  SELECT 0 AS t, 'order' AS unit_type, o_orderkey AS id FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderstatus = 'F'
  UNION ALL SELECT 1, 'again', o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderstatus = 'F') ORDER BY t, id LIMIT 40 OFFSET 25""")
def keyword_page(t) -> DataFrame:
    part = (t("part"), "part", "p_partkey", ["p_name"])  # has no such column: no hits
    orders = [(t("orders"), name, "o_orderkey", ["o_orderpriority"]) for name in ("order", "again")]
    return search.keyword_hits([part, *orders], "URGENT", {"o_orderstatus": "F"}, skip=25, limit=40)


_SIDES = """
s AS (SELECT o_custkey AS query_id, o_orderkey AS item, o_totalprice / 250000 - 0.1 AS score FROM orders), k AS (SELECT o_custkey AS query_id, o_orderkey AS item, 1.0 AS score FROM orders WHERE o_orderpriority LIKE '%U%'),
s2 AS (SELECT * FROM (SELECT query_id, item, greatest(0, least(1, score::DOUBLE)) AS score, row_number() OVER (PARTITION BY query_id ORDER BY greatest(0, least(1, score::DOUBLE)) DESC, query_id, item) AS r FROM s) WHERE r <= 10),
k2 AS (SELECT * FROM (SELECT query_id, item, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY item) AS r FROM k) WHERE r <= 10),
m AS (SELECT query_id, item, coalesce(s2.score, 0) * 0.6::DOUBLE + coalesce(k2.score, 0) * (1 - 0.6::DOUBLE) AS score, CASE WHEN s2.item IS NULL THEN 'keyword' WHEN k2.item IS NULL THEN 'semantic' ELSE 'both' END AS source FROM s2 FULL JOIN k2 USING (query_id, item))"""


@query(f"WITH {_SIDES} SELECT * FROM (SELECT query_id, item, round(score, 9) AS score, source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, query_id, item) AS INT) AS rank FROM m) WHERE rank <= 5")
def hybrid_best(t) -> DataFrame:
    orders = t("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), (F.col("o_totalprice") / 250000 - 0.1).alias("score"), "o_orderpriority")
    keyword = orders.where("o_orderpriority LIKE '%U%'").select("query_id", "item", F.lit(1.0).alias("score"))
    found = search.endpoint_hybrid(orders.drop("o_orderpriority"), keyword, ["query_id", "item"], 5, weights=(0.6, 0.4))
    return found.withColumn("score", F.round("score", 9))


_PLACE_WORDS = [rf"([^，,。\n]*{unit}[^，,。\n]*)" for unit in ("ring", "steel")]


@query(r"""
WITH p AS (SELECT p_partkey, p_name || ',' || p_type || ',' || p_name || '!' AS x FROM part), f AS (SELECT p_partkey, trim(unnest(list_concat(regexp_extract_all(x, '([^，,。\n]*ring[^，,。\n]*)', 1), regexp_extract_all(x, '([^，,。\n]*steel[^，,。\n]*)', 1)))) AS v FROM p)
SELECT p_partkey, coalesce(string_agg(DISTINCT v, ';' ORDER BY v) FILTER (length(v) BETWEEN 2 AND 10), '') AS tags FROM part LEFT JOIN f USING (p_partkey) GROUP BY p_partkey""")
def place_tags(t) -> DataFrame:
    whole = t("part").select("p_partkey", F.concat_ws(",", "p_name", "p_type", F.concat("p_name", F.lit("!"))).alias("x"))
    return whole.select("p_partkey", F.array_join(text.business_tags(F.col("x"), {"location": _PLACE_WORDS})["location"], ";").alias("tags"))
