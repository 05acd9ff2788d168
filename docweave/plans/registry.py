"""Registered queries: operators over whole given tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import rules, text
from docweave.operators import joins, labels, search, segments, store, summaries, tree
from docweave.sources import parsers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return run

    return register


SEGMENTS = r"""
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
seg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seg_id, regexp_replace(t, '^[\s]+|[\s]+$', '', 'g') AS text
        FROM raw WHERE regexp_replace(t, '^[\s]+|[\s]+$', '', 'g') <> '')"""


def _segments(t) -> DataFrame:
    return segments.split_segments(t("documents"), "doc_id", "text")


# -- vectors ---------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id,
             round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
           FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10""")
def vector_topk(t) -> DataFrame:
    rows = t("embeddings")
    found = search.search_all(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 10)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


def _ranked(where: str, k: int) -> str:
    """SQL of the k best rows of every query (rows whose id is divisible by 50)."""
    return f"""
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND {where})) WHERE rank <= {k})"""


@query(f"WITH {_ranked('v.label IN (1, 2, 3)', 10)} SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r")
def vector_filtered_topk(t) -> DataFrame:
    rows = t("embeddings")
    return search.search_all(rows.where("vec_id % 50 = 0"), store.safe_filter(rows, {"label": [1, 2, 3]}, ("label",)), "vec_id", "embedding", 10)


_HITS = f"""{_ranked('true', 100)},
h AS (SELECT query_id, vec_id AS item, CAST(label AS BIGINT) AS clause, CASE WHEN vec_id % 3 = 0 THEN 'CLAUSE' ELSE 'CLAUSE_ITEM' END AS unit_type, score FROM r)"""


def _hits(t) -> DataFrame:
    """The 100 best of every query, as clauses and items."""
    rows = t("embeddings")
    found = search.search_all(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 100).join(rows.select("vec_id", "label"), "vec_id")
    return found.select("query_id", F.col("vec_id").alias("item"), F.col("label").cast("bigint").alias("clause"), F.when(F.col("vec_id") % 3 == 0, "CLAUSE").otherwise("CLAUSE_ITEM").alias("unit_type"), "score")


@query(f"""
WITH {_HITS},
c AS (SELECT query_id, clause, max(score) AS score FROM h WHERE unit_type = 'CLAUSE' GROUP BY ALL),
i AS (SELECT query_id, clause, item, score FROM h WHERE unit_type = 'CLAUSE_ITEM'),
u AS (SELECT query_id, clause, count(*) AS n_items, arg_max(item, (score, -item)) AS best_item FROM i GROUP BY ALL)
SELECT query_id, clause, CAST(NULL AS BIGINT) AS item, c.score, coalesce(n_items, 0) AS n_items, best_item FROM c LEFT JOIN u USING (query_id, clause)
UNION ALL SELECT query_id, clause, item, score, 0, NULL FROM i ANTI JOIN c USING (query_id, clause)""")
def clause_roll_up(t) -> DataFrame:
    return search.roll_up(_hits(t), "unit_type", "clause", "item", "score", within=("query_id",))


@query(f"""
WITH {_HITS}, k AS (SELECT q.vec_id AS query_id, l.doc_id AS item, CAST(l.quality AS DOUBLE) AS score FROM labels l JOIN embeddings q ON l.quality = q.label WHERE l.toxic = 0 AND q.vec_id % 50 = 0)
SELECT query_id, item, coalesce(h.score, 0) * 0.7::DOUBLE + coalesce(k.score, 0) * (1 - 0.7::DOUBLE) AS score,
       CASE WHEN h.item IS NULL THEN 'keyword' WHEN k.item IS NULL THEN 'semantic' ELSE 'both' END AS source
FROM h FULL JOIN k USING (query_id, item)""")
def hybrid_merge(t) -> DataFrame:
    asked = t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("quality"))
    keyword = joins.join_spread(t("labels").where("toxic = 0"), asked, "quality", "doc_id").select("query_id", F.col("doc_id").alias("item"), F.col("quality").cast("double").alias("score"))
    return search.merge_hybrid(_hits(t).select("query_id", "item", "score"), keyword, ["query_id", "item"], search.normalize_weights(0.7, 0.3)[0])


@query(f"""
WITH {_ranked('v.label <> 0', 5)}
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score, lang, source, md5(text) AS digest FROM r LEFT JOIN documents ON vec_id = doc_id""")
def semantic_search(t) -> DataFrame:
    rows = t("embeddings")
    texts = t("documents").withColumnRenamed("doc_id", "vec_id")
    found = search.semantic_search(rows.where("vec_id % 50 = 0"), rows.where("label <> 0"), texts, "vec_id", "embedding", 5, ["lang", "source"], content="text")
    return found.withColumn("digest", F.md5("text")).drop("text")


# -- texts, segments, windows ------------------------------------------------------------------


@query(f"WITH {SEGMENTS} SELECT doc_id, CAST(seg_id AS INT) AS seg_id, text FROM seg")
def segment_text(t) -> DataFrame:
    return _segments(t)


@query("""
WITH p AS (SELECT doc_id, unnest(string_split(text, '. ')) AS x, generate_subscripts(string_split(text, '. '), 1) - 1 AS seg_id FROM documents)
SELECT doc_id, CAST(seg_id AS INT) AS seg_id, regexp_replace(x, '^[\\s]+|[\\s]+$', '', 'g') AS text FROM p WHERE regexp_replace(x, '^[\\s]+|[\\s]+$', '', 'g') <> ''""")
def split_paragraphs(t) -> DataFrame:
    return segments.split_segments(t("documents"), "doc_id", "text", separator=r"\. ", dense=False)


@query("""
WITH w AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 4000 THEN 1 ELSE CAST(ceil((length(text) - 4000) / 3800.0) AS INT) + 1 END)) AS k FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(k AS INT) AS "window", CAST(k * 3800 AS BIGINT) AS start, CAST(least(k * 3800 + 4000, length(text)) AS BIGINT) AS "end",
       md5(substr(text, CAST(k * 3800 + 1 AS BIGINT), 4000)) AS digest FROM w""")
def char_windows(t) -> DataFrame:
    w = segments.explode_char_windows(t("documents"), "doc_id", "text")
    return w.select("doc_id", "window", F.col("start").cast("bigint"), F.col("end").cast("bigint"), F.md5("text").alias("digest"))


_OFFSETS = f"""{SEGMENTS},
off AS (SELECT doc_id, seg_id, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM seg)"""


@query(f"WITH {_OFFSETS} SELECT doc_id, CAST(seg_id AS INT) AS seg_id, CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS \"end\" FROM off")
def segment_offsets(t) -> DataFrame:
    return segments.with_offsets(_segments(t), "doc_id", "seg_id").select("doc_id", "seg_id", F.col("start").cast("bigint"), F.col("end").cast("bigint"))


@query(f"""
WITH {_OFFSETS},
n AS (SELECT *, start + length(text) AS stop FROM off),
w AS (SELECT doc_id, seg_id, unnest(range(CAST(greatest(0, ceil((stop - 2000) / 1800.0)) AS BIGINT), CAST(floor(start / 1800.0) AS BIGINT) + 1)) AS k, text FROM n)
SELECT doc_id, CAST(seg_id AS INT) AS seg_id, max(k) AS last_window, count(*) AS n_windows FROM w GROUP BY doc_id, seg_id""")
def segments_in_char_windows(t) -> DataFrame:
    placed = segments.with_offsets(_segments(t), "doc_id", "seg_id")
    inside = segments.segments_in_windows(placed, "doc_id", 2000, 200)
    return inside.groupBy("doc_id", "seg_id").agg(F.max("window").cast("bigint").alias("last_window"), F.count("*").alias("n_windows"))


_ROW_WINDOWS = """
c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
rw AS (SELECT *, unnest(range(CAST(greatest(0, ceil((i - 3) / 3.0)) AS BIGINT), least(CAST(floor(i / 3.0) AS BIGINT), CAST(greatest(0, ceil((n - 4) / 3.0)) AS BIGINT)) + 1)) AS k FROM c)"""


def _row_windows(t) -> DataFrame:
    return segments.explode_row_windows(t("conversations"), "conv_id", "turn", 4, 1, ties=("role", "text"))


@query(f"WITH {_ROW_WINDOWS} SELECT conv_id, turn, k AS \"window\" FROM rw")
def row_windows(t) -> DataFrame:
    return _row_windows(t).select("conv_id", "turn", F.col("window").cast("bigint"))


@query(f"""
WITH {_ROW_WINDOWS},
l AS (SELECT conv_id, turn, CASE WHEN (k + length(text)) % 3 = 0 THEN NULL WHEN (k + length(text)) % 2 = 0 THEN 'TITLE' ELSE 'CLAUSE_BODY' END AS label FROM rw),
n AS (SELECT conv_id, turn, label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY ALL)
SELECT conv_id, turn, label FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, label) AS r FROM n) WHERE r = 1""")
def window_vote(t) -> DataFrame:
    k = F.col("window") + F.length("text")
    labelled = _row_windows(t).withColumn("label", F.when(k % 3 == 0, F.lit(None)).when(k % 2 == 0, "TITLE").otherwise("CLAUSE_BODY"))
    return labels.vote(labelled, ["conv_id", "turn"], "label")


@query(f"""
WITH {_ROW_WINDOWS}
SELECT conv_id, turn, coalesce(arg_max(CASE WHEN k % 2 = 0 THEN 'MAIN' ELSE 'COVER' END, k), 'MAIN') AS region FROM rw GROUP BY conv_id, turn""")
def last_window_wins(t) -> DataFrame:
    rows = _row_windows(t).withColumn("region", F.when(F.col("window") % 2 == 0, "MAIN").otherwise("COVER"))
    return labels.last_window(rows, ["conv_id", "turn"], "window", "region", "MAIN")


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 'unknown' WHEN length(regexp_replace(text, '[^一-鿿]', '', 'g')) > 0.1 * length(text) THEN 'zh' ELSE 'en' END AS language FROM documents")
def detect_language(t) -> DataFrame:
    return t("documents").select("doc_id", text.detect_language(F.col("text")).alias("language"))


@query(rf"""
WITH {SEGMENTS},
k AS (SELECT CASE WHEN regexp_matches(text, '^第[一二三四五六七八九十0-9]+[章节条款部分]') THEN 'heading1'
  WHEN regexp_matches(text, '^[0-9]+\.') OR regexp_matches(text, '^[一二三四五六七八九十]+[、．]') OR regexp_matches(text, '^[（(][0-9]+[）)]') OR regexp_matches(text, '^[（(][一二三四五六七八九十]+[）)]') THEN 'heading3'
  WHEN regexp_matches(text, '^[•·○●□■▪▫]') OR regexp_matches(text, '^[a-zA-Z]\.\s') THEN 'list1'
  WHEN contains(text, chr(9)) OR contains(text, '|') THEN 'table1' ELSE 'paragraph1' END AS kind FROM seg)
SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def block_types(t) -> DataFrame:
    kind = text.block_type(F.col("text"))
    return _segments(t).select(F.concat(kind["type"], kind["level"].cast("string")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(r"""
SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a[^>]*\shref="([^"]*)"', 1)) AS n_links,
       array_to_string(regexp_extract_all(html, '(?i)<a[^>]*\shref="([^"]*)"', 1), ' ') AS links FROM pages""")
def html_title_links(t) -> DataFrame:
    found = parsers.html_links(t("pages"), "page_id", "html")
    return found.select("page_id", "title", F.size("links").cast("bigint").alias("n_links"), F.array_join("links", " ").alias("links"))


@query("SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n_chars, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest, regexp_matches(html, '<[^>]+>') AS is_rich FROM pages")
def html_strip(t) -> DataFrame:
    bare = text.strip_tags(F.col("html"))
    return t("pages").select("page_id", F.length(bare).cast("bigint").alias("n_chars"), F.md5(bare).alias("digest"), F.col("html").rlike("<[^>]+>").alias("is_rich"))


@query()
def html_blocks(t) -> DataFrame:
    return parsers.parse(t("pages"), "page_id", "html", "html")


@query("""
SELECT page_id, CASE WHEN ends_with(lower(url), '.pdf') THEN 'pdf' WHEN ends_with(lower(url), '.docx') THEN 'docx' WHEN ends_with(lower(url), '.xlsx') THEN 'xlsx'
  WHEN ends_with(lower(url), '.html') THEN 'html' ELSE 'text' END AS by_url,
  CASE WHEN starts_with(html, '<!DOCTYPE') OR starts_with(html, '<html') OR starts_with(html, '<p') OR contains(html, '<div') THEN 'html' ELSE 'text' END AS by_text FROM pages""")
def sniff_types(t) -> DataFrame:
    return t("pages").select("page_id", text.sniff_type(F.lit(""), F.col("url")).alias("by_url"), text.sniff_rich_text(F.col("html")).alias("by_text"))


# -- labels and scores ---------------------------------------------------------------------------


def _case(rule: list[tuple[str, list[str]]], default: str, c: str = "lower(text)") -> str:
    arms = " ".join(f"WHEN {' OR '.join(f"contains({c}, '{w}')" for w in words)} THEN '{name}'" for name, words in rule)
    return f"CASE {arms} ELSE {default} END"


_LABELLED = f"""{SEGMENTS},
r AS (SELECT doc_id, seg_id, text, {_case(rules.NEUTRAL_REGIONS, "'MAIN'")} AS region FROM seg),
lab AS (SELECT *, CASE region {' '.join(f"WHEN '{k}' THEN {_case(v, 'NULL')}" for k, v in rules.NEUTRAL_NC_TYPES.items())} END AS nc_type,
  CASE WHEN {' + '.join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in rules.NEUTRAL_ROLE_WORDS)} >= 4 THEN 'CLAUSE' ELSE 'NON_CLAUSE' END AS role FROM r),
sc AS (SELECT *, (CASE role WHEN 'CLAUSE' THEN 4 ELSE 0 END * 4 + CASE region WHEN 'MAIN' THEN 2 WHEN 'APPENDIX' THEN 1 ELSE 0 END * 2
  + CASE WHEN nc_type = 'CLAUSE_BODY' THEN 4 WHEN nc_type = 'TITLE' THEN 1 WHEN nc_type IS NULL THEN 1 ELSE 0 END * 4) / 10.0 AS score_float FROM lab)"""
_LEVEL = "CASE WHEN score_float >= 3.5 THEN '4' WHEN score_float >= 2.5 THEN '3' WHEN score_float >= 1.5 THEN '2' ELSE '1' END"


def _labelled(t) -> DataFrame:
    return labels.label_segments(_segments(t), "text", rules.NEUTRAL_REGIONS, rules.NEUTRAL_NC_TYPES, rules.NEUTRAL_ROLE_WORDS, r"\A(?!)", 4)


def _scored(t) -> DataFrame:
    both = _labelled(t).withColumn("_s", labels.score_b(F.col("region"), F.col("nc_type"), F.col("role")))
    return both.select("doc_id", "seg_id", "text", "region", "nc_type", "role", "_s.score_float", "_s.score")


@query(f"WITH {_LABELLED} SELECT doc_id, CAST(seg_id AS INT) AS seg_id, region, nc_type, role, CAST(score_float AS DOUBLE) AS score_float, {_LEVEL} AS score FROM sc")
def label_and_score(t) -> DataFrame:
    return _scored(t).drop("text")


@query(f"""
WITH {_LABELLED},
a AS (SELECT region, nc_type, role, (CASE region WHEN 'MAIN' THEN 4 WHEN 'COVER' THEN 3 WHEN 'APPENDIX' THEN 3 WHEN 'TOC' THEN 2 WHEN 'SIGN' THEN 2 ELSE 1 END * 3
  + CASE nc_type WHEN 'CLAUSE_BODY' THEN 4 WHEN 'TITLE' THEN 3 WHEN 'PARTIES' THEN 2 ELSE 1 END * 3 + CASE role WHEN 'CLAUSE' THEN 4 ELSE 1 END * 4) / 10.0 AS total FROM lab)
SELECT region, nc_type, role, CAST(greatest(1, least(4, round_even(CAST(total AS DECIMAL(10,1)), 0))) AS INT) AS level, count(*) AS n FROM a GROUP BY ALL""")
def score_levels(t) -> DataFrame:
    level = labels.score_a(F.col("region"), F.col("nc_type"), F.col("role"))
    return _labelled(t).withColumn("level", level).groupBy("region", "nc_type", "role", "level").agg(F.count("*").alias("n"))


@query(f"""
WITH {_LABELLED},
k AS (SELECT * FROM sc WHERE {_LEVEL} >= '2'),
u AS (SELECT *, sum(CASE WHEN nc_type = 'TITLE' OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seg_id) - 1 AS unit
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_id) AS rn FROM k))
SELECT doc_id, CAST(unit AS BIGINT) AS unit, CAST(min(seg_id) AS INT) AS first, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY seg_id)) AS digest, CAST(min(score_float) AS DOUBLE) AS score FROM u GROUP BY doc_id, unit""")
def merge_units(t) -> DataFrame:
    kept = labels.keep_from(_scored(t), "score", "2")
    units = tree.merge_units(kept, "doc_id", "seg_id", F.coalesce(F.col("nc_type") == "TITLE", F.lit(False)), "text", "score_float")
    return units.select("doc_id", "unit", "first", "n", F.md5("text").alias("digest"), "score")


@query(f"""
WITH s AS (SELECT doc_id, unnest([{', '.join(f"{{'label': '{n}', 'place': {i}, 'score': {' + '.join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ws)}}}" for i, (n, ws) in enumerate(rules.NEUTRAL_CLASSES))}]) AS s FROM documents)
SELECT doc_id, s.label AS label, s.score AS score, least(s.score / 5.0, 1.0)::DOUBLE AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s.score DESC, s.place) AS r FROM s) WHERE r = 1""")
def lexicon_classify(t) -> DataFrame:
    found = t("documents").select("doc_id", labels.classify(F.col("text"), rules.NEUTRAL_CLASSES).alias("_c"))
    return found.select("doc_id", "_c.label", "_c.score", F.col("_c.confidence").cast("double").alias("confidence"))


# -- stores ---------------------------------------------------------------------------------------


@query("SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_filter(t) -> DataFrame:
    return store.json_equals(t("events"), "props", "$.k", "7").select("event_id", "user_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def find_rows(t) -> DataFrame:
    return store.find(t("orders"), {"o_orderstatus": "F"}, {"o_orderpriority": ["1-URGENT", "2-HIGH"]}).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_totalprice, 3 AS page FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200")
def paginate(t) -> DataFrame:
    return store.page(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 200, 100)


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR contains(p_type, 'ECONOMY')")
def substring_or(t) -> DataFrame:
    rows = t("part")
    return store.search(rows, ["p_name"], "ring").union(store.search(rows, ["p_type"], "ECONOMY")).distinct().select("p_partkey", "p_name")


@query("SELECT l_orderkey, least(count(*), 3) AS n FROM lineitem GROUP BY l_orderkey")
def capped_counts(t) -> DataFrame:
    return store.counts(t("lineitem"), "l_orderkey", 3)


@query("SELECT l_orderkey, CAST(max(l_linenumber) + 1 AS INT) AS next_order FROM lineitem GROUP BY l_orderkey")
def next_order(t) -> DataFrame:
    return store.next_order(t("lineitem"), ["l_orderkey"], "l_linenumber")


@query("""
SELECT c_custkey, CASE WHEN d.o_custkey IS NOT NULL THEN true ELSE false END AS deleted FROM customer
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) d ON c_custkey = o_custkey""")
def soft_delete(t) -> DataFrame:
    doomed = t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return store.soft_delete(t("customer"), doomed, "c_custkey").select("c_custkey", "deleted")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'Renamed#' || c_custkey ELSE c_name END AS c_name, c_acctbal FROM customer")
def partial_update(t) -> DataFrame:
    changes = t("customer").where("c_custkey % 10 = 0").select("c_custkey", F.concat(F.lit("Renamed#"), "c_custkey").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"))
    return store.update(t("customer"), changes, "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'processing' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderpriority END AS parse_status FROM orders")
def status_transition(t) -> DataFrame:
    rows = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("parse_status"))
    return store.transition(rows, F.col("status") == "P", "processing", parse_status="pending")


@query("""
WITH s AS (SELECT doc_id, sha256(text) AS checksum FROM documents), f AS (SELECT checksum, min(doc_id) AS first FROM s GROUP BY checksum)
SELECT doc_id, checksum, CASE WHEN first <> doc_id THEN first END AS duplicate_of, 'documents/' || substr(checksum, 1, 2) || '/' || checksum || '.txt' AS storage_path FROM s JOIN f USING (checksum)""")
def checksum_dedup(t) -> DataFrame:
    return store.deduplicate_uploads(t("documents").select("doc_id", "text"), "doc_id", "text", F.lit(".txt")).drop("text")


@query("""
WITH i AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, CASE WHEN length(text) < 200 THEN 'empty content' WHEN l.quality IS NULL THEN 'no embedding' END AS reason
           FROM documents LEFT JOIN labels l USING (doc_id))
SELECT CAST(i // 100 AS BIGINT) AS batch, count(*) AS total, count(*) - count(reason) AS succeeded, count(reason) AS failed, CASE WHEN count(reason) = 0 THEN 'ok' ELSE 'partial_failed' END AS message FROM i GROUP BY i // 100""")
def ingest_accounting(t) -> DataFrame:
    rows = t("documents").join(t("labels").select("doc_id", F.col("quality").alias("vector")), "doc_id", "left").select("doc_id", F.when(F.length("text") >= 200, F.col("text")).alias("content"), "vector")
    done = store.ingest(rows, "doc_id", "content", "vector")
    failed = F.count_if(F.col("reason").isNotNull())
    return done.groupBy("batch").agg(F.count("*").alias("total"), (F.count("*") - failed).alias("succeeded"), failed.alias("failed"), F.when(failed == 0, "ok").otherwise("partial_failed").alias("message"))


@query("""
SELECT c_custkey, coalesce(o.n, 0) AS n_orders, coalesce(l.n, 0) AS n_lines FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o.o_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) l ON c_custkey = l.o_custkey""")
def processing_status(t) -> DataFrame:
    orders = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    lines = t("lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "c_custkey"), "l_orderkey")
    return store.processing_status(t("customer").select("c_custkey"), "c_custkey", orders=orders, lines=lines)


@query("SELECT 'part' AS unit_type, p_partkey AS id, 1.0::DOUBLE AS relevance FROM part WHERE contains(lower(p_name || chr(10) || p_type), 'small') UNION ALL SELECT 'customer', c_custkey, 1.0 FROM customer WHERE contains(lower(c_mktsegment), 'small')")
def keyword_search(t) -> DataFrame:
    return search.keyword_hits([(t("part"), "part", "p_partkey", ["p_name", "p_type"]), (t("customer"), "customer", "c_custkey", ["c_mktsegment"])], "small")


# -- joins and trees ------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, coalesce(c_name, '') AS customer, coalesce(n_name, '') AS nation FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def lookup_names(t) -> DataFrame:
    customers = joins.lookup_chain(t("customer").select("c_custkey", "c_name", "c_nationkey"), (t("nation"), "c_nationkey", "n_nationkey", "n_name", "nation"))
    orders = t("orders").select("o_orderkey", "o_custkey")
    found = joins.lookup_chain(orders, (customers, "o_custkey", "c_custkey", "c_name", "customer"), (customers, "o_custkey", "c_custkey", "nation", "nation"))
    return found.select("o_orderkey", "customer", "nation")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_either(t) -> DataFrame:
    orders = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.in_either(t("customer"), orders.where("o_orderstatus = 'P'"), orders.where("o_totalprice > 400000"), "c_custkey").select("c_custkey")


@query("""
SELECT e.event_id, t.event_id AS last_error FROM events e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') t ON e.user_id = t.user_id AND e.event_id > t.event_id""")
def asof_preceding(t) -> DataFrame:
    return joins.asof_preceding(t("events"), "user_id", "event_id", F.col("event_type") == "error", "event_id", "last_error").select("event_id", "last_error")


@query("""
WITH t AS (SELECT user_id, event_id FROM events WHERE event_type = 'error'),
p AS (SELECT e.event_id, max(CASE WHEN t.event_id <= e.event_id THEN t.event_id END) AS p, min(CASE WHEN t.event_id >= e.event_id THEN t.event_id END) AS f FROM events e LEFT JOIN t USING (user_id) GROUP BY 1)
SELECT event_id, CASE WHEN p IS NOT NULL AND (f IS NULL OR event_id - p <= f - event_id) THEN p ELSE f END AS nearest FROM p""")
def nearest_event(t) -> DataFrame:
    return joins.nearest(t("events"), "user_id", "event_id", F.col("event_type") == "error", "event_id", "nearest").select("event_id", "nearest")


@query("""
WITH t AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase')
SELECT e.event_id, (SELECT min(t.event_id) FROM t WHERE t.user_id = e.user_id AND abs(t.event_id - e.event_id) < 50) AS first_near FROM events e""")
def band_first(t) -> DataFrame:
    rows = t("events")
    targets = rows.where("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("place"), F.col("event_id").alias("v"))
    return joins.band_first(rows, targets, "user_id", "event_id", "place", "v", "first_near", 50, "event_id").select("event_id", "first_near")


@query(f"""
WITH {_OFFSETS},
sp AS (SELECT doc_id, k AS span_index, k * 700 AS s, k * 700 + 1000 AS e, 'L' || (k % 3) AS label FROM (SELECT doc_id, unnest(range(0, CAST(length(text) // 700 + 1 AS BIGINT))) AS k FROM documents)),
h AS (SELECT o.doc_id, o.seg_id, min(sp.span_index) AS k FROM off o JOIN sp ON o.doc_id = sp.doc_id AND sp.s <= o.start AND sp.e >= o.start + length(o.text) GROUP BY 1, 2)
SELECT o.doc_id, CAST(o.seg_id AS INT) AS seg_id, 'L' || (h.k % 3) AS label FROM off o LEFT JOIN h USING (doc_id, seg_id)""")
def span_labels(t) -> DataFrame:
    placed = segments.with_offsets(_segments(t), "doc_id", "seg_id")
    k = F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 700).cast("int")))
    spans = t("documents").select("doc_id", k.alias("span_index")).selectExpr("doc_id", "span_index", "span_index * 700 as start", "span_index * 700 + 1000 as end", "'L' || (span_index % 3) as label")
    return joins.containing_span(placed, spans, "doc_id", "seg_id", "label").select("doc_id", "seg_id", "label")


@query("""
WITH r AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 6 + 1 AS level FROM events)
SELECT a.event_id, (SELECT max(b.event_id) FROM r b WHERE b.user_id = a.user_id AND b.event_id < a.event_id AND b.level < a.level) AS parent FROM r a""")
def parent_by_level(t) -> DataFrame:
    rows = t("events").select("user_id", "event_id", (F.floor("value") % 6 + 1).alias("level"))
    return tree.parent_by_level(rows, "user_id", "event_id", "level", 6).select("event_id", "parent")


_NUMBERS = """
n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o, l_quantity AS q, l_partkey AS p, l_suppkey AS s FROM lineitem),
r AS (SELECT l_orderkey, o, CASE CAST(q AS BIGINT) % 4 WHEN 0 THEN NULL WHEN 1 THEN '' || (p % 2) WHEN 2 THEN (p % 2) || '.' || (s % 2) ELSE (p % 2) || '.' || (s % 2) || '.' || o END AS number FROM n)"""


def _numbers(t) -> DataFrame:
    o = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    p, s, kind = F.col("l_partkey") % 2, F.col("l_suppkey") % 2, F.col("l_quantity").cast("bigint") % 4
    number = F.when(kind == 1, p.cast("string")).when(kind == 2, F.concat_ws(".", p, s)).when(kind == 3, F.concat_ws(".", p, s, F.col("o")))
    return t("lineitem").withColumn("o", o).select("l_orderkey", "o", number.alias("number"))


@query(f"""
WITH {_NUMBERS}
SELECT a.l_orderkey, CAST(a.o AS INT) AS o, a.number, CAST((SELECT max(b.o) FROM r b WHERE b.l_orderkey = a.l_orderkey AND b.o < a.o AND b.number IS NOT NULL AND starts_with(a.number, b.number || '.')) AS INT) AS parent FROM r a""")
def parent_by_prefix(t) -> DataFrame:
    return tree.parent_by_prefix(_numbers(t), "l_orderkey", "o", "number").select("l_orderkey", "o", "number", "parent")


@query(f"""
WITH {_NUMBERS},
k AS (SELECT l_orderkey, o, coalesce(number, 'unknown') AS number FROM r)
SELECT l_orderkey, number, count(*) AS n, min(o)::VARCHAR AS title, array_to_string(list(o::VARCHAR ORDER BY o)[2:], chr(10)) AS content FROM k GROUP BY l_orderkey, number""")
def group_by_number(t) -> DataFrame:
    rows = _numbers(t).withColumn("body", F.col("o").cast("string"))
    return tree.group_by_number(rows, "l_orderkey", "o", "number", "body").drop("segments")


@query("""
WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o, l_partkey FROM lineitem)
SELECT l_orderkey, 1 AS order_index, 1 AS level, 'o' || l_orderkey AS id, NULL AS parent_id, 'order ' || l_orderkey AS title FROM l GROUP BY l_orderkey
UNION ALL SELECT l_orderkey, CAST(o + 1 AS INT), 2, 'l' || o, 'o' || l_orderkey, 'part ' || l_partkey FROM l""")
def tree_flatten(t) -> DataFrame:
    o = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = t("lineitem").withColumn("o", o)
    child = F.struct("o", F.concat(F.lit("l"), "o").alias("id"), F.concat(F.lit("part "), "l_partkey").alias("title"))
    docs = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(child)).alias("children"))
    nested = docs.select("l_orderkey", F.to_json(F.struct(F.concat(F.lit("o"), "l_orderkey").alias("id"), F.concat(F.lit("order "), "l_orderkey").alias("title"), "children")).alias("json"))
    return tree.flatten_json(nested, "l_orderkey", "json").select("l_orderkey", "order_index", "level", "id", "parent_id", "title")


# -- summaries and chunks --------------------------------------------------------------------------


@query("""
WITH c AS (SELECT user_id, event_id, event_type || ' on ' || strftime(ts, '%Y-%m-%d') || ' for ' || value AS text FROM events)
SELECT user_id, event_id, regexp_extract(text, '([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})', 1) AS raw_date, 'dash' AS pattern, CAST(regexp_extract(text, '([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})', 1) AS DATE) AS date FROM c""")
def timeline(t) -> DataFrame:
    clauses = t("events").select("user_id", "event_id", F.concat(F.col("event_type"), F.lit(" on "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" for "), F.col("value").cast("string")).alias("text"))
    return summaries.timeline(clauses, "user_id", "event_id", "text", [("dash", r"\d{4}-\d{1,2}-\d{1,2}"), ("ymd", r"\d{4}年\d{1,2}月\d{1,2}日")]).drop("context", "start", "place")


@query(f"""
WITH {SEGMENTS}
SELECT doc_id, md5(substr(string_agg('【无标题】' || text, chr(10) || chr(10) ORDER BY seg_id), 1, 15000)) AS digest, count(*) AS n_clauses, array_to_string(list(seg_id ORDER BY seg_id)[1:10], ',') AS blocks FROM seg GROUP BY doc_id""")
def document_summaries(t) -> DataFrame:
    found = summaries.summarize(_segments(t).withColumn("title", F.lit("")), "doc_id", "seg_id", "title", "text")
    return found.select("doc_id", F.md5("text").alias("digest"), "n_clauses", F.array_join("block_orders", ",").alias("blocks"))


_ENTITIES = """
e AS (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]{4,})', 1)) AS name FROM documents)"""
_PATTERNS = {"OTHER": [r"([0-9]{4,})"]}


@query(f"WITH {_ENTITIES} SELECT 'OTHER' AS type, name, count(*) AS count, count(DISTINCT doc_id) AS n_docs FROM e GROUP BY name")
def entity_counts(t) -> DataFrame:
    return summaries.entity_counts(t("documents"), "doc_id", "text", _PATTERNS)


@query(f"""
WITH {_ENTITIES}, d AS (SELECT DISTINCT doc_id, name FROM e)
SELECT a.name AS source, b.name AS target, count(*) AS n_docs FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.name < b.name GROUP BY 1, 2""")
def entity_graph(t) -> DataFrame:
    found = t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_PATTERNS["OTHER"][0]), F.lit(1))).alias("name"))
    return summaries.cooccurrence(found, "doc_id", "name")


@query(f"""
WITH {_ranked('true', 10)}
SELECT query_id, md5(string_agg('【' || vec_id || '】' || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank)) AS digest FROM r LEFT JOIN documents ON vec_id = doc_id GROUP BY query_id""")
def retrieval_context(t) -> DataFrame:
    rows = t("embeddings")
    hits = search.search_all(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 10)
    texts = t("documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    joined = hits.join(texts, "vec_id", "left").withColumn("title", F.col("vec_id").cast("string"))
    return search.context_of(joined, "query_id", "rank", "title", "content", 10).select("query_id", F.md5("context").alias("digest"))


from docweave.plans import chunk_queries, item_queries, nested_queries, rule_queries, search_queries, structure_queries, table_queries  # noqa: E402, F401  they register themselves
