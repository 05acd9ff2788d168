"""Registered queries: nested hits, the clustered index, plugged-in models, places of matches, span labels, chunks as items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import rules
from docweave.operators import chunk, items, labels, matches, plugs, search, segments, summaries
from docweave.operators.once import cut_lineage
from docweave.plans.chunk_queries import MODE, _chunk_sql
from docweave.plans.registry import _case, _ranked, query

_NESTED = f"""{_ranked('true', 100)},
h AS (SELECT query_id, rank, vec_id, 'v' || vec_id AS item, 'c' || (vec_id % 40) AS clause, CASE WHEN vec_id % 3 = 0 THEN 'CLAUSE' ELSE 'CLAUSE_ITEM' END AS unit_type, score FROM r),
f AS (SELECT query_id, clause, min(rank) AS first, arg_min(rank, (-score, rank)) AS best FROM h WHERE unit_type = 'CLAUSE' GROUP BY ALL),
p AS (SELECT h.*, f.first, f.best FROM h LEFT JOIN f USING (query_id, clause)),
s AS (SELECT query_id, clause, string_agg(item || '@' || rank, ',' ORDER BY rank) AS sub FROM p WHERE unit_type = 'CLAUSE_ITEM' AND rank > best GROUP BY ALL),
e AS (SELECT p.*, 0 AS alone, first AS met FROM p WHERE unit_type = 'CLAUSE' AND rank = best UNION ALL SELECT p.*, 1, rank FROM p WHERE unit_type = 'CLAUSE_ITEM' AND (first IS NULL OR rank < first))"""


@query(f"""
WITH {_NESTED}
SELECT e.query_id, CAST(row_number() OVER (PARTITION BY e.query_id ORDER BY score DESC, alone, met) AS INT) AS place, unit_type, e.clause, item, score, CASE WHEN alone = 0 THEN coalesce(sub, '') ELSE '' END AS sub_items
FROM e LEFT JOIN s USING (query_id, clause)""")
def nested_hits(t) -> DataFrame:
    rows = t("embeddings")
    found = search.search_all(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 100)
    hits = found.select(
        "query_id", "rank", F.when(F.col("vec_id") % 3 == 0, "CLAUSE").otherwise("CLAUSE_ITEM").alias("unit_type"), F.concat(F.lit("c"), (F.col("vec_id") % 40).cast("string")).alias("clause"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("item"), "score",
    )
    nested = search.nest_hits(hits)
    return nested.withColumn("sub_items", F.array_join(F.transform("sub_items", lambda s: F.concat_ws("@", s["item"], s["rank"].cast("string"))), ","))


@query(f"WITH {_ranked('true', 10)} SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score, true AS within FROM r")
def clustered_topk(t) -> DataFrame:
    rows = t("embeddings")
    found, read = search.ClusteredIndex(rows, "vec_id", "embedding").search(rows.where("vec_id % 50 = 0"), 10)
    return found.join(read, "query_id").select("query_id", "rank", "vec_id", "score", ((F.col("share") > 0) & (F.col("share") <= 1)).alias("within"))


CLASSES = [name for name, _ in rules.NEUTRAL_CLASSES]


def _third_word_model(texts: list[str]) -> list[str]:
    """Stands for a model: fails on some texts, answers strangely on others."""
    out = []
    for t in texts:
        if len(t) % 7 == 3:
            raise ValueError("too odd")
        out.append("??" if len(t) % 11 == 5 else CLASSES[len(t) % len(CLASSES)])
    return out


_LEXICON = f"""
s AS (SELECT doc_id, unnest([{', '.join(f"{{'label': '{n}', 'place': {i}, 'score': {' + '.join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ws)}}}" for i, (n, ws) in enumerate(rules.NEUTRAL_CLASSES))}]) AS s FROM documents),
lex AS (SELECT doc_id, s.label AS rule FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s.score DESC, s.place) AS r FROM s) WHERE r = 1)"""


@query(f"""
WITH {_LEXICON}, m AS (SELECT doc_id, rule, CASE WHEN length(text) % 7 = 3 THEN 'ValueError: too odd' WHEN length(text) % 11 = 5 THEN 'not allowed: ??' END AS error, [{', '.join(f"'{c}'" for c in CLASSES)}][length(text) % {len(CLASSES)} + 1] AS said FROM documents JOIN lex USING (doc_id))
SELECT doc_id, CASE WHEN error IS NULL THEN said ELSE rule END AS label, CASE WHEN error IS NULL THEN 'model' ELSE 'rule' END AS label_by, error AS label_error FROM m""")
def model_or_rule(t) -> DataFrame:
    rule = labels.classify(F.col("text"), rules.NEUTRAL_CLASSES)["label"]
    return plugs.ask_or_rule(t("documents").select("doc_id", "text"), "text", _third_word_model, rule, "label", allowed=CLASSES).drop("text")


_NUMBERS, _CAPITALS = r"[0-9]+", r"[A-Z][a-z]+\."


def _places(name: str, pattern: str) -> str:
    return rf"""SELECT doc_id, '{name}' AS pattern, n, before AS start, before + length(value) AS "end", value, substr(text, CAST(greatest(before - 10, 0) + 1 AS BIGINT), CAST(before + length(value) + 10 - greatest(before - 10, 0) AS BIGINT)) AS context
FROM (SELECT doc_id, text, n, value, CAST(sum(length(gap)) OVER w + coalesce(sum(length(value)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS before
      FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '{pattern}')) AS value, unnest(string_split_regex(text, '{pattern}')[:-2]) AS gap, unnest(range(1, CAST(len(regexp_extract_all(text, '{pattern}')) AS INT) + 1))::INT AS n FROM documents) WINDOW w AS (PARTITION BY doc_id ORDER BY n))"""


@query(f"{_places('number', _NUMBERS)} UNION ALL {_places('capital', _CAPITALS)}")
def match_places(t) -> DataFrame:
    return matches.find_all(t("documents"), ["doc_id"], "text", [("number", _NUMBERS), ("capital", _CAPITALS)], 10)


@query(r"""
WITH c AS (SELECT user_id, event_id, unnest([strftime(ts, '%Y-%m-%d'), strftime(ts + INTERVAL 40 DAY, '%Y-%m-%d'), strftime(ts, '%Y-%m-%d')]) AS raw_date, unnest([3, 20, 40]) AS start FROM events)
SELECT user_id, event_id, raw_date, CAST(raw_date AS DATE) AS date, CAST(start AS INT) AS start, 'on ' || raw_date AS context, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CAST(raw_date AS DATE), event_id, start) AS INT) AS place FROM c""")
def timeline_ordered(t) -> DataFrame:
    day, later = F.date_format("ts", "yyyy-MM-dd"), F.date_format(F.expr("ts + INTERVAL 40 DAYS"), "yyyy-MM-dd")
    # three places in a text, two of them of one date
    clauses = t("events").select("user_id", "event_id", F.concat(F.lit("on "), day, F.lit(".   on "), later, F.lit(".      on "), day).alias("text"))
    found = summaries.timeline(clauses, "user_id", "event_id", "text", [("dash", r"\d{4}-\d{1,2}-\d{1,2}")], 3)
    return found.select("user_id", "event_id", "raw_date", "date", "start", F.concat(F.lit("on "), "raw_date").alias("context"), "place")


_REGIONS = [*[name for name, _ in rules.NEUTRAL_REGIONS], "MAIN"]


@query(f"""
WITH w AS (SELECT doc_id, k, substr(text, CAST(k * 450 + 1 AS BIGINT), 500) AS text FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 500 THEN 1 ELSE CAST(ceil((length(text) - 500) / 450.0) AS INT) + 1 END)) AS k FROM documents WHERE length(text) > 0)),
l AS (SELECT doc_id, k, unnest(string_split(text, chr(10))) AS line, unnest(range(CAST(len(string_split(text, chr(10))) AS INT))) AS i FROM w),
b AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(line) - length(regexp_replace(line, '^[\\s]+', '')) AS s, regexp_replace(line, '^[\\s]+|[\\s]+$', '', 'g') AS text FROM l),
sp AS (SELECT doc_id, CAST(s + k * 450 AS BIGINT) AS s, CAST(s + k * 450 + length(text) AS BIGINT) AS e, {_case(rules.NEUTRAL_REGIONS, "'MAIN'")} AS label FROM b WHERE text <> ''),
c AS (SELECT doc_id, s AS edge FROM sp UNION SELECT doc_id, e FROM sp),
pc AS (SELECT doc_id, edge AS s, lead(edge) OVER (PARTITION BY doc_id ORDER BY edge) AS e FROM c),
n AS (SELECT p.doc_id, p.s, p.e, sp.label, count(*) AS n FROM pc p JOIN sp ON sp.doc_id = p.doc_id AND sp.s <= p.s AND sp.e >= p.e GROUP BY ALL),
v AS (SELECT doc_id, s, e, arg_min(label, (-n, list_position([{', '.join(f"'{r}'" for r in _REGIONS)}], label))) AS label FROM n GROUP BY ALL),
g AS (SELECT *, CASE WHEN lag(label) OVER x = label AND lag(e) OVER x = s THEN 0 ELSE 1 END AS f FROM v WINDOW x AS (PARTITION BY doc_id ORDER BY s)),
q AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM g)
SELECT doc_id, min(s) AS start, max(e) AS "end", any_value(label) AS label FROM q GROUP BY doc_id, r""")
def window_span_labels(t) -> DataFrame:
    windows = segments.explode_char_windows(t("documents"), "doc_id", "text", 500, 50)
    lines = segments.line_spans(windows.select("doc_id", "window", "text"), ["doc_id", "window"])
    labelled = labels.label_segments(lines, "line", rules.NEUTRAL_REGIONS, rules.NEUTRAL_NC_TYPES, rules.NEUTRAL_ROLE_WORDS, r"\A(?!)", 4)
    return segments.overlay_spans(labelled, "doc_id", "region", _REGIONS, window="window", step=450)


@query(f"""
WITH RECURSIVE chunks AS ({_chunk_sql(MODE)}),
u AS (SELECT *, {_case(rules.NEUTRAL_REGIONS, "'MAIN'")} AS region, CASE WHEN {' + '.join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in rules.NEUTRAL_ROLE_WORDS)} >= 4 THEN 'CLAUSE' ELSE 'NON_CLAUSE' END AS role FROM chunks)
SELECT CASE role WHEN 'CLAUSE' THEN 'CLAUSE' ELSE 'CLAUSE_ITEM' END AS unit_type, doc_id, doc_id || '_chunk_' || chunk AS clause_id, chunk AS clause_order_index, role, region, text AS content, first AS span_from, first + n - 1 AS span_to, n AS block_count FROM u""")
def chunk_items(t) -> DataFrame:
    chunks = cut_lineage(chunk.chunk_texts(t("documents"), "doc_id", "text", MODE))  # read twice
    labelled = labels.label_segments(chunks, "text", rules.NEUTRAL_REGIONS, rules.NEUTRAL_NC_TYPES, rules.NEUTRAL_ROLE_WORDS, r"\A(?!)", 4)
    tags = labelled.select("doc_id", (F.col("chunk") * 3 + 5).alias("order"), "role", "region", "nc_type")  # numbers of their own, with gaps
    made = items.chunk_items(chunks, tags, "doc_id")
    return made.select("unit_type", "doc_id", "clause_id", "clause_order_index", "role", "region", "content", F.get("loc.chunk_span", 0).alias("span_from"), F.element_at("loc.chunk_span", -1).alias("span_to"), "biz_tags.block_count")
