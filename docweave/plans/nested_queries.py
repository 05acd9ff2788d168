"""Registered queries: nested documents of any depth, read, judged, put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import tree
from docweave.plans.registry import query

# A user's events, each inside the one before it, next to a leaf of its own.  Of every tenth user the text is cut short.
_OPEN = """'{"id":"e' || event_id || '","title":"' || event_type || '","content":"' || user_id || '","content_tags":{"role":"' || event_type || '"},"children":[{"id":"v' || event_id || '","content":"leaf"}'"""
_NESTED = f"""
o AS (SELECT user_id, event_id, {_OPEN} AS part FROM events),
j AS (SELECT user_id, string_agg(part, ',' ORDER BY event_id) || repeat(']}}', CAST(count(*) AS INT)) AS whole FROM o GROUP BY user_id),
d AS (SELECT user_id, CASE WHEN user_id % 10 = 0 THEN whole[:-2] ELSE whole END AS j FROM j)"""


def nested_events(t) -> DataFrame:
    parts = t("events").select("user_id", "event_id", F.expr(_OPEN).alias("part"))
    listed = parts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "part"))).alias("p"))
    whole = F.concat(F.array_join(F.transform("p", lambda p: p["part"]), ","), F.repeat(F.lit("]}"), F.size("p")))
    return listed.select("user_id", F.when(F.col("user_id") % 10 == 0, F.left(whole, F.length(whole) - 1)).otherwise(whole).alias("j"))


_FLAT = f"""
WITH RECURSIVE {_NESTED},
n AS (SELECT user_id, CAST(j AS JSON) AS node, [0] AS path, 1 AS level, NULL::VARCHAR AS parent_id FROM d WHERE json_valid(j)
      UNION ALL SELECT user_id, unnest(json_extract(node, '$.children[*]')), list_append(path, unnest(range(CAST(json_array_length(node, '$.children') AS INT)))), level + 1, node ->> 'id'
      FROM n WHERE json_array_length(node, '$.children') > 0),
flat AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY path) AS INT) AS order_index, level, node ->> 'id' AS id, parent_id, node ->> 'title' AS title, node ->> 'content' AS content, node -> 'content_tags' ->> 'role' AS role FROM n)"""


@query(f"""{_FLAT}
SELECT user_id, order_index, level, id, parent_id, title, content, role, NULL AS error FROM flat
UNION ALL SELECT user_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'is no JSON' FROM d WHERE NOT json_valid(j)""")
def nested_flatten(t) -> DataFrame:
    return tree.flatten_json(nested_events(t), "user_id", "j").drop("region", "nc_type", "score")


_JUDGED = """'{"metadata": {"id": 1}, "structure": ' || j || '}'"""


@query(f"""{_FLAT},
w AS (SELECT user_id, string_agg(x, '; ' ORDER BY order_index) AS errors FROM (SELECT user_id, order_index, CASE WHEN role = 'click' THEN 'content_tags: unknown tag kind' END AS x FROM flat) WHERE x IS NOT NULL GROUP BY user_id)
SELECT user_id, CASE WHEN NOT json_valid(j) THEN 'is no JSON' ELSE coalesce(errors, '') END AS errors FROM d LEFT JOIN w USING (user_id)""")
def nested_validate(t) -> DataFrame:
    tagged = F.replace("j", F.lit('"content_tags":{"role":"click"}'), F.lit('"content_tags":{"role":"click","kind":1}'))
    docs = nested_events(t).withColumn("j", tagged).withColumn("j", F.expr(_JUDGED))
    return tree.validate(docs, "user_id", "j").select("user_id", F.array_join("errors", "; ").alias("errors"))


@query(f"""{_FLAT}
SELECT user_id, count(*) AS n, max(level) AS depth, md5(string_agg(level || ':' || coalesce(title, '') || ':' || content, ',' ORDER BY order_index)) AS digest FROM flat GROUP BY user_id""")
def nested_assemble(t) -> DataFrame:
    # flat rows back to documents, and those to rows once more
    flat = tree.flatten_json(nested_events(t), "user_id", "j").where("error is null")
    again = tree.flatten_json(tree.assemble_json(flat, "user_id"), "user_id", "json")
    line = F.concat_ws(":", F.col("level").cast("string"), F.coalesce("title", F.lit("")), "content")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("order_index", line.alias("l")))), lambda r: r["l"])
    return again.groupBy("user_id").agg(F.count("*").alias("n"), F.max("level").alias("depth"), F.md5(F.array_join(lines, ",")).alias("digest"))
