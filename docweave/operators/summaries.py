"""Timelines, document summaries, overviews and entity graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import rules
from docweave.functions.text import strip, to_date
from docweave.operators.matches import find_all


def timeline(clauses: DataFrame, doc: str, clause: str, text: str, patterns=rules.DATE_PATTERNS, around: int = 100) -> DataFrame:
    """An event per place of a date: ``doc, clause, raw_date, pattern, date, start, context, place``.

    place: the event's number in its document, from 1, by date, then clause and start; what is
    no date comes last.  The clause is carried along, not searched for; every place of a date
    that is named more than once is an event with the context of its own.
    """
    found = find_all(clauses, [doc, clause], text, list(patterns), around)
    dated = found.select(doc, clause, F.col("value").alias("raw_date"), "pattern", to_date(F.col("value")).alias("date"), "start", "context")
    w = Window.partitionBy(doc).orderBy(F.asc_nulls_last("date"), clause, "start", "pattern")
    return dated.withColumn("place", F.row_number().over(w))


def summarize(clauses: DataFrame, doc: str, order: str, title: str, content: str, most: int = 15_000, blocks: int = 10) -> DataFrame:
    """Per document its clauses as 【title】content up to ``most`` characters, and ids of its first blocks."""
    line = F.concat(F.lit("【"), F.coalesce(F.nullif(F.col(title), F.lit("")), F.lit("无标题")), F.lit("】"), F.coalesce(F.col(content), F.lit("")))
    each = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("_l")))), lambda r: r["_l"])
    ids = F.slice(F.array_sort(F.collect_list(F.col(order))), 1, blocks)
    return clauses.groupBy(doc).agg(F.substring(F.array_join(each, "\n\n"), 1, most).alias("text"), ids.alias("block_orders"), F.count("*").alias("n_clauses"))


def overview(summaries: DataFrame, doc: str, text: str, docs: int = 8, most: int = 500) -> DataFrame:
    """One row: the first summaries joined, cut to ``most`` characters."""
    first = summaries.orderBy(doc).limit(docs)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(doc, text))), lambda r: r[text]), "\n\n")
    return first.agg(F.substring(joined, 1, most).alias("overview"), F.count("*").alias("n_docs"))


def entity_counts(docs: DataFrame, doc: str, text: str, patterns: dict[str, list[str]]) -> DataFrame:
    """``type, name, count, n_docs`` of what the patterns find."""
    found = None
    for kind, ps in patterns.items():
        for p in ps:
            hits = docs.select(doc, F.lit(kind).alias("type"), F.explode(F.regexp_extract_all(text, F.lit(p), F.lit(1))).alias("name"))
            found = hits if found is None else found.unionByName(hits)
    per_doc = found.groupBy("type", "name", doc).agg(F.count("*").alias("_n"))
    return per_doc.groupBy("type", "name").agg(F.sum("_n").alias("count"), F.count("*").alias("n_docs"))


def cooccurrence(entities: DataFrame, doc: str, name: str, block: int = 50) -> DataFrame:
    """Edges ``source, target, n_docs`` between entities of one document; entities are taken once per document.

    A document's entities are arrays of ``block``, by name; every two arrays of a document
    are paired, each pair in a row of its own, and edges come out of the pair.
    """
    named = entities.where(F.col(doc).isNotNull() & F.col(name).isNotNull()).groupBy(F.col(doc).alias("_d")).agg(F.array_sort(F.collect_set(name)).alias("_e"))
    blocks = named.select("_d", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("_e") - 1) / block).cast("int")), lambda k: F.slice("_e", k * block + 1, F.lit(block)))).alias("_i", "_a"))
    inside = blocks.select(F.col("_a"), F.col("_a").alias("_b"))
    several = blocks.where("_i > 0 or size(_a) = " + str(block))
    across = several.join(several.select("_d", F.col("_i").alias("_j"), F.col("_a").alias("_b")), "_d").where("_i < _j").select("_a", "_b")
    pairs = F.flatten(F.transform("_a", lambda a: F.transform(F.filter("_b", lambda b: a < b), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    return inside.unionByName(across).select(F.inline(pairs)).groupBy("source", "target").agg(F.count("*").alias("n_docs"))


def key_points(text: Column, most: int = 5) -> Column:
    """The leading sentences, at most so many: what stands for a model's key points without one."""
    sentences = F.filter(F.transform(F.split(text, "[.!?。！？]"), strip), lambda s: s != "")
    return F.slice(sentences, 1, most)
