"""Rows for a vector table: joined from structured tables, with defaults, places and what is shown of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of an item in order, with their types.
ITEM_COLUMNS = {
    "unit_type": "string", "doc_id": "string", "doc_name": "string", "section_id": "string", "section_title": "string", "section_level": "int",
    "clause_id": "string", "clause_title": "string", "clause_order_index": "int", "item_id": "string", "parent_item_id": "string", "item_order_index": "int",
    "content": "string", "role": "string", "region": "string", "nc_type": "string", "score": "int",
}
#: Where the id, title, level and order of a unit's own row go.
OWN_COLUMNS = {
    "SECTION": {"section_id": "id", "section_title": "title", "section_level": "level"},
    "CLAUSE": {"clause_id": "id", "clause_title": "title", "clause_order_index": "order_index"},
    "CLAUSE_ITEM": {"item_id": "id", "item_order_index": "order_index"},
}
#: What a hit shows where a field is missing.
HIT_DEFAULTS = {
    "id": "", "unit_type": "", "doc_id": "", "doc_name": "", "section_id": None, "section_title": "", "section_level": 0, "clause_id": "", "clause_title": "",
    "clause_order_index": 0, "item_id": None, "parent_item_id": None, "item_order_index": 0, "lang": "zh", "role": "", "region": "", "nc_type": None,
    "content": "", "loc": "{}", "score": 1, "distance": 0.0,
}


def _rows(table: DataFrame, unit: str, roles: Column) -> DataFrame:
    own, has = OWN_COLUMNS[unit], set(table.columns)
    fixed = {
        "unit_type": F.lit(unit), "doc_name": F.concat(F.lit("document_"), F.col("doc_id").cast("string")), "role": roles,
        "region": F.coalesce(F.col("region"), F.lit("MAIN")) if "region" in has else F.lit("MAIN"), "content": F.coalesce(F.col("content"), F.lit("")) if "content" in has else F.lit(""),
    }
    source = lambda c: F.col(own.get(c, c)) if own.get(c, c) in has else F.lit(None)
    return table.select(*[fixed.get(c, source(c)).cast(t).alias(c) for c, t in ITEM_COLUMNS.items()])


def structure_items(sections: DataFrame, clauses: DataFrame, items: DataFrame) -> DataFrame:
    """Sections, clauses and items as rows of one table.

    Each needs doc_id, id; title, level, order_index, content, region and the ids of what
    stands above are taken where they are given.  Sections aren't clauses whatever they
    say, clauses are; items keep their own role.
    """
    role = F.coalesce(F.col("role"), F.lit("CLAUSE")) if "role" in items.columns else F.lit("CLAUSE")
    parts = [_rows(sections, "SECTION", F.lit("NON_CLAUSE")), _rows(clauses, "CLAUSE", F.lit("CLAUSE")), _rows(items, "CLAUSE_ITEM", role)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def batch_vectorize(items: DataFrame, batch: str, order: list[str]) -> DataFrame:
    """Clauses and items with a content, and their ordinal in their batch as ``embedding_id``."""
    kept = items.where(F.col("unit_type").isin("CLAUSE", "CLAUSE_ITEM") & (F.coalesce(F.col("content"), F.lit("")) != ""))
    return kept.withColumn("embedding_id", (F.row_number().over(Window.partitionBy(batch).orderBy(*order)) - 1).cast("string"))


def hydrate(hits: DataFrame, clauses: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``page``, ``span_ids`` (by seq) and ``block_id`` to hits with clause_id and item_id (null: the clause itself).

    clauses: clause_id, page; spans: owner_type, owner_id, seq, span_id.  Hits of unknown
    clauses have none of them.  Only spans of hits are gathered.  A clause that has several
    rows is the one with the least page, so a hit stays one row; hits that are equal stay two.
    """
    kind, owner = F.when(F.col("item_id").isNull(), "CLAUSE").otherwise("CLAUSE_ITEM"), F.coalesce("item_id", "clause_id")
    asked = hits.withColumns({"owner_type": kind, "owner_id": owner})
    wanted = spans.join(asked.select("owner_type", "owner_id").distinct(), ["owner_type", "owner_id"], "left_semi")
    held = wanted.groupBy("owner_type", "owner_id").agg(F.array_sort(F.collect_list(F.struct("seq", "span_id"))).alias("_spans"))
    known = clauses.groupBy("clause_id").agg(F.min("page").alias("page"), F.lit(True).alias("_known"))
    out = asked.join(known, "clause_id", "left").join(held, ["owner_type", "owner_id"], "left")
    first = F.get("_spans", 0)["seq"]
    block = F.concat_ws("-", F.lit("block"), F.col("clause_id").cast("string"), first.cast("string"))
    ids = F.when(F.col("_known") & F.col("_spans").isNotNull(), F.transform("_spans", lambda s: s["span_id"])).otherwise(F.array().cast(f"array<{dict(spans.dtypes)['span_id']}>"))
    return out.withColumns({"span_ids": ids, "block_id": F.when(F.col("_known"), block)}).drop("_spans", "_known", "owner_type", "owner_id")


def hit_records(hits: DataFrame) -> DataFrame:
    """All fields of a hit, missing ones and nulls as their defaults."""
    return hits.select(*[(F.coalesce(F.col(c), F.lit(v)) if c in hits.columns else F.lit(v)).alias(c) for c, v in HIT_DEFAULTS.items()])


def project_hits(hits: DataFrame, include_content: bool = True, fields: tuple[str, ...] = ("lang", "region", "nc_type", "loc")) -> DataFrame:
    """Adds ``metadata``, a map of the fields that are there; without contents, title and content are null."""
    present = [x for f in fields if f in hits.columns for x in (F.lit(f), F.col(f).cast("string"))]
    out = hits.withColumn("metadata", F.map_filter(F.create_map(*present), lambda k, v: v.isNotNull()))
    return out if include_content else out.withColumns({c: F.lit(None).cast(t) for c, t in hits.dtypes if c in ("title", "content")})


def with_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """Adds an array ``name`` of the parent's children by ``order``; empty where there are none."""
    listed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias(name))
    return parents.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(dict(listed.dtypes)[name])))


def zip_shortest(*arrays: Column) -> Column:
    """Structs of the elements at the same place, as many as the shortest array has."""
    return F.slice(F.arrays_zip(*arrays), F.lit(1), F.least(*[F.size(a) for a in arrays]))


def overlay(under: Column, over: Column) -> Column:
    """A map of both maps' keys; where both have one, the value of ``over``."""
    return F.map_concat(F.map_filter(under, lambda k, v: ~F.map_contains_key(over, k)), over)


def align(key: str, *tables: tuple[DataFrame, list[str]]) -> DataFrame:
    """Rows of several tables by their place in the document: ``key, place`` (from 0) and all their columns.

    tables: (rows, the columns that order them).  Places are counted in each table, whatever
    gaps its own numbers have; a document has as many rows as the shortest of its tables, none
    if one has none.  Column names must differ but for ``key``; null keys are a key.
    """
    out = None
    for rows, order in tables:
        counted = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
        if out is None:
            out = counted
            continue
        other = counted.withColumnsRenamed({key: "_key", "place": "_place"})
        out = out.join(other, F.col(key).eqNullSafe(F.col("_key")) & (F.col("place") == F.col("_place"))).drop("_key", "_place")
    return out


def chunk_items(chunks: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Chunks (``chunk, first, n, text``) and their labels (``order, role, region, nc_type``) as rows for a vector table, one by one.

    A chunk of a clause is a CLAUSE, any other a CLAUSE_ITEM; null roles are NON_CLAUSE, null
    regions MAIN.  ``loc``: chunk_span (its blocks' numbers), order_index; ``biz_tags``: block_count.
    """
    both = align(key, (chunks, ["chunk"]), (labels, ["order"]))
    role, span = F.coalesce("role", F.lit("NON_CLAUSE")), F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)
    own = F.concat_ws("_chunk_", F.col(key).cast("string"), F.col("place").cast("string"))
    return both.select(
        F.when(role == "CLAUSE", "CLAUSE").otherwise("CLAUSE_ITEM").alias("unit_type"), key, F.concat(F.lit("document_"), F.col(key).cast("string")).alias("doc_name"), own.alias("clause_id"), own.alias("item_id"),
        F.col("place").alias("clause_order_index"), role.alias("role"), F.coalesce("region", F.lit("MAIN")).alias("region"), "nc_type", F.col("text").alias("content"),
        F.struct(span.alias("chunk_span"), F.col("place").alias("order_index")).alias("loc"), F.struct(F.col("n").alias("block_count"), F.lit("semantic_structure").alias("chunking_method")).alias("biz_tags"),
    )
