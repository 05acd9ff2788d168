"""Composed pipelines: document to labelled units, to a tree, to vectors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import rules
from docweave.functions.text import stable_id
from docweave.operators import labels, search, segments, tree
from docweave.operators.joins import asof_join


def labelled_units(docs: DataFrame, key: str, text: str, from_level: str = "1", **rule_sets) -> DataFrame:
    """Paragraphs, labelled and scored, those of level ``from_level`` and up, merged into units that begin at titles."""
    parts = labels.label_segments(segments.split_segments(docs, key, text), **rule_sets)
    scored = parts.withColumn("_s", labels.score_b(F.col("region"), F.col("nc_type"), F.col("role"))).select("*", "_s.score", "_s.score_float").drop("_s")
    kept = labels.keep_from(scored, "score", from_level)
    units = tree.merge_units(kept, key, "seg_id", F.coalesce(F.col("nc_type") == "TITLE", F.lit(False)), "text", "score_float")
    return units.withColumn("level", labels.regrade(F.col("score"), F.col("n")))


def structure(labelled: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections, clauses and items with their parents, from labelled segments."""
    elements = tree.classify_elements(labelled).where("element_type is not null")
    sections = tree.parent_by_level(elements.where("element_type = 'section'"), key, order, "level_hint", len(rules.SECTION_PATTERNS))
    clauses = asof_join(elements.where("element_type = 'clause'"), elements.where("element_type = 'section'").withColumn("_o", F.col(order)), key, order, "_o", "section")
    clauses = tree.parent_by_prefix(clauses, key, order, "number_token")
    items = asof_join(elements.where("element_type = 'clause_item'"), elements.where("element_type = 'clause'").withColumn("_o", F.col(order)), key, order, "_o", "clause")
    items = tree.parent_item(items.where("clause is not null"), key, order, "number_token")
    return sections, clauses, items


def ingest_items(units: DataFrame, key: str, title: Column | None = None) -> DataFrame:
    """Units as rows for a vector table."""
    return units.select(
        key, "unit", stable_id(F.col(key), F.col("unit")).alias("item_id"), F.lit("CLAUSE").alias("unit_type"),
        F.substring("text", 1, 50).alias("clause_title") if title is None else title.alias("clause_title"), F.col("text").alias("content"), F.struct("first", "n").alias("loc"), "score",
    )


Model = Callable[[list[str]], list[list[float]]]
#: Embedding models by name, as callers add them.
MODELS: dict[str, Model] = {}


def register_model(name: str, model: Model) -> None:
    MODELS[name] = model


def embed(items: DataFrame, content: str, model: str | Model, out: str = "embedding") -> DataFrame:
    """Adds ``out`` by a model, plugged in or registered by name, a batch of texts at a time; null texts are empty ones."""
    if isinstance(model, str):
        if model not in MODELS:
            raise ValueError(f"no model {model}: register it; known: {', '.join(sorted(MODELS)) or 'none'}")
        model = MODELS[model]
    call = model

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in call(texts.fillna("").tolist())])

    return items.withColumn(out, vectors(F.col(content)))


def search_texts(queries: DataFrame, table: DataFrame, key: str, text: str, model: str | Model, k: int, unit_type: str = "unit_type", clause: str = "clause") -> DataFrame:
    """Texts looked for in a table of vectors: ``query_id, place, unit_type, clause, <key>, score, sub_items``.

    queries: key and text; table: key, ``embedding``, unit type and clause.  The texts are
    embedded by the model that made the table's vectors, the k nearest by cosine found, and
    items put under the clauses that were found before them (``search.nest_hits``).  Only the
    hits' rows are looked up.
    """
    asked = search.unit_vectors(embed(queries.select(key, text), text, model), "embedding")
    hits = search.search_all(asked, search.unit_vectors(table.select(key, "embedding"), "embedding"), key, "embedding", k)
    known = hits.join(table.select(key, unit_type, clause), key)
    return search.nest_hits(known, unit_type=unit_type, clause=clause, item=key)
