"""License scans by an exact set-similarity join, in DataFrame functions only.

Two searches over every whole text:

* base phrases: places where the words of a phrase stand consecutively;
* templates: text blocks (lines, with the words behind them that a wrapped notice takes)
  that contain at least ``threshold`` of a license template's distinct words.

The second is a containment join between blocks and templates.  Words are put in one
global order, rarest in the corpus first.  A block with ``need`` of a template's n words
must hold one of the template's first n - need + 1 (prefix filter), must have at least
``need`` words at all (length filter), and enough words must be left behind the first
shared one on both sides (positional filter).  What passes is verified on the full sets,
so the join loses nothing.  Words outside all templates can't be shared; they take no
part in the order.

The templates are a fixed parameter, and so is the size of everything that is sent to
tasks: ``MAX_TEMPLATE_WORDS`` bounds it, and a longer list is refused.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import lower_ascii, once

#: Runs of what is not a word, after A-Z were lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_TEMPLATE_WORDS = 20_000
LINE = "\uE000"  # stands for a line break among words

#: Phrase -> label.
PHRASES: dict[str, str] = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: (label, text): notices as they stand in files and on pages.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License, version"),
    ("agpl", "licensed under the GNU Affero General Public License, version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike License"),
    ("cc-by", "licensed under a Creative Commons Attribution International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, BREAKS), "")


def _template_words(text: str) -> list[str]:
    return sorted({w for w in re.split(BREAKS, text.lower()) if w})


def _phrase_places(words: Column, phrase: str) -> Column:
    first, *rest = phrase.split()
    at = lambda i: F.get(words, i)
    fits = lambda w, i: _all([w == first, *[at(i + k) == x for k, x in enumerate(rest, 1)]])
    # places of the first word, then those that go on as the phrase does
    places = F.filter(F.transform(words, lambda w, i: F.when(fits(w, i), i)), lambda i: i.isNotNull())
    return places


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def find_phrases(docs: DataFrame, phrases: dict[str, str], text: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word (null without a place) and base_labels.

    Null and empty texts have no words.  Only texts in which a regular expression finds the
    phrase are looked at word by word.
    """
    lowered = once(docs, _low=lower_ascii(F.coalesce(F.col(text), F.lit(""))))
    split = once(lowered, _words=words_of(F.col("_low")))
    nothing = F.array().cast("array<int>")
    found = once(
        split,
        **{f"_p{k}": F.when(F.col("_low").rlike(BREAKS.join(p.split())), _phrase_places(F.col("_words"), p)).otherwise(nothing) for k, p in enumerate(phrases)},
    )
    every = F.concat(*[F.col(f"_p{k}") for k in range(len(phrases))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))
    drop = ["_words", *[f"_p{k}" for k in range(len(phrases))]]
    return found.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"), "n_base": F.size(every).cast("bigint"),
            "first_word": F.array_min(every).cast("bigint"), "last_word": F.array_max(every).cast("bigint"),
            "base_labels": F.array_join(F.array_sort(F.array_distinct(labels)), ","), "_base": labels,
        }
    ).drop(*drop)


def word_frequencies(docs: DataFrame, words: list[str], lowered: str) -> dict[str, int]:
    """In how many rows each of ``words`` occurs: one row per word comes back."""
    known = F.array(*[F.lit(w) for w in words])
    held = docs.select(F.explode(F.array_intersect(words_of(F.col(lowered)), known)).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def match_templates(
    docs: DataFrame, key: str, lowered: str, templates: tuple[tuple[str, str], ...], threshold: float, wrapped: bool = False
) -> DataFrame:
    """``key, label, score`` for every row and label whose template a block of it contains.

    Blocks are the lines; with ``wrapped``, every line with as many of the words behind it
    as the longest template has, so that notices are found however they are wrapped.
    score: the greatest containment.  docs: one row per key, with lower-cased text.
    """
    spark = docs.sparkSession
    sets = [(label, _template_words(text)) for label, text in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    if sum(len(ws) for _, ws in sets) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words: split the list")
    frequency = word_frequencies(docs, vocabulary, lowered)
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows, starts = [], set()
    for t, (label, ws) in enumerate(sets):
        ranks = sorted(rank[w] for w in ws)
        need = math.ceil(threshold * len(ranks) - 1e-9)
        for i, r in enumerate(ranks[: len(ranks) - need + 1]):
            rows.append((t, label, r, i, len(ranks), need, ranks))
            starts.add(order[r])
    prefixes = spark.createDataFrame(rows, "template int, label string, rank int, i int, n int, need int, ranks array<int>")

    # prefix filter on the lines before they are split into words
    least = min(r[5] for r in rows)
    pattern = r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])(?:" + "|".join(map(re.escape, sorted(starts))) + r")(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"
    ranks_of = F.create_map(*[F.lit(x) for w in order for x in (w, rank[w])])
    searched = docs.where(F.col(lowered).rlike(pattern))
    if wrapped:
        longest = max(len([w for w in re.split(BREAKS, text.lower()) if w]) for _, text in templates)
        marked = once(searched.select(key, F.replace(lowered, F.lit("\n"), F.lit(f" {LINE} ")).alias("_m")), _w=words_of(F.col("_m")))
        marks = F.filter(F.transform("_w", lambda w, i: F.when(w == LINE, i)), lambda i: i.isNotNull())
        ends = F.transform(marks, lambda p, k: p - k)  # in words, without the marks
        words = once(marked.select(key, F.array_remove("_w", LINE).alias("_w"), ends.alias("_e")), _ranks=ranks_of)
        ranked = once(words, _r=F.transform("_w", lambda w: F.try_element_at(F.col("_ranks"), w)), _a=F.concat(F.array(F.lit(0)), "_e"), _b=F.concat("_e", F.array(F.size("_w"))))
        runs = ranked.select(key, "_r", F.inline(F.arrays_zip("_a", "_b"))).where("_b > _a")
        blocks = runs.select(key, F.slice("_r", F.col("_a") + 1, F.col("_b") - F.col("_a") + longest).alias("_r"))
        blocks = blocks.select(key, F.array_sort(F.array_distinct(F.filter("_r", lambda r: r.isNotNull()))).alias("held"))
    else:
        lines = searched.select(key, F.explode(F.filter(F.split(lowered, "\n"), lambda x: x.rlike(pattern))).alias("line"))
        blocks = once(lines.select(key, F.array_distinct(words_of(F.col("line"))).alias("words")), _ranks=ranks_of)
        blocks = blocks.select(key, F.array_sort(F.filter(F.transform("words", lambda w: F.try_element_at(F.col("_ranks"), w)), lambda r: r.isNotNull())).alias("held"))
    blocks = blocks.where(F.size("held") >= least)
    candidates = (
        blocks.select(key, "held", F.posexplode("held").alias("j", "rank"))
        .join(F.broadcast(prefixes), "rank")  # at most MAX_TEMPLATE_WORDS rows
        .where((F.size("held") >= F.col("need")) & (1 + F.least(F.col("n") - F.col("i") - 1, F.size("held") - F.col("j") - 1) >= F.col("need") - F.col("i")))
    )
    shared = F.size(F.array_intersect("held", "ranks"))
    verified = candidates.withColumn("shared", shared).where("shared >= need")
    return verified.groupBy(key, "label").agg(F.max(F.col("shared") / F.col("n")).alias("score"))


def scan_licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] | None = None,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = 0.9,
    wrapped: bool = True,
) -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score``, a row per row.

    labels: the base labels and those of the templates found, distinct, sorted, joined by
    commas.  score: 1 with a base phrase, else the greatest containment found, else 0.
    Null and empty texts have no words and no labels; texts are searched whole; rows with
    the same key share what is found in any of them, rows with a null key only those with
    the same text; an empty table gives no rows; other columns are ignored.
    """
    found = find_phrases(docs.select(F.col(key), F.col(text)), PHRASES if phrases is None else phrases, text)
    # rows without a key are told apart by their texts
    own = F.struct(F.col(key).alias("key"), F.when(F.col(key).isNull(), F.xxhash64(text)).alias("text"))
    lowered = docs.select(own.alias("_k"), lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    hits = match_templates(lowered, "_k", "_low", templates, threshold, wrapped)
    per_key = hits.groupBy("_k").agg(F.collect_set("label").alias("_more"), F.max("score").alias("_best"))  # a set of few labels
    return found.withColumn("_k", own).join(per_key, "_k", "left").select(
        key, "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    brk = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    templates = ",\n    ".join(f"('{label}', {quoted(_template_words(text))})" for label, text in TEMPLATES)
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS i, '{label}' AS label FROM p WHERE "
        + " AND ".join(f"ws[i + {k}] = '{x}'" if k else f"ws[i] = '{x}'" for k, x in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    longest = max(len([w for w in re.split(BREAKS, text.lower()) if w]) for _, text in TEMPLATES)
    return rf"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT doc_id, low, list_filter(regexp_split_to_array(low, '{brk}'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
b AS ({places}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM b GROUP BY doc_id),
t(label, ts) AS (VALUES
    {templates}),
line AS (SELECT doc_id, unnest(string_split(low, chr(10))) AS line, unnest(range(CAST(len(string_split(low, chr(10))) AS INT))) AS i FROM d),
size AS (SELECT doc_id, i, CAST(len(list_filter(regexp_split_to_array(line, '{brk}'), lambda x: x <> '')) AS BIGINT) AS n FROM line),
stop AS (SELECT doc_id, n, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS b FROM size),
-- a line's words and as many behind it as the longest template has
block AS (SELECT doc_id, list_distinct(ws[b - n + 1:b + {longest}]) AS bs FROM stop JOIN w USING (doc_id) WHERE n > 0),
m AS (SELECT doc_id, label, len(list_intersect(bs, ts)) AS shared, len(ts) AS n FROM block CROSS JOIN t),
hit AS (SELECT doc_id, label, max(CAST(shared AS DOUBLE) / n) AS score FROM m WHERE shared >= ceil(0.9 * n - 1e-9) GROUP BY doc_id, label),
best AS (SELECT doc_id, max(score) AS score FROM hit GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
       FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best.score, 0.0) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id)
"""


ORACLE_SQL = _oracle()
