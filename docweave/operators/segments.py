"""Texts to segments, blocks and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import lstrip, strip


def split_segments(docs: DataFrame, key: str, text: str, separator: str = "\n", dense: bool = True) -> DataFrame:
    """``key, seg_id, text``: stripped, blank ones dropped; seg_id counts from 0, without gaps if ``dense``."""
    if not dense:
        pieces = docs.select(key, F.posexplode(F.split(text, separator)).alias("seg_id", "_raw")).select(key, "seg_id", strip(F.col("_raw")).alias("text"))
        return pieces.where("text <> ''")
    # counted inside the row's own array: no shuffle by document
    cleaned = F.filter(F.transform(F.split(text, separator), strip), lambda s: s != "")
    return docs.select(key, F.posexplode(cleaned).alias("seg_id", "text"))


def text_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that aren't blank, with their indent: ``key, pos, text, indent``."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "text"))
    indent = F.length("text") - F.length(F.regexp_replace("text", r"^\s+", ""))
    return lines.where(F.trim("text") != "").withColumn("indent", indent)


def with_offsets(segments: DataFrame, key: str, order: str, text: str = "text", gap: int = 1) -> DataFrame:
    """Adds start and end of every segment in its document's text joined by ``gap`` characters."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0))
    return segments.withColumn("start", start).withColumn("end", F.col("start") + F.length(text))


def char_windows(length: Column, size: int = 4000, overlap: int = 200) -> Column:
    """Array of ``{start, end}``: windows of ``size`` every ``size - overlap``, the last one ends with the text."""
    step = size - overlap
    last = F.when(length <= size, 0).otherwise(F.ceil((length - size) / step))
    windows = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda k: F.struct((k * step).alias("start"), F.least(k * step + size, length).alias("end")))
    return F.when(length > 0, windows)


def explode_char_windows(docs: DataFrame, key: str, text: str, size: int = 4000, overlap: int = 200) -> DataFrame:
    windows = docs.select(key, F.col(text).alias("_text"), F.posexplode(char_windows(F.length(text), size, overlap)).alias("window", "_w"))
    return windows.select(key, "window", "_w.start", "_w.end", F.substring("_text", F.col("_w.start") + 1, F.col("_w.end") - F.col("_w.start")).alias("text"))


def explode_row_windows(rows: DataFrame, key: str, order: str, size: int = 10, overlap: int = 2, ties: tuple[str, ...] = ()) -> DataFrame:
    """A row for each window of ``size`` rows, every ``size - overlap``, that it lies in; windows end with the document; ``ties`` order rows alike in ``order``."""
    step = size - overlap
    w = Window.partitionBy(key)
    placed = rows.withColumn("_i", F.row_number().over(w.orderBy(order, *ties)) - 1).withColumn("_n", F.count("*").over(w))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step)).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / step)).cast("int")
    return placed.withColumn("window", F.explode(F.sequence(first, F.least(F.floor(F.col("_i") / step).cast("int"), last)))).withColumnRenamed("_i", "row").drop("_n")


def segments_in_windows(segments: DataFrame, key: str, size: int = 4000, overlap: int = 200) -> DataFrame:
    """A row for each char window that contains the segment: window numbers follow from the offsets, no range join."""
    step = size - overlap
    first = F.greatest(F.lit(0), F.ceil((F.col("end") - size) / step)).cast("int")
    last = F.floor(F.col("start") / step).cast("int")
    return segments.withColumn("window", F.explode(F.when(first <= last, F.sequence(first, last))))


def overlay_spans(spans: DataFrame, key: str, label: str, labels: list[str], window: str | None = None, step: int = 0, default: str | None = None) -> DataFrame:
    """``key, start, end, label``: overlapping labelled spans as ones that don't overlap, in page order.

    Spans (``start, end``) of a window count from its beginning, window times ``step``.  A sweep
    over the borders of a document adds up, label by label, the spans that begin and end
    there: one window over as many rows as there are borders.  Between two borders the label of
    most spans holds, the first in ``labels`` of equals; neighbours with one label are one
    span.  Uncovered stretches have ``default``, or are left out if that is null.  Spans that
    are empty, have a null or a label that isn't listed don't count.
    """
    shift = F.col(window) * step if window else F.lit(0)
    placed = spans.select(key, (F.col("start") + shift).cast("bigint").alias("_s"), (F.col("end") + shift).cast("bigint").alias("_e"), F.col(label).alias("_l")).where(F.col("_l").isin(labels) & (F.col("_s") < F.col("_e")))
    edge = lambda c, n: F.struct(F.col(c).alias("_at"), F.lit(n).alias("_d"))
    edges = placed.select(key, "_l", F.inline(F.array(edge("_s", 1), edge("_e", -1))))
    borders = edges.groupBy(key, "_at").agg(*[F.sum(F.when(F.col("_l") == name, F.col("_d")).otherwise(0)).alias(f"_{i}") for i, name in enumerate(labels)])
    w = Window.partitionBy(key).orderBy("_at")
    open_ = borders.select(key, F.col("_at").alias("start"), F.lead("_at").over(w).alias("end"), *[F.sum(f"_{i}").over(w).alias(f"_{i}") for i in range(len(labels))])
    best = F.array_max(F.array(*[F.struct(F.col(f"_{i}").alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("label")) for i, name in enumerate(labels)]))
    voted = open_.where("end is not null").select(key, "start", "end", F.when(best["n"] > 0, best["label"]).otherwise(F.lit(default)).alias("label"))
    fresh = F.when(F.lag("label").over(w.orderBy("start")).eqNullSafe(F.col("label")), 0).otherwise(1)
    runs = voted.withColumn("_f", fresh).withColumn("_r", F.sum("_f").over(w.orderBy("start")))
    return runs.where("label is not null").groupBy(key, "_r").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label")).drop("_r")


def line_spans(windows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, start, end, line``: the lines of a window that aren't blank, stripped, by characters from its beginning."""
    held = windows.select(*keys, F.posexplode(F.split(text, "\n")).alias("_i", "_line"))
    w = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    begun = held.withColumn("_b", F.coalesce(F.sum(F.length("_line") + 1).over(w), F.lit(0)))
    lead = F.length("_line") - F.length(lstrip(F.col("_line")))
    line = strip(F.col("_line"))
    return begun.where(line != "").select(*keys, (F.col("_b") + lead).alias("start"), (F.col("_b") + lead + F.length(line)).alias("end"), line.alias("line"))
