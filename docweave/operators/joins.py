"""As-of, nearest, band and containment joins over ordered rows, as windows and equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
AFTER = (1, Window.unboundedFollowing)


def asof_preceding(rows: DataFrame, key: str, order: str, is_target, value: str, out: str) -> DataFrame:
    """Adds ``out``: ``value`` of the nearest earlier row of the key that is a target; rows of one table, order unique in a key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(*BEFORE)
    return rows.withColumn(out, F.last(F.when(is_target, F.col(value)), ignorenulls=True).over(w))


def asof_join(left: DataFrame, right: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Adds ``value`` of the nearest right row of the key with a smaller order, null if none: a union and one window."""
    tagged = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_right", F.lit(False))
    both = tagged.unionByName(right.select(key, order, F.col(value).alias("_v")).withColumn("_right", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("not _right").drop("_v", "_right")


def nearest(rows: DataFrame, key: str, order: str, is_target, value: str, out: str) -> DataFrame:
    """Adds ``out``: ``value`` of the target row nearest in either direction, the earlier one on ties; a target's own is itself."""
    by = Window.partitionBy(key).orderBy(order)
    at = F.when(is_target, F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    prev = F.last(at, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(at, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    near = rows.withColumn("_p", prev).withColumn("_f", following)
    earlier = F.col("_f").isNull() | (F.col(order) - F.col("_p.o") <= F.col("_f.o") - F.col(order))
    return near.withColumn(out, F.when(F.col("_p").isNotNull() & earlier, F.col("_p.v")).otherwise(F.col("_f.v"))).drop("_p", "_f")


def band_first(left: DataFrame, right: DataFrame, key: str, order: str, place: str, value: str, out: str, width: int, left_id: str) -> DataFrame:
    """Adds ``value`` of the first right row, by ``place``, with |order - order| < width; null if none.

    Orders are put into buckets of the width: a row can only meet its own and the two next
    to it, so the band is an equi-join.
    """
    probe = left.select(left_id, key, F.col(order).alias("_o")).withColumn("_b", F.explode(F.array(*[F.floor(F.col("_o") / width) + d for d in (-1, 0, 1)])))
    build = right.select(F.col(key), F.col(order).alias("_p"), F.col(place).alias("_place"), F.col(value).alias("_v")).withColumn("_b", F.floor(F.col("_p") / width))
    hits = probe.join(build, [key, "_b"]).where(F.abs(F.col("_o") - F.col("_p")) < width)
    best = hits.groupBy(left_id).agg(F.min_by("_v", "_place").alias(out))
    return left.join(best, left_id, "left")


def containing_span(segments: DataFrame, spans: DataFrame, key: str, segment_id: str, label: str, bucket: int = 1000) -> DataFrame:
    """Adds ``label`` of the first span, by ``span_index``, that contains the segment; null if none.

    Spans are listed under every bucket of positions they touch; a segment looks in the
    bucket where it starts.
    """
    listed = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    listed = listed.select(key, "_b", F.col("start").alias("_s"), F.col("end").alias("_e"), "span_index", F.col(label).alias("_l"))
    hits = segments.withColumn("_b", F.floor(F.col("start") / bucket)).join(listed, [key, "_b"]).where("_s <= start and _e >= end")
    best = hits.groupBy(key, segment_id).agg(F.min_by("_l", "span_index").alias(label))
    return segments.join(best, [key, segment_id], "left")


def join_spread(many: DataFrame, few: DataFrame, key: str, by: str, parts: int = 16) -> DataFrame:
    """``many`` joined with ``few`` on a key that has few values: a value's rows of ``many`` are dealt by ``by`` into parts, each with a copy of the value's rows of ``few``.

    What comes out may be far more than what goes in, so the numbers of tasks are given: by the
    size of what goes in, adaptive execution would make it one.
    """
    dealt = many.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    copies = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.repartition(4 * parts, key, "_part").join(copies.repartition(4 * parts, key, "_part"), [key, "_part"]).drop("_part")


def lookup_chain(rows: DataFrame, *steps: tuple[DataFrame, str, str, str, str]) -> DataFrame:
    """Left lookups one after the other; a step: (table, foreign key, its key, its value, name). Missing: ''."""
    for table, foreign, own, value, name in steps:
        found = table.select(F.col(own).alias(foreign), F.col(value).alias(name))
        rows = rows.join(found, foreign, "left")
        if dict(found.dtypes)[name] == "string":
            rows = rows.withColumn(name, F.coalesce(name, F.lit("")))
    return rows


def in_either(rows: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in one of two tables."""
    return rows.join(first.select(key).union(second.select(key)), key, "left_semi")
