"""Tables as snapshots: reads without deleted rows, writes as new snapshots.

A table is a DataFrame with a boolean ``deleted``; a mutation returns the table after it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import like_any, storage_path
from docweave.operators.once import cut_lineage


def live(table: DataFrame) -> DataFrame:
    return table.where("not deleted") if "deleted" in table.columns else table


def find(table: DataFrame, equals: dict | None = None, among: dict[str, list] | None = None, null: list[str] | None = None) -> DataFrame:
    """Rows by equality, membership and null columns, all of which must hold."""
    out = live(table)
    for c, v in (equals or {}).items():
        out = out.where(F.col(c).eqNullSafe(F.lit(v)))
    for c, vs in (among or {}).items():
        out = out.where(F.col(c).isin(vs))
    for c in null or []:
        out = out.where(F.col(c).isNull())
    return out


def search(table: DataFrame, columns: list[str], keyword: str) -> DataFrame:
    return live(table).where(like_any([F.col(c) for c in columns], keyword))


def json_equals(table: DataFrame, column: str, path: str, value: str) -> DataFrame:
    return live(table).where(F.get_json_object(column, path) == value)


#: Fields that vector filters may name.
FILTER_FIELDS = ("doc_id", "unit_type", "region")


def safe_filter(table: DataFrame, filters: dict, fields: tuple[str, ...] = FILTER_FIELDS) -> DataFrame:
    """Equality or membership on allowed fields; other names and None are ignored; values are never put into SQL text.

    A name that can't be a column's (letters, digits and underscores, no digit first) is refused
    even where it would be ignored: it was meant for something else.
    """
    out = table
    for name, value in filters.items():
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise ValueError(f"no field: {name}")
        if name in fields and value is not None:
            if not isinstance(value, (str, int, float, list)):
                raise ValueError(f"filter on {name}: {type(value).__name__}")
            out = out.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return out


#: What Spark reads as an escape, a comment or a quoted name; none of it can be part of a comparison.
_REFUSED = ("\\", "--", "/*", '"', "`", ";")
_WORDS = ("and", "or", "not", "in", "is", "null", "like", "between", "true", "false")


def expression_filter(table: DataFrame, expression: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows by a condition given as text: comparisons of allowed fields with values; other names and calls are refused.

    Backslashes, comments, double quotes and backticks are refused before anything else, so a
    value ends at the next single quote for Spark as it does here; two values side by side and
    a word before a value (a raw or typed literal) are refused, too.
    """
    bare = re.sub(r"'[^']*'", " \x00 ", expression)
    names = re.findall(r"[^\W\d]\w*", bare)
    calls = "|".join(map(re.escape, [*fields, *[w for w in _WORDS if w not in ("in", "and", "or", "not")]]))
    if (
        any(x in expression for x in _REFUSED) or "\x00" in expression
        or any(n not in fields and n.lower() not in _WORDS for n in names)
        or re.search(r"[^\w\s.,()<>=!+\-*/%\x00]", bare)
        or re.search(rf"(?i)\b({calls})\s*\(|\x00\s*\x00|\b(?!(?:in|and|or|not|like|between)\b)[^\W\d]\w*\s+\x00|\x00\s*\(|\)\s*\(", bare)
    ):
        raise ValueError(f"condition not allowed: {expression}")
    return table.where(expression)


def page(table: DataFrame, order: list, skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of a total order, and its number."""
    return table.orderBy(*order).offset(skip).limit(limit).withColumn("page", F.lit(skip // limit + 1))


def page_of_owners(table: DataFrame, owners: list[str], order: list[str], skip: int, limit: int) -> DataFrame:
    """Of every owner's live rows those from ``skip`` on, ``limit`` at most, with their ``place`` from 1; null owners are an owner."""
    place = F.row_number().over(Window.partitionBy(*owners).orderBy(*order))
    return live(table).withColumn("place", place).where((F.col("place") > skip) & (F.col("place") <= skip + limit))


def counts(table: DataFrame, key: str, cap: int | None = None) -> DataFrame:
    n = F.count("*")
    return live(table).groupBy(key).agg((F.least(n, F.lit(cap)) if cap else n).alias("n"))


def next_order(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The order after the last, by key; null keys are a key."""
    return live(table).groupBy(*keys).agg((F.coalesce(F.max(order), F.lit(0)) + 1).alias("next_order"))


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, key: str, clear: dict[str, str] | None = None) -> DataFrame:
    """Non-null values of ``changes`` replace the table's; keys without changes stay.

    clear: column to the boolean column of ``changes`` that says where it becomes null.  A key
    that ``changes`` has more than once takes each column's greatest value, and is cleared if
    any of its rows says so; no row of the table is doubled.
    """
    clear = clear or {}
    new = [c for c in changes.columns if c != key and c not in clear.values()]
    once = changes.groupBy(key).agg(*[F.max(c).alias(f"_{c}") for c in new], *[F.bool_or(F.coalesce(flag, F.lit(False))).alias(f"_no_{c}") for c, flag in clear.items()])
    out = table.join(once, key, "left")
    value = lambda c: F.coalesce(f"_{c}", c) if c in new else F.col(c)
    return out.select(*[(F.when(~F.coalesce(f"_no_{c}", F.lit(False)), value(c)) if c in clear else value(c)).alias(c) for c in table.columns])


def soft_delete(table: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    marks = doomed.select(key).distinct().withColumn("_gone", F.lit(True))
    before = F.col("deleted") if "deleted" in table.columns else F.lit(False)
    return table.join(marks, key, "left").withColumn("deleted", before | F.coalesce("_gone", F.lit(False))).drop("_gone")


def transition(table: DataFrame, when: Column, status: str, **subs: str) -> DataFrame:
    """Sets status, and the sub-statuses given, where ``when`` holds."""
    return table.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in {"status": status, **subs}.items()})


def guard(table: DataFrame, status: str = "status", needs: str | None = None) -> DataFrame:
    """Adds ``error``: null if the row may start, else why not (it runs already, or what it needs isn't completed)."""
    error = F.when(F.col(status) == "processing", "processing")
    return table.withColumn("error", error if needs is None else error.when(F.coalesce(F.col(needs), F.lit("")) != "completed", f"{needs} not completed"))


def replace_by_id(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows with ids that exist replace them; the old ones stay as deleted."""
    return append(soft_delete(table, rows, key), rows.withColumn("deleted", F.lit(False)))


def delete_rows(table: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """``table`` without the rows of the keys given, such as a document's vectors."""
    return table.join(doomed.select(key).distinct(), key, "left_anti")


def reprocess(table: DataFrame, rows: DataFrame, key: str, redone: DataFrame | None = None) -> DataFrame:
    """What the table held of the keys in ``redone`` (else those in ``rows``) goes, and ``rows`` come.

    The same however often it is done.  A rerun may yield no rows for a key: ``redone`` names
    it, and nothing of it stays.
    """
    return append(delete_rows(table, rows if redone is None else redone, key), rows)


def rewrite_partitions(path: str, rows: DataFrame, redone: DataFrame, key: str) -> None:
    """``reprocess`` for Parquet files partitioned by ``key``: only the folders of the keys redone are written.

    Overwriting is dynamic, so it replaces the folders that have rows; a key that yielded none
    gets one row that is marked as deleted, which ``live`` leaves out.
    """
    gone = redone.select(key).distinct().join(rows.select(key).distinct(), key, "left_anti").withColumn("deleted", F.lit(True))
    rows = rows if "deleted" in rows.columns else rows.withColumn("deleted", F.lit(False))
    every = rows.unionByName(gone, allowMissingColumns=True)
    every.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def relabel(spans: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Role, region and nc_type of ``changes`` where they aren't null; nothing else changes."""
    return update(spans, changes.select(key, *[c for c in ("role", "region", "nc_type") if c in changes.columns]), key)


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return append(table, rows.join(table, key, "left_anti"))


def deduplicate_uploads(files: DataFrame, key: str, content: str, extension: Column, known: DataFrame | None = None) -> DataFrame:
    """Adds checksum, duplicate_of (the first row with the content; null for itself) and storage_path.

    known: a table of files stored before (key, checksum), of which live rows count: a content
    that is there is a duplicate of its first row, whatever else comes with this upload.
    """
    summed = files.withColumn("checksum", F.sha2(content, 256))
    first = summed.groupBy("checksum").agg(F.min(key).alias("_first"))
    out = summed.join(first, "checksum").withColumn("_of", F.when(F.col("_first") != F.col(key), F.col("_first")))
    if known is not None:
        stored = live(known).where("checksum is not null").groupBy("checksum").agg(F.min(key).alias("_stored"))
        out = out.join(stored, "checksum", "left").withColumn("_of", F.coalesce("_stored", "_of")).drop("_stored")
    return out.withColumns({"duplicate_of": F.col("_of"), "storage_path": storage_path(F.col("checksum"), extension)}).drop("_first", "_of")


def upload_errors(size: Column, mime: Column, most: int = 100 << 20) -> Column:
    allowed = ["application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain", "text/markdown", "text/html"]
    return F.when(size > most, "413 too large").when(~F.coalesce(mime.isin(allowed), F.lit(False)), "400 type not allowed")


#: What a vector table holds where an item says nothing.
INGEST_DEFAULTS = {"section_level": 0, "clause_order_index": 0, "item_order_index": 0}


def ingest(items: DataFrame, order: str, content: str, embedding: str, batch: int = 100, whole: bool = False) -> DataFrame:
    """Adds item_index (from 0), batch, and ``reason`` for items that can't be stored: no content, or no vector.

    whole: a batch with an item that has a content and no vector fails as a whole, as a model's
    call does: its other items have the reason "batch failed".  INGEST_DEFAULTS fill nulls.
    """
    placed = _numbered(items, order).withColumn("batch", F.floor(F.col("item_index") / batch))
    empty, none = F.coalesce(F.col(content), F.lit("")) == "", F.col(embedding).isNull()
    reason = F.when(empty, "empty content").when(none, "no embedding")
    if whole:
        failed = placed.where(~empty & none).select("batch").distinct().withColumn("_failed", F.lit(True))
        placed = placed.join(failed, "batch", "left")
        reason = reason.when(F.col("_failed"), "batch failed")
    filled = {c: F.coalesce(c, F.lit(v)) for c, v in INGEST_DEFAULTS.items() if c in items.columns}
    return placed.withColumns({**filled, "reason": reason}).select(*items.columns, "item_index", "batch", "reason")


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """item_index by ``order``, of any type that can be sorted: counted in ranges of it, so that no task sorts all rows.

    Sorted ranges are fixed on disk first, as many as the session's shuffles have, so a row's
    range is the same whenever it is worked out again; each begins behind the ones before it.
    """
    ranged = cut_lineage(rows.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    base = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))  # a row per range
    own = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return ranged.withColumn("_i", own).join(base, "_p").withColumn("item_index", F.col("_base") + F.col("_i") - 1).drop("_p", "_i", "_base")


def ingest_summary(ingested: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("reason").isNotNull())
    return ingested.agg(
        F.count("*").alias("total"), (F.count("*") - failed).alias("succeeded"), failed.alias("failed"),
        F.when(failed == 0, "ok").otherwise("partial_failed").alias("message"),
    )


def processing_status(documents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Documents with a count per child table, 0 where there are none."""
    out = documents
    for name, table in children.items():
        out = out.join(live(table).groupBy(key).agg(F.count("*").alias(f"n_{name}")), key, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out
