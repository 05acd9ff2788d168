"""Flat rows to trees: element types, parents, units, and nested JSON to rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import rules
from docweave.functions.text import first_pattern, last_group, strip
from docweave.operators.joins import nearest
from docweave.operators.once import cut_lineage

#: What is said of a text that can't be read, and rows that are passed on at once.
NO_JSON, TOO_DEEP, ROWS = "is no JSON", "is nested too deeply", 5000


#: Tags that a node may carry, and texts of a document's metadata.
TAG_NAMES = ("role", "region", "nc_type", "score")
METADATA_TEXTS = ("title", "type", "created_at", "file_url")


def classify_elements(segments: DataFrame, text: str = "text", role: str = "role", nc_type: str = "nc_type") -> DataFrame:
    """Adds element_type (section, clause, clause_item; null: none), level_hint, number_token and title.

    Sections first, whatever the role; clauses and items need role CLAUSE; what is left is
    a clause without a number if it is a clause's body.
    """
    t, clause = F.col(text), F.col(role) == "CLAUSE"
    kinds = [("section", rules.SECTION_PATTERNS, F.lit(True)), ("clause", rules.CLAUSE_PATTERNS, clause), ("clause_item", rules.ITEM_PATTERNS, clause)]
    kind, hint, title = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string")
    body = clause & (F.col(nc_type) == "CLAUSE_BODY")
    kind, hint = F.when(body, "clause").otherwise(kind), F.when(body, 0).otherwise(hint)
    numbered = F.lit(False)
    for name, patterns, allowed in reversed(kinds):
        place = first_pattern(t, patterns)
        fits = place.isNotNull() & allowed
        found = F.lit(None).cast("string")
        for i, p in enumerate(patterns, 1):
            groups = re.compile(p).groups
            found = F.when(place == i, last_group(t, p, groups)).otherwise(found)
        title = F.when(fits, found if name != "clause_item" else F.lit(None)).otherwise(title)
        kind, hint, numbered = F.when(fits, name).otherwise(kind), F.when(fits, place).otherwise(hint), F.when(fits, True).otherwise(numbered)
    number = F.when(numbered, F.get(F.split(t, "[：:]"), 0))
    return segments.withColumns({"element_type": kind, "level_hint": hint, "number_token": number, "title": title})


def split_number(text: Column) -> Column:
    """``{number, title}`` by the first pattern that fits; no number: the whole text is the title."""
    out = F.struct(F.lit(None).cast("string").alias("number"), text.alias("title"))
    for p in reversed(rules.NUMBER_TITLE_PATTERNS):
        hit = F.struct(F.regexp_extract(text, f"(?U){p}", 1).alias("number"), F.regexp_extract(text, f"(?U){p}", 2).alias("title"))
        out = F.when(text.rlike(f"(?U){p}"), hit).otherwise(out)
    return out


def node_type(title: Column, content: Column, role: Column, region: Column) -> Column:
    """Type of a node of a nested document by its title, content and tags."""
    titled, filled = F.coalesce(title, F.lit("")) != "", F.coalesce(content, F.lit("")) != ""
    role, region = F.coalesce(role, F.lit("NON_CLAUSE")), F.coalesce(region, F.lit("MAIN"))
    return (
        F.when(titled & title.rlike(rules.NODE_SECTION), "section")
        .when(titled & (title.rlike(rules.NODE_CLAUSE) | (role == "CLAUSE")), "clause")
        .when(filled & (content.rlike(rules.NODE_ITEM) | ((role == "CLAUSE") & (region == "MAIN"))), "clause_item")
        .when(filled & (role == "CLAUSE"), "clause").otherwise("section")
    )


def parent_by_level(rows: DataFrame, key: str, order: str, level: str, levels: int, out: str = "parent") -> DataFrame:
    """Adds the order of the nearest earlier row with a smaller level, null if none: one window, a case per level."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = [F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(w) for k in range(1, levels)]
    lower = [F.when(F.col(level) > k, s) for k, s in enumerate(seen, 1)]
    return rows.withColumn(out, F.greatest(*lower) if len(lower) > 1 else lower[0])


def parent_by_prefix(rows: DataFrame, key: str, order: str, number: str, out: str = "parent") -> DataFrame:
    """Adds the order of the nearest earlier row whose digits are a strict prefix of this row's.

    Every row stands under its own number, and under each strict prefix of it, the empty one
    included, as one that looks for a parent; along a prefix the greatest number of order
    before each row is its parent there.  So the work grows with the rows times the depth.
    Rows without a number neither have nor are parents.  order: whole numbers.
    """
    digits = F.regexp_extract_all(number, F.lit(r"(\d+)"), F.lit(1))
    numbered = rows.where(F.coalesce(F.col(number), F.lit("")) != "").select(key, order, digits.alias("_d"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("_d")), lambda k: F.struct(F.array_join(F.slice("_d", F.lit(1), k), ".").alias("_p"), F.when(k == F.size("_d"), F.col(order)).alias("_o")))
    under = Window.partitionBy(key, "_p").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    # dealt out again: tasks are measured by these rows, and don't sort them beside those they come from
    looked = numbered.select(key, order, F.inline(prefixes)).repartition(key, "_p").withColumn("_f", F.max("_o").over(under))
    found = looked.where(F.col("_o").isNull()).groupBy(key, order).agg(F.max("_f").alias(out)).where(F.col(out).isNotNull())
    return rows.join(found, [key, order], "left")


def parent_item(rows: DataFrame, key: str, order: str, number: str, out: str = "parent", value: str | None = None, among: Column | None = None) -> DataFrame:
    """Adds the nearest earlier item that can own this one: a bracketed one owns ``1)``, ``(1)`` owns ``a)``.

    value: what is added of it, its order if not given.  among: which rows are items, if not all.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.col(number) if among is None else F.when(among, F.col(number)), F.lit(""))
    last = lambda cond: F.last(F.when(cond & (n != ""), F.col(value or order)), ignorenulls=True).over(w)
    bracket, digit = last(n.contains("（") | n.contains("(")), last(n.rlike(r"^\(\d+\)"))
    return rows.withColumn(out, F.when(n.rlike(r"^\d+\)"), bracket).when(n.rlike(r"^[a-zA-Z]\)"), digit))


def merge_units(rows: DataFrame, key: str, order: str, starts: Column, text: str, score: str) -> DataFrame:
    """Units that begin where ``starts`` holds and at the first row: ``key, unit, first, n, text, score`` (the least)."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("unit", F.sum(F.when(starts | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w) - 1)
    return marked.groupBy(key, "unit").agg(
        F.min(order).alias("first"), F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), "\n").alias("text"), F.min(score).alias("score"),
    )


def group_by_number(rows: DataFrame, key: str, order: str, number: str, text: str, page: str | None = None) -> DataFrame:
    """Document-wide groups of one number ('unknown' without): title is the first text, content the rest, ``segments`` their orders.

    With ``page`` also ``pages``, the distinct pages that aren't null, ascending.
    """
    each = F.array_sort(F.collect_list(F.struct(order, text)))
    pages = [] if page is None else [F.array_sort(F.collect_set(page)).alias("pages")]
    grouped = rows.groupBy(key, F.coalesce(F.col(number), F.lit("unknown")).alias("number")).agg(each.alias("_t"), F.count("*").alias("n"), *pages)
    texts = F.transform("_t", lambda r: r[text])
    content = F.trim(F.array_join(F.slice(texts, F.lit(2), F.size(texts)), "\n")).alias("content")
    return grouped.select(key, "number", "n", F.get(texts, 0).alias("title"), content, F.transform("_t", lambda r: r[order]).alias("segments"), *(["pages"] if pages else []))


def _read(text: str | None) -> tuple[object, str | None]:
    """A nested document and what is wrong with its text; null is a document without anything."""
    if text is None:
        return None, None
    try:
        return json.loads(text), None
    except ValueError:
        return None, NO_JSON
    except RecursionError:
        return None, TOO_DEEP


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _field(node: object, *path: str) -> object:
    for name in path:
        node = node.get(name) if isinstance(node, dict) else None
    return node


def _children(node: object) -> list:
    found = _field(node, "children")
    return found if isinstance(found, list) else []


def _nodes(root: object) -> Iterator[tuple[object, int, str | None]]:
    """Every node in pre-order with its level, from 1, and its parent's id."""
    todo = [(root, 1, None)]
    while todo:
        node, level, parent = todo.pop()
        yield node, level, parent
        own = _text(_field(node, "id"))
        todo += [(child, level + 1, own) for child in reversed(_children(node))]


def flatten_json(docs: DataFrame, key: str, json: str) -> DataFrame:
    """Nested documents to rows in pre-order: ``key, order_index`` (from 1), ``level, id, parent_id, title, content, role, region, nc_type, score, error``.

    One pass: a document is read once and its nodes are passed on as they are met, so neither
    the plan nor the work of a node depends on how deep it lies.  A text that is no JSON is one
    row with an ``error`` and nothing else; other documents aren't touched by it.  A null is a
    node without anything; numbers and objects in text fields are their JSON.
    """
    kind = docs.schema[key].dataType.simpleString()
    names, no_tags = ["order_index", "level", "id", "parent_id", "title", "content", *TAG_NAMES, "error"], [None] * len(TAG_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32() if n in ("order_index", "level") else pa.string() for n in names]
        for batch in batches:
            at: list[int] = []
            made: list[list] = [[] for _ in names]
            add = [column.append for column in made]
            texts = add[2:-1]

            def flush(batch=batch, at=at, made=made) -> pa.RecordBatch:
                columns = [pa.array(column, t) for column, t in zip(made, types, strict=True)]
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[key, *names])
                for column in (at, *made):
                    column.clear()
                return out

            for i, text in enumerate(batch.column(1)):  # one by one: a batch of texts is held as Arrow only
                root, error = _read(text.as_py())
                if error:
                    at.append(i)
                    for put in add[:-1]:
                        put(None)
                    add[-1](error)
                    continue
                for k, (node, level, parent) in enumerate(_nodes(root), 1):
                    at.append(i)
                    held = node if isinstance(node, dict) else {}
                    tags = held.get("content_tags")
                    tags = tags if isinstance(tags, dict) else {}
                    values = (held.get("id"), parent, held.get("title"), held.get("content"), *([tags.get(t) for t in TAG_NAMES] if tags else no_tags))
                    add[0](k)
                    add[1](level)
                    for put, value in zip(texts, values, strict=True):
                        put(value if value is None or type(value) is str else _text(value))
                    add[-1](None)
                    if len(at) == ROWS:
                        yield flush()
            if at:
                yield flush()

    return docs.select(key, json).mapInArrow(run, f"`{key}` {kind}, order_index int, level int, id string, parent_id string, title string, content string, {', '.join(f'{t} string' for t in TAG_NAMES)}, error string")


def assemble_json(rows: DataFrame, key: str, order: str = "order_index", level: str = "level") -> DataFrame:
    """The inverse of ``flatten_json``: ``key, json`` of every document from its rows (id, title, content and, where they are there, the tags).

    Rows come by ``order``, as ``flatten_json`` writes them: a level is at most one more than
    that of the row before, the least level is the top.  In JSON text that is brackets only: a node opens with its own
    fields, and what closes before it follows from two neighbouring levels, which one window
    shows.  So nothing is nested step by step, whatever the depth.  A document with several top
    rows gets them as the children of a node without fields.  Null fields are left out; rows
    without a level are no nodes; an empty table gives no documents.
    """
    w = Window.partitionBy(key).orderBy(order)
    held = rows.where(F.col(level).isNotNull())
    tops = Window.partitionBy(key)
    tags = [t for t in TAG_NAMES if t in rows.columns]
    tagged = F.when(F.coalesce(*tags).isNotNull(), F.struct(*tags)).alias("content_tags") if tags else None
    named = F.to_json(F.struct("id", "title", "content", *([] if tagged is None else [tagged])))
    before, after = F.lag(level).over(w), F.lead(level).over(w)
    depth = F.col("_depth")
    placed = held.select(key, order, F.col(level).alias("_l"), named.alias("_own"), before.alias("_b"), after.alias("_a"), F.min(level).over(tops).alias("_top"))
    placed = placed.withColumn("_depth", F.col("_l") - F.col("_top"))
    fields = F.substring("_own", 2, F.length("_own") - 2)
    opened = F.concat(F.lit("{"), fields, F.when(fields == "", "").otherwise(","), F.lit('"children":['))
    closing = F.when(F.col("_a").isNull(), depth + 1).otherwise(F.greatest(depth - (F.col("_a") - F.col("_top")) + 1, F.lit(0)))
    text = F.concat(F.when(F.coalesce(F.col("_l") <= F.col("_b"), F.lit(False)), ",").otherwise(""), opened, F.repeat(F.lit("]}"), closing.cast("int")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("_t")))), lambda r: r["_t"]), "")
    out = placed.groupBy(key).agg(joined.alias("_j"), F.count_if(depth == 0).alias("_n"))
    return out.select(key, F.when(F.col("_n") == 1, F.col("_j")).otherwise(F.concat(F.lit('{"children":['), "_j", F.lit("]}"))).alias("json"))


def tree_text(rows: DataFrame, key: str, order: str, kind: str, title: str, content: str) -> DataFrame:
    """A document's elements as text: ``## section``, ``### clause``, ``- item``, blank lines between."""
    line = F.when(F.col(kind) == "section", F.concat(F.lit("## "), F.col(title))).when(F.col(kind) == "clause", F.concat(F.lit("### "), F.col(title))).otherwise(F.concat(F.lit("- "), F.col(content)))
    body = F.when(F.col(kind).isin("section", "clause"), F.col(content))
    lines = rows.select(key, order, F.array_compact(F.array(line, body)).alias("_l"))
    return lines.groupBy(key).agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "_l"))), lambda r: r["_l"])), "\n\n").alias("text"))


def _wrong_node(node: object) -> Iterator[str]:
    held = node if isinstance(node, dict) else {}
    if "id" not in held:
        yield "id is missing"
    if "content" not in held and "title" not in held:
        yield "neither title nor content"
    if "children" in held and not isinstance(held["children"], list):
        yield "children is no list"
    for kind in ("title_tags", "content_tags"):
        tags = held.get(kind, {})
        if not isinstance(tags, dict):
            yield f"{kind} is no object"
            continue
        yield from (f"{kind}: unknown tag {t}" for t in sorted(tags, key=str.encode) if t not in TAG_NAMES)
        if "score" in tags and not (isinstance(tags["score"], int) and -(2**63) <= tags["score"] < 2**63):
            yield f"{kind}.score is no whole number"


def _wrong(doc: object) -> Iterator[str]:
    doc = doc if isinstance(doc, dict) else {}
    about = doc.get("metadata") if isinstance(doc.get("metadata"), dict) else {}
    if "metadata" not in doc:
        yield "metadata is missing"
    elif "id" not in about:
        yield "metadata.id is missing"
    if not isinstance(about.get("drafters", []), list):
        yield "metadata.drafters is no list"
    yield from (f"metadata.{f} is no text" for f in METADATA_TEXTS if not isinstance(about.get(f, ""), str))
    if "structure" not in doc:
        yield "structure is missing"
    if not isinstance(doc.get("vectorization", True), bool):
        yield "vectorization is no boolean"
    if "structure" in doc:
        for node, _, _ in _nodes(doc["structure"]):
            yield from _wrong_node(node)


def validate(docs: DataFrame, key: str, json: str) -> DataFrame:
    """``key, errors``: what is wrong with each nested document, in page order; nothing: an empty array.

    A document has metadata with an id, texts and a list of drafters, a structure, and
    perhaps a boolean ``vectorization``; every node has an id, a title or a content, a list
    of children if any, and tags of known names with a whole score.  A text that is no JSON has
    that as its one error; a null has nothing of what is asked for.  One pass, as deep as it goes.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[str]] = []
            begun = size = 0
            out = lambda b, n, found: pa.RecordBatch.from_arrays([b.column(0).slice(n, len(found)), pa.array(found, pa.list_(pa.string()))], names=[key, "errors"])
            for i, text in enumerate(batch.column(1), 1):  # one by one: a batch of texts is held as Arrow only
                root, error = _read(text.as_py())
                found.append([error] if error else list(_wrong(root)))
                size += 1 + len(found[-1])
                if size >= ROWS or i == batch.num_rows:
                    yield out(batch, begun, found)
                    found, begun, size = [], i, 0

    return docs.select(key, json).mapInArrow(run, f"`{key}` {kind}, errors array<string>")


def item_tree(rows: DataFrame, key: str, item: str, parent: str) -> DataFrame:
    """Adds ``depth`` (0: a root) and ``path`` (ids from the root, with slashes); a parent that isn't there makes a root.

    Pointers are doubled: every round joins each id's way up with that of where it ends, so a
    depth of d takes log2(d) rounds, each written to the checkpoint folder.  An id that several
    rows have is one node, under the smallest of their parents, and each row gets its place.
    Null keys are a key; rows without an id are roots without a path.  Rows on a circle of
    parents, or under one, hang under no root and are left out.
    """
    own = rows.where(F.col(item).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(item).alias("_id")).agg(F.min(parent).alias("_up"))
    known = own.select("_k", F.col("_id").alias("_up"))
    same = lambda a, b: F.col(f"{a}._k").eqNullSafe(F.col(f"{b}._k"))
    there = own.alias("a").join(known.alias("b"), same("a", "b") & (F.col("a._up") == F.col("b._up")), "left_semi")
    roots = own.alias("a").join(known.alias("b"), same("a", "b") & (F.col("a._up") == F.col("b._up")), "left_anti").withColumn("_up", F.lit(None).cast(own.schema["_up"].dataType))
    ways = cut_lineage(there.unionByName(roots).select("_k", "_id", "_up", F.lit(0).alias("depth"), F.col("_id").cast("string").alias("path")))
    left = None
    while True:
        open_ = ways.where("_up is not null")
        before, left = left, open_.count()
        if left == 0 or left == before:  # nothing ended at a root: what is left goes round in circles
            break
        further = open_.alias("a").join(ways.alias("b"), same("a", "b") & (F.col("a._up") == F.col("b._id")))
        further = further.select("a._k", "a._id", "b._up", (F.col("a.depth") + F.col("b.depth") + 1).alias("depth"), F.concat_ws("/", "b.path", "a.path").alias("path"))
        ways = cut_lineage(ways.where("_up is null").unionByName(further))
    placed = ways.select("_k", "_id", F.when(F.col("_up").isNull(), F.col("depth")).alias("depth"), "path")
    out = rows.alias("r").join(placed.alias("p"), F.col(f"r.{key}").eqNullSafe(F.col("p._k")) & (F.col(f"r.{item}") == F.col("p._id")), "left")
    return out.where(F.col("p.depth").isNotNull() | F.col(f"r.{item}").isNull()).select("r.*", F.coalesce("p.depth", F.lit(0)).alias("depth"), "p.path")


def sections_from_headings(segments: DataFrame, key: str, order: str, text: str = "text", role: str = "role", kind: str = "block_type", level: str = "level", page: str = "page") -> DataFrame:
    """Headings that are no clauses as sections: ``key, section_index`` (from 1), ``title, level, loc`` (segment and page).

    A null level is 1.  The columns of level and page may be missing.
    """
    has = lambda c, other: F.col(c) if c in segments.columns else F.lit(other)
    found = segments.where((F.col(role) == "NON_CLAUSE") & (F.col(kind) == "heading"))
    index = F.row_number().over(Window.partitionBy(key).orderBy(order))
    loc = F.struct(F.col(order).alias("segment"), has(page, None).cast("int").alias("page"))
    return found.select(key, index.alias("section_index"), strip(F.col(text)).alias("title"), F.coalesce(has(level, None).cast("int"), F.lit(1)).alias("level"), loc.alias("loc"))


def items_by_pattern(segments: DataFrame, key: str, order: str, text: str, is_clause: Column) -> DataFrame:
    """Segments numbered like items under the nearest clause, the earlier one of equals: ``clause, title`` (the number) and ``content``."""
    number = rf"^([（\(][{rules.CN}\d]+[）\)]|\d+\.\s)"
    near = nearest(segments, key, order, is_clause, order, "clause")
    title = F.regexp_extract(text, number, 1)
    found = near.where(F.col(text).rlike(number) & F.col("clause").isNotNull())
    return found.withColumns({"title": title, "content": strip(F.substring(F.col(text), F.length(title) + 1, F.length(text)))})
