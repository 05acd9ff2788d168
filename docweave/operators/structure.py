"""Sections, clauses and items of nested documents: built, related, saved, read back."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators import store, tree
from docweave.operators.once import compute_once, let, settle

#: What a node has where its tags say nothing: role, nc_type and score of each kind.
DEFAULTS = {"section": ("NON_CLAUSE", None, None), "clause": ("CLAUSE", "CLAUSE_BODY", 2), "clause_item": ("CLAUSE", "CLAUSE_BODY", 2)}


#: Columns that hold the parents of each kind, in its table.
PARENTS = {"section": ["parent_id"], "clause": ["section_id", "parent_clause_id"], "clause_item": ["clause_id", "parent_item_id"]}
LINKS = [c for links in PARENTS.values() for c in links]


class Structure(NamedTuple):
    sections: DataFrame
    clauses: DataFrame
    items: DataFrame


def build(flat: DataFrame, key: str) -> Structure:
    """Rows of ``tree.flatten_json`` as sections, clauses and items: ``key, id, order_index, number_token, title, content, role, region, nc_type, score`` and their parents.

    A node's kind follows from its texts and tags; its number and title are split from its
    title, an item's from its content; missing tags have defaults.  Only a parent of the right
    kind is one: a section's section, a clause's clause and section, an item's clause and item.
    Rows with an error, and nodes without an id, are no elements.
    """
    return _built(_find_parents(_elements(flat, key), key, near=False), key)


def build_related(flat: DataFrame, key: str) -> Structure:
    """``relate(build(flat, key), key)`` in one pass: nodes are dealt out once, by document, and written once."""
    return _built(_find_parents(_elements(flat, key), key), key)


def relate(built: Structure, key: str) -> Structure:
    """Parents where there is none: a clause's nearest section before it, an item's nearest clause; among clauses by number, among items by bracket.

    A parent that is there stays.  Elements before the first of what they look for have none.
    order_index: whole numbers, one for an element of a document.
    """
    parts = []
    for kind, rows in zip(PARENTS, built, strict=True):
        seen = [(F.col(c) if c in ("id", "number_token", *PARENTS[kind]) and c in rows.columns else F.lit(None).cast("string")).alias(c) for c in ("id", "number_token", *LINKS)]
        # a table's row travels as one column, so tables may differ in what else they have
        whole = [(F.struct(*t.columns) if k == kind else F.lit(None).cast(t.schema)).alias(f"_{k}") for k, t in zip(PARENTS, built, strict=True)]
        parts.append(rows.select(key, "order_index", F.lit(kind).alias("kind"), *seen, *whole))
    found = settle(_find_parents(parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(key), key, own=False))

    def of(kind: str, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in PARENTS[kind]]
        return found.where(F.col("kind") == kind).select(*[F.col(f"_{kind}")[c].alias(c) for c in others], *PARENTS[kind])

    return Structure(built.sections, of("clause", built.clauses), of("clause_item", built.items))


def _elements(flat: DataFrame, key: str) -> DataFrame:
    """Nodes that are elements with their ``kind``, number and title, dealt out by document."""
    nodes = flat.where(F.col("error").isNull() & F.col("id").isNotNull()).drop("error").repartition(key)
    nodes = compute_once(nodes, kind=tree.node_type(F.col("title"), F.col("content"), F.col("role"), F.col("region")))
    text = F.when(F.col("kind") == "clause_item", F.col("content")).otherwise(F.col("title"))
    nodes = compute_once(nodes, _n=tree.split_number(F.coalesce(text, F.lit(""))))
    return nodes.select(*[c for c in nodes.columns if c not in ("title", "_n")], F.col("_n.number").alias("number_token"), "_n.title")


def _built(found: DataFrame, key: str) -> Structure:
    """Elements with their parents, in one table, as three, with what is missing filled in."""
    default = lambda at: F.coalesce(*[F.when(F.col("kind") == k, F.lit(values[at])) for k, values in DEFAULTS.items()])
    score = F.coalesce(F.try_to_number("score", F.lit("9999")).cast("int"), default(2))
    filled = {"content": F.coalesce("content", F.lit("")), "role": F.coalesce("role", default(0)), "region": F.coalesce("region", F.lit("MAIN")), "nc_type": F.coalesce("nc_type", default(1)), "score": score}
    rows = settle(found.withColumns(filled))
    shown = [key, "id", "order_index", "level", "number_token", "title", "content", "role", "region", "nc_type", "score"]
    return Structure(*[rows.where(F.col("kind") == kind).select(*shown, *links) for kind, links in PARENTS.items()])


def _find_parents(rows: DataFrame, key: str, own: bool = True, near: bool = True) -> DataFrame:
    """Adds the columns of LINKS to elements in one table that is dealt out by document; nothing leaves its task.

    own: parents are those that ``parent_id`` names, if of the right kind; else LINKS are there
    already.  near: those that ``relate`` finds where there is none.  What would be a join is a
    window over places where those that look for something meet those that have it: a row as
    a whole stands under its parent's id, and its kind under its own; a clause's id stands under
    its number's digits, and the clause looks under each strict prefix of them
    (``tree.parent_by_prefix`` has the orders of these).
    """
    columns = [c for c in rows.columns if c != key]
    nothing = F.lit(None).cast("string")

    def place(at: Column, held: Column = nothing, by_number: bool = True, looks: Column | bool = False, row: Column | None = None) -> Column:
        row = F.lit(None).cast(whole_type) if row is None else row
        return F.struct(F.lit(by_number).alias("_by_number"), at.alias("_at"), F.col("order_index").alias("_order"), held.alias("_held"), F.lit(looks).alias("_looks"), row.alias("_row"))

    whole = F.struct(*columns)
    whole_type = rows.select(whole.alias("_row")).schema["_row"].dataType
    places = F.array(place(F.col("parent_id") if own else nothing, by_number=False, row=whole), *([place(F.col("id"), F.col("kind"), by_number=False)] if own else []))
    if near:
        numbered = (F.col("kind") == "clause") & (F.coalesce("number_token", F.lit("")) != "")
        prefixes = lambda d: F.transform(F.sequence(F.lit(0), F.size(d)), lambda k: place(F.array_join(F.slice(d, F.lit(1), k), "."), F.when(k == F.size(d), F.col("id")), looks=k < F.size(d)))
        by_number = let(F.regexp_extract_all("number_token", F.lit(r"(\d+)"), F.lit(1)), prefixes)
        places = F.when(numbered, F.concat(places, by_number)).otherwise(places)
    met = Window.partitionBy(key, "_by_number", "_at").orderBy("_order")
    seen = rows.select(key, F.inline(places)).withColumns({
        "_up": F.min("_held").over(met.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "_last": F.max(F.when(F.col("_held").isNotNull(), F.struct("_order", "_held"))).over(met.rangeBetween(Window.unboundedPreceding, -1)),
    })
    seen = seen.where(F.col("_row").isNotNull() | F.col("_looks")).select(key, "_order", "_looks", "_row", "_up", "_last")
    kind, links = F.col("_row.kind"), {c: F.col(f"_row.{c}") for c in LINKS if not own}
    if own:
        under = lambda own, up: F.when((kind == own) & (F.col("_up") == up), F.col("_row.parent_id"))
        links = {"parent_id": under("section", "section"), "section_id": under("clause", "section"), "parent_clause_id": under("clause", "clause"), "clause_id": under("clause_item", "clause"), "parent_item_id": under("clause_item", "clause_item")}
    if near:
        seen = tree.parent_item(seen, key, "_order", "_row.number_token", "_item", value="_row.id", among=kind == "clause_item")
        along = Window.partitionBy(key).orderBy("_order")
        last = lambda of: F.last(F.when(kind == of, F.col("_row.id")), ignorenulls=True).over(along.rangeBetween(Window.unboundedPreceding, -1))
        by_number = F.max(F.when(F.col("_looks"), F.col("_last"))).over(along.rangeBetween(Window.currentRow, Window.currentRow))
        seen = seen.withColumns({"_section": last("section"), "_clause": last("clause"), "_numbered": by_number})
        found = {"section_id": F.when(kind == "clause", F.col("_section")), "parent_clause_id": F.when(kind == "clause", F.col("_numbered._held")), "clause_id": F.when(kind == "clause_item", F.col("_clause")), "parent_item_id": F.col("_item")}
        links |= {c: F.coalesce(links[c], f) for c, f in found.items()}
    return seen.where(F.col("_row").isNotNull()).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns if c not in LINKS], *[c.alias(n) for n, c in links.items()])


def save(documents: DataFrame, tables: Structure, built: Structure, key: str, redone: DataFrame) -> tuple[DataFrame, Structure]:
    """Documents and tables after saving: what the tables held of the documents ``redone`` goes, what was built comes.

    Documents redone get structure_status "completed" and the numbers of their elements, 0 also
    where nothing was built; others stay as they are.
    """
    after = Structure(*[store.reprocess(old, new.withColumn("deleted", F.lit(False)) if "deleted" in old.columns else new, key, redone=redone) for old, new in zip(tables, built, strict=True)])
    done = redone.select(key).distinct().withColumn("_done", F.lit(True))
    out = documents.join(done, key, "left")
    for name, rows in built._asdict().items():
        out = out.join(rows.groupBy(key).agg(F.count("*").alias("_n")), key, "left").withColumn(f"total_{name}", F.when(F.col("_done"), F.coalesce("_n", F.lit(0)))).drop("_n")
    before = F.col("structure_status") if "structure_status" in documents.columns else F.lit(None).cast("string")
    return out.withColumn("structure_status", F.when(F.col("_done"), "completed").otherwise(before)).drop("_done"), after


def structure_documents(documents: DataFrame, json: str, key: str) -> tuple[DataFrame, Structure]:
    """The driver: documents with ``error, structure_status`` and totals, and the elements of those that could be structured.

    A document must have parse_status "completed", must not be in progress, and must be a nested
    document with a node.  One that fails says why and is "failed"; the others go on.
    """
    checked = store.guard(documents, "structure_status", needs="parse_status")
    ready = checked.where(F.col("error").isNull()).select(key, json)
    flat = tree.flatten_json(ready, key, json)
    broken = flat.where(F.col("error").isNotNull()).select(key, F.col("error").alias("_broken"))
    built = build_related(flat, key)
    counts = None
    for name, rows in built._asdict().items():
        own = rows.groupBy(key).agg(F.count("*").alias(f"total_{name}"))
        counts = own if counts is None else counts.join(own, key, "full_outer")
    out = checked.join(broken, key, "left").join(counts, key, "left")
    totals = {f"total_{n}": F.coalesce(f"total_{n}", F.lit(0)) for n in built._fields}
    none = F.lit(0)
    for c in totals.values():
        none = none + c
    error = F.coalesce("error", "_broken", F.when(none == 0, "no parse result"))
    return out.withColumns(totals).withColumn("error", error).withColumn("structure_status", F.when(F.col("error").isNull(), "completed").otherwise("failed")).drop("_broken", json), built


def read_back(tables: Structure, key: str) -> DataFrame:
    """``key, sections, clauses, items``: every document as arrays in arrays, live rows only, by order_index.

    sections have their clauses, those their items; clauses of no section that is there, and
    items of no such clause, stand in the document's own arrays, so nothing is lost.  Rows are
    dealt out once, by document; there children and their parent meet as a group of one id.
    """
    shown = ["order_index", "id", "number_token", "title", "content", "role", "region"]
    parts = []
    for kind, link, rows in zip(PARENTS, (None, "section_id", "clause_id"), tables, strict=True):
        up = F.lit(None) if link is None else F.col(link)
        parts.append(store.live(rows).select(key, F.lit(kind).alias("_kind"), up.alias("_up"), F.struct(*shown).alias("_e")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(key)
    of = lambda kind, *columns: F.collect_list(F.when(F.col("_kind") == kind, F.struct(*columns)))
    own_id = lambda kind: F.when(F.col("_kind") == kind, F.col("_e.id"))
    there = F.col("_at").isNotNull() & (F.size("_parents") > 0)
    none = lambda met, name: F.array().cast(met.schema[name].dataType)
    fields = lambda e: [e[c].alias(c) for c in shown]
    as_row = lambda kind, up, e, items: F.struct(F.lit(kind).alias("_kind"), up.cast(rows.schema["_up"].dataType).alias("_up"), e.cast(rows.schema["_e"].dataType).alias("_e"), items.alias("_items"))

    # items under their clauses; sections, and items of no clause as one row, go on beside them
    met = rows.groupBy(key, F.coalesce(own_id("clause"), F.when(F.col("_kind") == "clause_item", F.col("_up"))).alias("_at"))
    met = met.agg(of("section", "_e").alias("_sections"), of("clause", "_up", "_e").alias("_parents"), F.sort_array(of("clause_item", "_e.*")).alias("_items"))
    no_items = none(met, "_items")
    onwards = [
        F.transform("_sections", lambda s: as_row("section", F.lit(None), s["_e"], no_items)),
        F.transform("_parents", lambda p: as_row("clause", p["_up"], p["_e"], F.when(there, F.col("_items")).otherwise(no_items))),
        F.filter(F.array(as_row("clause_item", F.lit(None), F.lit(None), F.col("_items"))), lambda _: ~there & (F.size("_items") > 0)),
    ]
    rows_on = met.select(key, F.inline(F.concat(*onwards)))
    # clauses under their sections
    met = rows_on.groupBy(key, F.coalesce(own_id("section"), F.when(F.col("_kind") == "clause", F.col("_up"))).alias("_at"))
    with_items = of("clause", *fields(F.col("_e")), F.col("_items").alias("items"))
    met = met.agg(of("section", "_e").alias("_parents"), F.sort_array(with_items).alias("_clauses"), F.flatten(F.collect_list(F.when(F.col("_kind") == "clause_item", F.col("_items")))).alias("items"))
    no_clauses = none(met, "_clauses")
    sections = F.transform("_parents", lambda p: F.struct(*fields(p["_e"]), F.when(there, F.col("_clauses")).otherwise(no_clauses).alias("clauses")))
    out = met.select(key, sections.alias("sections"), F.when(there, no_clauses).otherwise(F.col("_clauses")).alias("clauses"), "items")
    return out.groupBy(key).agg(*[F.sort_array(F.flatten(F.collect_list(n))).alias(n) for n in ("sections", "clauses", "items")])


def segments_text(segments: DataFrame, key: str, order: str = "order_index", text: str = "text") -> DataFrame:
    """``key, text``: a document's segments with blank lines between, for those that come as segments; null texts are empty."""
    each = F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("_t"))))
    return segments.groupBy(key).agg(F.array_join(F.transform(each, lambda r: r["_t"]), "\n\n").alias("text"))


def structure_text(flat: DataFrame, key: str) -> DataFrame:
    """``key, text``: nested documents, flattened, as text with headings, for those that come structured."""
    kind = tree.node_type(F.col("title"), F.col("content"), F.col("role"), F.col("region"))
    return tree.tree_text(flat.where(F.col("error").isNull()).withColumn("_kind", kind), key, "order_index", "_kind", "title", "content")
