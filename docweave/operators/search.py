"""Vector, keyword and hybrid search, and the roll-up of items to clauses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import dot
from docweave.operators.once import cut_lineage

BLOCK_ROWS = 2048
#: Parts that a table's blocks are dealt into; a query gets k rows of each.
PARTS = 16
#: Queries of a block whose scores are in memory at once, and blocks of queries a task keeps results of.
QUERIES_AT_ONCE, BLOCKS_HELD = 256, 8
#: Blocks of a cell's vectors that are one part.
PART_BLOCKS = 8


def _blocks(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``size, ids, m``: up to BLOCK_ROWS vectors of one length, their ids as an array, the vectors as one matrix of doubles."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                for at in range(0, len(own), BLOCK_ROWS):
                    part = own[at : at + BLOCK_ROWS]
                    matrix = flat[starts[part][:, None] + np.arange(size)]
                    ids = batch.column(0).take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids), pa.array([np.ascontiguousarray(matrix).tobytes()], pa.binary())], names=["size", "ids", "m"])

    kept = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(key, vector)
    return kept.mapInArrow(run, f"size int, ids array<{kind}>, m binary")


def _order(scores: np.ndarray) -> np.ndarray:
    """What scores are ordered by: one that is no number comes first, as it does in SQL."""
    return np.where(np.isnan(scores), np.inf, scores)


def _cell_blocks(rows: DataFrame, key: str, vector: str, ids: str, m: str, *more: str) -> DataFrame:
    """``cell, part, <ids>, <m>``: up to BLOCK_ROWS vectors of one cell's part, and arrays of other columns of doubles, named in the plural."""
    kind = dict(rows.dtypes)[key]

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = lambda c: pa.concat_arrays([p.column(c) for p in parts])
        listed = lambda c: pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), whole(c))
        size = sum(p.num_rows for p in parts)
        matrix = pa.array([whole(3).flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([parts[0].column(0)[:1], parts[0].column(1)[:1], listed(2), matrix, *[listed(4 + i) for i in range(len(more))]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        of, size = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in (0, 1)])
            edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(edges, edges[1:], strict=False):
                own = tuple(marks[:, begin].tolist())
                if held and own != of:
                    yield block(held)
                    held, size = [], 0
                of = own
                while begin < end:
                    took = min(end - begin, BLOCK_ROWS - size)
                    held.append(batch.slice(begin, took))
                    begin, size = begin + took, size + took
                    if size == BLOCK_ROWS:
                        yield block(held)
                        held, size = [], 0
        if held:
            yield block(held)

    names = ["cell", "part", ids, m, *[f"{c}s" for c in more]]
    sorted_ = rows.select("cell", "part", key, vector, *more).repartition("cell", "part").sortWithinPartitions("cell", "part")
    return sorted_.mapInArrow(run, f"cell int, part int, {ids} array<{kind}>, {m} binary{''.join(f', {c}s array<double>' for c in more)}")


class _Best:
    """The k best rows of every query of a block among those looked at so far, equals by id.

    Once a query has k of them, of the next blocks only rows that come before the last of these
    are kept.  floor: per query a score that k rows are known to reach.
    """

    def __init__(self, q_ids: pa.Array, left: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.q_ids, self.left, self.k = q_ids, left, k
        self.floor = np.full(len(q_ids), -np.inf) if floor is None else floor.copy()
        self.last: pa.Array | None = None  # the id of the k-th best, null where there is none yet
        self.at, self.scores, self.ids, self.waiting = [], [], [], 0

    def look(self, ids: pa.Array, right: np.ndarray) -> None:
        if self.last is not None:
            ranks = pc.rank(pa.concat_arrays([ids, self.last]), tiebreaker="dense").to_numpy()
            own, last = ranks[: len(ids)], ranks[len(ids) :]
        for at in range(0, len(self.left), QUERIES_AT_ONCE):
            scores = self.left[at : at + QUERIES_AT_ONCE] @ right.T
            floor = least = self.floor[at : at + QUERIES_AT_ONCE]
            if len(ids) > self.k and np.isneginf(floor).any():
                least = np.fmax(floor, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            # scores are rounded to six places: what is lower by less may round to the same
            asked, found = np.nonzero(~(scores < (least - 2e-6 - np.abs(least) * 1e-12)[:, None]))
            rounded = np.round(scores[asked, found], 6)
            by, floor = _order(rounded), floor[asked]
            kept = by >= floor if self.last is None else (by > floor) | ((by == floor) & (own[found] < last[at + asked]))
            self.at.append(at + asked[kept])
            self.scores.append(rounded[kept])
            self.ids.append(ids.take(pa.array(found[kept])))
            self.waiting += int(kept.sum())
        if self.last is None or self.waiting > self.k * len(self.q_ids):
            self.cut()

    def cut(self) -> None:
        at, scores, ids = np.concatenate(self.at), np.concatenate(self.scores), pa.concat_arrays(self.ids)
        order = np.lexsort((pc.rank(ids, tiebreaker="dense").to_numpy(), -_order(scores), at))
        place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        order, place = order[place < self.k], place[place < self.k]
        at, scores, ids = at[order], scores[order], ids.take(pa.array(order))
        ends = np.flatnonzero(place == self.k - 1)
        self.floor[at[ends]] = _order(scores[ends])
        which = np.full(len(self.q_ids), -1)
        which[at[ends]] = ends
        self.last = ids.take(pa.array(which, mask=which < 0))
        self.at, self.scores, self.ids, self.waiting = [at], [scores], [ids], 0

    def found(self, key: str) -> pa.RecordBatch:
        self.cut()
        return pa.RecordBatch.from_arrays([self.q_ids.take(pa.array(self.at[0])), self.ids[0], pa.array(self.scores[0])], names=["query_id", key, "score"])


def _best_of(batches: Iterator[pa.RecordBatch], k: int, key: str) -> Iterator[pa.RecordBatch]:
    """The k best rows per query among a task's pairs of blocks (``q, q_ids, q_m, ids, m`` and, where they are known, ``floors``), q: the number of the queries' block.

    A block of queries keeps its best from pair to pair, so it gives k rows for each query,
    however many blocks it meets.
    """
    held: dict[int, _Best] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            cell = {c: batch.column(c)[row] for c in batch.schema.names}
            matrix = lambda c, own: np.frombuffer(cell[c].as_buffer()).reshape(len(own), -1)  # noqa: E731, B023
            q, ids = cell["q"].as_py(), cell["ids"].values
            if q not in held:
                while len(held) >= BLOCKS_HELD:
                    yield held.pop(next(iter(held))).found(key)
                q_ids = cell["q_ids"].values
                floors = cell["floors"].values.to_numpy(zero_copy_only=False) if "floors" in cell else None
                held[q] = _Best(q_ids, matrix("q_m", q_ids).copy(), k, floors)
            held[q].look(ids, matrix("m", ids))
    for best in held.values():
        yield best.found(key)


def search_all(queries: DataFrame, table: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k best rows of ``table`` for every query, itself included: ``query_id, rank, key, score``.

    Both sides are cut into blocks of BLOCK_ROWS vectors; every pair of blocks is one
    matrix product.  The table's blocks are dealt into PARTS parts, and each part keeps k rows
    per query from pair to pair; the k best of those are the result.  So what is ranked grows
    with the queries only, and the pairs are shared among the tasks.
    Exact, and no task holds more than two blocks, what they found and a part of the table's.
    Ids are of any type that can be sorted; vectors are compared with those of their own length;
    null vectors, ids and elements aren't found and find nothing.
    """
    kind, asked = dict(table.dtypes)[key], max(4, queries.sparkSession.sparkContext.defaultParallelism // 4)
    # queries are few and far between: they meet in a few parts before they are cut into blocks
    left = _blocks(queries.select(key, vector).repartition(asked), key, vector).withColumn("q", F.monotonically_increasing_id())
    left = left.select("q", F.col("size").alias("q_size"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m")).repartition(asked)
    right = _blocks(table, key, vector).repartition(PARTS)
    # not as an equality: that would bring all blocks of a size to one task
    pairs = left.join(right, ~(F.col("q_size") < F.col("size")) & ~(F.col("q_size") > F.col("size"))).select("q", "q_ids", "q_m", "ids", "m")
    best = pairs.mapInArrow(lambda batches: _best_of(batches, k, key), f"query_id {dict(queries.dtypes)[key]}, `{key}` {kind}, score double")
    return _ranked(best, key, k)


def _ranked(hits: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class ClusteredIndex:
    """Vectors in cells around centres, searched exactly: a cell is read only if it can hold a hit.

    For a query q and a vector v = c + r of a cell with centre c, q v is at most q c + |q| R,
    R the cell's greatest |r|.  First every query reads its PROBES most promising cells; its
    k-th best score there is a floor.  Then it reads all others whose bound is no lower, and no
    more: whatever is left can't be among the k best.  If no bound is low enough that is every
    cell, and the search is that of ``search_all``.  What is read is read in blocks, a matrix
    product for each pair of a block of queries and one of the cell's vectors.

    Centres are k-means of a sample of at most SAMPLE vectors (a documented bound: centres only
    decide what is read, never what is found); every vector is indexed.  Cells are written as
    blocks of vectors, which searches join by cell.
    """

    SAMPLE, CELLS, PROBES = 20_000, 1024, 4

    def __init__(self, table: DataFrame, key: str, vector: str, cells: int | None = None, seed: int = 7):
        self.key, self.vector = key, vector
        rows = table.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, F.transform(vector, lambda x: x.cast("double")).alias("_v"))
        total = rows.count()
        self.cells = min(self.CELLS, max(1, cells or round(total**0.5 / 2)))
        share = min(1.0, self.SAMPLE / max(total, 1))
        some = np.array([r[0] for r in rows.select("_v").sample(share, seed).limit(self.SAMPLE).collect()] or [r[0] for r in rows.select("_v").limit(self.cells).collect()])
        centres = self.centres = self._means(some, self.cells, seed) if len(some) else np.zeros((1, 1))
        kind = dict(table.dtypes)[key]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lengths = (centres**2).sum(axis=1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cell = (lengths - 2 * own @ centres.T).argmin(axis=1)
                off = np.linalg.norm(own - centres[cell], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(off)], names=[key, "_v", "cell", "off"])

        placed = cut_lineage(rows.mapInArrow(place, f"`{key}` {kind}, _v array<double>, cell int, off double"))
        self.radii = {r["cell"]: (r["off"], r["n"]) for r in placed.groupBy("cell").agg(F.max("off").alias("off"), F.count("*").alias("n")).collect()}  # a row per cell
        # a cell of many vectors is several parts, so that no task reads all of it
        many = {c: -(-n // (PART_BLOCKS * BLOCK_ROWS)) for c, (_, n) in self.radii.items() if n > PART_BLOCKS * BLOCK_ROWS}
        parts = F.create_map(*[F.lit(x) for pair in sorted(many.items()) for x in pair])
        self.parts = F.coalesce(F.try_element_at(parts, F.col("cell")), F.lit(1)) if many else F.lit(1)
        dealt = placed.withColumn("part", F.pmod(F.xxhash64(key), self.parts).cast("int"))
        self.blocks = cut_lineage(_cell_blocks(dealt, key, "_v", "ids", "m"))

    @staticmethod
    def _means(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        centres = rows[rng.choice(len(rows), min(n, len(rows)), replace=False)].copy()
        for _ in range(8):
            cell = ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
            sums, sizes = np.zeros_like(centres), np.bincount(cell, minlength=len(centres))
            np.add.at(sums, cell, rows)
            centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
        return centres

    def _bounds(self, queries: DataFrame) -> DataFrame:
        """``query_id, cell, bound, turn, n``: all cells of a query and how many vectors they hold, the most promising first."""
        centres, radii = self.centres, self.radii
        held = np.array(sorted(radii), np.int32)
        far, sizes = (np.array([radii[c][i] for c in held.tolist()]) for i in (0, 1))
        kind = dict(queries.dtypes)[self.key]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    own = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    # scores are rounded to six places: what is lower by less may round to the same
                    bounds = own @ centres[held].T + np.linalg.norm(own, axis=1)[:, None] * far + 2e-6
                    order = np.argsort(-bounds, axis=1, kind="stable")
                    each = pa.array(np.repeat(np.arange(part.num_rows), len(held)))
                    turns = np.tile(np.arange(len(held), dtype=np.int32), part.num_rows)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(each), pa.array(held[order].ravel()), pa.array(np.take_along_axis(bounds, order, 1).ravel()), pa.array(turns), pa.array(sizes[order].ravel())], names=["query_id", "cell", "bound", "turn", "n"])

        asked = queries.where(F.col(self.vector).isNotNull()).select(self.key, F.transform(self.vector, lambda x: x.cast("double")).alias("_v"))
        return asked.mapInArrow(run, f"query_id {kind}, cell int, bound double, turn int, n bigint")

    def _read(self, asked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """The k best of the cells ``asked`` (query_id, cell, floor), per query and block of queries.

        The queries of a cell are cut into blocks as its vectors are; each pair of blocks is one
        matrix product that keeps k rows per query, none below its floor.
        """
        vectors = queries.where(F.col(self.vector).isNotNull()).select(F.col(self.key).alias("query_id"), F.transform(self.vector, lambda x: x.cast("double")).alias("_q"))
        each = asked.join(vectors, "query_id").withColumn("part", F.explode(F.sequence(F.lit(0), self.parts - 1)))
        left = _cell_blocks(each, "query_id", "_q", "q_ids", "q_m", "floor").withColumn("q", F.monotonically_increasing_id())
        pairs = left.join(self.blocks, ["cell", "part"]).select("q", "q_ids", "q_m", "floors", "ids", "m")
        key, kinds = self.key, (dict(queries.dtypes)[self.key], self.blocks.schema["ids"].dataType.elementType.simpleString())
        return pairs.mapInArrow(lambda batches: _best_of(batches, k, key), f"query_id {kinds[0]}, `{key}` {kinds[1]}, score double")

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """What ``search_all`` finds, and ``query_id, cells, share``: how many cells a query read, and what share of the vectors."""
        bounds = cut_lineage(self._bounds(queries))
        some = bounds.where(F.col("turn") < self.PROBES)
        first = cut_lineage(_ranked(self._read(some.withColumn("floor", F.lit(float("-inf"))), queries, k), self.key, k))
        floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        more = bounds.where(F.col("turn") >= self.PROBES).join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
        more = cut_lineage(more.select("query_id", "cell", "n", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))
        found = _ranked(first.drop("rank").unionByName(self._read(more, queries, k)), self.key, k)
        total = max(1, sum(n for _, n in self.radii.values()))
        read = some.select("query_id", "cell", "n").unionByName(more.drop("floor"))
        return found, read.groupBy("query_id").agg(F.count("*").alias("cells"), (F.sum("n") / total).alias("share"))


def unit_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Vectors of length one, so that inner products are cosines; a zero vector has none: null."""
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    return rows.withColumn("_norm", norm).withColumn(vector, F.when(F.col("_norm") > 0, F.transform(vector, lambda x: x.cast("double") / F.col("_norm")))).drop("_norm")


def semantic_search(queries: DataFrame, table: DataFrame, details: DataFrame, key: str, vector: str, k: int, columns: list[str], content: str | None = None) -> DataFrame:
    """The k best rows of ``table`` for every query with their ``columns`` of ``details``: ``query_id, rank, key, score, ...``.

    Filters are those of ``table``.  content: the text to bring along; only hits' rows are
    looked up, after the search.  Hits without details stay, with nulls.
    """
    kept = [*columns, *([content] if content else [])]
    return search_all(queries, table, key, vector, k).join(details.select(key, *kept), key, "left").select("query_id", "rank", key, "score", *kept)


def roll_up(hits: DataFrame, unit_type: str, clause: str, item: str, score: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Per clause its best hit's score and its items by score; items of clauses that weren't hit stand alone.

    ``clause, item, score, n_items, best_item`` (the first of equals): item is null for clauses.
    within: columns, such as the query's id, by which hits are taken apart.
    """
    by, kind = [*within, clause], hits.schema[item].dataType
    clauses = hits.where(F.col(unit_type) == "CLAUSE").groupBy(*by).agg(F.max(score).alias(score))
    items = hits.where(F.col(unit_type) == "CLAUSE_ITEM")
    under = items.groupBy(*by).agg(F.count("*").alias("n_items"), F.min_by(item, F.struct(-F.col(score), F.col(item))).alias("best_item"))
    whole = clauses.join(under, by, "left").select(*by, F.lit(None).cast(kind).alias(item), score, F.coalesce("n_items", F.lit(0)).alias("n_items"), "best_item")
    alone = items.join(clauses, by, "left_anti").select(*by, item, score, F.lit(0).cast("bigint").alias("n_items"), F.lit(None).cast(kind).alias("best_item"))
    return whole.unionByName(alone)


def nest_hits(hits: DataFrame, query: str = "query_id", rank: str = "rank", unit_type: str = "unit_type", clause: str = "clause", item: str = "item", score: str = "score") -> DataFrame:
    """Hits in their order to clauses with sub-items: ``query, place, unit_type, clause, item, score, sub_items``.

    A clause's best hit stands for it, the first of equals; it has the items that come after
    that hit, as an array of ``{rank, item, score}`` in order.  Items before a clause's first
    hit, or of clauses that aren't hit, stand alone, with no sub-items; items between a
    clause's first hit and a better one went with the hit that was replaced.  place: from 1, by
    score, then clauses as they were first met, then what stands alone.  Ids of any type; a
    null clause is a clause; hits of other kinds and without a rank are left out.
    """
    kind, own = F.col(unit_type), Window.partitionBy(query, clause)
    met = F.when(kind == "CLAUSE", F.col(rank))
    placed = hits.where(kind.isin("CLAUSE", "CLAUSE_ITEM") & F.col(rank).isNotNull()).select(query, rank, unit_type, clause, item, score)
    placed = placed.withColumn("_first", F.min(met).over(own)).withColumn("_best", F.min_by(rank, F.when(kind == "CLAUSE", F.struct(-F.coalesce(F.col(score), F.lit(0.0)), F.col(rank)))).over(own))
    heads = placed.where((kind == "CLAUSE") & (F.col(rank) == F.col("_best")))
    alone = placed.where((kind == "CLAUSE_ITEM") & (F.col("_first").isNull() | (F.col(rank) < F.col("_first"))))
    sub = placed.where((kind == "CLAUSE_ITEM") & (F.col(rank) > F.col("_best")))
    lists = sub.groupBy(F.col(query).alias("_q"), F.col(clause).alias("_c")).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(item).alias("item"), F.col(score).alias("score")))).alias("sub_items"))
    whole = heads.join(lists, F.col(query).eqNullSafe(F.col("_q")) & F.col(clause).eqNullSafe(F.col("_c")), "left").drop("_q", "_c")
    none = F.array().cast(lists.schema["sub_items"].dataType)
    every = whole.withColumn("sub_items", F.coalesce("sub_items", none)).unionByName(alone.withColumn("sub_items", none))
    order = Window.partitionBy(query).orderBy(F.desc_nulls_last(score), F.when(kind == "CLAUSE", 0).otherwise(1), F.coalesce(F.when(kind == "CLAUSE", F.col("_first")), F.col(rank)))
    return every.select(query, F.row_number().over(order).alias("place"), unit_type, clause, item, score, "sub_items")


def keyword_hits(tables: list[tuple[DataFrame, str, str, list[str]]], keyword: str, equals: dict[str, object] | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """``unit_type, id, relevance`` over several (table, unit_type, id, columns): 1 where the keyword is in, in any case.

    equals: values that columns such as region or doc_id must have; a table without the column
    has no hits.  With a limit, that many from ``skip`` on: tables in the order given, then ids.
    """
    out = None
    for i, (table, unit, key, columns) in enumerate(tables):
        any_of = F.lower(F.concat_ws("\n", *columns)).contains(keyword.lower())
        for c, v in (equals or {}).items():
            any_of = any_of & (F.col(c) == F.lit(v) if c in table.columns else F.lit(False))
        hits = table.where(any_of).select(F.lit(i).alias("_t"), F.lit(unit).alias("unit_type"), F.col(key).cast("bigint").alias("id"), F.lit(1.0).alias("relevance"))
        out = hits if out is None else out.unionByName(hits)
    return (out if limit is None else out.orderBy("_t", "id").offset(skip).limit(limit)).drop("_t")


def endpoint_hybrid(semantic: DataFrame, keyword: DataFrame, keys: list[str], limit: int, weights: tuple[float, float] = (0.7, 0.3), within: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``merge_hybrid`` as it is asked for: scores clamped to 0 to 1 on both sides, weights that add up to 1, the ``limit`` best of each query.

    Both sides are cut to twice the limit per query before they meet, as each was asked for so
    many; equals by key.  Adds ``rank``.
    """
    sides = []
    for hits in (semantic, keyword):
        w = Window.partitionBy(*within).orderBy(F.desc("score"), *keys)
        clamped = hits.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score").cast("double"))))
        sides.append(clamped.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2 * limit).drop("_r"))
    merged = merge_hybrid(*sides, keys, normalize_weights(*weights)[0])
    w = Window.partitionBy(*within).orderBy(F.desc("score"), *keys)
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def merge_hybrid(semantic: DataFrame, keyword: DataFrame, keys: list[str], weight: float = 0.7) -> DataFrame:
    """Full outer join of two results with ``score``: weighted sum and where it comes from."""
    s, w = semantic.select(*keys, F.col("score").alias("_s")), keyword.select(*keys, F.col("score").alias("_k"))
    both = s.join(w, keys, "full_outer")
    source = F.when(F.col("_s").isNull(), "keyword").when(F.col("_k").isNull(), "semantic").otherwise("both")
    total = F.coalesce("_s", F.lit(0.0)) * weight + F.coalesce("_k", F.lit(0.0)) * (1 - weight)
    return both.select(*keys, total.alias("score"), source.alias("source"))


def normalize_weights(semantic: float, keyword: float) -> tuple[float, float]:
    total = semantic + keyword
    return (semantic, keyword) if abs(total - 1) <= 0.01 else (semantic / total, keyword / total)


def context_of(hits: DataFrame, key: str, rank: str, title: str, content: str, most: int = 10) -> DataFrame:
    """The best ``most`` hits of each query as one text: 【title】content, blank lines between."""
    best = hits.where(F.col(rank) <= most)
    line = F.concat(F.lit("【"), F.coalesce(F.col(title), F.lit("")), F.lit("】"), F.coalesce(F.col(content), F.lit("")))
    return best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, line.alias("line")))), lambda r: r["line"]), "\n\n").alias("context"))


def vector_text(*parts: str) -> Column:
    """What is embedded of an item: its number, title and content, those that aren't empty, with spaces between."""
    return F.concat_ws(" ", *[F.nullif(F.col(p), F.lit("")) for p in parts])
