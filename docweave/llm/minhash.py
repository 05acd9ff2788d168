"""Near duplicates by an inverted join over the coordinates of MinHash signatures.

Every distinct shingle set has a signature of COORDINATES minima.  A set is posted under each
(coordinate, value) pair; sets with at least ``matches`` pairs in common are held against each
other, and those whose whole sets have the similarity are linked.

* Prefix: a value that no other set has can't match.  Of a set's other values only the rarest
  are looked up, as many as are left of COORDINATES - matches + 1 after the values it has
  alone; any set with ``matches`` of its values has one of those.
* Skip: the longer lists are never merged.  Collisions there are counted from the two
  signatures, for candidates only.

Groups of copies never make all pairs: as in ``jaccard_join``, equal sets are one node, lists
are first compared with pivots, and then only across components.  Sketches, which lose no
similar pair, decide whose texts are read.

MATCHES = 36 of 64: two sets at exactly 0.8 are missed with odds of about 2 in a million (a
binomial's tail), at 0.85 of 1 in a thousand million; a component has more links than one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import collect_garbage, connected_components, discard, settle, tidily
from docweave.llm.jaccard_join import SKETCH, _near_sketches, _open_lists, _sketch_bits, _sketches, _small, _texts, across_lists, name_components, verify
from docweave.llm.shingles import set_ids, shingle_sets

WORDS = 4
COORDINATES, MATCHES = 64, 36
ROUNDS = 3
#: Shingles whose minima are taken at once, so that they stay in the processor's cache.
CHUNK = 1 << 15

_random = np.random.Generator(np.random.PCG64(12))
FACTORS = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The minima of sets ``values[bounds[i]:bounds[i + 1]]``, none of them empty: a row of uint32 per set."""
    out = np.full((len(bounds) - 1, COORDINATES), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(values), CHUNK):
        part = values[at : at + CHUNK]
        first, last = np.searchsorted(bounds, at, "right") - 1, np.searchsorted(bounds, at + len(part), "left")
        starts = np.maximum(bounds[first:last] - at, 0)
        for k in range(COORDINATES):
            hashes = ((part * FACTORS[k] + OFFSETS[k]) >> np.uint64(32)).astype(np.uint32)
            out[first:last, k] = np.minimum(out[first:last, k], np.minimum.reduceat(hashes, starts))
    return out


def measure(docs: DataFrame, key: str, text: str) -> DataFrame:
    """On disk, a row per document: ``key, set_id, n``, and once per task and set ``signature`` and ``sketch``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for few in _small(batches):
            sets = shingle_sets(_texts(few.column(1)), WORDS)
            ids, sizes = set_ids(sets).astype(np.int64), np.diff(sets.bounds)
            new = np.zeros(len(ids), bool)
            for i, (set_id, n) in enumerate(zip(ids.tolist(), sizes.tolist(), strict=True)):
                if n and set_id not in seen:
                    seen.add(set_id)
                    new[i] = True
            held = np.flatnonzero(sizes)
            made = signatures(sets.values, np.concatenate((sets.bounds[:-1][held], sets.bounds[-1:]))) if len(held) else None
            signed: list[bytes | None] = [None] * len(ids)
            for i, row in zip(held.tolist(), made if made is not None else (), strict=True):
                signed[i] = row.tobytes() if new[i] else None
            sketched = [row.tolist() if fresh else None for row, fresh in zip(_sketches(sets), new.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([few.column(0), pa.array(ids), pa.array(sizes), pa.array(signed, pa.binary()), pa.array(sketched, pa.list_(pa.int64()))], names=[key, "set_id", "n", "signature", "sketch"])

    return settle(docs.select(key, text).mapInArrow(tidily(run), f"`{key}` {kind}, set_id bigint, n bigint, signature binary, sketch array<bigint>"))


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per coordinate: the pair of coordinate and value as one number."""
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
        posts = (np.arange(COORDINATES, dtype=np.int64) << 32) + values.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(posts.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), COORDINATES))], names=["post", "set_id"])


def prefixes(signed: DataFrame, matches: int) -> DataFrame:
    """On disk: ``shingle, set_id, n, place`` of the lists that sets are looked up in, and that hold two sets or more.

    (A list's column is named as in ``jaccard_join``.)
    """
    posts = signed.select("set_id", "signature").mapInArrow(_post, "post bigint, set_id bigint")
    lists = posts.groupBy("post").agg(F.count("*").alias("length")).where("length > 1")
    own = posts.join(lists, "post").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("length", "post"))).alias("posts"))  # COORDINATES at most
    looked_up = F.slice("posts", 1, F.lit(COORDINATES - matches + 1) - (COORDINATES - F.size("posts")))
    own = own.where(F.size("posts") >= matches).select("set_id", F.posexplode(looked_up).alias("place", "entry"))
    entries = settle(own.select(F.col("entry.post").alias("shingle"), "set_id", "place").join(signed.select("set_id", F.col("n").cast("int").alias("n")), "set_id"))
    shared = entries.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1").select("shingle")
    kept = settle(entries.join(shared, "shingle", "left_semi"))
    discard(entries)
    return kept


def collide(pairs: DataFrame, signed: DataFrame, percent: int, matches: int) -> DataFrame:
    """``a, b, n_a, bits`` of the pairs ``a, b`` with ``matches`` collisions or more whose sketches let them be similar."""
    known = signed.join(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "set_id", "left_semi")
    for side in "ab":
        pairs = pairs.join(known.select(F.col("set_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "signature", "sketch")]), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[f"signature_{s}"].to_pylist()), np.uint32).reshape(-1, COORDINATES) for s in "ab")
            yield batch.select(["a", "b", "n_a", "bits"]).filter(pa.array((x == y).sum(axis=1) >= matches))

    near = pairs.where(_near_sketches(percent)).select("a", "b", "n_a", _sketch_bits().alias("bits"), "signature_a", "signature_b")
    return near.mapInArrow(run, "a bigint, b bigint, n_a bigint, bits int")


def _pivot_pairs(labelled: DataFrame, k: int) -> DataFrame:
    """``a, b``: the sets of a list and its pivot, where they are of different components; another pivot each round."""
    turn = F.xxhash64(F.lit(k), "set_id")
    rank = F.struct("members", turn) if k % 2 else turn
    pivots = labelled.groupBy("shingle").agg(F.max_by(F.struct("set_id", "component"), rank).alias("p"))
    both = labelled.join(pivots, "shingle").where(F.col("component") != F.col("p.component"))
    return both.select(F.col("set_id").alias("a"), F.col("p.set_id").alias("b")).distinct()


def find_links(docs: DataFrame, measured: DataFrame, key: str, text: str, percent: int, matches: int) -> DataFrame:
    """``a, b`` of set ids: links enough to connect every component."""
    rows = measured.where(F.col("n") > 0)
    nodes = settle(rows.where(F.col(key).isNotNull()).groupBy("set_id").agg(F.min(key).alias("_doc")))
    signed = settle(rows.where("signature is not null").select("set_id", "n", "signature", "sketch").dropDuplicates(["set_id"]))
    entries = prefixes(signed, matches)
    links, tried, done = None, None, [nodes, signed, entries]
    labelled = entries.withColumns({"component": F.col("set_id"), "members": F.lit(1)})
    for k in range(ROUNDS):
        pairs = _pivot_pairs(labelled, k)
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        near = settle(collide(pairs, signed, percent, matches))
        # of the pivots that it can be similar to, a set tries the nearest by their sketches and another one
        best = near.groupBy("a").agg(F.min(F.struct("bits", "b"))["b"].alias("one"), F.min_by("b", F.xxhash64("b")).alias("two"), F.first("n_a").alias("n_a"))
        stars = settle(best.select("a", F.explode(F.array_distinct(F.array("one", "two"))).alias("b"), "n_a"))
        found = verify(stars, docs, nodes, key, text, percent, WORDS)
        done += [links, near, stars, labelled]
        links = settle(found if links is None else links.unionByName(found))
        tried = stars.select("a", "b") if tried is None else tried.unionByName(stars.select("a", "b"))
        labelled = settle(_open_lists(labelled, connected_components(links)))

    # what is left: sets of one list in different components
    known = signed.select("set_id", "sketch").join(labelled.select("set_id").distinct(), "set_id", "left_semi")
    across = across_lists(labelled, known, _near_sketches(percent)).select("a", "b")
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = settle(collide(across.join(tried, ["a", "b"], "left_anti"), signed, percent, matches))
    every = settle(links.unionByName(verify(across, docs, nodes, key, text, percent, WORDS)))
    discard(*done, links, labelled, across)  # nothing reads them once all links are on disk
    collect_garbage(docs)
    return every


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, matches: int = MATCHES) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row.

    component_id: the smallest key reachable over links, its own included; kept: whether that
    is the row's own.  Words are lower-cased by A-Z; a set holds the distinct shingles of
    WORDS words, or the whole sequence of fewer.  A null, empty or blank text has no shingles
    and no links; equal sets are linked; repeated rows get a row each; a row with a null key
    links nothing, has no component and is kept; texts of any length are read whole; an empty
    table gives no rows; other columns are ignored.
    """
    docs = docs.select(key, text)
    measured = measure(docs, key, text)
    found = connected_components(find_links(docs, measured, key, text, percent, matches))
    named = name_components(measured.select(key, "set_id", "n"), found, key)
    return named.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
