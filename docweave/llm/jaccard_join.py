"""N-gram Jaccard self-join, size-aware: small sets by subsets, large sets by inverted lists.

Documents whose sets of distinct five-word shingles have a Jaccard similarity of at least
``percent`` are linked; the result is every document's component.  The join is exact.

For sets of n and m shingles the similarity asks for an overlap of at least
o(n, m) = ceil(p (n + m) / (100 + p)).

* Light: a set of n up to the boundary lists its subsets of o(n, m) shingles for every m
  that can match.  Two sets that share such a subset are linked; nothing is verified.
* Heavy: other sets (and light ones near enough to the boundary to match one) put their
  first n - ceil(p n / 100) + 1 shingles, rarest first, into inverted lists.  Sets that
  are similar meet in at least one list; candidates are verified on their whole sets.

The boundary is chosen by cost: from the numbers of sets of each small size, the subsets
that would be listed against the list entries and candidates that would be made.

Groups of copies never make all pairs.  Equal sets are one node.  In a list, sets of a
size band are first compared with one of them, the pivot, every set with one or two of its
pivots, in a few rounds: first the set that shares most of its prefix, later members of the
list's largest component, another one each round.  Only sets of one list that are still in
different components are then compared with each other.  All pairs that could connect two
components are looked at, so the components are exact, though links inside a component
needn't be listed.

Before texts travel, pairs are held against their sketches: a bit per hash slot, set if an
odd number of a set's shingles fall there.  Every shingle that only one of two sets has
changes one bit, so sketches that differ in d bits prove at least d such shingles; similar
sets of n and m have at most (100 - p) (n + m) / (100 + p).  No similar pair is lost, and in
a group of near copies hardly any other pair is left.

"Rarest first" goes by how often a shingle's rarest word occurs in all documents; shingles
that several sets of one task share, such as those of a passage that many documents carry,
come behind all others.  Both are kept in tables of fixed size (hash slots: one byte for
words, one bit for shingles), which is what tasks are sent; what shares a slot only makes
the order less good, not the result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import FAN, collect_garbage, connected_components, discard, group_of, moduli, settle, tidily
from docweave.llm.shingles import Sets, mix, set_ids, shingle_sets, slots, word_hashes

WORDS = 5
SLOTS = 1 << 20
FREQUENT_SLOTS = 1 << 23
#: A shingle in so many sets of about GATHER shingles of one task counts as frequent.
FREQUENT, GATHER = 3, 4_000_000
BLOCK_TEXT = 4 << 20
BUCKET_TEXT = 16 << 20
#: Boundaries up to this are weighed; a set of 20 would list 10**4 subsets, so larger ones never cost least.
MOST_LIGHT = 20
#: Cost of verifying a candidate pair, in list entries.
VERIFY_COST = 30
PIVOT_ROUNDS = 2
PIVOT_GROUP = 60_000  # shingles of a pivot's candidates that one group verifies, about
SKETCH = 1024  # bits
FILTER_SLOTS = 1 << 20
SQUARE = 2000  # sets of a list that one task holds against as many others, about


def overlap(n: int, m: int, percent: int) -> int:
    """The least overlap at which sets of n and m have the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def partners(n: int, percent: int) -> range:
    """Sizes that a set of n can be similar to."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subsets_of(n: int, percent: int) -> int:
    return sum(math.comb(n, overlap(n, m, percent)) for m in partners(n, percent))


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """The size up to which sets are light: least total cost over the small sizes given."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= boundary:
                total += count * subsets_of(n, percent)
            if max(partners(n, percent)) > boundary:
                total += count * (prefix_length(n, percent) + VERIFY_COST)
        return total

    return min(range(MOST_LIGHT + 1), key=lambda b: (cost(b), b))


def _texts(column: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "replace").lower() for t in column]  # bytes.lower: A-Z only


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            yield batch.slice(at, 128)


def measure(docs: DataFrame, key: str, text: str) -> DataFrame:
    """On disk: a row per document (set_id, n), and per task the words' slots and counts and the frequent shingles' bits."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "set_id", "n", "slot", "words", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, frequent, key_type = np.zeros(SLOTS, np.int64), np.zeros(FREQUENT_SLOTS, bool), None
        gathered: list[np.ndarray] = []
        seen: set[int] = set()

        def find_frequent() -> None:
            if gathered:
                values = np.concatenate(gathered)
                gathered.clear()
                values.sort()
                hit = values[FREQUENT - 1 :] == values[: len(values) - FREQUENT + 1]
                frequent[slots(values[: len(hit)][hit], FREQUENT_SLOTS)] = True
            seen.clear()

        for few in _small(batches):
            texts = _texts(few.column(1))
            words, _ = word_hashes(texts)
            at, n = np.unique((words % np.uint64(SLOTS)).astype(np.int64), return_counts=True)
            counts[at] += n
            sets = shingle_sets(texts, WORDS)
            ids = set_ids(sets).astype(np.int64)
            for values, set_id in zip(sets, ids.tolist(), strict=True):
                if set_id not in seen:
                    seen.add(set_id)
                    gathered.append(values)
            if sum(map(len, gathered)) > GATHER:
                find_frequent()
            empty, key_type = pa.nulls(few.num_rows, pa.int64()), few.column(0).type
            yield pa.RecordBatch.from_arrays([few.column(0), pa.array(ids), pa.array(np.diff(sets.bounds)), empty.cast(pa.int32()), empty, empty], names=names)
        if key_type is None:
            return
        find_frequent()
        bits = np.packbits(frequent, bitorder="little").view("<i8")
        for values, column in ((counts, 4), (bits, 5)):
            held = np.flatnonzero(values)
            for part in np.array_split(held, max(1, len(held) // 50_000)):
                columns = [pa.nulls(len(part), key_type), *[pa.nulls(len(part), pa.int64())] * 2, pa.array(part.astype(np.int32)), *[pa.nulls(len(part), pa.int64())] * 2]
                columns[column] = pa.array(values[part].astype(np.int64))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return settle(docs.select(key, text).mapInArrow(tidily(run), f"`{key}` {kind}, set_id bigint, n bigint, slot int, words bigint, bits bigint"))


def word_levels(measured: DataFrame) -> np.ndarray:
    """One byte per slot: four steps for every doubling of the count.  Fixed size: SLOTS rows."""
    sums = measured.where("words is not null").groupBy("slot").agg(F.sum("words").alias("words")).toArrow()
    levels = np.zeros(SLOTS, np.uint8)
    levels[sums["slot"].to_numpy()] = np.minimum(127, np.floor(4 * np.log2(sums["words"].to_numpy() + 1)))
    return levels


def frequent_shingles(measured: DataFrame) -> np.ndarray:
    """One truth value per slot.  Fixed size: FREQUENT_SLOTS / 64 rows."""
    rows = measured.where("bits is not null").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FREQUENT_SLOTS // 64, "<i8")
    bits[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def _subset_keys(values: np.ndarray, percent: int, boundary: int) -> Iterator[tuple[int, bool]]:
    """(key, whether the set has the smaller of the two sizes) of every subset a light set lists."""
    n = len(values)
    for m in partners(n, percent):
        if m > boundary:
            continue
        low, high, size = min(n, m), max(n, m), overlap(n, m, percent)
        picks = np.array(list(combinations(range(n), size)), np.int64)
        chosen = mix(values)[picks]
        sums = chosen.sum(axis=1, dtype=np.uint64) + np.bitwise_xor.reduce(chosen, axis=1) * np.uint64(3)
        for k in mix(sums + np.uint64(low * 1000 + high)).astype(np.int64).tolist():
            yield k, n == low


def _planes(values: np.ndarray) -> bytes:
    """Numbers of 48 bits as zstandard over their byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view("<u8").ravel()


def _gaps(values: np.ndarray) -> np.ndarray:
    """Differences modulo 2**48, which undo a running sum."""
    return np.diff(values, prepend=np.uint64(0)) & np.uint64((1 << 48) - 1)


def _sums(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.uint64) & np.uint64((1 << 48) - 1)


def _sketches(sets: Sets) -> np.ndarray:
    """SKETCH / 64 numbers for each set."""
    own = np.repeat(np.arange(len(sets.bounds) - 1), np.diff(sets.bounds))
    held = np.bincount(own * SKETCH + (sets.values % np.uint64(SKETCH)).astype(np.int64), minlength=(len(sets.bounds) - 1) * SKETCH)
    return np.packbits((held & 1).astype(bool).reshape(-1, SKETCH), axis=1, bitorder="little").view("<i8")


def write_lists(docs: DataFrame, text: str, levels: np.ndarray, frequent: np.ndarray, percent: int, boundary: int) -> DataFrame:
    """On disk, per block of texts: the prefixes and sketches of its sets, and the subsets of its light sets.

    A prefix shingle is kept to its 48 leading bits, its level among them: others that
    begin alike only make candidates.
    """

    packed = np.packbits(frequent).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        schema = pa.schema([("block", pa.string()), ("kind", pa.string()), *[(c, pa.binary()) for c in "abc"]])
        kept: list[tuple[np.ndarray, int, int, bytes]] = []
        seen: set[int] = set()
        light: list[tuple[int, int, bool]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows, block = [], uuid.uuid4().hex
            if kept:
                prefixes, ids, sizes, sketches = zip(*kept, strict=True)
                keys, ids = np.concatenate(prefixes) >> np.uint64(16), np.array(ids, "<i8").tobytes()
                rows.append({"block": block, "kind": "prefixes", "a": _planes(_gaps(keys)), "b": ids, "c": np.array(sizes, "<u4").tobytes()})
                rows.append({"block": block, "kind": "sketches", "a": ids, "b": b"".join(sketches), "c": None})
            if light:
                k, i, s = zip(*light, strict=True)
                rows.append({"block": block, "kind": "light", "a": np.array(k, "<i8").tobytes(), "b": np.array(i, "<i8").tobytes(), "c": bytes(s)})
            for r in rows:
                yield pa.RecordBatch.from_pylist([r], schema=schema)
            kept.clear()
            light.clear()
            seen.clear()

        for few in _small(batches):
            texts = _texts(few.column(0))
            ids = set_ids(shingle_sets(texts, WORDS)).astype(np.int64)
            sets = shingle_sets(texts, WORDS, levels, marked)
            for values, set_id, sketch in zip(sets, ids.tolist(), _sketches(sets), strict=True):
                n = len(values)
                if not n or set_id in seen:  # equal sets are one node
                    continue
                seen.add(set_id)
                if n <= boundary:
                    light += [(k, set_id, small) for k, small in _subset_keys(values, percent, boundary)]
                if n > boundary or max(partners(n, percent)) > boundary:
                    kept.append((values[: prefix_length(n, percent)].copy(), set_id, n, sketch.tobytes()))
            size += sum(map(len, texts))
            if size >= BLOCK_TEXT or len(light) > 200_000:
                yield from flush()
                size = 0
        yield from flush()

    return settle(docs.select(text).mapInArrow(tidily(run), "block string, kind string, a binary, b binary, c binary"))


def is_early(place, n, percent: int):
    """Whether a set of n can share enough with one that is no smaller, if this place holds the first they share."""
    return (100 + percent) * (n - place) >= 2 * percent * n


def shared_entries(lists: DataFrame, percent: int, buckets: int) -> DataFrame:
    """On disk: the entries of lists with two sets or more, ``shingle, set_id, n, place, share``.

    share: how much of the set's prefix is in such lists, of 100.

    First the distinct shingles of the blocks are counted, by bucket; then every block gets
    its own shared ones back and lets the rest of its entries go.  Both sides are as large
    as a block; a list's length plays no part.  A block is dealt out into at most FAN
    buckets.  Where more are needed, groups of blocks are merged, and dealt out into finer
    ones, and what is shared comes back on the same way: rows grow with the blocks, not
    with blocks times buckets.
    A list in which no set is early (``is_early``) is not the first that two similar sets
    share, as the smaller one would be: it goes, too.
    """

    steps = moduli(buckets, FAN)

    def placed(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries of each set, place of each entry)."""
        lengths = sizes - -(-percent * sizes // 100) + 1  # prefix_length
        return lengths, np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def deal(keys: np.ndarray, often: np.ndarray, into: int) -> Iterator[tuple[int, bytes, bytes]]:
        of = (keys % np.uint64(into)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        keys, often, of = keys[order], often[order], of[order]
        first = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
        for i, j in zip(first, [*first[1:], len(of)], strict=True):
            yield int(of[i]), _planes(_gaps(keys[i:j])), often[i:j].tobytes()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("member", pa.string()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
        for batch in batches:
            for block, a, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                keys, sizes = _sums(_from_planes(a)), np.frombuffer(c, "<u4").astype(np.int64)
                lengths, places = placed(sizes)
                early = is_early(places, np.repeat(sizes, lengths), percent)
                order = np.argsort(keys, kind="stable")
                keys, early = keys[order], early[order]
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                often = np.minimum(np.diff(first, append=len(keys)), 2).astype(np.uint8)  # 1 or 2: sets; 4: one is early
                often |= np.logical_or.reduceat(early, first).astype(np.uint8) << 2
                rows = [{"member": block, "bucket": k, "a": x, "b": y} for k, x, y in deal(keys[first], often, steps[0])]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def merged(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Each row's shingles, and the distinct ones of all with how often they are held."""
        own = [_sums(_from_planes(a)) for a in t["a"].to_pylist()]
        keys = np.concatenate(own)
        often = np.concatenate([np.frombuffer(b, np.uint8) for b in t["b"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, often = keys[order], often[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sets = np.minimum(np.add.reduceat((often & 3).astype(np.int64), first), 2).astype(np.uint8)
        return own, keys[first], sets | (np.maximum.reduceat(often, first) & 4)

    def only(own: list[np.ndarray], shared: np.ndarray) -> pa.Array:
        return pa.array([_planes(_gaps(x[np.isin(x, shared, assume_unique=True)])) for x in own], pa.binary())

    def into(finer: int):
        def run(t: pa.Table) -> pa.Table:
            bucket, a, b = zip(*deal(*merged(t)[1:], finer), strict=True)
            return pa.table({"member": pa.array([t["up"][0].as_py()] * len(a), pa.string()), "bucket": pa.array(bucket, pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

        return run

    def count(t: pa.Table) -> pa.Table:
        own, keys, often = merged(t)
        return pa.table({"member": t["member"], "bucket": t["bucket"], "a": only(own, keys[often == 6])})  # two sets, one early

    def hand_down(mine: pa.Table, known: pa.Table) -> pa.Table:
        shared = np.concatenate([_sums(_from_planes(a)) for a in known["a"].to_pylist()])
        return pa.table({"member": mine["member"], "bucket": mine["bucket"], "a": only([_sums(_from_planes(a)) for a in mine["a"].to_pylist()], shared)})

    def pick(entries: pa.Table, shared: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([np.array([], np.uint64), *[_sums(_from_planes(a)) for a in shared["a"].to_pylist()]]))
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for a, b, c in zip(*(entries[x].to_pylist() for x in "abc"), strict=True):
            own, ids, sizes = _sums(_from_planes(a)), np.frombuffer(b, "<i8"), np.frombuffer(c, "<u4").astype(np.int64)
            lengths, places = placed(sizes)
            hit = np.zeros(len(own), bool)
            if len(keys):
                hit = keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own
            share = 100 * np.add.reduceat(hit, np.cumsum(lengths) - lengths, dtype=np.int64) // lengths
            for column, v in zip(columns, (own.astype(np.int64), np.repeat(ids, lengths), *[x.astype(np.int32) for x in (np.repeat(sizes, lengths), places, np.repeat(share, lengths))]), strict=True):
                column.append(v[hit])
        return pa.table({name: np.concatenate(v) for name, v in zip(("shingle", "set_id", "n", "place", "share"), columns, strict=True)})

    entries = lists.where("kind = 'prefixes'").select("block", "a", "b", "c")
    rows = entries.select("block", "a", "c").mapInArrow(spread, "member string, bucket int, a binary, b binary")
    members, levels = None, []
    for i, (size, finer) in enumerate(zip(steps, steps[1:], strict=False)):
        members = entries.count() if members is None else members
        members = max(1, math.ceil(members * size / finer))
        rows, up = settle(rows), group_of("member", i, members).alias("up")
        levels.append((rows, size, up))
        rows = rows.select("*", up).groupBy("up", "bucket").applyInArrow(into(finer), "member string, bucket int, a binary, b binary")
    found = rows.select("member", "bucket", "a", "b").groupBy("bucket").applyInArrow(count, "member string, bucket int, a binary")
    for level, size, up in reversed(levels):
        known = found.select(F.col("member").alias("up"), F.pmod("bucket", F.lit(size)).alias("coarse"), "a").groupBy("up", "coarse")
        mine = level.select("member", "bucket", "a", up).groupBy("up", "bucket")
        found = mine.cogroup(known).applyInArrow(hand_down, "member string, bucket int, a binary")
    shared = found.select("member", "a").groupBy("member")
    picked = settle(entries.groupBy("block").cogroup(shared).applyInArrow(pick, "shingle bigint, set_id bigint, n int, place int, share int"))
    discard(*[level for level, _, _ in levels])
    return picked


def light_links(lists: DataFrame) -> DataFrame:
    """``a, b``: each set that shares a subset with a set of the smaller size, linked to that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, "<i8")), pa.array(np.frombuffer(b, "<i8")), pa.array(np.frombuffer(c, np.uint8) > 0)], names=["subset", "set_id", "low"])

    rows = lists.where("kind = 'light'").select("a", "b", "c").mapInArrow(run, "subset bigint, set_id bigint, low boolean")
    pivots = rows.groupBy("subset").agg(F.min(F.when(F.col("low"), F.col("set_id"))).alias("pivot"), F.max("set_id").alias("most"), F.min("set_id").alias("least"))
    pivots = pivots.where("pivot is not null and least <> most").select("subset", "pivot")
    return rows.join(pivots, "subset").where("set_id <> pivot").select(F.col("set_id").alias("a"), F.col("pivot").alias("b")).distinct()


def sketch_table(lists: DataFrame) -> DataFrame:
    """``set_id, sketch`` (an array of SKETCH / 64 numbers); sets that several blocks hold have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sketches = pa.FixedSizeListArray.from_arrays(pa.array(np.frombuffer(b, "<i8")), SKETCH // 64).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, "<i8")), sketches], names=["set_id", "sketch"])

    return lists.where("kind = 'sketches'").select("a", "b").mapInArrow(run, "set_id bigint, sketch array<bigint>")


def _sketch_bits() -> Column:
    """In how many bits the sketches of a and b differ."""
    return sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH // 64)), F.lit(0))


def _near_sketches(percent: int) -> Column:
    """Whether sets a and b, of n_a and n_b, can be similar by their sketches."""
    return (100 + percent) * _sketch_bits() <= (100 - percent) * (F.col("n_a") + F.col("n_b"))


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, key: str, text: str, percent: int, words: int = WORDS) -> DataFrame:
    """The pairs ``a, b`` (n_a: a's size) whose whole sets, of ``words`` words a shingle, are similar.  nodes: a document for every set id.

    a's text goes to b, in groups of about PIVOT_GROUP shingles; b's own text goes to each.
    Only pivots with more than one group are looked up, few enough that no pivot's pairs
    need to meet for it.
    Texts travel compressed, and most that no pair asks for stay behind: a bit per hash slot
    of the wanted documents goes along with the scan.
    """
    groups = pairs.groupBy("b").agg(F.ceil(F.sum("n_a") / PIVOT_GROUP).cast("int").alias("groups"))
    mine = pairs.join(groups.where("groups > 1"), "b", "left").select(
        F.col("a").alias("set_id"), F.col("b").alias("pivot"), F.coalesce(F.pmod(F.xxhash64("a"), F.col("groups")), F.lit(0)).cast("int").alias("g"), F.lit(False).alias("is_pivot")
    )
    own = groups.select(F.col("b").alias("set_id"), F.col("b").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(True).alias("is_pivot"))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_SLOTS)).cast("int")
    wanted = settle(mine.unionByName(own).join(nodes.select("set_id", "_doc"), "set_id"))
    bits = np.zeros(FILTER_SLOTS, bool)
    bits[wanted.select(slot("_doc").alias("slot")).distinct().toArrow()["slot"].to_numpy()] = True  # FILTER_SLOTS rows at most
    packed = np.packbits(bits).tobytes()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        asked, zstd = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            batch = batch.filter(pa.array(asked[batch.column(2).to_numpy()]))
            for few in _small([batch]):
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array([zstd.compress(t) for t in _texts(few.column(1))], pa.binary())], names=["_doc", "body"])

    def run(t: pa.Table) -> pa.Table:
        import zstandard

        zstd = zstandard.ZstdDecompressor()
        sets = shingle_sets([zstd.decompress(x) for x in t["body"].to_pylist()], words)
        right = set_ids(sets).astype(np.int64) == t["set_id"].to_numpy()  # ids of documents may repeat
        pivots = np.flatnonzero(right & t["is_pivot"].to_numpy())
        similar = np.zeros(t.num_rows, bool)
        if len(pivots):
            base = sets.values[sets.bounds[pivots[0]] : sets.bounds[pivots[0] + 1]]
            at = np.minimum(np.searchsorted(base, sets.values), len(base) - 1)
            both = np.concatenate(([0], np.cumsum(base[at] == sets.values)))
            inter = both[sets.bounds[1:]] - both[sets.bounds[:-1]]
            union = np.diff(sets.bounds) + len(base) - inter
            similar = right & ~t["is_pivot"].to_numpy() & (100 * inter >= percent * union)
        return t.select(["set_id", "pivot"]).filter(pa.array(similar)).rename_columns(["a", "b"])

    kind = docs.schema[key].dataType.simpleString()
    bodies = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_doc"), F.col(text).alias("text"), slot(key).alias("slot")).mapInArrow(tidily(send), f"_doc {kind}, body binary")
    rows = bodies.join(wanted, "_doc").select("set_id", "pivot", "g", "is_pivot", "body")
    return rows.groupBy("pivot", "g").applyInArrow(run, "a bigint, b bigint")


def _first_shared(percent: int) -> Column:
    """Whether a list can be the first that two similar sets share: sizes fit, and enough is behind the places.

    Similar sets pass in their first common list; that they fail in later ones does no harm.
    """
    need = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    behind = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (behind >= need)


def find_links(docs: DataFrame, measured: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """``a, b`` of set ids: links enough to connect every component."""
    sizes = measured.where("slot is null")
    # duplicates count once: of equal sets one document stands for all
    nodes = settle(sizes.where("n > 0").groupBy("set_id").agg(F.min(key).alias("_doc"), F.min("n").alias("n")))
    small = {r["n"]: r["count"] for r in nodes.where(F.col("n") <= 2 * MOST_LIGHT).groupBy("n").count().collect()}  # a row per small size
    boundary = choose_boundary(small, percent)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    lists = write_lists(docs, text, word_levels(measured), frequent_shingles(measured), percent, boundary)
    entries = shared_entries(lists, percent, math.ceil(total / BUCKET_TEXT) + 6)

    links, sketches = settle(light_links(lists)), sketch_table(lists)
    own, couples, large = split_lists(entries, percent)
    discard(entries)
    collect_garbage(docs)
    done = [lists, own, large, nodes]  # what nothing reads once all links are on disk
    tried, labelled = None, large.withColumns({"component": F.col("set_id"), "members": F.lit(1)})
    for k in range(PIVOT_ROUNDS):
        pairs = _pivot_pairs(labelled, percent, k)
        pairs = pairs.unionByName(couples) if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        near = settle(_with_sketches(pairs, sketches).where(_near_sketches(percent)).select("a", "b", "n_a", "couple", _sketch_bits().alias("bits")))
        # of the pivots that it can be similar to, a set tries the nearest by their sketches and another one
        best = near.where("not couple").groupBy("a").agg(F.min(F.struct("bits", "b"))["b"].alias("one"), F.min_by("b", F.xxhash64("b")).alias("two"), F.first("n_a").alias("n_a"))
        stars = best.select("a", F.explode(F.array_distinct(F.array("one", "two"))).alias("b"), "n_a")
        stars = settle(stars.unionByName(near.where("couple").select("a", "b", "n_a")).distinct())
        found = verify(stars, docs, nodes, key, text, percent)
        done += [links, near, stars, labelled]
        links, tried = settle(links.unionByName(found)), stars.select("a", "b") if tried is None else tried.unionByName(stars.select("a", "b"))
        labelled = settle(_open_lists(labelled, connected_components(links)))

    # what is left: sets of one list in different components
    left = labelled.select("set_id").distinct()
    known = sketches.join(left, "set_id", "left_semi").dropDuplicates(["set_id"])
    across = across_lists(labelled, known, _first_shared(percent) & _near_sketches(percent))
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = settle(across.join(tried, ["a", "b"], "left_anti"))
    every = settle(links.unionByName(verify(across, docs, nodes, key, text, percent)))
    discard(*done, links, labelled, across)
    collect_garbage(docs)
    return every


def across_lists(open_lists: DataFrame, sketches: DataFrame, meets: Column) -> DataFrame:
    """``a, b, n_a``, a < b: pairs of sets of one list (``shingle``) and different components that ``meets`` lets pass.

    In a list every set outside its largest component is held against every set, in squares of
    about SQUARE by SQUARE sets, so that no task gets a long list whole; inside the largest
    component nothing is.  sketches: one of each set (``set_id, sketch``), which its entries get
    once their square is known.  ``meets``: over columns with the suffixes _a and _b.
    """
    parts = open_lists.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    sizes = parts.groupBy("shingle").agg(F.sum("size").alias("all"), F.max(F.struct("size", "component")).alias("large"))
    sides = lambda c: F.ceil(c / SQUARE).cast("int")
    sizes = sizes.select("shingle", F.col("large.component").alias("large"), sides(F.col("all") - F.col("large.size")).alias("rows"), sides(F.col("all")).alias("columns"))
    placed = open_lists.join(sizes, "shingle")
    columns = ("set_id", "n", "place", "component")
    own = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "set_id"), F.greatest(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    few = placed.where("component <> large").select("shingle", own(F.col("rows"), 1).alias("i"), every(F.col("columns")).alias("j"), *columns)
    all_ = placed.where("rows > 0").select("shingle", every(F.col("rows")).alias("i"), own(F.col("columns"), 2).alias("j"), *columns)
    a, b = (side.join(sketches, "set_id").select("shingle", "i", "j", *[F.col(c).alias(f"{c}_{name}") for c in (*columns, "sketch")]) for side, name in ((few, "a"), (all_, "b")))
    pairs = a.join(b, ["shingle", "i", "j"]).where((F.col("component_a") != F.col("component_b")) & meets)
    least, most = F.least("set_id_a", "set_id_b"), F.greatest("set_id_a", "set_id_b")
    return pairs.select(least.alias("a"), most.alias("b"), F.when(least == F.col("set_id_a"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a")).distinct()


def _with_sketches(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``pairs`` with ``sketch_a, sketch_b``."""
    ids = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    known = settle(sketches.join(ids, "set_id", "left_semi").dropDuplicates(["set_id"]))
    for side in "ab":
        pairs = pairs.join(known.select(F.col("set_id").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
    return pairs


def split_lists(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The entries, each once (on disk), ``a, b, n_a, n_b, couple`` of lists with two sets, and the entries of larger ones (on disk).

    Most lists hold two sets: they are done with their one pair and take no part in what follows.
    """
    own = settle(entries.groupBy("shingle", "set_id").agg(*[F.first(c).alias(c) for c in ("n", "place", "share")]))
    ends = F.struct("set_id", "n", "place")
    lists = own.groupBy("shingle").agg(F.count("*").alias("sets"), F.min(ends).alias("x"), F.max(ends).alias("y"))
    couples = lists.where("sets = 2").select(*[F.col(f"{p}.{c}").alias(f"{c}_{q}") for p, q in ("xa", "yb") for c in ("set_id", "n", "place")])
    couples = couples.where(_first_shared(percent)).select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"), "n_a", "n_b", F.lit(True).alias("couple")).distinct()
    return own, couples, settle(own.join(lists.where("sets > 2").select("shingle"), "shingle", "left_semi"))


def _open_lists(entries: DataFrame, found: DataFrame) -> DataFrame:
    """The entries of lists with sets of several components, with ``component`` and its ``members``."""
    entries, members = entries.drop("component", "members"), found.groupBy("component").agg(F.count("*").cast("int").alias("members"))
    named = found.join(members, "component").withColumnRenamed("id", "set_id")
    labelled = entries.join(named, "set_id", "left").withColumns({"component": F.coalesce("component", "set_id"), "members": F.coalesce("members", F.lit(1))})
    mixed = labelled.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("shingle")
    return labelled.join(mixed, "shingle", "left_semi")


def _pivot_pairs(labelled: DataFrame, percent: int, k: int) -> DataFrame:
    """``a, b, n_a, n_b, couple`` (false): sets and the pivots of their lists that they could be similar to, in other components.

    A list's pivot, per size band, is a set that comes early enough in its own order: in the
    first round (k = 0) one that shares most of its prefix, then one of the list's largest
    component and one of all sets by turns, another one each round.
    """
    band = F.floor(F.log(F.col("n") + 0.0) / math.log(100 / percent)).cast("int")
    turn = F.xxhash64(F.lit(k), "set_id")
    rank = F.struct("share", turn) if k == 0 else F.struct("members", turn) if k % 2 else turn
    banded = labelled.withColumn("band", band)
    columns = ("set_id", "n", "place", "component")
    pivots = banded.where(is_early(F.col("place"), F.col("n"), percent)).groupBy("shingle", "band").agg(F.max_by(F.struct(*columns), rank).alias("p"))
    pivots = pivots.select("shingle", "band", *[F.col(f"p.{c}").alias(f"{c}_b") for c in columns])
    near = banded.select("shingle", "band", *[F.col(c).alias(f"{c}_a") for c in columns])
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = near.join(pivots, ["shingle", "band"]).where((F.col("component_a") != F.col("component_b")) & (_first_shared(percent) if k == 0 else fits))
    return pairs.select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"), "n_a", "n_b", F.lit(False).alias("couple")).distinct()


def name_components(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``key, n_shingles, component_id`` of ``rows`` (key, set_id, n): found has the component of set ids that are linked."""
    least = rows.where("n > 0").groupBy("set_id").agg(F.min(key).alias("first"))
    labelled = least.join(found.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("smallest"))
    named = settle(labelled.join(smallest, "component").select("set_id", "smallest"))
    return rows.join(named, "set_id", "left").select(
        key, F.col("n").alias("n_shingles"), F.when(F.col(key).isNull(), F.lit(None)).otherwise(F.coalesce("smallest", key)).alias("component_id")
    )


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``key, n_shingles, component_id`` of every row.

    component_id: the smallest key reachable over links, its own included.  A null, empty
    or blank text has no shingles and no links; equal sets are linked; repeated rows get
    a row each; a row with a null key links nothing and has no component; rows that share
    a key are compared each; texts of any length are read whole; an empty table gives no
    rows; other columns are ignored.
    """
    docs = docs.select(key, text)
    measured = measure(docs, key, text)
    rows = measured.where("slot is null").select(key, "set_id", "n")
    found = connected_components(find_links(docs, measured, key, text, percent))
    return name_components(rows, found, key)
