"""Language-model scoring by context-tree weighting over bytes.

A byte is coded as eight binary decisions.  Each decision (a node of the byte's binary
tree) has a context tree over the preceding bytes: with a and b the zeros and ones seen in
a context, Krichevsky-Trofimov's estimate of them is

    P_kt(a, b) = G(a + 1/2) G(b + 1/2) / (pi G(a + b + 1)),   G: the gamma function,

and a context's weighted probability mixes its own estimate with its children's,

    P_w = 1/2 P_kt + 1/2 prod(P_w of the contexts one byte longer),   P_w = P_kt at full depth.

So all depths are mixed, with weights that follow from the counts.  A text is scored by the
predictive form of the same mixture: going down its context from depth 0, depth d gets the
share w_d = 1/2 P_kt / P_w of what the shorter contexts left over.

How it runs:

1. One pass cuts the rows into blocks of text and writes them, with the block's distinct
   (context, byte) pairs and words, and how often training rows hold them.  All else works
   on these, so no text is shuffled until the end.
2. Pairs are summed over blocks, by bucket.  A block is dealt out into at most FAN buckets;
   where the corpus needs more, that many blocks are merged, and the merged rows dealt out
   into finer buckets, as often as it takes.  So the rows are at most FAN a block and step,
   and twice the corpus makes twice the rows, not four times.  The trees grow bottom-up and
   the mixture goes top-down: deep levels in groups of whole subtrees, the upper levels as
   DataFrame steps.
3. Every block gets back the code lengths of its own pairs, and only those, on the way the
   pairs came, and scores its texts.  A task holds a block and its slice of the model, never
   the model.  Code lengths travel as 32-bit floats; sums over a text are 64-bit.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import FAN, group_of, moduli, settle

DEPTH = 5  # bytes of context: with the byte itself 48 bits of a 64-bit number
END = b"\xff"  # ends every text; no UTF-8 text holds this byte
NEAR = 3  # contexts up to this long are grouped by Spark, longer ones within groups
BLOCK_BYTES = 16 << 20
STEP_BYTES = 1 << 20
LN2, LN_PI = math.log(2), math.log(math.pi)


def _compress(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _compress_all(parts: list[bytes]) -> bytes:
    import zstandard

    z = zstandard.ZstdCompressor(level=1).compressobj(size=sum(map(len, parts)))
    return b"".join([*map(z.compress, parts), z.flush()])


def _decompress(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted numbers: zstandard over the byte planes of their differences."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return _compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pair_keys(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(key, part) of every byte of the parts, each given with the DEPTH bytes before it.

    key: the byte in the lowest eight bits, above it the context, the nearest byte lowest.
    """
    joined = np.frombuffer(b"".join(before + body for before, body in parts), np.uint8)
    keys = joined.astype(np.uint64)
    for i in range(1, DEPTH + 1):
        keys[i:] |= joined[:-i].astype(np.uint64) << np.uint64(8 * i)
    sizes = np.array([len(body) for _, body in parts])
    own = np.ones(len(joined), bool)
    starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    own[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return keys[own], np.repeat(np.arange(len(parts), dtype=np.uint64), sizes)


def _steps(texts: Iterable[bytes]) -> Iterator[tuple[list[int], list[tuple[bytes, bytes]]]]:
    """Texts as parts of at most STEP_BYTES together, long ones cut: (text numbers, parts)."""
    numbers, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), STEP_BYTES):
            body = text[at : at + STEP_BYTES]
            before = text[max(0, at - DEPTH) : at].rjust(DEPTH, b"\0")
            if parts and (size + len(body) > STEP_BYTES or len(parts) == 1 << 16):
                yield numbers, parts
                numbers, parts, size = [], [], 0
            numbers.append(i)
            parts.append((before, body))
            size += len(body)
    if parts:
        yield numbers, parts


def _merge(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def count_pairs(texts: list[bytes], learn: list[bool], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all texts and their ends, sorted, and how often the texts to learn from hold them."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for wanted in (True, False):
        for _, parts in _steps(t + end for t, x in zip(texts, learn, strict=True) if x == wanted):
            keys, _ = pair_keys(parts)
            keys.sort()
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            counts = np.diff(first, append=len(keys)) if wanted else np.zeros(len(first), np.int64)
            kept.append((keys[first], counts.astype(np.int64)))
            if len(kept) == 8:
                kept = [_merge(kept)]
    return _merge(kept) if kept else (np.array([], np.uint64), np.array([], np.int64))


class Pairs:
    """Rows of (context, byte) keys, sorted, and a number for each."""

    kind, values = "pairs", "<f4"
    merge = staticmethod(_merge)

    @staticmethod
    def keys(a: bytes) -> np.ndarray:
        return _unpack_sorted(a)

    @staticmethod
    def deal(keys: np.ndarray, counts: np.ndarray, buckets: int, width: str) -> Iterator[tuple[int, bytes, bytes]]:
        of = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        keys, counts, of = keys[order], counts[order], of[order]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(of)], strict=True):
            yield int(of[i]), _pack_sorted(keys[i:j]), _compress(counts[i:j].astype(width).tobytes())

    @staticmethod
    def lookup(known: list[tuple[np.ndarray, np.ndarray]]):
        keys, values = (np.concatenate(x) for x in zip(*known, strict=True))
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        return lambda wanted: values[np.searchsorted(keys, wanted)]


class Words:
    """Rows of words and a number for each."""

    kind, values = "words", "<i8"

    @staticmethod
    def keys(a: bytes) -> list[bytes]:
        return _decompress(a).split(b" ")

    @staticmethod
    def merge(kept: list[tuple[list[bytes], np.ndarray]]) -> tuple[list[bytes], np.ndarray]:
        total: dict[bytes, int] = {}
        for words, counts in kept:
            for w, n in zip(words, counts.tolist(), strict=True):
                total[w] = total.get(w, 0) + n
        return list(total), np.array(list(total.values()), np.int64)

    @staticmethod
    def deal(words: list[bytes], counts: np.ndarray, buckets: int, width: str) -> Iterator[tuple[int, bytes, bytes]]:
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(_word_bucket(w, buckets), []).append(i)
        for bucket, mine in by.items():
            yield bucket, _compress(b" ".join([words[i] for i in mine])), _compress(counts[mine].astype(width).tobytes())

    @staticmethod
    def lookup(known: list[tuple[list[bytes], np.ndarray]]):
        of = {w: n for words, values in known for w, n in zip(words, values.tolist(), strict=True)}
        return lambda wanted: np.array([of[w] for w in wanted], np.int64)


def write_blocks(docs: DataFrame, key: str, text: str, learn: Column, buckets: int) -> DataFrame:
    """On disk, rows of three kinds: a block's texts; its pairs and its words by bucket."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"block string, kind string, bucket int, ids array<{kind}>, sizes binary, learn binary, a binary, b binary"

    def rows(block: str, ids: list, texts: list[bytes], learns: list[bool]) -> Iterator[dict]:
        sizes = np.array([len(t) for t in texts], "<i8").tobytes()
        yield {"block": block, "kind": "text", "bucket": -1, "ids": ids, "sizes": sizes, "learn": bytes(learns), "a": _compress_all(texts), "b": None}
        for bucket, keys, counts in Pairs.deal(*count_pairs(texts, learns, END), buckets, "<u4"):
            yield {"block": block, "kind": "pairs", "bucket": bucket, "a": keys, "b": counts}
        words: Counter = Counter()
        for t, x in zip(texts, learns, strict=True):
            words.update(t.split()) if x else words.update(dict.fromkeys(t.split(), 0))
        for bucket, ws, counts in Words.deal(list(words), np.array(list(words.values()), np.int64), buckets, "<u4"):
            yield {"block": block, "kind": "words", "bucket": bucket, "a": ws, "b": counts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        ids, texts, learns, size = [], [], [], 0
        for batch in batches:
            out = out or pa.schema([("block", pa.string()), ("kind", pa.string()), ("bucket", pa.int32()), ("ids", pa.list_(batch.schema.field(0).type)), *[(n, pa.binary()) for n in ("sizes", "learn", "a", "b")]])
            for i, t, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t.as_py().encode("utf-8", "replace").lower())  # bytes.lower: A-Z only
                learns.append(x)
                size += len(texts[-1]) + 1
                if size >= BLOCK_BYTES:
                    for r in rows(uuid.uuid4().hex, ids, texts, learns):
                        yield pa.RecordBatch.from_pylist([r], schema=out)
                    ids, texts, learns, size = [], [], [], 0
        if ids:
            for r in rows(uuid.uuid4().hex, ids, texts, learns):
                yield pa.RecordBatch.from_pylist([r], schema=out)

    plain = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"))
    return settle(plain.mapInArrow(run, schema))


def _word_bucket(word: bytes, buckets: int) -> int:
    import zlib

    return zlib.crc32(word) % buckets


# -- the trees ---------------------------------------------------------------------------


def ln_gamma(x):
    """ln of the gamma function for x >= 1/2, of a Column or an array: Stirling's series at x + 7, and the recurrence."""
    ln = F.ln if isinstance(x, Column) else np.log
    z = x + 7
    series = (z - 0.5) * ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = x
    for i in range(1, 7):
        product = product * (x + i)
    return series - ln(product)


def ln_kt(a, b):
    """ln P_kt(a, b) of Columns or arrays of doubles."""
    return ln_gamma(a + 0.5) + ln_gamma(b + 0.5) - ln_gamma(a + b + 1) - LN_PI


@dataclass
class Level:
    """Nodes at one depth, sorted by id: the context, and in the lowest eight bits the node of the byte's tree."""

    ids: np.ndarray
    a: np.ndarray
    b: np.ndarray
    own: np.ndarray  # ln P_kt
    all: np.ndarray  # ln P_w

    def ones(self) -> np.ndarray:
        return (self.b + 0.5) / (self.a + self.b + 1)

    def share(self) -> np.ndarray:
        return np.exp(self.own - self.all - LN2)


def _grouped(ids: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return [ids[first], *[np.add.reduceat(c[order], first) for c in columns]]


def nodes_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, bit) of the eight decisions of every key, eight rows."""
    byte = keys & np.uint64(255)
    steps = np.arange(8, dtype=np.uint64)[:, None]
    node = (np.uint64(1) << steps) | (byte >> (np.uint64(8) - steps))
    return (keys & ~np.uint64(255)) | node, (byte >> (np.uint64(7) - steps)) & np.uint64(1)


def deep_levels(keys: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels DEPTH down to NEAR, from keys that share the nearest NEAR bytes or none."""
    ids, bits = nodes_of(keys)
    counts = np.broadcast_to(n.astype(np.float64), ids.shape)
    found, a, b = _grouped(ids.ravel(), np.where(bits == 0, counts, 0).ravel(), np.where(bits == 1, counts, 0).ravel())
    own = ln_kt(a, b)
    levels = [Level(found, a, b, own, own)]
    for depth in range(DEPTH - 1, NEAR - 1, -1):
        last = levels[-1]
        found, a, b, below = _grouped(last.ids & np.uint64((1 << 8 * depth + 8) - 1), last.a, last.b, last.all)
        own = ln_kt(a, b)
        levels.append(Level(found, a, b, own, np.logaddexp(own, below) - LN2))
    return levels


def code_lengths(pairs: DataFrame, groups: int) -> DataFrame:
    """``key, log10p`` of every (context, byte) key, from ``key, n``: its training count, 0 included.

    The deep levels are worked out in groups of keys whose nearest NEAR bytes of context are
    alike, so that a group holds whole subtrees: at most 2**24 keys for each such context.
    The NEAR upper levels are a few rows per short context and plain DataFrame steps.
    """
    near = (1 << 8 * NEAR) - 1
    pairs = pairs.select("key", "n", F.pmod(F.shiftright("key", 8).bitwiseAND(near), F.lit(groups)).cast("int").alias("part"))

    def grow(t: pa.Table) -> pa.Table:
        top = deep_levels(t["key"].to_numpy().astype(np.uint64), t["n"].to_numpy())[-1]
        return pa.table({"id": top.ids.astype(np.int64), "a": top.a, "b": top.b, "own": top.own, "all": top.all})

    level = settle(pairs.groupBy("part").applyInArrow(grow, "id bigint, a double, b double, own double, all double"))
    levels = [level]
    for depth in range(NEAR - 1, -1, -1):
        shorter = F.col("id").bitwiseAND(F.lit((1 << 8 * depth + 8) - 1))
        level = level.groupBy(shorter.alias("id")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("all").alias("below"))
        level = level.withColumn("own", ln_kt(F.col("a"), F.col("b")))
        high, low = F.greatest("own", "below"), F.least("own", "below")
        level = settle(level.withColumn("all", high + F.log1p(F.exp(low - high)) - LN2).drop("below"))
        levels.append(level)
    # from the root: one = probability of a one so far, rest = share left to longer contexts
    above = None
    for depth, level in enumerate(reversed(levels)):
        share = F.exp(F.col("own") - F.col("all") - LN2)
        level = level.select("id", ((F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)).alias("p1"), share.alias("w"))
        if above is None:
            above = level.select("id", (F.col("w") * F.col("p1")).alias("one"), (1 - F.col("w")).alias("rest"))
            continue
        shorter = F.col("id").bitwiseAND(F.lit((1 << 8 * depth) - 1))
        up = above.select(F.col("id").alias("short"), F.col("one").alias("up_one"), F.col("rest").alias("up_rest"))
        above = level.withColumn("short", shorter).join(up, "short").select(
            "id", (F.col("up_one") + F.col("up_rest") * F.col("w") * F.col("p1")).alias("one"), (F.col("up_rest") * (1 - F.col("w"))).alias("rest")
        )
    above = above.withColumn("top_part", F.pmod(F.shiftright("id", 8), F.lit(groups)).cast("int"))

    def finish(mine: pa.Table, top: pa.Table) -> pa.Table:
        keys = mine["key"].to_numpy().astype(np.uint64)
        ids = top["id"].to_numpy().astype(np.uint64)
        order = np.argsort(ids)
        ids, one, rest = ids[order], top["one"].to_numpy()[order], top["rest"].to_numpy()[order]
        for depth, level in zip(range(NEAR + 1, DEPTH + 1), reversed(deep_levels(keys, mine["n"].to_numpy())[:-1]), strict=True):
            up = np.searchsorted(ids, level.ids & np.uint64((1 << 8 * depth) - 1))
            share = level.share() if depth < DEPTH else np.ones(len(level.ids))
            ids, one, rest = level.ids, one[up] + rest[up] * share * level.ones(), rest[up] * (1 - share)
        nodes, bits = nodes_of(keys)
        p = one[np.searchsorted(ids, nodes)]
        return pa.table({"key": mine["key"], "log10p": np.log10(np.where(bits == 1, p, 1 - p)).sum(axis=0)})

    return pairs.groupBy("part").cogroup(above.groupBy("top_part")).applyInArrow(finish, "key bigint, log10p double")


# -- sums over blocks, and back ------------------------------------------------------------


def _merged(rows_of: type[Pairs] | type[Words], width: str, buckets: int):
    """The function that merges the members of a group and bucket and deals them out into finer ones."""

    def run(t: pa.Table) -> pa.Table:
        kept = [(rows_of.keys(a), np.frombuffer(_decompress(b), width).astype(np.int64)) for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True)]
        bucket, a, b = zip(*rows_of.deal(*rows_of.merge(kept), buckets, "<i8"), strict=True)
        return pa.table({"member": pa.array([t["up"][0].as_py()] * len(a), pa.string()), "bucket": pa.array(bucket, pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def steps_up(blocks: DataFrame, rows_of: type[Pairs] | type[Words], buckets: list[int]) -> list[DataFrame]:
    """Per step of ``buckets`` the rows ``member, bucket, a, b, up``: members are blocks, then merged groups of members.

    up: the group that a member is merged into.  A group has about as many members as it is
    dealt out into, so it holds no more than a block does.
    """
    rows = blocks.where(F.col("kind") == rows_of.kind).select(F.col("block").alias("member"), "bucket", "a", "b")
    members, out = None, []
    for i, (size, finer) in enumerate(zip(buckets, buckets[1:], strict=False)):
        members = blocks.where("kind = 'text'").count() if members is None else members
        members = max(1, math.ceil(members * size / finer))
        rows = rows.withColumn("up", group_of("member", i, members))
        out.append(rows)
        merged = _merged(rows_of, "<u4" if i == 0 else "<i8", finer)
        rows = settle(rows.groupBy("up", "bucket").applyInArrow(merged, "member string, bucket int, a binary, b binary"))
    return [*out, rows]


def sum_pairs(rows: DataFrame, width: str) -> DataFrame:
    """``key, n`` over the rows of the last step; a group is one bucket, of which there are more the more text there is."""

    def run(t: pa.Table) -> pa.Table:
        kept = [(_unpack_sorted(a), np.frombuffer(_decompress(b), width).astype(np.int64)) for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True)]
        keys, counts = _merge(kept)
        return pa.table({"key": keys.astype(np.int64), "n": counts})

    return rows.select("bucket", "a", "b").groupBy("bucket").applyInArrow(run, "key bigint, n bigint")


def sum_words(rows: DataFrame, width: str) -> DataFrame:
    """Per member and bucket of the last step its words and their counts over all; the bucket's totals on its first row."""

    def run(t: pa.Table) -> pa.Table:
        lists = [Words.keys(a) for a in t["a"].to_pylist()]
        words, counts = Words.merge([(ws, np.frombuffer(_decompress(b), width)) for ws, b in zip(lists, t["b"].to_pylist(), strict=True)])
        total = dict(zip(words, counts.tolist(), strict=True))
        n_rows = len(lists)
        return pa.table(
            {
                "member": t["member"], "bucket": t["bucket"], "a": t["a"],
                "b": pa.array([_compress(np.array([total[w] for w in ws], "<i8").tobytes()) for ws in lists], pa.binary()),
                "n": pa.array([sum(total.values()), *[0] * (n_rows - 1)], pa.int64()),
                "v": pa.array([sum(n > 0 for n in total.values()), *[0] * (n_rows - 1)], pa.int64()),
            }
        )

    grouped = rows.select("member", "bucket", "a", "b").groupBy("bucket")
    return settle(grouped.applyInArrow(run, "member string, bucket int, a binary, b binary, n bigint, v bigint"))


def lengths_by_member(rows: DataFrame, lengths: DataFrame, buckets: int) -> DataFrame:
    """Per member and bucket of the last step its pairs and their log10p."""

    def run(mine: pa.Table, model: pa.Table) -> pa.Table:
        find = Pairs.lookup([(model["key"].to_numpy().astype(np.uint64), model["log10p"].to_numpy())])
        found = [_compress(find(_unpack_sorted(a)).astype("<f4").tobytes()) for a in mine["a"].to_pylist()]
        return pa.table({"member": mine["member"], "bucket": mine["bucket"], "a": mine["a"], "b": pa.array(found, pa.binary())})

    left = rows.select("member", "bucket", "a").groupBy("bucket")
    right = lengths.select("key", "log10p", F.pmod("key", F.lit(buckets)).cast("int").alias("bucket")).groupBy("bucket")
    return left.cogroup(right).applyInArrow(run, "member string, bucket int, a binary, b binary")


def steps_down(steps: list[DataFrame], rows_of: type[Pairs] | type[Words], buckets: list[int], found: DataFrame) -> DataFrame:
    """``block, kind, a, b``: what the last step's members ``found``, handed down to the members that they were merged from."""

    def run(mine: pa.Table, known: pa.Table) -> pa.Table:
        find = rows_of.lookup([(rows_of.keys(a), np.frombuffer(_decompress(b), rows_of.values)) for a, b in zip(known["a"].to_pylist(), known["b"].to_pylist(), strict=True)])
        values = [_compress(find(rows_of.keys(a)).astype(rows_of.values).tobytes()) for a in mine["a"].to_pylist()]
        return pa.table({"member": mine["member"], "bucket": mine["bucket"], "a": mine["a"], "b": pa.array(values, pa.binary())})

    for rows, size in zip(reversed(steps[:-1]), reversed(buckets[:-1]), strict=True):
        found = settle(found)
        left = rows.select("member", "bucket", "a", "up").groupBy("up", "bucket")
        right = found.select(F.col("member").alias("up"), F.pmod("bucket", F.lit(size)).alias("coarse"), "a", "b").groupBy("up", "coarse")
        found = left.cogroup(right).applyInArrow(run, "member string, bucket int, a binary, b binary")
    return found.select(F.col("member").alias("block"), F.lit(rows_of.kind).alias("kind"), "a", "b")


def _score_texts(texts: Iterable[bytes], n: int, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.zeros(n)
    for numbers, parts in _steps(texts):
        found, part = pair_keys(parts)
        packed = (found << np.uint64(16)) | part  # 48 bits and at most 2**16 parts
        packed.sort()
        found = packed >> np.uint64(16)
        first = np.concatenate(([True], found[1:] != found[:-1]))
        value = values[np.searchsorted(keys, found[first])][np.cumsum(first) - 1]
        sums = np.bincount((packed & np.uint64(0xFFFF)).astype(np.int64), weights=value, minlength=len(parts))
        np.add.at(total, np.array(numbers), sums)
    return total


def score_texts(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", fan: int = FAN) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte`` of every row.

    learn: the rows to learn from; null counts as true.  fan: buckets that a block is dealt
    out into at most (odd); the rows don't depend on it but for the last digits.  score: log10 of the model's
    probability of the text, A-Z lower-cased, and its end; bits_per_byte: the code length
    of the same over its bytes and end.  base_score: the add-one unigram's.
    A null text is empty (one token: the end); texts of any length are read whole; repeated
    rows each count and get a row; with nothing to learn from every bit costs one bit; an
    empty table gives no rows; other columns are ignored.
    """
    size = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).alias("n"), F.sum(F.when(F.coalesce(learn, F.lit(True)), 1).otherwise(0)).alias("ends")).first()
    buckets = moduli(2 * math.ceil((size["n"] or 0) / BLOCK_BYTES) + 7, fan)  # odd
    width = "<u4" if len(buckets) == 1 else "<i8"
    ends = size["ends"] or 0
    blocks = write_blocks(docs, key, text, learn, buckets[0])
    by_words, by_pairs = (steps_up(blocks, rows_of, buckets) for rows_of in (Words, Pairs))
    words = sum_words(by_words[-1], width)
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    train, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    pairs = settle(sum_pairs(by_pairs[-1], width))
    lengths = lengths_by_member(by_pairs[-1], code_lengths(pairs, buckets[-1]), buckets[-1])
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double"

    def score(mine: pa.Table, model: pa.Table) -> pa.Table:
        scale = math.log10(train + distinct + 1)
        keys, values, costs, unknown = [np.array([], np.uint64)], [np.array([], "<f4")], {}, set()
        for kind_of, a, b in zip(model["kind"], model["a"], model["b"], strict=True):
            if kind_of.as_py() == "pairs":
                keys.append(_unpack_sorted(a.as_py()))
                values.append(np.frombuffer(_decompress(b.as_py()), "<f4"))
            else:
                own, counts = _decompress(a.as_py()).split(b" "), np.frombuffer(_decompress(b.as_py()), "<i8")
                costs.update(zip(own, (np.log10(counts + 1.0) - scale).tolist(), strict=True))
                unknown.update(own[k] for k in np.flatnonzero(counts == 0).tolist())
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        del order
        end_cost, end_known = math.log10(ends + 1) - scale, int(ends > 0)
        out: list[pa.Table] = []
        for row in mine.to_pylist():
            raw, sizes = memoryview(_decompress(row["a"])), np.frombuffer(row["sizes"], "<i8")
            stops = np.cumsum(sizes)
            spans = list(zip((stops - sizes).tolist(), stops.tolist(), strict=True))
            scores = _score_texts((bytes(raw[i:j]) + END for i, j in spans), len(spans), keys, values)
            counted = []
            for i, j in spans:
                ws = bytes(raw[i:j]).split()
                counted.append((len(ws) + 1, len(ws) - sum(map(unknown.__contains__, ws)) + end_known, math.fsum(map(costs.__getitem__, ws)) + end_cost))
            n_tokens, n_known, base = zip(*counted, strict=True)
            n_bytes = sizes + 1
            out.append(
                pa.table(
                    {
                        key: pa.array(row["ids"], mine.schema.field("ids").type.value_type), "held_out": pa.array([not x for x in row["learn"]]),
                        "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                        "train_tokens": pa.array([train] * len(spans), pa.int64()), "base_score": pa.array(base, pa.float64()),
                        "score": scores, "n_bytes": pa.array(sizes, pa.int64()), "bits_per_byte": -scores / math.log10(2) / n_bytes,
                    }
                )
            )
        return pa.concat_tables(out)

    model = steps_down(by_pairs, Pairs, buckets, lengths).unionByName(steps_down(by_words, Words, buckets, words.select("member", "bucket", "a", "b")))
    texts = blocks.where("kind = 'text'").select("block", "ids", "sizes", "learn", "a")
    return texts.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(score, schema)


def held_out(key: Column) -> Column:
    """The query's fold: crc32 of the id's text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 7 == 2, F.lit(False))
