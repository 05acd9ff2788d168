"""Benchmark decontamination by latent semantic retrieval.

1. Vocabulary and counts: the words of the benchmark, and those that a share of all
   documents holds, which bounds their number; documents are counted over all of them.
2. Latent space: a randomised singular value decomposition of the TF-IDF passages of all
   documents, whole, and of the benchmark, distributed: every task multiplies its passages,
   only matrices of vocabulary times rank meet.  One pass is enough, by the Nystroem form
   for positive semidefinite matrices (Tropp, Yurtsever, Udell and Cevher, 2017); three
   quarters of the test matrix are the benchmark's own leading directions, the others are
   random.  Benchmark passages weigh as much as all others together, so that the space tells
   them apart.  A space of RANK directions holds GROUP items; more items are fitted in groups,
   each with a space of its own, so what is found doesn't depend on how many there are.
3. Search: windows of every document, at three lengths, are projected and compared by
   cosine with what the space keeps of each benchmark item.  Places with RUN words of an
   item in a row are found by their hashes, too, so that copies don't depend on the rank.
4. Check: for what passes, the longest common subsequence of words between the item and
   the text around the window must hold enough of the item, and its answer (the last
   sentence) must be there too.  So paraphrases that keep most words in order are found,
   and texts on the same matter are left alone.

What tasks are sent is bounded by the vocabulary's share and the benchmark, whose size is
checked.  Step 1 writes the words of every batch of documents as places in the batch's own
list of words; the other steps read those instead of texts, without a shuffle of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby, product

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import collect_garbage, discard, settle, tidily
from docweave.llm.shingles import ROLL, mix, word_hashes

#: Words that a smaller share of the documents holds all weigh like one at this share; only
#: the benchmark's have a latent vector.  So weights don't depend on how many documents there are.
SHARE = 1 / 500
FIT_TASKS = 256  # at most, each of which hands on one matrix
RANK, EXTRA = 128, 8
PASSAGE, STRIDE = 64, 32
#: Words in a block; windows are runs of 2, 4, 8, ... blocks, every half of their length.
BLOCK = 8
SEGMENT = 1 << 14  # words of a text that are looked at together
MAX_ITEMS = 20_000
#: Items that share a latent space: twice its rank, so that it can tell them apart.
GROUP = 256
TABLE = 1 << 20
COUNTED = 1 << 21  # words that a task counts before it hands them on
TOGETHER = 32  # passages that are multiplied together
ITEMS_TOGETHER = 512  # items that windows are compared with together
HELD = 1 << 18  # words around places found that are looked up together
KEPT = 512  # words of an item whose bits are kept for the next place
RUN = 8  # words of an item that make a place worth a check by themselves
PART = 1024  # rows of a matrix that are summed together


@dataclass(frozen=True)
class Thresholds:
    cosine: float = 0.3
    #: Share of the item's words in the longest common subsequence, and of its answer's words.
    subsequence: float = 0.6
    answer: float = 0.5


@dataclass
class Space:
    """Words of the vocabulary (sorted hashes), inverse document frequencies, and their latent vectors."""

    words: np.ndarray
    idf: np.ndarray
    unknown_idf: float
    vectors: np.ndarray
    slots: np.ndarray = field(init=False)
    weighted: np.ndarray = field(init=False)  # vectors times idf, and zeros behind them for words without one

    def __post_init__(self) -> None:
        self.slots = slot_table(self.words)
        self.weighted = np.vstack([self.vectors * self.idf[:, None], np.zeros((1, self.vectors.shape[1]), np.float32)])

    def index(self, hashes: np.ndarray) -> np.ndarray:
        return lookup(self.words, self.slots, hashes)

    def cosine(self, places: np.ndarray, query: np.ndarray) -> float:
        norm = np.sqrt((np.where(places >= 0, self.idf[places], self.unknown_idf) ** 2).sum())
        return float(self.weighted[places].sum(axis=0) @ query / max(1e-9, norm))


def slot_table(words: np.ndarray) -> np.ndarray:
    """First word of each slot, by the leading 20 bits of sorted hashes."""
    return np.searchsorted(words >> np.uint64(44), np.arange(TABLE + 1, dtype=np.uint64)).astype(np.int32)


def lookup(words: np.ndarray, slots: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in ``words``, -1 where it isn't there."""
    top = (hashes >> np.uint64(44)).astype(np.int64)
    at, end = slots[top], slots[top + 1]
    found = np.full(len(hashes), -1, np.int32)
    rest = np.flatnonzero(at < end)
    while len(rest):  # slots hold one word, rarely more
        hit = words[at[rest]] == hashes[rest]
        found[rest[hit]] = at[rest[hit]]
        rest = rest[~hit]
        at[rest] += 1
        rest = rest[at[rest] < end[rest]]
    return found


#: ASCII marks count as spaces, so that a passage is found whatever its punctuation.
MARKS = bytes(32 if 33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127 else c for c in range(256))


def normalized(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").translate(MARKS)


def lowered(column: pa.Array) -> list[bytes]:
    return [normalized(t.as_py()) for t in column]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def _merged(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, sorted, with their counts summed."""
    word, count = np.concatenate(words), np.concatenate(counts)
    order = np.argsort(word, kind="stable")
    word, count = word[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    return word[first], np.add.reduceat(count, first)


def encode(docs: DataFrame, key: str, text: str) -> DataFrame:
    """On disk: a row per batch of texts (``keys``, ``bounds`` of each text's words, the batch's sorted ``words``, the ``places`` of its words among them), and rows of ``word, docs``: a word's number of documents in a task."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, size = [], [], 0
        for few in _small(batches):
            hashes, bounds = word_hashes(lowered(few.column(1)))
            order = np.argsort(hashes, kind="stable")  # a word's documents stay in order
            word, owner = hashes[order], np.repeat(np.arange(few.num_rows), np.diff(bounds))[order]
            other = word[1:] != word[:-1]
            first = np.concatenate((np.ones(min(1, len(word)), bool), other))
            new = np.concatenate((np.ones(min(1, len(word)), bool), other | (owner[1:] != owner[:-1])))
            place = np.empty(len(word), np.int64)
            place[order] = np.cumsum(first) - 1
            own = word[first]
            places = place.astype("<u2" if len(own) <= 1 << 16 else "<u4")
            yield _row(few.column(0), bounds.astype("<i8").tobytes(), own.astype("<u8").tobytes(), places.tobytes(), few.schema.field(0).type)
            if not len(own):
                continue
            words.append(own)
            counts.append(np.add.reduceat(new.astype(np.int64), np.flatnonzero(first)))
            size += len(own)
            if size > COUNTED:
                word, count = _merged(words, counts)
                words, counts, size = [word], [count], len(word)
                if size > COUNTED // 2:
                    yield from _counted(word, count, few.schema.field(0).type)
                    words, counts, size = [], [], 0
        if words:
            yield from _counted(*_merged(words, counts), few.schema.field(0).type)

    return settle(docs.select(key, text).mapInArrow(tidily(run), f"keys array<{kind.simpleString()}>, bounds binary, words binary, places binary, word bigint, docs bigint"))


def _row(keys: pa.Array, bounds: bytes, words: bytes, places: bytes, kind: pa.DataType) -> pa.RecordBatch:
    listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
    columns = [listed.cast(pa.list_(kind)), *[pa.array([x], pa.binary()) for x in (bounds, words, places)], pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["keys", "bounds", "words", "places", "word", "docs"])


def _counted(word: np.ndarray, count: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(word), 50_000):
        own, n = word[at : at + 50_000].astype(np.int64), count[at : at + 50_000].astype(np.int64)
        columns = [pa.nulls(len(own), pa.list_(kind)), *[pa.nulls(len(own), pa.binary())] * 3, pa.array(own), pa.array(n)]
        yield pa.RecordBatch.from_arrays(columns, names=["keys", "bounds", "words", "places", "word", "docs"])


def decode(row: dict, words: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the vocabulary of every word, -1 without one; words before each text and after the last) of a batch."""
    own, bounds = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["bounds"], "<i8")
    places = np.frombuffer(row["places"], "<u2" if len(own) <= 1 << 16 else "<u4")
    return np.append(lookup(words, slots, own), np.int32(-1))[places] if len(places) else np.array([], np.int32), bounds


def document_frequencies(encoded: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Words (sorted hashes) that ``least`` documents or more hold, and in how many they occur, over all of them."""
    sums = encoded.where("word is not null").groupBy("word").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).toArrow()
    words, held = sums["word"].to_numpy().astype(np.uint64), sums["docs"].to_numpy()
    order = np.argsort(words)
    return words[order], held[order]


def batches_of(encoded: DataFrame) -> DataFrame:
    return encoded.where("bounds is not null").select("keys", "bounds", "words", "places")


def passages(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of every passage of some texts: PASSAGE words every STRIDE, the last one ends with the text."""
    size = np.diff(bounds)
    count = np.where(size > 0, np.maximum(1, -(-(size - PASSAGE + STRIDE) // STRIDE)), 0)
    at = _runs(np.zeros(len(size), np.int64), count) * STRIDE
    return np.repeat(bounds[:-1], count) + at, np.minimum(PASSAGE, np.repeat(size, count) - at)


def _weighted(places: np.ndarray, starts: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, unit TF-IDF weights: passages times these words) of a few passages at a time."""
    seen, local = np.zeros(len(idf), bool), np.zeros(len(idf), np.int64)
    for at in range(0, len(starts), TOGETHER):
        size = sizes[at : at + TOGETHER]
        word = places[_runs(starts[at : at + TOGETHER], size)]
        row = np.repeat(np.arange(len(size)), size)[word >= 0]
        word = word[word >= 0]
        if not len(word):
            continue
        seen[word] = True
        own = np.flatnonzero(seen)
        seen[own], local[own] = False, np.arange(len(own))
        weights = np.bincount(row * len(own) + local[word], minlength=len(size) * len(own)).reshape(len(size), -1).astype(np.float32)
        weights *= idf[own]
        norm = np.sqrt(np.einsum("ij,ij->i", weights, weights))
        weights, norm = weights[norm > 0], norm[norm > 0]
        yield own, weights / norm[:, None]


def _product(parts: Iterator[tuple[np.ndarray, np.ndarray]], basis: np.ndarray) -> tuple[np.ndarray, int]:
    """A'(A basis) over some passages, and their number."""
    total, n = np.zeros(basis.shape, np.float32), 0
    for own, weights in parts:
        total[own] += weights.T @ (weights @ basis[own])
        n += len(weights)
    return total, n


def leading_directions(items: list[tuple[np.ndarray, np.ndarray]], size: int, count: int) -> np.ndarray:
    """The leading right singular vectors of the items' passages, at most ``count``, by steps of subspace iteration."""
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((size, count), np.float32))[0]
    for _ in range(3):
        basis = np.linalg.qr(_product(iter(items), basis)[0])[0]
    return basis


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a'b, summed in double precision, PART rows at a time."""
    return sum(a[at : at + PART].T.astype(np.float64) @ b[at : at + PART] for at in range(0, len(a), PART))


def nystroem(test: np.ndarray, product: np.ndarray, rank: int) -> np.ndarray:
    """The leading ``rank`` eigenvectors of a positive semidefinite matrix from its product with an orthonormal test matrix."""
    core = _cross(test, product)
    values, turn = np.linalg.eigh((core + core.T) / 2)
    kept = values > 1e-6 * max(values.max(), 1e-30)  # single precision carries no more
    half = product @ (turn[:, kept] / np.sqrt(values[kept])).astype(np.float32)  # half @ half.T is the approximation
    values, turn = np.linalg.eigh(_cross(half, half))
    best = np.argsort(values)[::-1][:rank]
    best = best[values[best] > 1e-6 * max(values.max(), 1e-30)]
    return half @ (turn[:, best] / np.sqrt(values[best])).astype(np.float32)


PARTS = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("m", pa.binary())])


def _parts(matrix: np.ndarray, n: int = 0) -> Iterator[pa.RecordBatch]:
    """A matrix as float32 numbers, PART rows at a time."""
    for at in range(0, len(matrix), PART):
        part = matrix[at : at + PART].astype("<f4").tobytes()
        yield pa.RecordBatch.from_pydict({"part": [at // PART], "n": [n], "m": [part]}, schema=PARTS)


def _matrix(rows: list, columns: int, size: int) -> np.ndarray:
    out = np.zeros((size, columns), np.float32)
    for r in rows:
        out[r["part"] * PART :][:PART] = np.frombuffer(r["m"], "<f4").reshape(-1, columns)
    return out


def fit_space(batches: DataFrame, items: list[bytes], words: np.ndarray, idf: np.ndarray, unknown: float) -> Space:
    """The randomised decomposition over all texts, as encoded.

    The matrices that meet have vocabulary times rank numbers; single tasks make the test
    matrix and the decomposition, so that the driver only hands them on.
    """
    rank, size = min(RANK, len(words)), min(RANK + EXTRA, len(words))
    idf, slots, schema = idf.astype(np.float32), slot_table(words), "part int, n bigint, m binary"
    hashes, item_bounds = word_hashes(items)
    item_places = lookup(words, slots, hashes)
    spark = batches.sparkSession

    def item_parts() -> list[tuple[np.ndarray, np.ndarray]]:
        return list(_weighted(item_places, item_bounds[:-1], np.diff(item_bounds), idf))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            random = np.random.default_rng(11).standard_normal((len(idf), size - 3 * size // 4), np.float32)
            yield from _parts(np.linalg.qr(np.hstack([leading_directions(item_parts(), len(idf), 3 * size // 4), random]))[0])

    test = _matrix(spark.range(1, numPartitions=1).mapInArrow(tidily(begin), schema).collect(), size, len(words))
    shared = spark.sparkContext.broadcast((test, idf, words, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, idf, words, slots = shared.value

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for at in range(batch.num_rows):
                    places, bounds = decode(batch.slice(at, 1).to_pylist()[0], words, slots)
                    yield from _weighted(places, *passages(bounds), idf)

        total, n = _product(parts(), test)
        if n:
            yield from _parts(total, n)

    def add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, part = 0.0, 0, None
        for t in tables:
            for i, k, m in zip(*(c.to_pylist() for c in t.columns), strict=True):
                total, n, part = total + np.frombuffer(m, "<f4").astype(np.float64), n + k, i
        yield pa.RecordBatch.from_pydict({"part": [part], "n": [n], "m": [total.astype("<f4").tobytes()]}, schema=PARTS)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shared.value[0]
        rows, own = [r for batch in batches for r in batch.to_pylist()], item_parts()
        product = _matrix(rows, size, len(test))
        product += np.float32(max([1, *(r["n"] for r in rows)]) / max(1, sum(len(w) for _, w in own))) * _product(iter(own), test)[0]
        yield from _parts(nystroem(test, product, rank))

    summed = batches.select("bounds", "words", "places").coalesce(FIT_TASKS).mapInArrow(tidily(run), schema).groupBy("part").applyInArrow(add, schema)
    rows = summed.repartition(1).mapInArrow(tidily(finish), schema).collect()  # one matrix
    shared.destroy()
    vectors = _matrix(rows, len(rows[0]["m"]) // 4 // min(PART, len(words)), len(words)) if rows else np.zeros((len(words), rank), np.float32)
    return Space(words, idf.astype(np.float64), unknown, vectors)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence: one bit per word of ``a``, one step per word of ``b``."""
    return _common(_bits(a), len(a), b)


def _bits(a: list) -> dict:
    """The places of each word of ``a``, a bit for each."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    return places


def _common(places: dict, n: int, b: list) -> int:
    full = (1 << n) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return n - row.bit_count()


@dataclass
class Held:
    """The items' words: a bit for each word of the vocabulary and item that has it, and (item, word) with how often it does, sorted."""

    marks: np.ndarray
    entries: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, own: list[list[int]], size: int) -> Held:
        marks = np.zeros((size + 1, -(-len(own) // 8)), np.uint8)  # behind the words: those without a place, which no item has
        for i, words in enumerate(own):
            marks[words, i >> 3] |= np.uint8(1 << (i & 7))
        item = np.repeat(np.arange(len(own)), [len(words) for words in own])
        return cls(marks, *np.unique(item * len(marks) + np.concatenate(own), return_counts=True))

    def has(self, words: np.ndarray, item: np.ndarray | int) -> np.ndarray:
        return self.marks[words, item >> 3] >> (item & 7) & 1 > 0

    def most(self, places: np.ndarray, first: np.ndarray, count: np.ndarray, item: np.ndarray) -> np.ndarray:
        """How many words each stretch has in common with its item in any order, repeats as often as both have them: no common subsequence is longer."""
        out, group = np.zeros(len(first), np.int64), (np.cumsum(count) - count) // HELD
        for few in np.split(np.arange(len(first)), np.flatnonzero(np.diff(group)) + 1):
            which, word = np.repeat(few, count[few]), places[_runs(first[few], count[few])]
            hit = self.has(word, item[which])
            if not hit.any():
                continue
            which, word = which[hit], word[hit]
            entry = np.searchsorted(self.entries, item[which] * len(self.marks) + word)
            seen, n = np.unique((which - few[0]) * len(self.entries) + entry, return_counts=True)
            out[few] = np.bincount(seen // len(self.entries), np.minimum(n, self.times[seen % len(self.entries)]), len(few)).astype(np.int64)
        return out


def places_around(found: list[tuple], bounds: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, item) of what is compared with the item at every place found."""
    row, start, n, item = np.array([h[:4] for h in found], np.int64).reshape(-1, 4).T
    middle, reach = start + n // 2, np.maximum(n // 2, lengths[item])
    low, size = np.maximum(0, middle - reach), bounds[row + 1] - bounds[row]
    return bounds[row] + low, np.maximum(0, np.minimum(middle + reach, size) - low), item


def answer_of(text: str) -> list[bytes]:
    """Words of the last sentence; of the whole text if there is only one."""
    sentences = [w for s in re.split(r"(?<=[.!?])\s+|\n+", text) if (w := normalized(s).split())]
    return sentences[-1] if sentences else []


def windows_for(lengths: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(blocks, items) of each window length: an item is looked for by windows of half to twice its words."""
    out, blocks = [], 2
    while True:
        words = blocks * BLOCK
        longer = lengths > 2 * words
        items = np.flatnonzero(~longer & ((lengths > words // 2) | (blocks == 2)) if longer.any() else (lengths > words // 2) | (blocks == 2))
        out.append((blocks, items))
        if not longer.any():
            return out
        blocks *= 2


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] numbers), one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def find_windows(
    places: np.ndarray, bounds: np.ndarray, space: Space, queries: np.ndarray, windows: list[tuple[int, np.ndarray]], least: float
) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, first word, words, item, cosine) of the windows that pass, for some texts' words at once."""
    # long texts are looked at in segments, which overlap by the longest window
    reach = windows[-1][0] * BLOCK
    text, begin = [], []
    for i, n in enumerate(np.diff(bounds).tolist()):
        own = range(0, max(1, n), SEGMENT)
        text += [i] * len(own)
        begin += own
    text, begin = np.array(text), np.array(begin)
    size = np.minimum(np.diff(bounds)[text] - begin, SEGMENT + reach)
    idf = np.where(places >= 0, space.idf[places], space.unknown_idf).astype(np.float32)
    first = bounds[:-1][text] + begin
    group = np.cumsum(size) // (4 * SEGMENT)  # so many words at once
    for g in np.unique(group):
        mine = np.flatnonzero(group == g)
        at, n = _runs(first[mine], size[mine]), size[mine]
        if not len(at):
            continue
        blocks = -(-n // BLOCK)
        base = np.cumsum(blocks) - blocks
        cell = np.repeat(base * BLOCK, n) + _runs(np.zeros(len(n), np.int64), n)
        squares, rows = np.zeros(blocks.sum() * BLOCK), np.full(blocks.sum() * BLOCK, -1)
        squares[cell], rows[cell] = idf[at].astype(np.float64) ** 2, places[at]
        weights = np.concatenate(([0.0], np.cumsum(squares.reshape(-1, BLOCK).sum(axis=1))))
        sums = np.zeros((blocks.sum() + 1, space.vectors.shape[1]), np.float32)
        for k in range(BLOCK):
            sums[1:] += space.weighted.take(rows[k::BLOCK], axis=0)  # -1: the zeros
        np.cumsum(sums, axis=0, out=sums)
        for length, items in windows:
            if not len(items):
                continue
            step = length // 2
            count = np.maximum(1, -(-(blocks - length) // step) + 1) * (blocks > 0)
            which = np.repeat(np.arange(len(mine)), count)
            a = _runs(np.zeros(len(mine), np.int64), count) * step
            b = np.minimum(a + length, blocks[which])
            low, high = base[which] + a, base[which] + b
            norm = np.sqrt(np.maximum(weights[high] - weights[low], 1e-9)).astype(np.float32)
            vectors = sums[high] - sums[low]
            for few in range(0, len(items), ITEMS_TOGETHER):
                dots = vectors @ queries[:, items[few : few + ITEMS_TOGETHER]]
                w, k = np.nonzero(dots >= least * norm[:, None])
                s = mine[which[w]]
                columns = text[s], begin[s] + a[w] * BLOCK, (b[w] - a[w]) * BLOCK, items[few + k], dots[w, k] / norm[w]
                yield from zip(*(c.tolist() for c in columns), strict=True)


@dataclass
class Runs:
    """Runs of RUN words of the items, of shorter items their whole text: (item, offset) of each hash, by length."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _rolled(hashes: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the run of so many words that begins at each word); lengths ascend."""
    roll, k = hashes.copy(), 1
    for length in lengths:
        while k < length:
            roll = roll[:-1] * ROLL + hashes[k:]
            k += 1
        if not len(roll):
            return
        yield length, mix(roll)


def item_runs(hashes: np.ndarray, bounds: np.ndarray) -> Runs:
    size = np.diff(bounds)
    out = {}
    for length, rolled in _rolled(hashes, sorted({int(x) for x in np.minimum(size, RUN) if x > 0})):
        mine = np.flatnonzero(np.minimum(size, RUN) == length)
        count = size[mine] - length + 1
        item, offset = np.repeat(mine, count), _runs(np.zeros(len(mine), np.int64), count)
        value = rolled[bounds[item] + offset]
        order = np.argsort(value, kind="stable")
        words, first = np.unique(value[order], return_index=True)
        out[length] = words, slot_table(words), np.append(first, len(value)), item[order], offset[order]
    return Runs(out)


def find_runs(hashes: np.ndarray, bounds: np.ndarray, runs: Runs) -> list[tuple[int, int, int]]:
    """(text, item, start) of every place where a text has a run of an item's words; start: where the item would begin."""
    out = []
    for length, rolled in _rolled(hashes, list(runs.by_length)):
        words, slots, first, item, offset = runs.by_length[length]
        found = lookup(words, slots, rolled)
        at = np.flatnonzero(found >= 0)
        text = np.searchsorted(bounds, at, side="right") - 1
        inside = at + length <= bounds[text + 1]
        at, text, found = at[inside], text[inside], found[at[inside]]
        count = first[found + 1] - first[found]
        which = _runs(first[found], count)
        start = np.repeat(at - bounds[text], count) - offset[which]
        if len(start):
            out.append(np.unique(np.stack([np.repeat(text, count), item[which], np.maximum(0, start)], 1), axis=0))
    return [tuple(x) for x in np.concatenate(out).tolist()] if out else []


LEAKS = "item_id bigint, start bigint, cosine double, subsequence double, answer double"


Search = Callable[[np.ndarray, np.ndarray], tuple[list[int], list[tuple]]]


def _searchers(encoded: DataFrame, total: int, benchmark: DataFrame, item: str, limits: Thresholds | None) -> list[tuple[Broadcast, Search]]:
    """For every GROUP items their space, sent, and what finds leaks in some texts' places: (texts that leak, (item, start, scores) of each leak).

    Nothing can leak where there are no items or documents.  Documents are counted once; the
    passes of the fit and the work of a search grow with the number of groups.
    """
    limits = limits or Thresholds()
    rows = benchmark.select(item, "text").where(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")).orderBy(item, "text").limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} benchmark items: search them in parts")
    if not rows or not total:
        return []
    least = max(1.0, total * SHARE)
    counted = document_frequencies(encoded, least)
    return [_searcher(encoded, total, rows[at : at + GROUP], item, limits, least, *counted) for at in range(0, len(rows), GROUP)]


def _searcher(encoded: DataFrame, total: int, rows: list, item: str, limits: Thresholds, least: float, frequent: np.ndarray, held: np.ndarray) -> tuple[Broadcast, Search]:
    item_ids, items = [r[item] for r in rows], [normalized(r["text"]) for r in rows]
    item_words, item_bounds = word_hashes(items)
    words = np.unique(np.concatenate((item_words, frequent)))
    counts = np.full(len(words), least)
    counts[np.searchsorted(words, frequent)] = held
    idf, unknown = np.log((total + 1) / (counts + 1)) + 0.1, math.log((total + 1) / (least + 1)) + 0.1
    space = fit_space(batches_of(encoded), items, words, idf, unknown)

    places = space.index(item_words)
    queries = []
    for a, b in zip(item_bounds, item_bounds[1:]):  # noqa: B905
        own = places[a:b]
        vector = (space.vectors[own] * space.idf[own, None]).sum(axis=0)
        queries.append(vector / max(1e-9, float(np.linalg.norm(vector))))  # by what the space keeps of the item
    own = [places[a:b].tolist() for a, b in zip(item_bounds, item_bounds[1:])]  # noqa: B905
    answers = [space.index(word_hashes([b" ".join(answer_of(r["text"]))])[0]).tolist() for r in rows]
    windows, lengths = windows_for(np.diff(item_bounds)), np.diff(item_bounds)
    sent = encoded.sparkSession.sparkContext.broadcast((space, np.array(queries, np.float32).T.copy(), own, answers, item_runs(item_words, item_bounds), lengths, Held.of(own, len(words))))

    def search(places: np.ndarray, bounds: np.ndarray) -> tuple[list[int], list[tuple]]:
        space, queries, item_words, answers, runs, lengths, held = sent.value
        picked, out, kept_bits = [], [], {}
        found = [*find_windows(places, bounds, space, queries, windows, limits.cosine)]
        # last, without a cosine yet: places with a run of an item's words, whatever the space keeps of it
        hashes = np.where(places >= 0, space.words[places], np.uint64(0))  # items have no unknown words
        found += [(row, start, len(item_words[i]), i, -2.0) for row, i, start in find_runs(hashes, bounds, runs)]
        # most places lack the words: only the others are compared word by word
        first, count, item = places_around(found, bounds, lengths)
        most = held.most(places, first, count, item)
        likely = np.flatnonzero(most / lengths[item] >= limits.subsequence).tolist()
        found = [(*found[f], int(first[f]), int(first[f] + count[f]), int(most[f])) for f in likely]
        found.sort(key=lambda h: (h[0], h[3], -h[4], h[1]))
        for row, hits in groupby(found, key=lambda h: h[0]):
            split, best = places[bounds[row] : bounds[row + 1]], {}
            for _, start, n, i, cosine, low, high, most in hits:
                wanted = item_words[i]
                if i in best and best[i][2] >= min(1, most / len(wanted)):
                    continue
                around = places[low:high]
                bits = kept_bits.get(i) or _bits(wanted)
                if len(wanted) <= KEPT:
                    kept_bits[i] = bits
                own = around[held.has(around, i)].tolist()  # others don't change what is common
                share = _common(bits, len(wanted), own) / len(wanted)
                if share < limits.subsequence or i in best and share <= best[i][2]:
                    continue
                answer = common_subsequence(answers[i], around.tolist()) / len(answers[i])
                if answer >= limits.answer:
                    if cosine < -1:
                        cosine = space.cosine(split[start : start + n], queries[:, i])
                    best[i] = (start, cosine, share, answer)
            for i, scores in sorted(best.items()):
                picked.append(row)
                out.append((item_ids[i], *scores))
        return picked, out

    return sent, search


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", limits: Thresholds | None = None
) -> DataFrame:
    """A row per document and benchmark item that it gives away: ``key, item_id, start, cosine, subsequence, answer``.

    start: the first word of the best window; cosine, subsequence and answer: its scores.
    Clean documents have no row.  Null and empty texts and items leak nothing and nothing
    leaks; items alike each get their rows; repeated documents each get theirs; texts of
    any length are read whole; an empty table on either side gives no rows; other columns
    are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {LEAKS}"
    encoded = encode(docs, key, text)
    searchers = _searchers(encoded, docs.count(), benchmark, item, limits)
    if not searchers:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.drop_columns(["keys"])
            for at, (sent, search) in product(range(batch.num_rows), searchers):
                space = sent.value[0]
                picked, out = search(*decode(rest.slice(at, 1).to_pylist()[0], space.words, space.slots))
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                keys = batch.column(0)[at].values.take(pa.array(picked, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[key, "item_id", "start", "cosine", "subsequence", "answer"])

    return batches_of(encoded).mapInArrow(tidily(run), schema)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that give away a benchmark item: every row goes or stays by its own text, whatever its key."""
    encoded = encode(docs.select(F.lit(0).alias("_k"), text), "_k", text)
    searchers = _searchers(encoded, docs.count(), benchmark, "item_id", None)
    discard(encoded)  # the search reads texts
    collect_garbage(docs)
    if not searchers:
        return docs
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in _small(batches):
            hashes, bounds = word_hashes(lowered(few.column(place)))
            kept = np.ones(few.num_rows, bool)
            for sent, search in searchers:
                kept[search(sent.value[0].index(hashes), bounds)[0]] = False
            yield few.filter(pa.array(kept))

    return docs.mapInArrow(tidily(run), docs.schema)
