"""Mixture-controlled packing: deficit round-robin over one token queue per source.

Every window of ``window_tokens`` visits the sources in order and takes from each its
quantum, its share of the window, plus the deficit it carries.  After w windows a source
has given floor(w * quantum) tokens, so its deficit is always under one token and what it
has given follows from w alone.  That closed form is what lets windows be filled in
parallel: a document knows its place in its source's queue, so the windows, the places
there and the sequences it falls into are arithmetic, with no state to hand from one
partition to the next.

A source that runs dry ends a phase after that window; the others go on with their shares
scaled up.  Windows follow each other without a gap and are cut into sequences, so only
the last sequence has padding.

Steps: tokenize once into a table in the shared folder, numbered by task and by place in
the source's queue within the task; sum by task and source; prefix sums over tasks give
every document its place; a last pass over the table cuts the pieces.  Token ids are never
shuffled, and a source with a third of all rows is spread like the others.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import settle, tidily

#: Words in each generation of a task's cache.
CACHED_WORDS = 600_000
#: Latin letters, then marks that stand together in one run.
SIMPLE = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,;:!?#*$%&|]*)\Z")
#: The mixture is a table of sources sent to every task; there may be so many.
MAX_SOURCES = 1000


class WordTokenizer:
    """Ids of a text by a tokenizer that drops white space, so that words can be cached.

    Words between ASCII spaces are encoded by themselves and remembered as bytes (ids as
    little-endian ``dtype``), in two generations: when the younger is full it becomes the
    older, and words in use come back from there.  New words are encoded many at a time,
    with one of the tokenizer's special tokens between them.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark, self.mark_id = special[0] if special else (None, -1)
        self.fast = self._try_simple()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _simple(self, text: str) -> bytes | None:
        """Ids of letters and the marks behind them: two runs to the tokenizer, the first one lower-cased.

        Normalizing and splitting are most of the work on a short word; here they are known,
        and the model is asked directly.
        """
        m = SIMPLE.match(text)
        if m is None:
            return None
        word, mark = m.groups()
        word = word.lower()
        ids = array("H" if self.dtype.itemsize == 2 else "I", [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]).tobytes()
        if not mark:
            return ids
        if mark not in self.marks:
            self.marks[mark] = self._ids(mark).tobytes()
        return ids + self.marks[mark]

    def _try_simple(self) -> bool:
        """Whether this tokenizer treats simple words as ``_simple`` does."""
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha()]
        self.letters = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})
        self.model, self.marks = self.tokenizer.model, {}
        probes = ["".join(letters), "The,", "reading.", "Größe;", "élève***", "ÉTÉ!?", "naïve", "a", "Zz%%%", "it:"]
        probes += [w + m for w in ("tionont", "Überlich", "señor") for m in ("", ".", "&&&", "###", "$$$", "|", ",,")]
        try:
            return all(self._simple(x) == self._ids(x).tobytes() for x in probes)
        except Exception:  # noqa: BLE001  a model of another kind: everything goes the usual way
            return False

    def _learn(self, words: list[bytes]) -> None:
        if len(self.cache) + len(words) > CACHED_WORDS:
            self.older, self.cache = self.cache, {}
        texts = [w.decode("utf-8", "replace") for w in words]
        together = []
        for k, text in enumerate(texts):
            ids = self._simple(text) if self.fast else None
            if ids is not None:
                self.cache[words[k]] = ids
            elif self.mark and self.mark not in text:
                together.append(k)
            else:
                self.cache[words[k]] = self._ids(text).tobytes()
        for at in range(0, len(together), 2000):
            part = together[at : at + 2000]
            ids = self._ids(self.mark.join([texts[k] for k in part]))
            marks = np.flatnonzero(ids == self.mark_id)
            raw, width = ids.tobytes(), self.dtype.itemsize
            for k, a, b in zip(part, [0, *(width * (marks + 1)).tolist()], [*(width * marks).tolist(), len(raw)], strict=True):
                self.cache[words[k]] = raw[a:b]

    def encode(self, text: str) -> bytes:
        words = text.encode("utf-8", "replace").split()
        unknown = []
        for w in dict.fromkeys(words):
            if w not in self.cache:
                known = self.older.get(w)
                if known is None:
                    unknown.append(w)
                else:
                    self.cache[w] = known
        if unknown:
            before = self.cache
            self._learn(unknown)
            if self.cache is not before:  # a new generation began: take this text's words along
                self.cache |= {w: before[w] for w in words if w in before}
        return b"".join(map(self.cache.__getitem__, words)) + self.end


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A table on disk: ``key, source, part, part_start, n, ids``.

    part: the task; part_start: tokens of the same source before this row in the task.
    A null text is empty; every row ends with ``end_id``; a null source is ''.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, source string, part int, part_start bigint, n bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, given = WordTokenizer(tokenizer_path, end_id), TaskContext.get().partitionId(), {}
        width = tokenizer.dtype.itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # keeps what waits to be sent small
                few = batch.slice(at, 256)
                sources, starts, counts, ids = few.column(1).to_pylist(), [], [], []
                for s, t in zip(sources, few.column(2), strict=True):
                    ids.append(tokenizer.encode(t.as_py()))
                    counts.append(len(ids[-1]) // width)
                    starts.append(given.get(s, 0))
                    given[s] = starts[-1] + counts[-1]
                columns = [few.column(0), few.column(1), pa.array([part] * few.num_rows, pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "source", "part", "part_start", "n", "ids"])

    plain = docs.select(F.col(key), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return settle(plain.mapInArrow(tidily(run), schema))


@dataclass(frozen=True)
class Phase:
    """So many windows, of sources that last at least until its last one."""

    position: int  # of its first token among all packed tokens
    window: int  # its first window
    windows: int
    used: tuple[int, ...]  # what each source gave before
    left: tuple[int, ...]  # what each source has when it begins
    shares: tuple[int, ...]  # weights, 0 for dry sources


class Mixture:
    """Where token x of a source's queue goes.  totals: tokens by source; weights: target shares."""

    def __init__(self, totals: list[int], weights: list[int], window_tokens: int):
        self.size, self.phases = window_tokens, []
        used, position, window = [0] * len(totals), 0, 0
        while any(u < t for u, t in zip(used, totals, strict=True)):
            left = [t - u for u, t in zip(used, totals, strict=True)]
            shares = [w if n else 0 for w, n in zip(weights, left, strict=True)]
            if not any(shares):  # only sources without weight are left: their own sizes decide
                shares = left
            whole = sum(shares)
            windows = min(-(-n * whole // (window_tokens * a)) for n, a in zip(left, shares, strict=True) if a)
            phase = Phase(position, window, windows, tuple(used), tuple(left), tuple(shares))
            self.phases.append(phase)
            given = [self._given(phase, j, windows) for j in range(len(totals))]
            used = [u + g for u, g in zip(used, given, strict=True)]
            position, window = position + sum(given), window + windows
        self._layouts: dict[tuple[int, int], tuple[list[int], list[int], list[int]]] = {}
        self._starts = [[p.used[j] for p in self.phases] for j in range(len(totals))]

    def _given(self, phase: Phase, j: int, w: int) -> int:
        """What source j has given after w windows of the phase."""
        return min(w * self.size * phase.shares[j] // sum(phase.shares), phase.left[j])

    def _layout(self, f: int, w: int) -> tuple[list[int], list[int], list[int]]:
        """Of window w of phase f: first queue place, tokens and first packed place by source."""
        if (f, w) in self._layouts:
            return self._layouts[f, w]
        if len(self._layouts) > 4096:
            self._layouts.clear()
        phase = self.phases[f]
        sources = range(len(phase.left))
        before = [self._given(phase, j, w) for j in sources]
        takes = [self._given(phase, j, w + 1) - before[j] for j in sources]
        places, at = [], phase.position + sum(before)
        for n in takes:
            places.append(at)
            at += n
        self._layouts[f, w] = ([phase.used[j] + before[j] for j in sources], takes, places)
        return self._layouts[f, w]

    def pieces(self, j: int, x: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(window, packed place, length) of the runs that hold tokens x to x + n of source j."""
        while n:
            f = bisect.bisect_right(self._starts[j], x) - 1
            phase = self.phases[f]
            w = (x - phase.used[j]) * sum(phase.shares) // (self.size * phase.shares[j])
            first, takes, places = self._layout(f, w)
            while x >= first[j] + takes[j]:  # the quotient can be one window early
                w += 1
                first, takes, places = self._layout(f, w)
            length = min(n, first[j] + takes[j] - x)
            yield phase.window + w, places[j] + x - first[j], length
            x, n = x + length, n - length


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    weights: dict[str, int] | None = None,
    sequence_tokens: int = 4096,
    window_tokens: int = 16 * 4096,
    end_id: int = 2,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, window_id, ids``.

    start: the document's ids before the piece; ids: the piece's, as little-endian unsigned
    32-bit numbers; offset: its place in its sequence.  weights: target share by source,
    sources without one get none until the others are used up; by default shares are the
    sources' own token counts.
    Null and empty texts are one id; a null source is the source ''; repeated rows are
    packed each; a document longer than a window spreads over several; an empty table
    gives no rows; other columns are ignored.
    """
    tokens = tokenize(docs, tokenizer_path, end_id, key, text, source)
    sums = settle(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")))
    totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").limit(MAX_SOURCES + 1).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: map them to fewer queues")
    names = list(totals)
    shares = [totals[s] if weights is None else weights.get(s, 0) for s in names]
    mixture, place = (Mixture(list(totals.values()), shares, window_tokens), {s: j for j, s in enumerate(names)})
    # a row per task and source: sums over tasks, in the order of their numbers
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(sums.select("part", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("queue_start")))
    width = WordTokenizer(tokenizer_path, end_id).dtype.itemsize
    kind = docs.schema[key].dataType.simpleString()
    names_out = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window_id", "ids"]
    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string, window_id bigint, ids binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in range(0, whole.num_rows, 256):
                batch = whole.slice(b, 256)
                picked, out = [], [[] for _ in names_out[1:]]
                for row, (s, x, n, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                    ids = memoryview(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
                    done = 0
                    for window, position, length in mixture.pieces(place[s], x, n):
                        while length:
                            sequence, offset = divmod(position, sequence_tokens)
                            take = min(length, sequence_tokens - offset)
                            piece = bytes(ids[4 * done : 4 * (done + take)])
                            picked.append(row)
                            for column, v in zip(out, (done, take, zlib.crc32(piece), n, sequence, offset, s, window, piece), strict=True):
                                column.append(v)
                            done, position, length = done + take, position + take, length - take
                types = [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(picked, pa.int64())), *[pa.array(v, t) for v, t in zip(out, types, strict=True)]], names=names_out)

    placed = tokens.join(starts, ["part", "source"]).select(key, "source", (F.col("queue_start") + F.col("part_start")).alias("x"), "n", "ids")
    return placed.mapInArrow(tidily(cut), schema)

