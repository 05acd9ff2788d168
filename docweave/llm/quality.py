"""Quality rules: base counts of a text, and compression bands.

zstandard's ratio (bytes in over bytes out) tells repetitive text (high) and text without
structure (low) from prose.  Ratios rise with length, so the limits go by length; they hold
for the whole document and, with limits of their own, for its fixed chunks.

The work is one Arrow pass over the rows without a shuffle: it is bounded by a batch of
texts, and a lost task is run again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class Bands:
    """limits: (shorter than so many bytes, least ratio, greatest ratio), in order of length."""

    level: int = 3
    chunk_bytes: int = 4096
    limits: tuple[tuple[float, float, float], ...] = field(
        default=(
            (512, 1.05, 3.0),
            (1024, 1.15, 3.2),
            (4096, 1.25, 3.6),
            (16384, 1.4, 4.2),
            (65536, 1.5, 5.0),
            (float("inf"), 1.6, 6.0),
        )
    )
    #: A document goes if more than this share of its chunks is out of the chunks' limits.
    bad_chunk_share: float = 0.3

    def fits(self, n_bytes: int, ratio: float) -> bool:
        for below, least, greatest in self.limits:
            if n_bytes < below:
                return least <= ratio <= greatest
        return True


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split: exactly the six ASCII spaces
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:]))  # noqa: B905  the shortest sets the end
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, marked = Counter(windows), 0  # marked: words before it are counted or can't be
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(marked, i)
                marked = i + 3
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean,"
    " kept boolean, ratio double, worst_chunk_ratio double, n_chunks bigint, n_bad_chunks bigint"
)


def _judge(text: str, bands: Bands, zstd) -> tuple:
    counts = base_counts(text)
    n_words, repeated = counts[0], counts[4]
    failed = n_words < 50 or 100 * repeated > 50 * n_words
    raw = text.encode("utf-8", "surrogatepass")
    ratio = len(raw) / len(zstd.compress(raw))
    # a tail of less than half a chunk belongs to the chunk before it
    step = bands.chunk_bytes
    cuts = [*range(0, max(1, len(raw) - step // 2 + 1), step), len(raw)]
    worst, bad = ratio, 0
    if len(cuts) > 2:
        ratios = [(b - a) / len(zstd.compress(raw[a:b])) for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        worst, bad = max(ratios), sum(not bands.fits(step, r) for r in ratios)
    kept = not failed and bands.fits(len(raw), ratio) and bad <= bands.bad_chunk_share * (len(cuts) - 1)
    return (*counts, failed, kept, ratio, worst, len(cuts) - 1, bad)


def judge_quality(docs: DataFrame, text: str = "text", bands: Bands | None = None) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and the ratios added.

    A null text counts as empty; an empty text has no words, ratio 0 and fails; texts of any
    length are judged whole; every row is judged by itself, so repeated rows get the same;
    an empty table gives no rows.  Columns of ``docs`` with the name of an added one are
    replaced by it.
    """
    bands = bands or Bands()
    names = [c.split()[0] for c in SCHEMA.split(",")]
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])

    @F.arrow_udf(f"struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import zstandard

        zstd = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = [_judge(x.as_py() or "", bands, zstd) for x in batch]
            yield pa.array([dict(zip(names, r, strict=True)) for r in rows], type=_TYPE)

    return rest.withColumn("_quality", judged(F.col(text))).select(*[F.col(f"`{c}`") for c in rest.columns], "_quality.*")


_TYPE = pa.struct([(c.split()[0], {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]]) for c in SCHEMA.split(",")])

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
