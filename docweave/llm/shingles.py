"""Word shingles of texts as 64-bit numbers, many texts at a time.

A word's hash is a polynomial over a random number per byte value, taken from one running
sum over all texts; a shingle's is a polynomial over its words' hashes.  Equal shingles
have equal numbers; that different ones do has odds of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BATCH_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
ROLL = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, n of them or more; those for usual sizes are kept."""
    if "up" not in _powers or len(_powers["up"]) < n:
        made = {}
        for name, base in (("up", BASE), ("down", UNBASE)):
            steps = np.full(max(n, BATCH_BYTES + 1), base, np.uint64)
            steps[0] = 1
            made[name] = np.cumprod(steps, dtype=np.uint64)
        if n > BATCH_BYTES + 1:  # one long text
            return made["up"], made["down"]
        _powers.update(made)
    return _powers["up"], _powers["down"]


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~SPACE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words before each text and after the last).  Texts are lower-cased by the caller."""
    found, counts = [], np.zeros(len(texts), np.int64)
    group, size = [], 0

    def flush() -> None:
        if group:
            hashes, starts = _hash_words(b"\n".join(part for _, part in group))
            bounds = np.cumsum([0, *[len(part) + 1 for _, part in group]])
            per = np.diff(np.searchsorted(starts, bounds))
            np.add.at(counts, [i for i, _ in group], per)
            found.append(hashes)
            group.clear()

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > BATCH_BYTES:  # cut a long text at a space; a longer word stays whole
                cuts = [c for c in (text.find(s, at + BATCH_BYTES) for s in (b" ", b"\n")) if c >= 0]
                end = min(cuts) if cuts else end
            group.append((i, text[at:end]))
            size += end - at + 1
            at = end
            if size >= BATCH_BYTES:
                flush()
                size = 0
    flush()
    return np.concatenate(found) if found else np.array([], np.uint64), np.concatenate(([0], np.cumsum(counts)))


def slots(values: np.ndarray, n: int) -> np.ndarray:
    """Slot of each number among ``n``, a power of two: its leading bits."""
    return (values >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64)


@dataclass
class Sets:
    """Shingle sets of some texts: text i has ``values[bounds[i]:bounds[i + 1]]``, sorted, without repeats."""

    values: np.ndarray
    bounds: np.ndarray

    def __iter__(self) -> Iterator[np.ndarray]:
        for a, b in zip(self.bounds, self.bounds[1:]):  # noqa: B905
            yield self.values[a:b]


def shingle_sets(texts: list[bytes], k: int = 5, level: np.ndarray | None = None, frequent: np.ndarray | None = None) -> Sets:
    """Sets of distinct k-word shingles; of fewer words, the whole sequence; of none, empty.

    With ``level``, a small number for each of its slots, a shingle's number begins with
    the least level among its words (a word's slot: its hash modulo the slots) and goes on
    with 56 bits of hash, so that sorted sets come lowest level first.  ``frequent``, a truth
    value for each of its slots (a power of two), puts the shingles it marks behind all others.
    """
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    if not len(words):
        return Sets(np.array([], np.uint64), np.zeros(len(texts) + 1, np.int64))
    levels = None if level is None else level[(words % np.uint64(len(level))).astype(np.int64)]
    roll, low = words.copy(), levels
    n = len(words)
    for i in range(1, k):
        roll[: n - i] = roll[: n - i] * ROLL + words[i:] if i < n else roll[: n - i]
        if low is not None and i < n:
            low = np.concatenate((np.minimum(low[: n - i], levels[i:]), low[n - i :]))
    keep = np.zeros(n, bool)
    lengths = np.maximum(counts - k + 1, 0)
    long = np.flatnonzero(lengths)
    if len(long):
        keep[:] = True
        tails = np.minimum(counts, k - 1)
        # the last k - 1 words of a text begin no shingle
        ends = np.repeat(bounds[1:], tails)
        keep[ends - 1 - (np.arange(len(ends)) - np.repeat(np.cumsum(tails) - tails, tails))] = False
    short = np.flatnonzero((counts > 0) & (counts < k))
    for i in short:
        h = np.uint64(counts[i])
        with np.errstate(over="ignore"):
            for w in words[bounds[i] : bounds[i + 1]]:
                h = h * ROLL + w
        roll[bounds[i]] = h ^ np.uint64(0xA5A5A5A5A5A5A5A5)
        if low is not None:
            low[bounds[i]] = levels[bounds[i] : bounds[i + 1]].min()
        keep[bounds[i]] = True
        lengths[i] = 1
    values = mix(roll[keep])
    if low is not None:
        low = np.minimum(low[keep], 127)
        if frequent is not None:
            low |= frequent[slots(values, len(frequent))].astype(np.uint8) << 7
        values = (low.astype(np.uint64) << np.uint64(56)) | (values >> np.uint64(8))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    for a, b in zip(starts.tolist(), starts[1:].tolist()):  # noqa: B905
        values[a:b].sort()
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    first[starts[:-1][lengths > 0]] = True
    kept = np.concatenate(([0], np.cumsum(first)))
    return Sets(values[first], kept[starts])


def set_ids(sets: Sets) -> np.ndarray:
    """A number for each set, the same for equal sets; 0 for the empty one."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(sets.values ^ ROLL), dtype=np.uint64)))
    total = sums[sets.bounds[1:]] - sums[sets.bounds[:-1]]
    sizes = np.diff(sets.bounds).astype(np.uint64)
    return np.where(sizes == 0, np.uint64(0), mix(total + sizes * ROLL))
