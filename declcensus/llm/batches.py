"""Helpers of the operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20
VOCABULARY = 200_000


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``SLICE_BYTES`` of text, or one long text.

    Only the working memory of a task depends on it, never a result.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets = np.cumsum(_lengths(batch.column(batch.schema.get_field_index(column))))
        start = 0
        while start < batch.num_rows:
            before = offsets[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(offsets, before + SLICE_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end


def _lengths(array: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class WordHashes(dict):
    """64-bit hash of a word, looked up once per distinct word while there is room."""

    def __missing__(self, word: str) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@cache
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)


@cache
def _character_hashes() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


_STEP, _STRIDE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """The first powers of an odd number modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < count:
        held = np.full(max(count, 2 * SLICE_BYTES), base, np.uint64)
        held[0] = 1
        held = _powers[base] = np.multiply.accumulate(held)
    return held[:count]


def spans_hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of ``values[start:end]`` for each span: a polynomial taken from running sums."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, powers(base, len(values)), out=sums[1:])
    np.cumsum(sums, out=sums)
    back = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] ^ (ends - starts).astype(np.uint64))


class Tokens:
    """Words of some texts, lower-cased: runs of letters, digits and underscores.

    ``keys`` are their hashes, ``owner`` the text of each, ``fresh`` marks the first of a line;
    ``starts`` and ``ends`` are their places in ``lowered``, all texts in one.
    """

    def __init__(self, texts: list[str | None]) -> None:
        lowered = [(t or "").lower() + "\n" for t in texts]
        self.lowered = "".join(lowered)
        codes = np.frombuffer(self.lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = _word_characters()[codes]
        before = np.concatenate(([False], inside[:-1]))
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
        self.starts, self.ends = starts, ends
        self.keys = spans_hashed(_character_hashes()[codes], starts, ends, _STEP)
        bounds = np.searchsorted(starts, np.cumsum([len(t) for t in lowered]))
        self.owner = np.repeat(np.arange(len(lowered)), np.diff(bounds, prepend=0))
        lines = np.searchsorted(starts, np.flatnonzero(codes == 10))
        self.fresh = np.zeros(len(starts), bool)
        self.fresh[lines[lines < len(starts)]] = True
        self.fresh[:1] = True


def digests(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of words."""
    return spans_hashed(keys, starts, ends, _STRIDE)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the public splitmix64 finaliser)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def winnowed(values: np.ndarray, window: int, within: np.ndarray) -> np.ndarray:
    """The place of the first smallest value of each window that is ``within``, each place once.

    Smallest values are taken by doubling; places are looked for only where the smallest
    value changes or is the one that the window has just left.
    """
    least, width = values, 1
    while 2 * width <= window:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = window - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    fresh = within.copy()
    fresh[1:] &= ~within[:-1] | (least[1:] != least[:-1]) | (values[: len(least) - 1] == least[:-1])
    starts = np.flatnonzero(fresh)
    windows = np.lib.stride_tricks.sliding_window_view(values, window)
    return np.unique(starts + windows[starts].argmin(axis=1))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one run, an empty one has none."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    count = len(words) - size + 1
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = mix(out ^ words[k : k + count]) + np.uint64(k + 1)
    return out


def labelled(values: np.ndarray) -> np.ndarray:
    """Values made distinct: each is hashed with its occurrence number so far."""
    if len(values) == 0:
        return values
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    fresh = np.empty(len(values), bool)
    fresh[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
    position = np.arange(len(values))
    number = np.empty(len(values), np.uint64)
    number[order] = (position - np.maximum.accumulate(np.where(fresh, position, 0))).astype(np.uint64)
    return mix(values ^ (number * np.uint64(0x9E3779B97F4A7C15)))


def labelled_each(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What :func:`labelled` gives for each of the runs of ``sizes`` values."""
    if len(values) == 0:
        return values
    run = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((values, run))
    ranked, own = values[order], run[order]
    fresh = np.concatenate(([True], (ranked[1:] != ranked[:-1]) | (own[1:] != own[:-1])))
    position = np.arange(len(values))
    number = np.empty(len(values), np.uint64)
    number[order] = (position - np.maximum.accumulate(np.where(fresh, position, 0))).astype(np.uint64)
    return mix(values ^ (number * np.uint64(0x9E3779B97F4A7C15)))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    if len(keys) == 0:
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts, starts)
