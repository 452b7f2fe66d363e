"""Hashes of words, word runs and character runs, for whole Arrow columns at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is hashed by itself.
CHUNK = 1 << 18
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal to equal, scattered otherwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get(base, ((),))[0]) < n:
        size = max(n, 1 << 16)
        both = (np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        _POWERS[base] = tuple(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(b)[:-1]]) for b in both)
    forth, back = _POWERS[base]
    return forth[:n], back[:n]


class Runs:
    """Hashes of any runs of one sequence of hashes, in constant time each."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self.base = _BASES[which]
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(self.base, len(values))[0], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = _powers(self.base, len(self.sums))[1]
        return mix((self.sums[end] - self.sums[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of the given counts, one after the other."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(count.sum())


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, the rows' offsets in them); null is empty."""
    wide = pa.types.is_large_string(column.type)
    n, held = len(column), column.buffers()
    offsets = np.frombuffer(held[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(held[2], np.uint8) if held[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n), data[offsets[lo] : offsets[min(hi, n)]], offsets[lo : min(hi, n) + 1] - offsets[lo]
        lo = min(hi, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words between ASCII white space: starts, ends, hashes, and the texts' offsets among them."""
    n = len(data)
    space = _SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[:-1] |= space
    first = np.ones(n, bool)
    first[1:] = space[:-1]
    starts = np.flatnonzero(~space & (first | cut[:-1])) if n else np.zeros(0, np.int64)
    last = np.ones(n, bool)
    last[:-1] = cut[1:-1]
    ends = np.flatnonzero(~space & last) + 1
    return starts, ends, Runs(_BYTE[data], 1)(starts, ends), np.searchsorted(starts, offsets)


def word_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of `size` words, by text, and the texts' offsets among them. A text of fewer words, but not none, has one run."""
    _, _, hashes, at = words(data, offsets)
    return _shingles(hashes, at, size)


def _shingles(values: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    start = ranges(at[:-1], count)
    return Runs(values, 2)(start, start + np.repeat(np.minimum(n, size), count)), np.concatenate([[0], np.cumsum(count)])


def char_shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of characters: runs of `size` code points; a shorter text is filled up with zeros to one run."""
    full = [t if len(t) >= size else t.ljust(size, "\0") for t in texts]
    points = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points *= np.uint64(0x9E3779B97F4A7C15)
    points ^= points >> np.uint64(29)
    forth, back = _powers(_BASES[2], len(points) + 1)
    points *= forth[:-1]
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points, out=sums[1:])
    runs = sums[size:] - sums[:-size] if len(points) >= size else np.zeros(0, np.uint64)
    runs *= back[: len(runs)]
    runs ^= runs >> np.uint64(32)
    runs *= np.uint64(0xD6E8FEB86659FD93)
    ends = np.cumsum([len(t) for t in full])
    inside = np.ones(len(runs), bool)  # not across two texts
    across = ranges(ends[:-1] - size + 1, np.full(max(0, len(ends) - 1), size - 1)) if len(ends) > 1 else np.zeros(0, np.int64)
    inside[across] = False
    return runs[inside], np.concatenate([[0], ends - (size - 1) * np.arange(1, len(ends) + 1)]).astype(np.int64)
