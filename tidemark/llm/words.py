"""Words and rolling fingerprints of Arrow text columns, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once.
STRETCH = 1 << 19
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words, by a polynomial over a random value for each byte."""

    def __init__(self) -> None:
        self.byte = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = 0x9E3779B97F4A7C15
        self.grow(STRETCH)

    def grow(self, n: int) -> None:
        step, back = np.full(n, self.base, np.uint64), np.full(n, pow(self.base, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        self.power, self.inverse = np.multiply.accumulate(step), np.multiply.accumulate(back)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        lo = 0
        while lo < len(starts):
            at = int(starts[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, at + STRETCH, "right")))
            n = int(ends[hi - 1]) - at
            if n > len(self.power):
                self.grow(n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.byte[data[at : at + n]] * self.power[:n], out=sums[1:])
            s, e = starts[lo:hi] - at, ends[lo:hi] - at
            out[lo:hi] = (sums[e] - sums[s]) * self.inverse[s]
            lo = hi
        return mixed(out)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and each text's bounds in them."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def stretches(bounds: np.ndarray, limit: int = 4 * STRETCH) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes each, or one longer text."""
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def words_in(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word of adjoining texts."""
    first, last = int(bounds[0]), int(bounds[-1])
    inside = ~_SPACES[data[first:last]]
    edge = bounds[:-1][np.diff(bounds) > 0] - first
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[edge] = inside[edge]
    ends[:-1] &= ~inside[1:]
    before = edge[edge > 0] - 1
    ends[before] = inside[before]
    s, e = np.flatnonzero(starts) + first, np.flatnonzero(ends) + first + 1
    return s, e, np.searchsorted(bounds, s, "right") - 1


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """A fingerprint of each run of ``k`` consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD1342543DE82EF95) + hashes[j : j + n]
    return mixed(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(values) - width + 1], out[width - span :])
    return out


def spaced_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow array, each with a space behind it, so that runs of them are text."""
    lengths = (ends - starts).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(int(bounds[-1]), 32, np.uint8)
    if len(lengths):
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(bounds[:-1], lengths) + within] = data[np.repeat(starts, lengths) + within]
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])
