"""Word hashes of whole text batches in numpy.

A word is a maximal run of bytes other than space and tab to carriage return.
Its hash is a polynomial over random 64-bit values of its bytes, taken from one
running sum over the batch, then finalised; work and memory are linear in the
bytes, and a long text is summed in pieces cut between words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_PIECE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * U(_ODD))
_LOWERED = _VALUES.copy()
_LOWERED[65:91] = _VALUES[97:123]
_POWERS: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [_powers(_ODD, max(n, _PIECE + 4096)), _powers(pow(_ODD, -1, 1 << 64), max(n, _PIECE + 4096))]
    return _POWERS[0], _POWERS[1]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and where each row starts; one more entry ends it."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, hashes, and each row's first word (one more entry ends it)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:]
    end = inside
    end[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = np.empty(len(starts), np.uint64)
    values, k = _LOWERED if lower else _VALUES, 0
    while k < len(starts):
        at = starts[k]
        # at least one word, and all that end within a piece
        to = max(k + 1, int(np.searchsorted(ends, at + _PIECE, "right")))
        piece = values[data[at:ends[to - 1]]]
        power, inverse = _tables(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * power[:len(piece)], out=sums[1:])
        s, e = starts[k:to] - at, ends[k:to] - at
        hashes[k:to] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93)
        k = to
    return starts, ends, mix64(hashes), np.searchsorted(starts, offsets)


_STEPS = mix64(np.arange(101, 165, dtype=np.uint64) * U(_ODD)) | U(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring words of the batch."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += hashes[k:k + m] * _STEPS[k]
    return mix64(out)


def rows_of(firsts: np.ndarray) -> np.ndarray:
    """The row of each word, from each row's first word."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
