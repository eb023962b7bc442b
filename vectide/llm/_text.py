"""Vectorised text primitives over Arrow string batches.

A batch of documents is viewed as one UTF-8 byte buffer plus offsets; words,
hashes and n-grams of all its documents come from a few NumPy passes, so no
Python loop runs over words or characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 4096)
            for name, base in (("up", self.base), ("down", self.inverse)):
                v = np.full(size, base, dtype=np.uint64)
                v[0] = 1
                setattr(self, name, np.multiply.accumulate(v))
        return self.up, self.down


BYTES, WORDS = Powers(0xD1342543DE82EF95), Powers(0xAF251AF3B0F025B5)


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[s:e] for each pair (s, e), independent of where it stands."""
    up, down = powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64) * U(0x9E3779B97F4A7C15)
    return mix64(h)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer text stands alone, whole."""
    b, o = utf8(column)
    row, n = 0, len(o) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(o, o[row] + limit, "right")) - 1)
        yield row, end, b[o[row] : o[end]], o[row : end + 1] - o[row]
        row = end


def words(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document) of all words; the last has one entry more than there are documents."""
    w = ~SPACE[b]
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    cut = offsets[(offsets > 0) & (offsets < len(b))]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    first[cut] = w[cut]
    last[cut - 1] = w[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return rolled(_TABLE[b], starts, ends, BYTES)


def hash_strings(values: list[str]) -> np.ndarray:
    """The hash that :func:`word_hashes` gives to each of these words."""
    b, o = utf8(pa.array(values, pa.string()))
    return word_hashes(b, o[:-1], o[1:])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


class HashTable:
    """A read-only map from 64-bit keys to row numbers, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        bits = max(4, int(2 * self.n + 1).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)
        self.longest = 0
        left, step = np.arange(self.n, dtype=np.int32), 0
        slot = self._home(keys)
        while len(left):
            at = (slot[left] + step) & self.mask
            free = self.rows[at] < 0
            # of rows that want the same free slot the last written wins; the others go on
            self.rows[at[free]] = left[free]
            won = self.rows[at] == left
            self.keys[at[won]] = keys[left[won]]
            left, step = left[~won], step + 1
        self.longest = max(1, step)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 if there is none."""
        if not self.n:
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        rows = self.rows[at]
        out = np.where(self.keys[at] == keys, rows, np.int32(-1))
        left = np.flatnonzero((out < 0) & (rows >= 0))
        for step in range(1, self.longest):
            if not len(left):
                break
            at2 = (at[left] + step) & self.mask
            rows = self.rows[at2]
            hit = (self.keys[at2] == keys[left]) & (rows >= 0)
            out[left[hit]] = rows[hit]
            left = left[~hit & (rows >= 0)]
        out[(out < 0)] = -1
        return out
