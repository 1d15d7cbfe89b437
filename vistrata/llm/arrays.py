"""Texts of an Arrow batch as flat byte arrays: words, lines and their hashes, for a whole block of rows at once.

A block is a run of rows of about BLOCK bytes (one row alone may be longer), so memory is bounded by the longest
text, not by the batch. Words are runs of bytes other than 0x20 and 0x09-0x0D, which leaves UTF-8 sequences whole.
Hashes are 64-bit: bytes are mixed through a table, weighted by powers of an odd number and summed, so that any
range of a block is hashed by two look-ups in one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, i below n, modulo 2 ** 64."""
    if len(_POWERS["up"]) < n:
        for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset:]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `size` bytes and `rows` rows; a longer row is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = max(start + 1, min(end, start + rows, n))
        yield start, end
        start = end


class Block:
    """Rows start..end of a flat column, with the running hash of their bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, start: int, end: int, lower: bool = False):
        self.data = data[offsets[start]:offsets[end]]
        if lower:
            self.data = LOWER[self.data]
        self.offsets = offsets[start:end + 1] - offsets[start]
        self.rows = end - start
        self._sums = None

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a byte property over each row."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def edges(self, at: np.ndarray) -> np.ndarray:
        """Flags of bytes, True at the given row offsets that lie inside the block."""
        out = np.zeros(len(self.data) + 1, bool)
        out[at] = True
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts, byte ends and rows of all words."""
        if not len(self.data):
            return (np.zeros(0, np.int64),) * 3
        word = ~SEPARATOR[self.data]
        first, last = self.edges(self.offsets[:-1])[:-1], self.edges(self.offsets[1:])[1:]
        before = np.concatenate(([False], word[:-1]))
        after = np.concatenate((word[1:], [False]))
        starts = np.flatnonzero(word & (~before | first))
        ends = np.flatnonzero(word & (~after | last)) + 1
        return starts, ends, self.row_of(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts, byte ends (before the line break) and rows of all lines of non-empty rows."""
        breaks = np.flatnonzero(self.data == 10)
        full = np.flatnonzero(self.offsets[1:] > self.offsets[:-1])
        starts = np.sort(np.concatenate((self.offsets[full], breaks + 1)))
        ends = np.sort(np.concatenate((self.offsets[full + 1], breaks)))
        rows = np.sort(np.concatenate((full, self.row_of(breaks))))
        return starts, ends, rows

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range; equal for equal bytes anywhere in any block."""
        n = len(self.data)
        up, down = powers(max(1 << 16, n + 1))
        with np.errstate(over="ignore"):
            if self._sums is None:
                self._sums = np.zeros(n + 1, np.uint64)
                np.cumsum(BYTE_VALUE[self.data] * up[:n], out=self._sums[1:])
            out = (self._sums[ends] - self._sums[starts]) * down[starts]
            return mix(out + (ends - starts).astype(np.uint64) * BASE)


def grams(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of n words of one row."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:count] == rows[n - 1:])
    with np.errstate(over="ignore"):
        out = words[:count].copy()
        for j in range(1, n):
            out *= BASE
            out += words[j:j + count]
        return mix(out[at] + np.uint64(n)), at


def with_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Values that are equal only for equal values of one row."""
    with np.errstate(over="ignore"):
        return mix(values + mix(rows.astype(np.uint64) + np.uint64(1)))


def repeated(values: np.ndarray) -> np.ndarray:
    """Flags of values that occur more than once."""
    ordered = np.sort(values)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(values), bool)
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, values), len(twice) - 1)
    return twice[at] == values


def later(values: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Flags of the flagged values that equal an earlier flagged one."""
    at = np.flatnonzero(flags)
    out = flags.copy()
    out[at[np.unique(values[at], return_index=True)[1]]] = False
    return out


def covered(flags: np.ndarray, starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Flags of the n items inside runs of `width` items from the flagged starts."""
    hits = starts[flags]
    step = np.bincount(hits, minlength=n + 1) - np.bincount(hits + width, minlength=n + 1)
    return np.cumsum(step[:n]) > 0
