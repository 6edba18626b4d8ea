"""Whole texts as one numpy byte array: word spans, word hashes, shingles.

All separators of the word patterns are ASCII, so UTF-8 bytes can be classed
one by one: a byte of 0x80 or more is always inside a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False

_R = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads its input (splitmix64's last steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            inverse = pow(_R, -1, 1 << 64)
            for name, r in (("up", _R), ("down", inverse)):
                a = np.full(size, r, np.uint64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up, cls.down


def text_bytes(column: pa.Array, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the rows [start, end) of a string column; null reads as empty."""
    part = column.slice(start, end - start)
    if part.null_count:
        part = pa.compute.fill_null(part, "")
    part = part.cast(pa.large_binary())
    offsets = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8)
    data = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] is not None and part.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of several texts: ``start``/``end`` byte positions, ``row`` of the text, ``first`` word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1 : n + 1] = kind[self.data]
        begins = inside[1:] & ~inside[:-1]
        ends = inside[:-1] & ~inside[1:]
        # a text's border ends a word even if both neighbours are word bytes
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        both = cut[inside[cut] & inside[cut + 1]]
        begins[both] = True
        ends[both] = True
        self.start = np.flatnonzero(begins[:n]) if n else np.zeros(0, np.int64)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.count)
        self._sums = None

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        up, down = _Powers.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * down[self.start]
        return mix(h ^ ((self.end - self.start).astype(np.uint64) << np.uint64(56)))

    def shingles(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``width`` words inside one row."""
        n = len(self) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        return at, roll(hashes, at, width)


def roll(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = mix(h + hashes[at + k] + np.uint64(k + 1))
    return h


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` bytes of ``data``."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
