"""Similarity of strings, token lists and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaccard(a: Column, b: Column, missing: float | None = 0.0) -> Column:
    """Shared part of two token lists: 1 if both are empty, 0 if one is.

    A missing list gives ``missing``; with None it is read as an empty list.
    """
    if missing is None:
        empty = F.array().cast("array<string>")
        return jaccard(F.coalesce(a, empty), F.coalesce(b, empty))
    both = F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), F.lit(missing)).when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both)


def overlap(a: Column, b: Column) -> Column:
    """How many different numbers both lists hold."""
    return F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0))


def conflict(a: Column, b: Column) -> Column:
    """1 if both lists hold numbers but share none."""
    return F.coalesce(((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)).cast("int"), F.lit(0))


def lcs_prefixes(a_bits: dict[str, int], m: int, b: str) -> list[int]:
    """Length of the longest common subsequence of a text (its position bits by character) with each prefix of ``b``."""
    full, v, out = (1 << m) - 1, (1 << m) - 1, []
    for c in b:
        u = v & a_bits.get(c, 0)
        v = ((v + u) | (v - u)) & full
        out.append(m - v.bit_count())
    return out


def position_bits(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; 1 for two empty texts."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    return 2.0 * lcs_prefixes(position_bits(a), len(a), b)[-1] / (len(a) + len(b))


def best_window_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of its length of the longer one, or with one cut off at an end."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    return max(_windows(short, long_), _windows(long_, short)) if len(a) == len(b) else _windows(short, long_)


def _windows(short: str, long_: str) -> float:
    bits, m, best = position_bits(short), len(short), 0.0
    if short in long_:
        return 1.0
    for i in range(len(long_)):
        window = long_[i : i + m]
        if 2.0 * min(m, len(window)) / (m + len(window)) <= best:
            continue
        lengths = lcs_prefixes(bits, m, window)
        # from the start every prefix is a window too; later on only the full one or the text's end
        for k in range(1, len(window) + 1) if i == 0 else (len(window),):
            best = max(best, 2.0 * lengths[k - 1] / (m + k))
    return best


#: Texts up to so many characters are compared many pairs at once, as two words of 64 bits; longer ones pair by pair.
_WIDE = 128
#: Pairs compared at once, and pairs whose windows are.
_PAIRS, _WINDOW_PAIRS = 256, 1024


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, filled up with 0 beyond the end; lengths) of texts."""
    lengths = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), max(1, int(lengths.max()))), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, lengths


def _places(short: np.ndarray, m: np.ndarray, long_: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(pair, character of the long text, word): at which places of the short text the character stands, as bits."""
    same = np.zeros((*long_.shape, _WIDE), bool)
    same[:, :, : short.shape[1]] = (long_[:, :, None] == short[:, None, :]) & (np.arange(long_.shape[1]) < n[:, None])[:, :, None] & (np.arange(short.shape[1]) < m[:, None])[:, None, :]
    return np.packbits(same, axis=2, bitorder="little").view("<u8")


def _step(v: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The next row of the table of common subsequences, kept as two words of bits a row."""
    u = v & bits
    low = v[..., 0] + u[..., 0]
    high = v[..., 1] + u[..., 1] + (low < u[..., 0])
    return np.stack([low, high], -1) | (v & ~bits)


def _common(v: np.ndarray, full: np.ndarray) -> np.ndarray:
    """The length that a row tells: the bits that are gone."""
    return np.bitwise_count(~v & full).sum(-1, dtype=np.int64)


def _full(m: np.ndarray) -> np.ndarray:
    return np.packbits(np.arange(_WIDE) < m[:, None], axis=1, bitorder="little").view("<u8")


def _ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """:func:`indel_ratio` of pairs of texts that are not empty."""
    (a, m), (b, n) = _coded([x for x, _ in pairs]), _coded([y for _, y in pairs])
    bits, v = _places(a, m, b, n), np.full((len(pairs), 2), ~np.uint64(0))
    for j in range(b.shape[1]):
        v = _step(v, bits[:, j])
    return 2.0 * _common(v, _full(m)) / (m + n)


def _bytes(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, pair) of both texts' characters as small numbers; what lies beyond a text's end equals nothing."""
    if max(a.max(), b.max()) > 253:
        kinds, each = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
        a, b = each[: a.size].reshape(a.shape), each[a.size :].reshape(b.shape)
        small = np.uint8 if len(kinds) <= 253 else np.uint16
    else:
        small = np.uint8
    out = []
    for x, size, beyond in ((a, m, -1), (b, n, -2)):
        x = x.T.astype(small)
        x[np.arange(len(x))[:, None] >= size] = np.iinfo(small).max + 1 + beyond
        out.append(x)
    return out[0], out[1]


def _combed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Semi-local comparison (Tiskin's combing) of pairs (position, pair): which strand ends at each row of the first text, from its end on, and at each column of the second.

    Strands 0 and up begin at the rows, from the last one on, those from len(a) on at the columns.
    LCS(a, b[i:j]) is j - i less the strands from len(a) + i on that end at a column before j.
    """
    m, n = len(a), len(b)
    a = np.ascontiguousarray(a[::-1])
    h = np.repeat(np.arange(m, dtype=np.uint8)[:, None], a.shape[1], 1)
    v = np.repeat(np.arange(m, m + n, dtype=np.uint8)[:, None], a.shape[1], 1)
    turned_, same_, other = np.empty((3, min(m, n), a.shape[1]), np.uint8)
    for d in range(m + n - 1):
        # one diagonal of the table: its cells do not depend on each other
        lo, hi = max(0, d - n + 1), min(d, m - 1)
        rows, columns = slice(m - 1 - hi, m - lo), slice(d - hi, d - lo + 1)
        x, y, turned, same = h[rows], v[columns], turned_[: hi - lo + 1], same_[: hi - lo + 1]
        # strands that meet at equal characters turn, others cross unless they have crossed before
        np.equal(a[rows], b[columns], out=same.view(bool))
        np.negative(same, out=same)
        np.minimum(x, y, out=turned)
        same &= np.bitwise_xor(turned, y, out=other[: hi - lo + 1])
        turned ^= same
        y ^= x
        y ^= turned
        x[:] = turned
    return h, v


def _window_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The best ratio of each first text, not the longer one, with the windows of the second; of texts of one length also the other way."""
    (a, m), (b, n) = _coded([x for x, _ in pairs]), _coded([y for _, y in pairs])
    a, b = _bytes(a, m, b, n)
    rows, columns = len(a), len(b)
    h, v = _combed(a, b)
    m, n = m.astype(np.uint16), n.astype(np.uint16)
    count = lambda some: np.add.reduce(some.view(np.uint8), 0, dtype=np.uint8)
    crossed = np.uint16(columns) - count(v >= rows)
    v[np.arange(columns)[:, None] >= n] = 0
    inside = np.arange(rows)[:, None] < m
    best = _Highest(len(pairs))
    for i in range(columns):
        size = np.minimum(m, np.maximum(n, i) - np.uint16(i))
        some = v[i : i + rows] >= rows + i
        some &= inside[: len(some)]
        best.add(size - count(some), m + size)
    # from the start every prefix is a window too
    before = np.zeros(len(pairs), np.uint16)
    for k in range(1, min(rows, columns) + 1):
        before += v[k - 1] >= rows
        best.add((np.uint16(k) - before) * (k <= m), m + np.uint16(k))
    out = best.ratios()
    even = np.flatnonzero(m == n)
    if len(even):
        h, v, crossed, m = h[:, even], v[:, even], crossed[even], m[even]
        best = _Highest(len(even))
        for k in range(rows):
            size = np.maximum(m, k) - np.uint16(k)
            best.add((m - count(v >= rows - k)) * (size > 0), m + size)
        for k in range(rows, 0, -1):
            best.add(crossed * (k <= m), m + np.uint16(k))
            crossed = crossed - (h[rows - k] >= rows)
        out[even] = np.maximum(out[even], best.ratios())
    return out


class _Highest:
    """The highest of fractions ``common`` / ``total``, compared in whole numbers (no product is over 2^15)."""

    def __init__(self, n: int):
        self.common, self.total = np.zeros(n, np.uint16), np.ones(n, np.uint16)

    def add(self, common: np.ndarray, total: np.ndarray) -> None:
        more = common * self.total > self.common * total
        np.copyto(self.common, common, where=more)
        np.copyto(self.total, total, where=more)

    def ratios(self) -> np.ndarray:
        return 2.0 * self.common / self.total


def ratios(pairs: list[tuple[str, str]], windows: bool = False) -> np.ndarray:
    """:func:`indel_ratio`, or with ``windows`` :func:`best_window_ratio`, of many pairs."""
    out = np.array([float(not a and not b) for a, b in pairs])
    both = [i for i, (a, b) in enumerate(pairs) if a and b]
    wide = [i for i in both if max(map(len, pairs[i])) <= _WIDE]
    for i in set(both) - set(wide):
        out[i] = (best_window_ratio if windows else indel_ratio)(*pairs[i])
    wide.sort(key=lambda i: (len(pairs[i][0]) + len(pairs[i][1]), i))
    at_once = _WINDOW_PAIRS if windows else _PAIRS
    for lo in range(0, len(wide), at_once):
        part = wide[lo : lo + at_once]
        if not windows:
            out[part] = _ratios([pairs[i] for i in part])
            continue
        out[part] = _window_ratios([tuple(sorted(pairs[i], key=len)) for i in part])
    return out


def _each_once(batches: Iterator[tuple[pd.Series, pd.Series]], windows: bool) -> Iterator[pd.Series]:
    """The ratios of every pair, worked out once for equal pairs of a batch; both orders of a pair give the same."""
    for a, b in batches:
        keys = [(x, y) if x <= y else (y, x) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)]
        known = dict.fromkeys(keys)
        known = dict(zip(known, ratios(list(known), windows).tolist(), strict=True)) if known else {}
        yield pd.Series([known[k] for k in keys], dtype="float64")


@F.pandas_udf(DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    yield from _each_once(pairs, False)


@F.pandas_udf(DoubleType())
def partial_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    yield from _each_once(pairs, True)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))
