"""Fixed-size bitmaps of 64-bit keys: a bounded broadcast that thins a join's large side before the exact join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytegrid import mix

#: 2**27 bits are 16 MiB: the most a bitmap takes, however many keys there are.
MIN_BITS, MAX_BITS = 16, 27
#: Bits that a key gets where the bound allows.
BITS_A_KEY = 32
_BLOCK = 32768
#: Where a key's second slot begins.
SECOND = 31


def build(keys: DataFrame, column: str, most: int = MAX_BITS) -> np.ndarray:
    """The bitmap of ``column`` (long) of ``keys``, of 2**``most`` bits at most; built by the executors in blocks of 4 KiB.

    A key has two slots, its lowest bits and those above them.  More keys than the largest bitmap suits
    only let more rows pass: what follows is an exact join.
    """
    keys = keys.select(F.col(column).alias("k"))
    n = keys.count()
    bits = min(most, max(MIN_BITS, math.ceil(math.log2(max(1, n) * BITS_A_KEY))))
    slots = F.array(*[F.shiftrightunsigned("k", n).bitwiseAND(F.lit((1 << bits) - 1)) for n in (0, SECOND)])
    blocks = keys.select(F.explode(slots).alias("s")).groupBy(F.shiftright("s", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND(F.lit(_BLOCK - 1))).alias("m"))
    out = np.zeros(((1 << bits) + _BLOCK - 1) // _BLOCK * (_BLOCK // 8), np.uint8)
    for r in blocks.toLocalIterator():
        out[r.b * (_BLOCK // 8) : (r.b + 1) * (_BLOCK // 8)] = np.frombuffer(r.m, np.uint8)
    return out


class Sieve:
    """Blocks of 4 KiB; a key has its three slots in one of them, spread apart for keys that differ in few bits."""

    #: Bits that a key gets, and gets at least; where a key's slots begin; where its block does.
    BITS, LEAST, SLOTS, PLACE = 16, 8, (0, 15, 30), 40

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    @staticmethod
    def places(keys: np.ndarray, n: int) -> np.ndarray:
        return ((keys >> np.uint64(Sieve.PLACE)) % np.uint64(n)).astype(np.int64)

    @staticmethod
    def slot(keys: np.ndarray, at: int) -> np.ndarray:
        return ((keys >> np.uint64(at)) & np.uint64(_BLOCK - 1)).astype(np.int64)

    def test(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        place, flat = self.places(keys, len(self.blocks)) * (_BLOCK // 8), self.blocks.ravel()
        at, keys = np.arange(len(keys)), mix(keys)
        for first in self.SLOTS:
            slot = self.slot(keys[at], first)
            hit = (flat[place[at] + (slot >> 3)] >> (slot & 7).astype(np.uint8)) & 1 != 0
            out[at[~hit]] = False
            at = at[hit]
        return out


def parts(n: int, most: int) -> int:
    """In how many parts ``n`` keys have to go so that a sieve of 2**``most`` bits gives each key enough of them."""
    return max(1, -(-n * Sieve.LEAST // (1 << most)))


def sieve(keys: DataFrame, column: str, most: int) -> Sieve:
    """The :class:`Sieve` of ``column`` (long, well mixed) of ``keys``, of 2**``most`` bits at most: unlike a bitmap's its size follows the number of keys."""
    from tessera.llm.common import drop_settled, settle

    keys = keys.select(F.col(column).alias("k"))
    n = keys.count()
    blocks = max(1, min(-(-n * Sieve.BITS // _BLOCK), (1 << most) // _BLOCK))
    session = keys.sparkSession
    tasks = max(1, min(blocks, max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy().view(np.uint64) for b in batches]
        if not held:
            return
        k = np.concatenate(held)
        place = Sieve.places(k, blocks)
        order = np.argsort(place)
        k, place = k[order], place[order]
        begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        for a, b in zip(begins, np.append(begins[1:], len(k)), strict=True):
            bits, mixed = np.zeros(_BLOCK, bool), mix(k[a:b])
            for first in Sieve.SLOTS:
                bits[Sieve.slot(mixed, first)] = True
            yield pa.RecordBatch.from_arrays([pa.array([int(place[a])], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["b", "m"])

    dealt = keys.repartition(tasks, F.shiftrightunsigned("k", Sieve.PLACE) % F.lit(blocks))
    made = settle(dealt.mapInArrow(fill, "b long, m binary"))
    out = np.zeros((blocks, _BLOCK // 8), np.uint8)
    for r in made.toLocalIterator():
        out[r.b] = np.frombuffer(r.m, np.uint8)
    drop_settled(made)
    return Sieve(out)


def test(bitmap: np.ndarray | Sieve, keys: np.ndarray) -> np.ndarray:
    """Which of the uint64 ``keys`` may be in the bitmap."""
    if isinstance(bitmap, Sieve):
        return bitmap.test(keys)
    out = _bit(bitmap, keys)
    at = np.flatnonzero(out)
    out[at] = _bit(bitmap, keys[at] >> np.uint64(SECOND))
    return out


def _bit(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 != 0
