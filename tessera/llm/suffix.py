"""Removal of long repeated byte strings by prefix doubling over sampled positions.

A string of ``LENGTH`` bytes is removed where the same string starts in a
document with a smaller id.  Positions get names (ranks that only tell equal
from different) at growing lengths, each from a pair of names at two offsets;
positions whose name is unique leave before the next length:

1. ``SEED`` bytes.  Of every window of ``LENGTH`` bytes only its anchor, the
   position with the smallest seed name inside it, is named.  Equal windows
   have equal anchors at equal offsets, so nothing is lost.  A window has 12
   bytes before its seed or 13 behind it, so it repeats only if the seed does
   with these: the names of such longer strings are counted, packed to 5 bytes
   each, and anchors whose strings are found in one document only end here.
2. The stretch of windows that share an anchor, named by the pair (seed name,
   name of the whole stretch).  A stretch that also stands in a smaller
   document is removed as a whole.
3. Windows, only in stretches whose seed has several different stretches:
   names of ``LENGTH`` bytes, each from the pair of ``SEED``-byte names at
   offsets 0 and 25.

Texts never move for this.  They are read once for each step, and only the
texts that lose bytes are joined with their spans at the end, a share of the
documents at a time.  Of equal texts only those of the smallest id go through
the steps: the others lose all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm.bytegrid import _BYTE, _Powers, mix, signed, text_bytes
from tessera.llm.common import drop_settled, lean, pieces, settle, table

LENGTH, SEED = 50, 25
#: Bytes handed to numpy at once; what it holds then fits in a core's cache.
PIECE = 1 << 18
#: What share of all spots makes a stretch's class a hot one.
HOT_SHARE = 1000
#: Stretches of one seed that a task may hold at once.
SEED_STRETCHES = 20_000
#: Bytes beside its seed, before or behind, of which every window has the one or the other.
BEFORE, BEHIND = (LENGTH - SEED) // 2, LENGTH - SEED - (LENGTH - SEED) // 2
#: Names that a task sorts before it passes them on, and the most bits of a sieve of names.
HELD_NAMES, NAME_BITS = 1 << 21, 30
#: Copies of whole texts that are told to every task; what is beyond goes through all steps.
COPIES = 1 << 22
#: Stretches whose spans are worked out at once, about, and in how many shares of the documents at most.
SPOTS, SHARES = 1 << 22, 6
#: The lowest bits of a name are its seed's: by them names and stretches are parted alike.
_PARTED = 8
#: Of a name so many bits are passed on; the others tell where to.  Names that agree in them cost time, not results.
_PACKED = 40
_LAST = (1 << 63) - 1


class Stretches:
    """The stretches of windows with one anchor of the texts in ``data``: ``row``, ``lo`` and ``hi`` (first and last window), ``seed``, ``name``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        n = len(data)
        up, down = _Powers.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
        self._sums, self._down = sums, down
        if n < LENGTH:
            self.lo = self.hi = self.row = np.zeros(0, np.int64)
            self.seed = self.name = np.zeros(0, np.uint64)
            self._anchor = self.lo
            return
        self.names = (sums[SEED:] - sums[:-SEED]) * down[: n - SEED + 1]
        self.names *= np.uint64(0xBF58476D1CE4E5B9)
        # 32 bits of the hash and then the place: an order that does not depend on where the texts stand in ``data``
        place = np.uint64(0xFFFFFFFF)
        low = self.names ^ (self.names >> np.uint64(29))
        low *= np.uint64(0x94D049BB133111EB)
        low &= ~place
        low |= np.arange(len(low), dtype=np.uint64)
        wide, size = LENGTH - SEED + 1, 1
        while 2 * size <= wide:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < wide:
            low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
        at = (low & place).astype(np.int64)
        ok = np.ones(len(at) + 2, bool)
        ok[0] = ok[-1] = False
        for o in offsets[1:-1].tolist():
            ok[1 + max(0, o - LENGTH + 1) : 1 + min(o, len(at))] = False
        differ = np.ones(len(at) + 1, bool)
        differ[1:-1] = at[1:] != at[:-1]
        self.lo = np.flatnonzero(ok[1:-1] & (~ok[:-2] | differ[:-1]))
        self.hi = np.flatnonzero(ok[1:-1] & (~ok[2:] | differ[1:]))
        self._anchor = anchor = at[self.lo]
        self.seed = mix(self.names[anchor])
        whole = (sums[self.hi + LENGTH] - sums[self.lo]) * down[self.lo]
        self.name = mix(whole ^ ((self.hi - self.lo).astype(np.uint64) << np.uint64(56)) ^ ((anchor - self.lo).astype(np.uint64) << np.uint64(48)))
        self.row = np.searchsorted(offsets, self.lo, side="right") - 1

    def sides(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(stretches, names) of the seeds with the bytes before them, and of those with the bytes behind, where some window has these."""
        n = len(self.lo) and len(self.data)
        for have, a, b, tag in ((self._anchor - self.lo >= BEFORE, -BEFORE, SEED, 1), (self._anchor - self.hi <= BEFORE, 0, SEED + BEHIND, 2)) if n else ():
            which = np.flatnonzero(have)
            at = self._anchor[which]
            name = mix((self._sums[at + b] - self._sums[at + a]) * self._down[at + a] ^ np.uint64(tag << 60))
            low = np.uint64((1 << _PARTED) - 1)
            yield which, name & ~low | self.seed[which] & low

    def windows(self, which: np.ndarray) -> list[np.ndarray]:
        """Names of the windows of the stretches ``which``: pairs of seed names, SEED bytes apart."""
        out = []
        for lo, hi in zip(self.lo[which].tolist(), self.hi[which].tolist(), strict=True):
            one = self.names[lo : hi + LENGTH - SEED + 1]
            out.append(mix(mix(one[:-SEED]) + one[SEED:]))
        return out


class Copies:
    """Which rows (by ord and key) have the text of a row of a smaller id."""

    def __init__(self, key: np.ndarray, ord_: np.ndarray):
        order = np.argsort(key)
        self.key, self.ord = key[order], ord_[order]

    def test(self, key: np.ndarray, ord_: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(key), bool), np.searchsorted(self.key, key)
        while len(self.key):
            # keys of different rows may be equal
            same = (at < len(self.key)) & (self.key[np.minimum(at, len(self.key) - 1)] == key)
            if not same.any():
                break
            out |= same & (self.ord[np.minimum(at, len(self.key) - 1)] == ord_)
            at = at + 1
        return out


def _copies(keyed: DataFrame) -> Copies:
    """The rows whose whole text, of ``LENGTH`` bytes at least, a smaller id has too; texts are equal if two 64-bit hashes of them are."""
    hashed = keyed.filter(F.octet_length("text") >= LENGTH).select("ord", F.xxhash64("ord", "text").alias("key"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"))
    more = hashed.withColumn("least", F.min("ord").over(Window.partitionBy("a", "b"))).filter("ord > least").select("key", "ord").distinct()
    more = settle(more)
    shares = -(-more.count() // COPIES)
    rows = (more.filter(F.pmod("key", F.lit(shares)) == 0) if shares > 1 else more).toArrow()
    drop_settled(more)
    return Copies(*(c.to_numpy() for c in rows.columns))


def _each(batches: Iterator[pa.RecordBatch], text_at: int, copies: Copies | None = None) -> Iterator[tuple[pa.RecordBatch, int, int, Stretches, np.ndarray]]:
    """The stretches of some rows of a batch at a time; the rows of ``copies``, by the columns ord and key, are left out."""
    for batch in batches:
        if copies is not None:
            batch = batch.filter(pa.array(~copies.test(*(batch.column(c).to_numpy() for c in ("key", "ord")))))
        for lo, hi in pieces(batch, text_at, PIECE):
            data, offsets = text_bytes(batch.column(text_at), lo, hi)
            yield batch, lo, hi, Stretches(data, offsets), offsets


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(ord, text): null ids come after all others, null texts are empty."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("ord"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _packed(names: np.ndarray) -> bytes:
    """The lowest 40 bits of sorted names, byte by byte: the first bytes of neighbours are alike."""
    return names.view(np.uint8).reshape(-1, 8)[:, : _PACKED // 8].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // (_PACKED // 8), 8), np.uint8)
    out[:, : _PACKED // 8] = np.frombuffer(data, np.uint8).reshape(_PACKED // 8, -1).T
    return out.view(np.uint64).ravel()


def _short(names: np.ndarray) -> np.ndarray:
    """What is known of a name that was passed on, spread over 64 bits."""
    return mix(names & np.uint64((1 << _PACKED) - 1))


def _shared(keyed: DataFrame, copies: Copies | None = None) -> DataFrame:
    """(k, part): :func:`_short` and the lowest bits of the names (:meth:`Stretches.sides`) that stand in different rows; rows of one id that repeat a text count as different here."""
    session = keyed.sparkSession
    told = session.sparkContext.broadcast(copies)
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    places = np.uint64(min(8 * tasks, 1 << (64 - _PACKED)))
    low = np.uint64(_PACKED)

    def out(names: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        x, row = np.concatenate(names), np.concatenate(rows)
        x = ((x >> low) % places) << low | x & np.uint64((1 << _PACKED) - 1)
        order = np.argsort(x)
        x, row = x[order], row[order]
        same = np.concatenate([[False], x[1:] == x[:-1]])
        again = same & np.concatenate([[False], row[1:] != row[:-1]])
        first = np.flatnonzero(~same)
        more = np.logical_or.reduceat(again, first)
        x = x[first]
        place = (x >> low).astype(np.int64)
        at = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(x)]])
        each = list(zip(at, at[1:], strict=False))
        once = [_packed(x[a:b][~more[a:b]]) for a, b in each]
        often = [_packed(x[a:b][more[a:b]]) for a, b in each]
        return pa.RecordBatch.from_arrays([pa.array(place[at[:-1]]), pa.array(once, pa.binary()), pa.array(often, pa.binary())], ["place", "once", "often"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows, held, begun = [], [], 0, 0
        for _, lo, hi, s, _ in _each(batches, 0, told.value):
            for which, x in s.sides():
                names.append(x)
                rows.append(s.row[which] + begun)
                held += len(x)
            begun += hi - lo
            if held >= HELD_NAMES:
                yield out(names, rows)
                names, rows, held = [], [], 0
        if held:
            yield out(names, rows)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, once, often = None, [], []

        def found() -> pa.RecordBatch:
            x = np.sort(np.concatenate([_unpacked(b) for b in once]))
            both = np.concatenate([x[1:][x[1:] == x[:-1]], *(_unpacked(b) for b in often)])
            both = np.unique(both)
            return pa.RecordBatch.from_arrays([pa.array(signed(_short(both))), pa.array((both & np.uint64((1 << _PARTED) - 1)).astype(np.int32))], ["k", "part"])

        for batch in batches:
            for p, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if p != place and place is not None:
                    yield found()
                    once, often = [], []
                place = p
                once.append(a)
                often.append(b)
        if place is not None:
            yield found()

    blocks = keyed.select("text", "ord", F.xxhash64("ord", "text").alias("key")).mapInArrow(lean(pack), "place long, once binary, often binary")
    return blocks.repartition(tasks, "place").sortWithinPartitions("place").mapInArrow(lean(common), "k long, part int")


def _found(docs: DataFrame, keep: list[str], doc_id: str, text: str, names: np.ndarray | bitmap.Sieve, copies: Copies | None = None, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """Each row's columns ``keep`` with ord, n_bytes, key, text_sha256, whether it is of ``copies``, and its stretches of shared names.

    ``part`` (which, of how many) takes the stretches of that part of the seeds only.
    """
    import pyspark.sql.types as T

    shared, told = docs.sparkSession.sparkContext.broadcast(names), docs.sparkSession.sparkContext.broadcast(copies)
    one = T.StructType([T.StructField("seed", T.LongType()), T.StructField("name", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("__ord", T.LongType()), T.StructField("__key", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("__sha", T.StringType()), T.StructField("__copy", T.BooleanType()), T.StructField("__found", T.ArrayType(one))])
    kind = pa.list_(pa.struct([("seed", pa.int64()), ("name", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))
    k = len(keep)

    def no_copies(batches: Iterator[pa.RecordBatch], held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = told.value.test(batch.column(k + 1).to_numpy(), batch.column(k).to_numpy())
            if gone.any():
                held.append(batch.filter(pa.array(gone)))
                batch = batch.filter(pa.array(~gone))
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch, lo, hi, s, offsets in _each(no_copies(batches, held) if told.value is not None else batches, k + 2):
            while held:
                yield copied(held.pop())
            some = np.zeros(len(s.lo), bool)
            for which, x in s.sides():
                if part[1] > 1:
                    own = np.flatnonzero((x & np.uint64((1 << _PARTED) - 1)) % np.uint64(part[1]) == part[0])
                    which, x = which[own], x[own]
                some[which] |= bitmap.test(shared.value, _short(x))
            pick = np.flatnonzero(some)
            rows = s.row[pick]
            base = offsets[rows]
            found = pa.StructArray.from_arrays([pa.array(signed(s.seed[pick])), pa.array(signed(s.name[pick])), pa.array((s.lo[pick] - base).astype(np.int32)), pa.array((s.hi[pick] - base).astype(np.int32))], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int32)), found)
            flat, cut = s.data, offsets.tolist()
            sha = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in range(k + 2)), pa.array(np.diff(offsets)), pa.array(sha, pa.string()), pa.array(np.zeros(hi - lo, bool)), lists], [f.name for f in schema])
        while held:
            yield copied(held.pop())

    def copied(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        size = pa.compute.binary_length(batch.column(k + 2)).cast(pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[: k + 2], size, pa.array([hashlib.sha256(b"").hexdigest()] * n, pa.string()), pa.array(np.ones(n, bool)), pa.array([[]] * n, kind)], [f.name for f in schema])

    source = docs.withColumns({"__ord": F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)), "__text": F.coalesce(F.col(text).cast("string"), F.lit(""))})
    return source.select(*[F.col(c) for c in keep], "__ord", F.xxhash64("__ord", "__text").alias("__key"), "__text").mapInArrow(lean(run), schema)


def _parts(keyed: DataFrame, mixed: DataFrame) -> DataFrame:
    """(seed, name, part): of the stretches ``mixed`` the windows that a stretch of the same seed in a smaller document has too.

    Each stretch is read again in its smallest document.  The stretches of a
    seed meet in one task, which goes through them by document and holds their
    window names; of seeds with more than ``SEED_STRETCHES`` stretches the
    windows themselves are spread over all tasks and joined.
    """
    key = lambda df: bitmap.sieve(df.select(F.col("name").bitwiseXOR(F.col("least")).alias("k")), "k", NAME_BITS)
    few, many = mixed.filter(F.col("n") <= SEED_STRETCHES), mixed.filter(F.col("n") > SEED_STRETCHES)
    asked = few.select("seed", "name", "least", F.lit(None).cast("array<long>").alias("windows"))
    rows = _windows_of(keyed, key(few)).unionByName(asked).repartition("seed").sortWithinPartitions("seed", "least", "name", F.col("windows").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, least, due, seen, new = None, None, None, set(), []
        out: list[list] = [[], [], []]
        for batch in batches:
            windows = batch.column(3)
            flat, cut = windows.values.to_numpy(zero_copy_only=False), windows.offsets.to_numpy()
            empty = windows.is_null().to_pylist()
            for i, (s, n, o) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if s != seed:
                    seed, least, due, seen, new = s, o, None, set(), []
                elif o != least:
                    seen.update(*new)
                    least, new = o, []
                if empty[i]:
                    due = (n, o)
                elif due == (n, o):
                    due = None
                    own = flat[cut[i] : cut[i + 1]].tolist()
                    part = [j for j, w in enumerate(own) if w in seen] if seen else []
                    new.append(own)
                    if part:
                        for column, v in zip(out, (s, n, part), strict=True):
                            column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], ["seed", "name", "part"])
                out = [[], [], []]

    part = rows.mapInArrow(lean(run), "seed long, name long, part array<int>")
    if many.isEmpty():
        return part
    stretches = _windows_of(keyed, key(many)).groupBy("seed", "name", "least").agg(F.first("windows").alias("windows"))
    windows = settle(stretches.join(many.select("seed", "name", "least"), ["seed", "name", "least"]))
    each = windows.select("seed", "name", "least", F.posexplode("windows").alias("j", "w"))
    # windows are equal if their seeds and their own names are: 128 bits, as for whole stretches
    lowest = each.groupBy("seed", "w").agg(F.min("least").alias("first"), F.max("least").alias("last")).filter("first < last").select("seed", "w", "first")
    return part.unionByName(each.join(lowest, ["seed", "w"]).filter("least > first").groupBy("seed", "name").agg(F.sort_array(F.collect_set("j")).alias("part")))


class Repeats:
    """What the steps leave: each row's ``keep`` with its stretches (``found``), and the stretches to remove (``told``)."""

    def __init__(self, docs: DataFrame, keep: list[str], doc_id: str, text: str):
        keyed = _keyed(docs, doc_id, text)
        copies = _copies(keyed)
        names = settle(_shared(keyed, copies))
        n = bitmap.parts(names.count(), NAME_BITS)
        sieves = (bitmap.sieve(names.filter(F.col("part") % n == i) if n > 1 else names, "k", NAME_BITS) for i in range(n))
        founds = [settle(_found(docs, keep if i == 0 else [], doc_id, text, x, copies, (i, n)).filter("size(__found) > 0" if i else "true")) for i, x in enumerate(sieves)]
        drop_settled(names)
        self.rows = founds[0]
        each = [f.select("__ord", "__key", F.explode("__found").alias("f")).select("__ord", "__key", "f.*") for f in founds]
        self.spots = spots = reduce(DataFrame.union, each)
        classes = settle(spots.groupBy("seed", "name").agg(F.min("__ord").alias("least"), F.max("__ord").alias("most"), F.count("*").alias("spots")))
        several = classes.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1")
        mixed = settle(classes.join(several, "seed").select("seed", "name", "least", "n"))
        part = settle(_parts(keyed, mixed))
        drop_settled(mixed)
        self.count = classes.agg(F.sum("spots")).first()[0] or 0
        self.told = settle(classes.join(part, ["seed", "name"], "left").filter("least < most OR part IS NOT NULL").select("seed", "name", "least", "part", "spots"))
        drop_settled(classes, part)

    def spans(self, share: Column | None = None) -> DataFrame:
        """(__ord, __key, s, e) byte spans to remove, not yet merged, without those of copies; of the rows of ``share`` only."""
        # a stretch that has more than one in HOT_SHARE of all spots is told to every task (there are fewer than HOT_SHARE of them); the others meet by a shuffle
        hot = self.count / HOT_SHARE
        few, many = self.told.filter(F.col("spots") <= hot).drop("spots"), self.told.filter(F.col("spots") > hot).drop("spots")
        spots = self.spots if share is None else self.spots.filter(share)
        common = spots.join(F.broadcast(many), ["seed", "name"])
        cold = spots.join(F.broadcast(many.select("seed", "name")), ["seed", "name"], "left_anti")
        hit = cold.join(few, ["seed", "name"]).unionByName(common)
        whole = F.array(F.struct(F.col("lo").alias("s"), (F.col("hi") + LENGTH).alias("e")))
        some = F.transform("part", lambda j: F.struct((F.col("lo") + j).alias("s"), (F.col("lo") + j + LENGTH).alias("e")))
        hit = hit.select("__ord", "__key", F.explode(F.when(F.col("__ord") > F.col("least"), whole).otherwise(some)).alias("x"))
        return hit.select("__ord", "__key", "x.s", "x.e")


def repeated_spans(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): each row's ``keep``, __ord, __key, n_bytes, __sha, __copy; and (__ord, __key, s, e) byte spans to remove, not yet merged."""
    found = Repeats(docs, keep, doc_id, text)
    whole = found.rows.filter("__copy").select("__ord", "__key", F.lit(0).alias("s"), F.col("n_bytes").cast("int").alias("e"))
    return found.rows.drop("__found"), found.spans().unionByName(whole)


def _windows_of(keyed: DataFrame, wanted: np.ndarray | bitmap.Sieve) -> DataFrame:
    """(seed, name, least, windows): the window names of the stretches that may be wanted in this document."""
    shared = keyed.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, s, _ in _each(batches, 1):
            ids = batch.column(0).slice(lo, hi - lo).to_numpy()[s.row]
            pick = np.flatnonzero(bitmap.test(shared.value, s.name ^ ids.view(np.uint64)))
            names = s.windows(pick)
            cut = np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype(np.int32)
            flat = pa.array(signed(np.concatenate([*names, np.zeros(0, np.uint64)])))
            yield pa.RecordBatch.from_arrays([pa.array(signed(s.seed[pick])), pa.array(signed(s.name[pick])), pa.array(ids[pick]), pa.ListArray.from_arrays(pa.array(cut), flat)], ["seed", "name", "least", "windows"])

    return keyed.mapInArrow(lean(run), "seed long, name long, least long, windows array<long>")


def _merge(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def text_key(doc_id: str = "doc_id", text: str = "text") -> tuple:
    """The columns (__ord, __key) that :func:`changed_texts` names a row by: its id and a hash of id and text."""
    ord_ = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))
    return ord_.alias("__ord"), F.xxhash64(ord_, F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("__key")


def changed_texts(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(__ord, __key, n_removed, n_spans, kept_sha256, kept_text) of the texts that lose bytes; only these are moved."""
    spans = settle(spans.groupBy("__ord", "__key").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    needed = docs.sparkSession.sparkContext.broadcast(bitmap.build(spans.select("__key"), "__key"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmap.test(needed.value, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                removed, n, sha, texts = [], [], [], []
                for text_, spans_ in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    data = text_.encode()
                    merged = _merge([(x["s"], x["e"]) for x in spans_])
                    kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in merged)], [*(s for s, _ in merged), len(data)], strict=True))
                    removed.append(len(data) - len(kept))
                    n.append(len(merged))
                    sha.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode("utf-8", "ignore") if with_text else "")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], ["__ord", "__key", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    keyed = _keyed(docs, doc_id, text).select(F.col("ord").alias("__ord"), F.xxhash64("ord", "text").alias("__key"), "text")
    texts = keyed.mapInArrow(lean(pick), "__ord long, __key long, text string").dropDuplicates(["__ord", "__key"])
    return texts.join(spans, ["__ord", "__key"]).mapInArrow(lean(cut), "__ord long, __key long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``keep``, n_bytes, n_removed, n_spans, kept_sha256; with_text also kept_text, null where nothing was removed.

    Each byte covered by a 50-byte string that also starts in a document with a
    smaller id is removed; strings are equal if two 64-bit hashes of them are; rows of one id do not remove each other's bytes, and
    null ids come after all others and count as one id.  Null and empty texts
    have no bytes; shorter texts than 50 bytes lose none.  A cut may fall
    inside a character; kept_text then drops the halves.  Repeated rows get
    equal results.  Result columns' names must not be among ``keep``.
    """
    clash = {"n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "__ord", "__key", "__sha", "__copy", "__found", "__text"} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are result columns")
    found = Repeats(docs, keep, doc_id, text)
    shares = max(1, min(SHARES, found.count // SPOTS))
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(shares))
    if shares == 1:
        parts = [changed_texts(docs, found.spans(), doc_id, text, with_text)]
    else:
        # what one share shuffles is gone before the next begins
        parts = [settle(changed_texts(docs.filter(share(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))) == i), found.spans(share("__ord") == i), doc_id, text, with_text)) for i in range(shares)]
    out = found.rows.join(reduce(DataFrame.union, parts), ["__ord", "__key"], "left")
    gone = lambda c, whole, kept: F.when(F.col("__copy"), whole).otherwise(kept).alias(c)
    columns = [*keep, "n_bytes", gone("n_removed", F.col("n_bytes"), F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), gone("n_spans", F.lit(1), F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "__sha").alias("kept_sha256")]
    return out.select(*columns, *([gone("kept_text", F.lit(""), F.col("kept_text"))] if with_text else []))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])


ORACLE_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, substr(x, 2 * s + 1, 100) AS w FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS s FROM b WHERE n >= 50)),
m AS (SELECT w, min(doc_id) AS m FROM w GROUP BY w HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, s FROM w JOIN m ON w.w = m.w WHERE doc_id > m),
runs AS (
  SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS new FROM hit)),
spans AS (SELECT doc_id, run, min(s) AS s, max(s) + 50 AS e FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, e AS a, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS z FROM spans
  UNION ALL SELECT b.doc_id, 0, (SELECT min(s) FROM spans WHERE spans.doc_id = b.doc_id) FROM b),
kept AS (
  SELECT b.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(z, n) - a)), '' ORDER BY a) AS x FROM b JOIN gaps ON b.doc_id = gaps.doc_id GROUP BY b.doc_id),
sums AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM b JOIN kept ON b.doc_id = kept.doc_id LEFT JOIN sums ON b.doc_id = sums.doc_id
"""
