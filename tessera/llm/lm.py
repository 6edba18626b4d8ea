"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

The whole vocabulary is factored into nested classes of up to 16: frequent words
by a Huffman tree over their counts, all others below one leaf of it, by digits
of their hash, down to bins of some 16 words.  So
P(word | history) = P(class | history) * P(class | class, history) * ... and
every factor is log-linear in hashed features of the history: the word before,
the two before, and the words two and three before alone (skips).  Inside its
bin a rare word has its smoothed share of the bin's training tokens.

Training goes over all training texts in every round.  Tasks add up how often
each feature was observed with each class and how often the parameters so far
expect it; Spark sums that, and the step follows the difference, scaled by its
size.  What was observed is the same in every round and counted in the first.
The sums, and so the model, do not depend on how rows are dealt to tasks.
What the driver and a worker hold (parameters, the table of frequent words) has
a fixed bound; all other counts stay in tables and are joined.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bytegrid import SPACED, Words, mix, signed, text_bytes
from tessera.llm.common import lean, pieces, settle, table

#: Outcomes of a class, and words of a bin on average at most.
WIDTH, BIN_WORDS = 16, 16
#: Words with a path of their own, whose counts every worker holds; the counts of all others are joined.
FREQUENT = 1 << 17
#: Hashed parameter rows: a power of two that grows with the training tokens up to 2**18 (16 MiB), shared out to the features.
LEAST_ROW_BITS, MOST_ROW_BITS = 10, 18
#: Steps of the rounds, each over all training rows, and what damps rarely seen features.
STEPS, DAMPING = (0.6, 0.3), 5.0
#: Tokens handled at once, and batches whose observed outcomes are held before they are counted.
BATCH, KEYS_HELD = 8192, 32
#: Splits of the training texts that a task of a training round reads.
SPLITS = 4
END = np.uint64(0x2545F4914F6CDD1D)
_BEGIN = np.uint64(0x6A09E667F3BCC909)
_HASHED = np.uint64(1 << 63)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FEATURES = 5
_NEVER = -30.0
_BLOCK = 256
_DIGIT = WIDTH.bit_length() - 1


def tokens(batch_column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each row): a row's words and then one end."""
    words = Words(*text_bytes(batch_column, lo, hi), SPACED)
    n = hi - lo
    out = np.full(len(words) + n, END, np.uint64)
    out[np.arange(len(words)) + words.row] = words.hashes()
    return out, np.concatenate([words.first + np.arange(n + 1)])


def features(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Four feature hashes of each token's history: the word before, the two before, the words two and three before."""
    back = []
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    for d in (1, 2, 3):
        b = np.full(len(h), _BEGIN, np.uint64)
        b[d:] = h[:-d]
        b[place < d] = _BEGIN
        back.append(b)
    one = mix(back[0] + np.uint64(1))
    return [one, mix(one ^ mix(back[1] + np.uint64(2))), mix(back[1] + np.uint64(3)), mix(back[2] + np.uint64(4))]


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(depth, node, digit, log shares) of a Huffman tree of WIDTH branches: each leaf's path from the root, node 0, and each node's shares."""
    n = len(weights)
    order = np.argsort(weights, kind="stable")
    leaves = deque([(0.0, -1)] * (-(n - 1) % (WIDTH - 1)) + [(float(weights[i]), int(i)) for i in order])
    inner: deque = deque()
    parent, digit, masses = np.zeros(2 * n + 2, np.int64), np.zeros(2 * n + 2, np.uint8), []
    while len(leaves) + len(inner) > 1 or not masses:
        total, row = 0.0, np.zeros(WIDTH)
        for k in range(min(WIDTH, len(leaves) + len(inner))):
            w, i = (leaves if not inner or (leaves and leaves[0][0] <= inner[0][0]) else inner).popleft()
            total += w
            row[k] = w
            if i >= 0:
                parent[i], digit[i] = len(masses), k
        inner.append((total, n + len(masses)))
        masses.append(row)
    nodes = len(masses)
    depth = np.zeros(n + nodes, np.int64)
    for i in range(nodes - 2, -1, -1):
        depth[n + i] = depth[n + parent[n + i]] + 1
    depth[:n] = depth[n + parent[:n]] + 1
    deepest = int(depth[:n].max())
    node, digits = np.zeros((n, deepest), np.int32), np.zeros((n, deepest), np.uint8)
    at, left, rows = np.arange(n), depth[:n].copy(), np.arange(n)
    while len(rows):
        node[rows, left - 1], digits[rows, left - 1] = nodes - 1 - parent[at], digit[at]
        at, left = n + parent[at], left - 1
        go = left > 0
        rows, at, left = rows[go], at[go], left[go]
    m = np.array(masses[::-1])
    shares = np.where(m > 0, np.log(np.maximum(m, 1e-12)) - np.log(np.maximum(m.sum(1, keepdims=True), 1e-12)), _NEVER)
    return depth[:n], node, digits, shares.astype(np.float32)


@dataclass
class Counts:
    """Training counts: the frequent words (sorted hashes with counts), found ``least`` times at least, and totals; from them follow the nested classes."""

    hashes: np.ndarray
    counts: np.ndarray
    least: int
    total: int
    distinct: int

    def __post_init__(self):
        self.rare_words = self.distinct - len(self.hashes)
        rare = self.total - int(self.counts.sum()) + 0.5 * (self.rare_words + 1)
        #: digits of a rare word's hash that are classes, and the bits of its bin
        self.levels = max(0, math.ceil(math.log(max(1, self.rare_words) / BIN_WORDS, WIDTH) - 1e-9))
        self.bin_mask = (1 << (_DIGIT * self.levels)) - 1
        self.depth, self.node, self.digit, self.shares = huffman(np.append(self.counts + 0.5, rare))
        bits = max(LEAST_ROW_BITS, min(MOST_ROW_BITS, math.ceil(math.log2(max(2, self.total)))))
        #: rows of each feature; the first one's are those of hashed classes
        self.row_bits = [bits - 2] * 3 + [bits - 3] * 2
        self.first_row = np.cumsum([len(self.shares)] + [1 << b for b in self.row_bits])
        #: hashes with an end, and the first of them that begins with each value of some bits; there are twice as many values as hashes at least
        self._ended = np.append(self.hashes, np.uint64((1 << 64) - 1))
        self._shift = np.uint64(64 - max(1, (2 * len(self.hashes)).bit_length()))
        self._begin = np.searchsorted(self.hashes, np.arange(1 << (64 - int(self._shift)), dtype=np.uint64) << self._shift).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is a frequent word, its count, its leaf); all other words have the last leaf."""
        n = len(self.hashes)
        if not n:
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        i = self._begin[h >> self._shift]
        later = np.flatnonzero(self._ended[i] < h)
        while len(later):
            i[later] += 1
            later = later[self._ended[i[later]] < h[later]]
        i = np.minimum(i, n - 1)
        known = self.hashes[i] == h
        return known, np.where(known, self.counts[i], 0), np.where(known, i, n)

    @property
    def norm(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


class Model:
    """Parameter rows of WIDTH: one for each class of the tree, holding its shares at first, then the hashed rows of each feature."""

    def __init__(self, counts: Counts, params: np.ndarray | None = None):
        self.counts = counts
        #: whether no feature says anything yet, so that each class has its shares after every history
        self.plain = params is None
        if params is None:
            params = np.zeros((int(counts.first_row[-1]), WIDTH), np.float32)
            params[: len(counts.shares)] = counts.shares
        self.params = params

    def choices(self, h: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, class, outcome) of every choice on the tokens' paths."""
        c, parts = self.counts, []
        depth = c.depth[leaf]
        for d in range(c.node.shape[1]):
            t = np.flatnonzero(depth > d)
            if len(t):
                parts.append((t, c.node[leaf[t], d].astype(np.uint64), c.digit[leaf[t], d].astype(np.int64)))
        t = np.flatnonzero(leaf == len(c.hashes))
        x = h[t]
        for k in range(c.levels):
            above = x & np.uint64((1 << (_DIGIT * k)) - 1)
            parts.append((t, mix(above + np.uint64((k + 1) << 56)) | _HASHED, ((x >> np.uint64(_DIGIT * k)) & np.uint64(WIDTH - 1)).astype(np.int64)))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def rows(self, f: list[np.ndarray], token: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The parameter rows of each choice: its class's own and one for each feature."""
        c = self.counts
        spread = mix(cls + np.uint64(77))
        out = np.empty((_FEATURES, len(token)), np.int64)
        out[0] = np.where(cls < _HASHED, cls, (spread >> np.uint64(64 - c.row_bits[0])) + np.uint64(c.first_row[0]))
        for k in range(1, _FEATURES):
            out[k] = (((f[k - 1][token] ^ spread) * _SPREAD) >> np.uint64(64 - c.row_bits[k])) + np.uint64(c.first_row[k])
        return out

    def batches(self, h: np.ndarray, first: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(token, rows, outcome, exp of all outcomes' sums, their total) of the choices, some thousand tokens at a time."""
        f = features(h, first)
        for lo in range(0, len(h), BATCH):
            part = slice(lo, lo + BATCH)
            token, cls, outcome = self.choices(h[part], leaf[part])
            rows = self.rows([x[part] for x in f], token, cls)
            s = np.take(self.params, rows[0], axis=0, mode="clip")
            one = np.empty_like(s)
            for r in rows[1:]:
                s += np.take(self.params, r, axis=0, out=one, mode="clip")
            np.exp(s, out=s)
            yield token + lo, rows, outcome, s, np.einsum("ij->i", s)

    def scores(self, h: np.ndarray, first: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural log of each token's path; for rare words, of the path to their bin."""
        out = np.zeros(len(h))
        for token, _, outcome, e, total in self.batches(h, first, leaf):
            out += np.bincount(token, np.log(e[np.arange(len(token)), outcome] / total), len(h))
        return out


class Sums:
    """How often each row was observed with each outcome (only if ``observe``: no model changes that), and how often the model expects it."""

    def __init__(self, model: Model, observe: bool = True):
        self.model = model
        self.expected = np.zeros(model.params.shape)
        self.observed = np.zeros(model.params.shape) if observe else None
        #: what is expected since the last count, in short numbers; small terms would be lost beside the whole sum
        self._now = np.zeros(model.params.shape, np.float32)
        self._keys: list[np.ndarray] = []
        self._held = 0
        self._met: list[np.ndarray] = []
        hashed = len(model.counts.shares)
        #: (row, class) as one number, short where it can be as that is sorted faster
        self._met_kind = np.uint32 if len(model.params) * (hashed + 1) <= 1 << 32 else np.int64

    def add(self, h: np.ndarray, first: np.ndarray, leaf: np.ndarray) -> None:
        if self.model.plain:
            self._add_plain(h, first, leaf)
            return
        for _, rows, outcome, e, total in self.model.batches(h, first, leaf):
            e /= total[:, None]
            # a row and its place as one number: that is sorted several times faster than an order of rows is found
            place, bits = np.arange(len(e)), len(e).bit_length()
            for r in rows:
                both = (r << bits) | place
                both.sort()
                self._expect(both >> bits, np.take(e, both & ((1 << bits) - 1), axis=0, mode="clip"))
            self._hold(rows, outcome)

    def _hold(self, rows: np.ndarray, outcome: np.ndarray) -> None:
        """Keep what was observed until some batches are counted at once; sums in short numbers go over as often."""
        if self.observed is not None:
            self._keys.append((rows * WIDTH + outcome).astype(np.int32).reshape(-1))
        self._held += 1
        if self._held >= KEYS_HELD:
            self._count()

    def _expect(self, rows: np.ndarray, terms: np.ndarray) -> None:
        """Add ``terms`` to sorted ``rows``; two short numbers are added as one complex number, which halves the additions."""
        pairs = self._now.view(np.complex64).reshape(-1)
        start, at = rows * (WIDTH // 2), np.empty((len(rows), WIDTH // 2), np.int64)
        for k in range(WIDTH // 2):
            np.add(start, k, out=at[:, k])
        np.add.at(pairs, at.reshape(-1), terms.view(np.complex64).reshape(-1))

    def _add_plain(self, h: np.ndarray, first: np.ndarray, leaf: np.ndarray) -> None:
        """The same where only a choice's class matters: rows and classes that meet often are counted and added once."""
        f, hashed = features(h, first), len(self.model.counts.shares)
        for lo in range(0, len(h), BATCH):
            part = slice(lo, lo + BATCH)
            token, cls, outcome = self.model.choices(h[part], leaf[part])
            rows = self.model.rows([x[part] for x in f], token, cls)
            self._met.append((rows * (hashed + 1) + np.minimum(cls, np.uint64(hashed)).astype(np.int64)).astype(self._met_kind).reshape(-1))
            self._hold(rows, outcome)

    def _count(self) -> None:
        """Put what is held so far, (row, outcome) and (row, class) of choices, into ``observed`` and ``expected``."""

        def counted(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[at], np.diff(np.append(at, len(keys)))

        if self._keys:
            keys, n = counted(self._keys)
            self.observed.reshape(-1)[keys] += n
        if self._met:
            shares = np.exp(np.vstack([self.model.counts.shares, np.full((1, WIDTH), -math.log(WIDTH), np.float32)]))
            keys, n = counted(self._met)
            row = keys // len(shares)
            row, cls = row.astype(np.int64), keys - row * len(shares)
            for lo in range(0, len(row), BATCH):
                part = slice(lo, lo + BATCH)
                self._expect(row[part], np.take(shares, cls[part], axis=0, mode="clip") * n[part, None].astype(np.float32))
        self._held = 0
        self.expected += self._now
        self._now[:] = 0

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """(block, expected and, where counted, observed behind it) of the blocks of rows that were touched."""
        self._count()
        sides = [self.expected] if self.observed is None else [self.expected, self.observed]
        for k, lo in enumerate(range(0, len(self.expected), _BLOCK)):
            if self.expected[lo : lo + _BLOCK].any():
                yield k, b"".join(x[lo : lo + _BLOCK].astype(np.float32).tobytes() for x in sides)


def step(observed: np.ndarray, expected: np.ndarray, rate: float) -> np.ndarray:
    """The change of a row: along observed - expected, on a log scale; rarely seen rows move little."""
    return (rate * np.clip(np.log((observed + DAMPING) / (expected + DAMPING)), -5, 5)).astype(np.float32)


def _prepared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return docs.select(F.crc32(ident.cast("binary")).alias("crc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def count_words(training: DataFrame, text: str = "text") -> DataFrame:
    """(h, c): each distinct token of the training texts and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            found += [tokens(batch.column(0), lo, hi)[0] for lo, hi in pieces(batch, 0)]
            h, c = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(c.astype(np.int64))], ["h", "c"])

    return training.select(text).mapInArrow(lean(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def known_counts(counted: DataFrame, frequent: int = FREQUENT) -> Counts:
    """The fixed-size table of the most frequent tokens and the totals."""
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # a count that few enough words reach: sizes of count ranges tell it, so no task sends more than its share
    ranges = counted.groupBy(F.floor(F.log2("c") * 16).alias("r")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    held, least = 0, 1 << 62
    for r in sorted(ranges, key=lambda r: -r["r"]):
        held += r["n"]
        if held > frequent:
            break
        least = r["c"]
    top = counted.filter(F.col("c") >= least).toPandas()
    h, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return Counts(h[order], c[order], least, int(total), int(distinct))


def _wide(training: DataFrame) -> DataFrame:
    """``training`` with ``SPLITS`` splits to a task while there is a task for every core: each task hands in a table of sums."""
    n = training.rdd.getNumPartitions()
    cores = max(1, training.sparkSession.sparkContext.defaultParallelism)
    return training.coalesce(max(1, min(n, math.ceil(max(cores, n / SPLITS) / cores) * cores)))


def train(training: DataFrame, counts: Counts, steps: tuple[float, ...] = STEPS) -> Model:
    """Parameters learned from all training rows (text), which every round goes over."""
    sc = training.sparkSession.sparkContext
    model, params, observed = Model(counts), None, None
    training = _wide(training.select("text"))
    kind = "block int, sums binary"

    def pack(k: int, sums: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
                held[k] = held[k] + x if k in held else x
        for k, x in held.items():
            yield pack(k, x.astype(np.float32).tobytes())

    for rate in steps:
        shared = sc.broadcast((counts, params))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, observe=observed is None) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                for lo, hi in pieces(batch, 0):
                    sums = sums or Sums(Model(*shared.value), observe)
                    h, first = tokens(batch.column(0), lo, hi)
                    sums.add(h, first, sums.model.counts.find(h)[2])
            for block in sums.blocks() if sums else ():
                yield pack(*block)

        summed = training.mapInArrow(lean(run), kind).repartition("block").mapInArrow(lean(add), kind)
        params = model.params.copy()
        known, observed = observed, np.zeros(params.shape, np.float32) if observed is None else observed
        for r in summed.collect():
            sides = np.frombuffer(r["sums"], np.float32).astype(np.float64).reshape(2 if known is None else 1, -1, WIDTH)
            part = slice(r["block"] * _BLOCK, r["block"] * _BLOCK + sides.shape[1])
            if known is None:
                observed[part] = sides[1]
            params[part] += step(observed[part], sides[0], rate)
        model = Model(counts, params)
        shared.unpersist()
    return model


def _bins(counted: DataFrame, counts: Counts) -> DataFrame:
    """(bin, tokens, words, counts) of the rare words' bins; hashes share bins evenly, so a bin holds some 16 words."""
    return counted.filter(F.col("c") < counts.least).groupBy(F.col("h").bitwiseAND(F.lit(counts.bin_mask)).alias("bin")).agg(F.sum("c").alias("tokens"), F.count("*").alias("words"), F.map_from_entries(F.collect_list(F.struct("h", "c"))).alias("counts"))


def score(docs: DataFrame, keep: list[str], counted: DataFrame, counts: Counts, model: Model, text: str = "text") -> DataFrame:
    """``keep``, n_tokens, n_known, train_tokens, base_score and score of each row's whole text.

    Null reads as empty; an empty text is one end token.  Repeated rows get
    equal scores.  With no training rows every token is unknown and scores 0.
    Result columns' names must not be among ``keep``.
    """
    import pyspark.sql.types as T

    clash = {"n_tokens", "n_known", "train_tokens", "base_score", "score", "__row", "__rest", "__base", "__score", "__known"} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are result columns")
    k = len(keep)
    rest = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType())]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("__row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("__known", T.LongType()), T.StructField("__base", T.DoubleType()), T.StructField("__score", T.DoubleType()), T.StructField("__rest", rest)])
    kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast((counts, model.params))
    log_norm = math.log10(counts.norm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        m = Model(*shared.value)
        for batch in batches:
            for lo, hi in pieces(batch, k):
                h, first = tokens(batch.column(k), lo, hi)
                n = np.diff(first)
                rows = np.repeat(np.arange(hi - lo), n)
                frequent, c, leaf = m.counts.find(h)
                # words whose counts are joined later add their own part there
                base = np.where(frequent, np.log10(c + 0.5), 0.0) - log_norm
                own = m.scores(h, first, leaf) / math.log(10)
                other = np.flatnonzero(~frequent)
                key = np.lexsort((h[other], rows[other]))
                ho, ro = h[other][key], rows[other][key]
                at = np.flatnonzero(np.concatenate([[True], (ho[1:] != ho[:-1]) | (ro[1:] != ro[:-1])])) if len(ho) else np.zeros(0, np.int64)
                items = pa.StructArray.from_arrays([pa.array(signed(ho[at])), pa.array(np.diff(np.append(at, len(ho))).astype(np.int32))], fields=list(kind.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(ro[at], np.arange(hi - lo + 1)).astype(np.int32)), items)
                total = lambda x, rows=rows, size=hi - lo: np.bincount(rows, x, size)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(k)), pa.array(np.arange(row, row + hi - lo)), pa.array(n), pa.array(total(frequent).astype(np.int64)), pa.array(total(base)), pa.array(total(own)), lists], [f.name for f in schema])
                row += hi - lo

    found = settle(docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("__text")).mapInArrow(lean(run), schema))
    each = found.select("__row", F.explode("__rest").alias("x")).select("__row", "x.n", "x.h", F.col("x.h").bitwiseAND(F.lit(counts.bin_mask)).alias("bin")).join(_bins(counted, counts), "bin", "left")
    seen = F.coalesce(F.element_at("counts", F.col("h")), F.lit(0))
    share = (seen + 0.5) / (F.coalesce("tokens", F.lit(0)) + 0.5 * (F.coalesce("words", F.lit(0)) + 1))
    part = each.groupBy("__row").agg(F.sum(F.col("n") * F.log10(seen + 0.5)).alias("base"), F.sum(F.col("n") * F.log10(share)).alias("own"), F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("known"))
    out = found.drop("__rest").join(part, "__row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(*keep, "n_tokens", plus("__known", "known").cast("long").alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"), plus("__base", "base").alias("base_score"), plus("__score", "own").alias("score"))


def held_out(doc_id):
    """Rows the model never learns from: crc32 of the id as text leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = _prepared(docs.filter(~held_out(F.col("doc_id"))), "doc_id", "text")
    counted = settle(count_words(training))
    counts = known_counts(counted)
    model = train(training, counts)
    out = score(docs, ["doc_id"], counted, counts, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
