"""The exact best matches by n-gram cosine, worked out in cells of queries and index rows of one country.

Only texts are dealt to cells; a cell makes the grams itself.  Frequent grams
meet in a product of dense single-precision matrices, the others by their
postings.  What may be among the best, by the bound of the rounding errors, is
then scored again in double precision, so no pair is lost to rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import search_text
from tessera.sources.shared import settle, spread_tasks

#: Index rows of a cell at most, queries of a cell at least (if a country has them), ids of a query row.
CELL_ROWS, LEAST_QUERIES, QUERY_IDS = 1 << 16, 2048, 1000
#: Texts that are cut into grams at once, and rows that meet a cell's queries at once.
TEXTS, ROWS = 2048, 256
#: Grams of more than this share of the queries are columns of the dense product, up to so many numbers in all.
DENSE_SHARE, DENSE_NUMBERS = 0.05, 1 << 24
#: Products by postings that are worked out at once, candidates kept before the best are told, rows passed on at once.
PRODUCTS, HELD, PASSED = 1 << 22, 1 << 20, 1 << 16
#: Gram numbers below this are looked up in a table.
TABLE = 1 << 22
_TINY = np.finfo(np.float32).tiny


def _counted(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of equal pairs, by row."""
    if not len(row):
        return row, code, np.zeros(0, np.int64)
    width = int(code.max()) + 1
    if (most := (int(row.max()) + 1) * width) < 1 << 62:
        kind = np.uint32 if most < 1 << 32 else np.int64
        key = row.astype(kind)
        key *= kind(width)
        key += code.astype(kind)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count, key = np.diff(np.append(first, len(key))), key[first]
        row = key // kind(width)
        return row.astype(np.int64), (key - row * kind(width)).astype(np.int64), count
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]))
    return row[first], code[first], np.diff(np.append(first, len(row)))


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    for lo in range(0, len(texts), TEXTS):
        yield lo, texts.slice(lo, TEXTS)


class CharGrams:
    """3- and 4-grams as numbers, as ``char_grams`` has them: those whose inner characters are no space."""

    def __init__(self, *sides: pa.Array):
        seen = np.zeros(0x110000, bool)
        for side in sides:
            for _, texts in _slices(side):
                seen[self._points(texts.to_pylist())] = True
        seen[32] = True
        self.base = int(seen.sum()) + 1
        self.rank = np.cumsum(seen, dtype=np.int64 if self.base**4 >= 1 << 31 else np.int32)

    @staticmethod
    def _points(texts: list[str]) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, number, count, length of each row's vector)."""
        padded = [f" {t} " for t in texts.to_pylist()]
        points = self._points(padded)
        row = np.repeat(np.arange(len(padded), dtype=np.int32), [len(t) for t in padded])
        r, inner = self.rank[points], points != 32
        three = np.flatnonzero(inner[1:-1])
        four = np.flatnonzero(inner[1:-2] & inner[2:-1])
        begin = ((r[:-2] * self.base + r[1:-1]) * self.base + r[2:]) * self.base
        row, code, n = _counted(np.concatenate([row[three], row[four]]), np.concatenate([begin[three], begin[four] + r[four + 3]]))
        return row, code, n, np.sqrt(np.bincount(row, np.square(n, dtype=np.float64), len(padded)))


class WordGrams:
    """Words of two characters or more and neighbouring pairs of these, as ``word_grams`` has them; -1 stands for those with a word that no query has."""

    def __init__(self, queries: pa.Array, index: pa.Array | None = None):
        words = pc.unique(pc.list_flatten(pc.split_pattern(queries, " ")))
        self.words = words.filter(pc.greater_equal(pc.utf8_length(words), 2))

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        row, words = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists)
        long = pc.greater_equal(pc.utf8_length(words), 2)
        row, coded = row[long.to_numpy(zero_copy_only=False)], words.filter(long).dictionary_encode()
        word, here = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, len(coded.dictionary) + 1
        pair = np.flatnonzero(row[1:] == row[:-1])
        row, code, n = _counted(np.concatenate([row, row[pair]]), np.concatenate([word, word[pair] * here + word[pair + 1]]))
        length = np.sqrt(np.bincount(row, np.square(n, dtype=np.float64), len(texts)))
        known = np.concatenate([[0], pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1])
        first, second = code // here, code % here
        number = known[first] * (len(self.words) + 1) + known[second]
        return row, np.where((known[second] == 0) | ((first > 0) & (known[first] == 0)), -1, number), n, length


KINDS = {"char": CharGrams, "word": WordGrams}


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


class Cell:
    """The queries of a cell and the index rows that they meet."""

    def __init__(self, kind: str, queries: pa.Array, index: pa.Array, first: np.ndarray, k: int):
        """``first`` tells ties: the place of each index row's smallest id among all ids."""
        grams = KINDS[kind](queries, index)
        self.k, self.first, self.n = k, first, len(queries)
        parts = [(lo, *grams.counts(t)) for lo, t in _slices(queries)]
        row, code, n, length = (np.concatenate([p[i] + p[0] if i == 1 else p[i] for p in parts]) for i in range(1, 5))
        self.vocabulary, gram = np.unique(code, return_inverse=True)
        df = np.bincount(gram, minlength=len(self.vocabulary))
        order = np.argsort(-df, kind="stable")
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        gram, weight = self.place[gram], n / length[row]
        # frequent grams come first
        self.dense = min(int((df > DENSE_SHARE * self.n).sum()), DENSE_NUMBERS // max(1, self.n))
        self.q_start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=self.n))])
        self.q_gram, self.q_weight = gram, weight
        own = gram < self.dense
        self.head = np.zeros((self.dense, self.n), np.float32)
        self.head[gram[own], row[own]] = weight[own]
        rest = np.flatnonzero(~own)
        rest = rest[np.argsort(gram[rest], kind="stable")]
        self.p_start = np.concatenate([[0], np.cumsum(np.bincount(gram[rest] - self.dense, minlength=len(order) - self.dense))])
        self.p_row, self.p_weight = row[rest], weight[rest].astype(np.float32)
        # of a sum of m products of single precision, each of two rounded factors, at most 2^-24 (m + 4) is lost; both what is compared and the floor are such sums
        self.slack = 2.0**-22 * (int(np.diff(self.q_start).max(initial=0)) + 8)
        self._index(grams, index)

    def _index(self, grams, index: pa.Array) -> None:
        """The index rows' grams that some query has, by row."""
        gram, count, sizes, length = [], [], [], []
        least = int(self.vocabulary[-1]) + 1 if len(self.vocabulary) else 0
        # small numbers are looked up in a table
        table = np.full(least + 1, -1, np.int32) if least < TABLE else None
        if table is not None:
            table[self.vocabulary] = self.place
        for _, texts in _slices(index):
            row, code, n, size = grams.counts(texts)
            if table is not None:
                place = table[np.where(code < 0, least, np.minimum(code, least))]
            else:
                at = np.minimum(np.searchsorted(self.vocabulary, code), len(self.vocabulary) - 1)
                place = np.where(self.vocabulary[at] == code, self.place[at], -1)
            hit = np.flatnonzero(place >= 0)
            gram.append(place[hit].astype(np.uint32))
            count.append(_small(n[hit]))
            sizes.append(np.bincount(row[hit], minlength=len(texts)))
            length.append(size)
        self.gram, self.count = _small(np.concatenate(gram)), np.concatenate(count)
        self.start, self.length = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(length)

    def _near(self, lo: int, hi: int) -> np.ndarray:
        """Scores of index rows lo to hi with all queries in single precision."""
        a, b = self.start[lo], self.start[hi]
        row = np.repeat(np.arange(hi - lo), np.diff(self.start[lo : hi + 1]))
        gram = self.gram[a:b].astype(np.int64)
        weight = (self.count[a:b] / self.length[lo:hi][row]).astype(np.float32)
        own = gram < self.dense
        table = np.zeros((hi - lo, self.dense), np.float32)
        table[row[own], gram[own]] = weight[own]
        scores = table @ self.head
        row, gram, weight = row[~own], gram[~own] - self.dense, weight[~own]
        begin, n = self.p_start[gram], self.p_start[gram + 1] - self.p_start[gram]
        done, flat, at = np.cumsum(n), scores.reshape(-1), 0
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PRODUCTS, side="right")))
            m = n[at:end]
            post = np.repeat(begin[at:end] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            np.add.at(flat, np.repeat(row[at:end] * self.n, m) + self.p_row[post], np.repeat(weight[at:end], m) * self.p_weight[post])
            at = end
        return scores

    def exact(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Cosine of the pairs in double precision, rounded to 9 digits; ``q`` is sorted."""
        out, held = np.zeros(len(q)), np.zeros(len(self.vocabulary))
        for lo, hi in zip(first := np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else [], [*first[1:], len(q)] if len(q) else [], strict=True):
            own = slice(self.q_start[q[lo]], self.q_start[q[lo] + 1])
            held[self.q_gram[own]] = self.q_weight[own]
            for at in range(lo, hi, TEXTS):
                rows = x[at : min(at + TEXTS, hi)]
                n = self.start[rows + 1] - self.start[rows]
                ends = np.cumsum(n)
                place = np.repeat(self.start[rows] - (ends - n), n) + np.arange(ends[-1])
                # each row shares a gram with its query, so none is empty
                out[at : at + len(rows)] = np.add.reduceat(held[self.gram[place]] * self.count[place], ends - n) / self.length[rows]
            held[self.q_gram[own]] = 0.0
        return np.round(out, 9)

    def _cut(self, q: np.ndarray, x: np.ndarray, near: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Without what is below the k-th of its query by more than the slack; raises ``floor``."""
        order = np.argsort(q.astype(np.uint64) << np.uint64(32) | np.uint64(0xFFFFFFFF) - near.view(np.uint32))
        q, x, near = q[order], x[order], near[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = np.flatnonzero(place == self.k - 1)
        floor[q[last]] = near[last]
        keep = near >= floor[q] - self.slack
        return q[keep], x[keep], near[keep]

    def _best(self, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` best index rows of each query with their exact score, ties by smallest id."""
        order = np.argsort(q, kind="stable")
        q, x = q[order], x[order]
        score = self.exact(q, x)
        order = np.lexsort((self.first[x], -score, q))
        q, x, score = q[order], x[order], score[order]
        keep = (np.arange(len(q)) - np.searchsorted(q, q) < self.k) & (score > 0)
        return q[keep], x[keep], score[keep]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, index row, score) of the ``k`` best of each query."""
        q, x, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        floor, found, held = np.zeros(self.n, np.float32), [], 0
        most = max(HELD, 3 * self.k * self.n)
        rows = len(self.length)
        for lo in range(0, rows, ROWS):
            scores = self._near(lo, min(lo + ROWS, rows))
            hit = np.flatnonzero(scores >= np.maximum(floor - np.float32(self.slack), _TINY))
            found.append((hit % self.n, hit // self.n + lo, scores.reshape(-1)[hit]))
            held += len(hit)
            if held > most or lo + ROWS >= rows or lo == 0:
                q, x, near = self._cut(*(np.concatenate(c) for c in zip((q, x, near), *found, strict=True)), floor)
                if len(q) > 2 * self.k * self.n:
                    # many rows of one score: told apart by their ids
                    q, x, score = self._best(q, x)
                    near = score.astype(np.float32)
                found, held = [], 0
        return self._best(q, x)


def _ids(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(ids, where each list begins)."""
    return lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _expanded(start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``of``, place of an id) for every id of the lists ``of``."""
    n = start[of + 1] - start[of]
    return np.repeat(np.arange(len(of)), n), np.repeat(start[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _cell_rows(kind: str, k: int, cell: pa.Table) -> Iterator[pa.RecordBatch]:
    """(s1_id, c_id, score) of the ``k`` best items of each query id of a cell."""
    side = cell.column("side").to_numpy()
    queries, index = (cell.filter(pa.array(side == s)).combine_chunks() for s in (0, 1))
    if not queries.num_rows or not index.num_rows:
        return
    texts, lists = zip(*((t.column("text").combine_chunks(), t.column("ids").combine_chunks()) for t in (queries, index)), strict=True)
    (s1, s1_start), (c, c_start) = map(_ids, lists)
    rank = np.empty(len(c), np.int64)
    rank[np.argsort(c.to_numpy(zero_copy_only=False).astype(str))] = np.arange(len(c))
    q, x, score = Cell(kind, texts[0], texts[1], rank[c_start[:-1]], k).best()
    # the best items are among those of the best classes
    place, item = _expanded(c_start, x)
    q, score = q[place], score[place]
    order = np.lexsort((rank[item], -score, q))
    q, item, score = q[order], item[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    q, item, score = q[keep], item[keep], score[keep]
    # so many at once that their copies of the queries stay few
    ends = np.cumsum(s1_start[q + 1] - s1_start[q])
    lo = 0
    while lo < len(q):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PASSED, side="right")))
        place, own = _expanded(s1_start, q[lo:hi])
        yield pa.RecordBatch.from_arrays([s1.take(pa.array(own)), c.take(pa.array(item[lo:hi][place])), pa.array(score[lo:hi][place])], ["s1_id", "c_id", "score"])
        lo = hi


def best_matches(query: DataFrame, index: DataFrame, kind: str, k: int, block: int) -> DataFrame:
    """(s1_id, c_id, score): the ``k`` best of each query entity in each cell, at most ``block`` queries in one.

    ``kind`` is char or word.  Equal search texts of a country are one class.
    """
    spark = query.sparkSession
    ids = F.array_sort(F.collect_list("entity_id"))

    def classes(df: DataFrame) -> DataFrame:
        own = df.filter("country_normalized <> ''").select("country_normalized", search_text().alias("text"), "entity_id")
        return own.groupBy("country_normalized", "text").agg(ids.alias("ids"))

    # a query text of very many entities is several rows
    pieces = F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.size("ids") / QUERY_IDS).cast("int") - 1), lambda i: F.struct(i.alias("piece"), F.slice("ids", i * QUERY_IDS + 1, F.lit(QUERY_IDS)).alias("ids"))))
    q = settle(classes(query).select("country_normalized", "text", pieces.alias("p")).select("country_normalized", "text", "p.piece", "p.ids"))
    x = settle(classes(index).select("country_normalized", "text", F.lit(0).alias("piece"), F.slice("ids", 1, k).alias("ids")))
    count = lambda df, name: df.groupBy("country_normalized").agg(F.count("*").alias(name))
    sizes = count(q, "a").join(count(x, "b"), "country_normalized")
    pairs = sizes.agg(F.sum(F.col("a") * F.col("b").cast("double"))).first()[0] or 0.0
    tasks = spread_tasks(spark)
    # four cells for each core, if these are large enough: a cell makes its index rows' grams, so few queries cost more each
    own = F.least(F.lit(float(block)), F.greatest(F.lit(float(min(block, LEAST_QUERIES))), F.lit(pairs / (4 * spark.sparkContext.defaultParallelism)) / F.least(F.col("b"), F.lit(CELL_ROWS))))
    cuts = sizes.select("country_normalized", F.ceil(F.col("a") / own).cast("int").alias("rows"), F.ceil(F.col("b") / CELL_ROWS).cast("int").alias("columns"))
    before = F.coalesce(F.sum(F.col("rows").cast("long") * F.col("columns")).over(Window.partitionBy(F.lit(0)).orderBy("country_normalized").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = settle(cuts.withColumn("before", before))
    cells = cuts.agg(F.sum(F.col("rows").cast("long") * F.col("columns"))).first()[0] or 1

    def dealt(df: DataFrame, side: int) -> DataFrame:
        own, other = ("rows", "columns") if side == 0 else ("columns", "rows")
        place = F.pmod(F.xxhash64("text", "piece"), F.col(own)).alias("own")
        cut = df.join(F.broadcast(cuts), "country_normalized").select("*", place, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"))
        i, j = ("own", "other") if side == 0 else ("other", "own")
        return cut.select((F.col("before") + F.col(i) * F.col("columns") + F.col(j)).alias("cell"), F.lit(side).alias("side"), "text", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            cell = batch.column(0).to_numpy()
            ends = [*np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)] if len(cell) else []
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                if held and cell[lo] != now:
                    yield from _cell_rows(kind, k, pa.Table.from_batches(held))
                    held = []
                now = cell[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from _cell_rows(kind, k, pa.Table.from_batches(held))

    # cells are costly whatever their size: enough partitions that few cells share one
    both = dealt(q, 0).unionByName(dealt(x, 1)).repartition(max(tasks, min(4 * cells, 64 * tasks)), "cell").sortWithinPartitions("cell", "side")
    return both.mapInArrow(run, "s1_id string, c_id string, score double")
