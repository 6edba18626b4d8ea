"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of an item (a shorter item is one
window).  Its shingles (pairs of words; the word itself in a one-word item)
are ordered by rarity over all documents.  To contain a window a document must
hold its rarest shingle, so only that one, the necessary prefix, is joined.  A
candidate must leave room for the window's words before and after it (the
positional and length bounds), and is then verified word by word.

Documents never move: they are read twice, once to count the items' shingles
and once to find the prefix shingles.  Both reads are thinned by a bitmap of
bounded size; the joins that follow are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm.bytegrid import ALNUM, Words, mix, signed, text_bytes
from tessera.llm.common import lean, pieces, settle, table

WINDOW = 10
_ALONE = np.uint64(0xD6E8FEB86659FD93)


def _shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes as one-word shingles, first word of each pair, hash of each pair)."""
    h = words.hashes()
    at, pairs = words.shingles(h, 2)
    return mix(h ^ _ALONE), at, pairs


def windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(item, words, n, at, h): each shingle of each window, ``at`` words from its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch, 1):
                w = Words(*text_bytes(batch.column(1), lo, hi), ALNUM)
                alone, at, pairs = _shingles(w)
                pair = np.zeros(len(w), np.uint64)
                pair[at] = pairs
                flat = w.data.tobytes()
                names = [flat[s:e].decode() for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)]
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                out: list[list] = [[], [], [], [], []]
                for r in range(hi - lo):
                    a, b = int(w.first[r]), int(w.first[r + 1])
                    n = min(size, b - a)
                    for s in range(a, b - n + 1) if n else ():
                        text = " ".join(names[s : s + n])
                        for k in range(max(1, n - 1)):
                            for column, v in zip(out, (ids[r], text, n, k, int(signed((pair if n > 1 else alone)[s + k : s + k + 1])[0])), strict=True):
                                column.append(v)
                    if len(out[0]) > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names_)
                        out = [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names_)

    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
    names_ = ["item", "words", "n", "at", "h"]
    source = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(lean(run), "item string, words string, n int, at int, h long")


def _counted(docs: DataFrame, text: str, held: np.ndarray) -> DataFrame:
    """(h, n): how often each shingle that may be in ``held`` stands in the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lo, hi in pieces(batch, 0):
                alone, _, pairs = _shingles(Words(*text_bytes(batch.column(0), lo, hi), ALNUM))
                for h in (alone, pairs):
                    found.append(h[bitmap.test(shared.value, h)])
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, keep: list[str], text: str, held: np.ndarray, size: int) -> DataFrame:
    """The columns ``keep`` of each document with __row, n_words and its candidates (h, at, first, words around)."""
    import pyspark.sql.types as T

    shared = docs.sparkSession.sparkContext.broadcast(held)
    cand = T.StructType([T.StructField("h", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("words", T.StringType())])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("__row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("__found", T.ArrayType(cand))])
    names = [f.name for f in schema]
    kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        k = len(keep)
        for batch in batches:
            for lo, hi in pieces(batch, k):
                w = Words(*text_bytes(batch.column(k), lo, hi), ALNUM)
                alone, at, pairs = _shingles(w)
                a, b = bitmap.test(shared.value, alone), bitmap.test(shared.value, pairs)
                where = np.concatenate([np.flatnonzero(a), at[b]])
                order = np.argsort(where, kind="stable")
                where, h = where[order], np.concatenate([alone[a], pairs[b]])[order]
                flat = w.data.tobytes() if len(where) else b""
                starts, ends = w.start, w.end
                around, first = [], []
                for i in where.tolist():
                    r = int(w.row[i])
                    x, y = max(int(w.first[r]), i - size + 1), min(int(w.first[r + 1]), i + size)
                    around.append(b" ".join([flat[s:e] for s, e in zip(starts[x:y].tolist(), ends[x:y].tolist(), strict=True)]).decode())
                    first.append(x - int(w.first[r]))
                rows = w.row[where]
                found = pa.StructArray.from_arrays([pa.array(signed(h)), pa.array((where - w.first[rows]).astype(np.int32)), pa.array(first, pa.int32()), pa.array(around, pa.string())], fields=list(kind.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int32)), found)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in range(k)), pa.array(np.arange(row, row + hi - lo)), pa.array(w.count.astype(np.int64)), lists], names)
                row += hi - lo

    return docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("__text")).mapInArrow(lean(run), schema)


def scan(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in any occurrence of any window.  Null and empty
    texts have no words and no hits; an item without words has no window; items
    with the same id count once; a null item id reads as an empty string.
    Repeated rows and any ids are told apart by row.  Texts are read whole.
    The column names of the result must not be among ``keep``.
    """
    clash = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated", "__row", "__found", "__text"} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are result columns")
    every = settle(windows(items, item_id, item_text, size))
    counts = _counted(docs, text, bitmap.build(every.select("h").distinct(), "h"))
    once = every.select("words", "n", "at", "h").distinct().join(counts.withColumnRenamed("n", "df"), "h", "left")
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("h"), F.col("at"))).alias("r")
    prefix = settle(once.groupBy("words", "n").agg(rarest).select("words", "n", F.col("r.h").alias("h"), F.col("r.at").alias("at")))
    found = settle(_candidates(docs, keep, text, bitmap.build(prefix.select("h").distinct(), "h"), size))

    one = found.select("__row", "n_words", F.explode("__found").alias("c")).select("__row", "n_words", "c.h", F.col("c.at").alias("p"), F.col("c.first").alias("first"), F.col("c.words").alias("around"))
    start = F.col("p") - F.col("at")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), start - F.col("first") + 1, F.col("n")), " ") == F.col("words")
    hits = one.join(prefix, "h").filter(fits & (start >= F.col("first"))).filter(same).select("__row", "words", start.alias("s"), (start + F.col("n")).alias("e"))
    hits = settle(hits)
    # the union of a document's hit intervals: words up to the furthest end so far count once
    step = lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0), x.e - F.greatest(x.s, acc.end))).cast("long").alias("n"), F.greatest(acc.end, x.e).alias("end"))
    spans = hits.groupBy("__row").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
    spans = spans.select("__row", F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step, lambda acc: acc.n).alias("n_hit"))
    item_of = every.select("item", "words").distinct()
    of_row = hits.select("__row", "words").distinct().join(item_of, "words").groupBy("__row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    of_row = of_row.select("__row", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = found.drop("__found").join(spans.join(of_row, "__row"), "__row", "left")
    return out.select(*keep, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.words = iw.words AND dw.n = iw.n),
per AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per ON d.doc_id = per.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
