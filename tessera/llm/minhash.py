"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

One permutation scatters a document's shingles over 2**32 places; a second one
is read at those places shifted circularly by 0, 1, 2, ..., which gives all
signature coordinates.  Bands of coordinates make candidates.  Within a band
every document is first compared with the band's centre and its smallest member
only; then the pairs across components that are neither compared nor excluded
by an exact bound are compared too.  So no pair of a band is lost, and copies
are not expanded into all pairs.  A link counts only if the full shingle sets
confirm it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm.bytegrid import SPACED, Words, mix, roll, signed, text_bytes
from tessera.llm.common import lean, pieces, settle, table
from tessera.llm.components import components

#: Contract of the query; the near-duplicate default elsewhere is 5 words and 0.8.
QUERY_WORDS, QUERY_PERCENT = 3, 85
WORDS, PERCENT = 5, 80
#: 32 bands of 4 coordinates: two sets of similarity 0.85 share no band with probability 6e-11, of 0.8 with 5e-8.
BANDS, ROWS = 32, 4
#: Words of 64 bits in a set's parity bitmap.
PARITY = 16
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)
_ALONE = np.uint64(0x94D049BB133111EB)


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit places (a bijection by xor-shifts and odd factors)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinate k: the smallest value of the second permutation at the shingles' places shifted by k."""
    places = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_SHIFTS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), 512):
        np.minimum(out, _second(places[i : i + 512, None] + _SHIFTS).min(axis=0), out=out)
    return out


def bands(signature_: np.ndarray) -> np.ndarray:
    grid = signature_.reshape(BANDS, ROWS).astype(np.uint64)
    h = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))
    for k in range(ROWS):
        h = mix(h ^ (grid[:, k] + np.uint64(k << 40)))
    return h


def sets_of(words: Words, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row; fewer than ``width`` words make one shingle, none an empty set."""
    h = words.hashes()
    at, shingles = words.shingles(h, width)
    cut = np.searchsorted(at, words.first)
    out = []
    for r, n in enumerate(words.count.tolist()):
        if n >= width:
            out.append(np.unique(shingles[cut[r] : cut[r + 1]]))
        elif n:
            out.append(mix(roll(h, words.first[r : r + 1], n) ^ _ALONE))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set's members alone."""
    a, b = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def parity(s: np.ndarray) -> np.ndarray:
    """A bitmap of the set: bit k tells whether an odd number of its members fall on k.

    Where two bitmaps differ, the sets differ: the number of such bits is at
    most the size of the symmetric difference.
    """
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed_docs(docs: DataFrame, keep: list[str], text: str, width: int) -> DataFrame:
    """The columns ``keep`` of each row with __row, n_shingles, the set's digest and its band hashes."""
    import pyspark.sql.types as T

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, T.LongType()) for n in ("__row", "n_shingles", "__a", "__b")] + [T.StructField("__bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, k = TaskContext.get().partitionId() << 40, len(keep)
        for batch in batches:
            for lo, hi in pieces(batch, k):
                sets = sets_of(Words(*text_bytes(batch.column(k), lo, hi), SPACED), width)
                a, b = zip(*map(digest, sets), strict=True)
                at = [signed(bands(signature(s))) if len(s) else None for s in sets]
                own = [pa.array(np.arange(row, row + len(sets))), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(at, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in range(k)), *own], [f.name for f in schema])
                row += len(sets)

    return docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("__text")).mapInArrow(lean(run), schema)


def _full_sets(docs: DataFrame, text: str, width: int, needed: np.ndarray) -> DataFrame:
    """(a, b, set, bits): the shingles and parity bitmap of every row whose digest may be needed; a repeated set once a batch."""
    shared = docs.sparkSession.sparkContext.broadcast(needed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for lo, hi in pieces(batch, 0):
                keys, out, bits = [], [], []
                for s in sets_of(Words(*text_bytes(batch.column(0), lo, hi), SPACED), width):
                    if len(s):
                        key = digest(s)
                        if key not in seen and bitmap.test(shared.value, np.array([key[0]], np.int64).view(np.uint64))[0]:
                            seen.add(key)
                            keys.append(key)
                            out.append(signed(s))
                            bits.append(parity(s))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(out, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["a", "b", "set", "bits"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lean(run), "a long, b long, set array<long>, bits array<long>")


def _bounded(percent: int):
    """Pairs whose sizes and own shingles allow the similarity.

    A shingle that only one set has (u1, u2 of them) is in no intersection, and
    the own shingles of both are in the union: the rest bounds the similarity.
    """
    most = F.least(F.col("n1") - F.col("u1"), F.col("n2") - F.col("u2"))
    least = F.col("u1") + F.col("u2") + F.greatest(F.col("n1") - F.col("u1"), F.col("n2") - F.col("u2"))
    return (most * 100 >= least * percent) & (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent)


def _alike(percent: int):
    """Pairs whose parity bitmaps allow the similarity: d differing bits leave an intersection of (n1 + n2 - d) / 2 at most."""
    d = sum((F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(1, PARITY)), F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))))
    return (F.col("n1") + F.col("n2") - d) * 100 >= (F.col("n1") + F.col("n2") + d) * percent


def near_duplicates(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, n_shingles, component_id, kept, __component.

    Documents whose shingle sets have 100 * |intersection| >= percent * |union|
    are linked; component_id is the smallest ``doc_id`` reachable.  Rows with
    the same set, repeated rows too, are in one component.  Null, empty and
    word-less texts have n_shingles 0 and are alone.  Null ids are never the
    smallest; a component of null ids alone has a null component_id, and its
    rows are kept.  __component tells components apart in every case.  Texts
    are read whole; an empty table gives an empty result.
    """
    clash = {"n_shingles", "component_id", "kept", "__component", "__row", "__a", "__b", "__bands", "__id"} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are result columns")
    found = settle(_signed_docs(docs.withColumn("__id", F.col(doc_id)), [*keep, "__id"], text, width))
    nodes = found.filter("n_shingles > 0").groupBy("__a", "__b").agg(F.min("__row").alias("node"), F.min("n_shingles").alias("n"), F.min("__id").alias("id"), F.first("__bands").alias("bands"))
    nodes = settle(nodes)
    banded = nodes.select(F.explode("bands").alias("band"), "node", "n")
    shared = banded.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1").select("band")
    together = settle(banded.join(shared, "band"))
    # the full sets of all that share a band, and how many shingles of each no other one has
    keys = settle(nodes.select("node", "__a", "__b").join(together.select("node").distinct(), "node"))
    sets = _full_sets(docs, text, width, bitmap.build(keys.select("__a"), "__a"))
    sets = settle(sets.join(keys, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b"))).groupBy("node").agg(F.first("set").alias("set"), F.first("bits").alias("bits")))
    own = sets.select("node", F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1").groupBy("node").agg(F.count("*").alias("u"))
    # a set of which too much is its own has no partner
    able = sets.select("node", F.size("set").cast("long").alias("n")).join(own, "node", "left").select("node", F.coalesce("u", F.lit(0)).alias("u"), (F.col("n") - F.coalesce("u", F.lit(0))).alias("common"), "n")
    able = settle(able.filter(F.col("common") * 100 >= F.col("n") * percent).select("node", "u"))
    together = together.join(able, "node")
    # a band's centre is the member with the smallest share of own shingles: copies with edits resemble it more than each other
    reps = together.groupBy("band").agg(F.count("*").alias("c"), F.min(F.struct(F.round(F.col("u") / F.col("n"), 6), "node", "n", "u")).alias("centre"), F.min(F.struct("node", "n", "u")).alias("least")).filter("c > 1")
    together = settle(together.join(reps.select("band", F.struct("centre.node", "centre.n", "centre.u").alias("centre"), "least"), "band"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of (u, v) pairs those that the full sets confirm."""
        with_u = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("su")), "u")
        both = with_u.join(sets.select(F.col("node").alias("v"), F.col("set").alias("sv")), "v")
        same = both.select("u", "v", F.size(F.array_intersect("su", "sv")).alias("i"), (F.size("su") + F.size("sv")).alias("s"))
        return settle(same.filter(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("u", "v"))

    def star(column: str) -> DataFrame:
        return together.select(F.col(f"{column}.node").alias("u"), F.col(f"{column}.n").alias("n1"), F.col(f"{column}.u").alias("u1"), F.col("node").alias("v"), F.col("n").alias("n2"), F.col("u").alias("u2")).filter("u <> v")

    tried = star("centre").union(star("least")).filter(_bounded(percent))
    tried = settle(tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    links = verified(tried)
    groups = settle(components(links))
    # bands whose members are not yet in one component: the pairs across components that were not compared
    placed = together.select("band", "node", "n", "u").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("band").agg((F.min("component") < F.max("component")).alias("split")).filter("split").select("band")
    open_ = settle(placed.join(split, "band").join(sets.select("node", *[F.get("bits", k).alias(f"bits{k}") for k in range(PARITY)]), "node"))
    first = open_.select("band", F.col("node").alias("p"), F.col("n").alias("n1"), F.col("u").alias("u1"), F.col("component").alias("c1"), *[F.col(f"bits{k}").alias(f"x{k}") for k in range(PARITY)])
    second = open_.select("band", F.col("node").alias("q"), F.col("n").alias("n2"), F.col("u").alias("u2"), F.col("component").alias("c2"), *[F.col(f"bits{k}").alias(f"y{k}") for k in range(PARITY)])
    # sets of a band meet only if their sizes allow it: those of one size class and the two beside it
    size = lambda n: F.floor(F.log(F.col(n).cast("double")) / (math.log(100 / min(percent, 99)) * 1.001))
    first = first.withColumn("class", size("n1"))
    second = second.withColumnRenamed("band", "band2").withColumn("class2", F.explode(F.array(*[size("n2") + d for d in (-1, 0, 1)])))
    rest = first.join(second, (F.col("band") == F.col("band2")) & (F.col("class") == F.col("class2")) & (F.col("p") < F.col("q")) & (F.col("c1") != F.col("c2")) & _bounded(percent) & _alike(percent)).select(F.col("p").alias("u"), F.col("q").alias("v")).distinct()
    rest = settle(rest.join(tried, ["u", "v"], "left_anti"))
    if not rest.isEmpty():
        more = verified(rest)
        if not more.isEmpty():
            groups = settle(components(links.union(more)))
    of_node = nodes.select("__a", "__b", "node", "id").join(groups, "node", "left").withColumn("__component", F.coalesce("component", "node"))
    least = of_node.groupBy("__component").agg(F.min("id").alias("__least"))
    of_node = of_node.join(least, "__component").select("__a", "__b", "__component", "__least")
    rows = found.drop("__bands").join(of_node, ["__a", "__b"], "left")
    alone = F.col("n_shingles") == 0
    rows = rows.withColumns({"__component": F.when(alone, F.col("__row")).otherwise(F.col("__component")), "component_id": F.when(alone, F.col("__id")).otherwise(F.col("__least"))})
    return rows.select(*keep, "n_shingles", "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "__component")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"], width=QUERY_WORDS, percent=QUERY_PERCENT)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
f AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM f JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v WHERE 100 * i >= 85 * (len(a.g) + len(b.g) - i)),
both_ways AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT reach.doc_id, both_ways.v FROM reach JOIN both_ways ON reach.other = both_ways.u)
SELECT s.doc_id, CAST(len(any_value(g)) AS BIGINT) AS n_shingles, min(other) AS component_id, s.doc_id = min(other) AS kept
FROM s JOIN reach ON s.doc_id = reach.doc_id GROUP BY s.doc_id
"""
