"""Features and labels of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.similarity import conflict, jaccard, overlap, partial_ratio, ratio
from tessera.operators.decide import keyed_number
from tessera.sources.shared import settle, spread_tasks

_NEEDED = ("name_basic", "address_basic", "name_tokens", "address_tokens", "numeric_tokens")
#: Pairs of classes that a cell of a frequent name holds, about.
CELL = 20_000
#: The nine columns a matcher sees; the two named jaro hold the best window ratio.
FEATURES = ["retrieval_score", "name_jaro", "name_ratio", "name_jaccard", "addr_jaro", "addr_ratio", "addr_jaccard", "num_overlap", "num_conflict"]


def enriched(pairs: DataFrame, query: DataFrame, index: DataFrame, known: bool = False) -> DataFrame:
    """Pairs with both entities' normalised columns (q_*, x_*); an unknown entity has none, or with ``known`` a pair with an unknown candidate goes."""
    side = lambda df, p, key: df.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in _NEEDED])
    return pairs.join(side(query, "q", "s1_id"), "s1_id", "left").join(side(index, "x", "c_id"), "c_id", "inner" if known else "left")


def exact_scored(query: DataFrame, index: DataFrame, columns: dict[str, Column], values: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """(s1_id, c_id, values, keep) of the entities with equal basic name and country.

    ``values`` may use the columns q_* and x_* of both sides for each of
    ``columns``, which name expressions of an entity.  Entities that agree in
    these are one class: a value is worked out once for a pair of classes, and
    the ids are put in where it is written, so no pair is moved.  A name with
    many pairs of classes is cut into cells that are dealt to all tasks.
    """
    tasks = spread_tasks(query.sparkSession)
    on = ["country_normalized", "name_basic"]

    def classes(df: DataFrame, p: str) -> DataFrame:
        own = df.select(*on, "entity_id", *[c.alias(f"{p}_{n}") for n, c in columns.items()])
        return settle(own.groupBy(*on, *[f"{p}_{n}" for n in columns]).agg(F.collect_set("entity_id").alias(f"{p}_ids")))

    q, x = classes(query, "q"), classes(index, "x")
    sizes = q.groupBy(*on).agg(F.count("*").alias("a")).join(x.groupBy(*on).agg(F.count("*").alias("b")), on)
    cuts = settle(sizes.select(*on, F.ceil(F.sqrt(F.col("a") * F.col("b") / CELL)).cast("int").alias("cuts")).filter("cuts > 1"))

    def dealt(df: DataFrame, p: str, own: str, other: str) -> DataFrame:
        n = F.coalesce("cuts", F.lit(1))
        place = F.pmod(F.xxhash64(*[f"{p}_{c}" for c in columns]), n).cast("int")
        cut = df.join(F.broadcast(cuts), on, "left").select(*df.columns, place.alias(own), F.explode(F.sequence(F.lit(0), n - 1)).alias(other))
        return cut.repartition(tasks, *on, "i", "j")

    both = dealt(q, "q", "i", "j").join(dealt(x, "x", "j", "i").hint("merge"), [*on, "i", "j"])
    scored = both.select("q_ids", "x_ids", *[v.alias(n) for n, v in values.items()], *keep)
    each = scored.withColumn("s1_id", F.explode("q_ids")).withColumn("c_id", F.explode("x_ids"))
    return each.select("s1_id", "c_id", *values, *keep)


def pair_features(pairs: DataFrame, query: DataFrame, index: DataFrame, missing: float | None = 0.0, constant_score: bool = False, known: bool = False) -> DataFrame:
    """s1_id, c_id, the nine features and a label if there is one.

    ``missing`` is the Jaccard value of unknown tokens (None: as empty lists);
    ``constant_score`` gives every pair the retrieval score 1; with ``known``
    pairs with a candidate that the index does not hold are dropped.
    """
    both = enriched(pairs, query, index, known)
    # the string ratios cost far more than the rows' size tells: spread the pairs before them
    session = pairs.sparkSession
    both = both.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), "s1_id", "c_id")
    score = F.lit(1.0) if constant_score or "score" not in pairs.columns else F.col("score")
    return both.select(
        "s1_id", "c_id", score.alias("retrieval_score"),
        partial_ratio("q_name_basic", "x_name_basic").alias("name_jaro"), ratio("q_name_basic", "x_name_basic").alias("name_ratio"), jaccard(F.col("q_name_tokens"), F.col("x_name_tokens"), missing).alias("name_jaccard"),
        partial_ratio("q_address_basic", "x_address_basic").alias("addr_jaro"), ratio("q_address_basic", "x_address_basic").alias("addr_ratio"), jaccard(F.col("q_address_tokens"), F.col("x_address_tokens"), missing).alias("addr_jaccard"),
        overlap(F.col("q_numeric_tokens"), F.col("x_numeric_tokens")).alias("num_overlap"), conflict(F.col("q_numeric_tokens"), F.col("x_numeric_tokens")).alias("num_conflict"),
        *(["label"] if "label" in pairs.columns else []),
    )


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with label 1 where ``truth`` (s1_id, c_id) has them, else 0."""
    marked = truth.select("s1_id", "c_id").distinct().withColumn("hit", F.lit(1))
    return pairs.join(marked, ["s1_id", "c_id"], "left").withColumn("label", F.coalesce("hit", F.lit(0))).drop("hit")


def random_negatives(query: DataFrame, index: DataFrame, truth: DataFrame, seed: int = 42) -> DataFrame:
    """(s1_id, c_id): each query entity with one index entity of the same hash slot, if it is no match."""
    n = max(1, query.count())
    slot = lambda s: (keyed_number("entity_id", s) % n).alias("slot")
    q = query.select(F.col("entity_id").alias("s1_id"), slot(seed))
    x = index.select(slot(seed + 1), F.col("entity_id").alias("id")).groupBy("slot").agg(F.min("id").alias("c_id"))
    return q.join(x, "slot").select("s1_id", "c_id").join(truth.select("s1_id", "c_id"), ["s1_id", "c_id"], "left_anti")
