"""Connected components of an edge table by alternating star contraction; nothing reaches the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: long); the component is its smallest node.

    Each round hangs a node's larger neighbours, then its smaller ones, on the
    smallest; a log of the longest path's length of rounds is enough.
    Raises if ``rounds`` are not.
    """
    star = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        star = settle(small)
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
