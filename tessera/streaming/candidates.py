"""Streaming forms: candidates as index rows arrive, capped or ranked state, appended tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import fixed
from tessera.functions.text import normalize
from tessera.operators.blocking import key_table, lookup_keys
from tessera.sources.shared import new_path, spread_tasks


def probe(stream: DataFrame, query: DataFrame) -> DataFrame:
    """(s1_id, c_id, src, ord) of streamed index entities that share a lookup key with the static first source."""
    keys = lookup_keys(normalize(query)).select("country", "key_type", "key", F.col("entity_id").alias("s1_id")).distinct()
    arrived = key_table(normalize(stream).filter("country_normalized <> ''"), ("exact", "acr", "tok")).withColumnRenamed("entity_id", "c_id")
    return arrived.join(keys, ["country", "key_type", "key"]).select("s1_id", "c_id", "src", "ord")


def capped(found: DataFrame, cap: int = fixed.ARRIVALS) -> DataFrame:
    """The first ``cap`` different candidates of each entity; within a batch in order of arrival."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else ([],)
        held = list(seen)
        rows = pd.concat(list(batches)).drop_duplicates("c_id").sort_values(["src", "ord"])
        rows = rows[~rows["c_id"].isin(held)].head(max(0, cap - len(held)))
        state.update((held + rows["c_id"].tolist(),))
        yield pd.DataFrame({"s1_id": key[0], "c_id": rows["c_id"], "rank": range(len(held) + 1, len(held) + len(rows) + 1)})

    return found.groupBy("s1_id").applyInPandasWithState(step, "s1_id string, c_id string, rank int", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def best_scores(scored: DataFrame, k: int = 200) -> DataFrame:
    """Update stream of each entity's ``k`` best candidates with their best score so far."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, scores = state.get if state.exists else ([], [])
        best = dict(zip(ids, scores, strict=True))
        for batch in batches:
            for c, s in zip(batch["c_id"], batch["score"], strict=True):
                best[c] = max(s, best.get(c, s))
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        state.update(([c for c, _ in top], [s for _, s in top]))
        yield pd.DataFrame({"s1_id": key[0], "c_id": [c for c, _ in top], "score": [s for _, s in top]})

    return scored.groupBy("s1_id").applyInPandasWithState(step, "s1_id string, c_id string, score double", "ids array<string>, scores array<double>", "update", GroupStateTimeout.NoTimeout)


def best_by_batch(scored: DataFrame, path: str, k: int = 200) -> DataFrame:
    """(s1_id, c_id, score): what :func:`best_scores` comes to when all that has arrived is read, ranked a batch at a time by Spark's own operators.

    Each batch writes the best of the entities it touches to ``path``; these and
    the next batch's rows are all that the next one needs.
    """
    from tessera.operators.retrieve import top_k

    spark, kind = scored.sparkSession, "s1_id string, c_id string, score double, batch long"

    def latest(before: int) -> DataFrame:
        every = spark.read.schema(kind).parquet(path).filter(F.col("batch") < before)
        return every.join(every.groupBy("s1_id").agg(F.max("batch").alias("batch")), ["s1_id", "batch"], "left_semi").select("s1_id", "c_id", "score")

    done = []

    def step(df: DataFrame, i: int) -> None:
        rows = df.select("s1_id", "c_id", "score")
        if i:
            rows = rows.unionByName(latest(i).join(rows.select("s1_id").distinct(), "s1_id", "left_semi"))
        # one exchange by entity does for both steps
        best = rows.repartition(spread_tasks(spark), "s1_id").groupBy("s1_id", "c_id").agg(F.max("score").alias("score"))
        top_k(best, k).select("s1_id", "c_id", "score").write.mode("overwrite").parquet(f"{path}/batch={i}")
        done.append(i)

    each_batch(scored, step, f"{path}-state")
    return latest(1 << 62) if done else spark.createDataFrame([], "s1_id string, c_id string, score double")


def running_frequency(words: DataFrame, most: int = fixed.RARE_RUNNING) -> DataFrame:
    """Append stream of the words (country, key, c_id, src, ord) whose running count, up to and with their own row, is at most ``most``.

    The state of a word is its count so far; within a batch rows count in order of arrival.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).groupby(["src", "ord", "c_id"], as_index=False).size().sort_values(["src", "ord"])
        upto = seen + rows["size"].cumsum()
        state.update((int(min(upto.iloc[-1], 2**31 - 1)),))
        rows = rows[upto <= most]
        yield pd.DataFrame({"country": key[0], "key": key[1], "c_id": rows["c_id"], "src": rows["src"], "ord": rows["ord"]})

    kind = words.select("country", "key", "c_id", "src", "ord").schema
    return words.groupBy("country", "key").applyInPandasWithState(step, kind, "seen int", "append", GroupStateTimeout.NoTimeout)


def append_all(stream: DataFrame, path: str | None = None) -> str:
    """Append what has arrived to a Parquet folder, then stop; the folder's path."""
    spark = stream.sparkSession
    path = path or new_path(spark)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return path


def each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    """Run ``action`` on each micro-batch of what has arrived; states that are updated need ``mode`` update."""
    stream.writeStream.outputMode(mode).foreachBatch(action).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def stream_candidates(spark: SparkSession, index: DataFrame, query: DataFrame, cap: int = fixed.ARRIVALS) -> DataFrame:
    """Capped candidates of ``query`` over the streamed ``index``, as the batch form finds them."""
    path = append_all(capped(probe(index, query), cap))
    return spark.read.schema("s1_id string, c_id string, rank int").parquet(path)
