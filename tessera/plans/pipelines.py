"""Whole flows: exact match, first-arrival matcher, training, cascade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.operators import blocking, decide, features, models, retrieve
from tessera.sources.shared import settle


@dataclass
class Settings:
    """mode: full, or validate with the first n_val entities."""

    mode: str = "full"
    n_val: int = 50_000
    ce_threshold: float = fixed.RERANK_SCORE
    top_k: int = fixed.MODEL_TOP


def settings_from(args: list[str] | None = None) -> Settings:
    """Settings from a command line."""
    import argparse

    p = argparse.ArgumentParser()
    p.add_argument("--mode", choices=["validate", "full"], default="full")
    p.add_argument("--n-val", type=int, default=50_000)
    p.add_argument("--ce-threshold", type=float, default=fixed.RERANK_SCORE)
    p.add_argument("--top-k", type=int, default=fixed.MODEL_TOP)
    return Settings(**vars(p.parse_args(args)))


def as_lists(entities: DataFrame, pairs: DataFrame, order: str = "rank") -> DataFrame:
    """(s1_id, c_ids) of every entity, ids in ``order``; entities without pairs have none."""
    lists = pairs.groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("place"), F.col("c_id").alias("id")))), lambda x: x["id"]).alias("c_ids"))
    return entities.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left").select("s1_id", F.coalesce("c_ids", F.array().cast("array<string>")).alias("c_ids"))


def candidates(query: DataFrame, index: DataFrame, k: int = 100) -> DataFrame:
    """Training candidates: character and word cosine above their thresholds and streamed structural hits, the best ``k``."""
    from tessera.functions.text import char_grams, search_text, word_grams

    char = retrieve.cosine_pairs(query, index, char_grams(search_text()), fixed.CHAR_THRESHOLD)
    word = retrieve.cosine_pairs(query, index, word_grams(search_text()), fixed.WORD_THRESHOLD)
    hits = blocking.streamed_structural(query, index).select("s1_id", "c_id", F.lit(fixed.STRUCTURAL_STREAM).alias("score"))
    return retrieve.top_k(retrieve.merge_best(char, word, hits), k)


def train(query: DataFrame, index: DataFrame, truth: DataFrame, rounds: int = 30) -> tuple[PipelineModel, DataFrame]:
    """(model, labelled features with the held-out flag); an entity's pairs are on one side of the split."""
    found = features.label(settle(candidates(query, index)), truth)
    table = settle(decide.hash_split(features.pair_features(found, query, index), "s1_id"))
    return models.train_matcher(table, held="held", rounds=rounds), table


def first_arrival_match(query: DataFrame, index: DataFrame, model: PipelineModel) -> tuple[DataFrame, DataFrame]:
    """(matches, candidates) as pairs in order of arrival; a match has a probability above one half."""
    found = settle(blocking.arrival_candidates(query, index))
    scored = models.score_pairs(model, features.pair_features(found, query, index, constant_score=True))
    return decide.decide(scored, "match_prob").join(found, ["s1_id", "c_id"]).select("s1_id", "c_id", "rank"), found


def cascade(query: DataFrame, index: DataFrame, found: DataFrame, model: PipelineModel, settings: Settings | None = None, scorer: models.Scorer = models.lexical_scorer) -> DataFrame:
    """(s1_id, c_id, rank, scores): the model's best ten of each entity, then the reranker's decision."""
    settings = settings or Settings()
    if settings.mode == "validate":
        first = query.orderBy("ord").limit(settings.n_val).select(F.col("entity_id").alias("s1_id"))
        found = found.join(first, "s1_id", "left_semi")
    scored = models.score_pairs(model, features.pair_features(found, query, index, missing=None, constant_score=True, known=True), "lgbm_score")
    best = retrieve.top_k(scored.select("s1_id", "c_id", F.round("lgbm_score", 9).alias("lgbm_score")), settings.top_k, score="lgbm_score")
    fused = decide.fuse(models.rerank(best, query, index, scorer))
    return decide.decide(fused, "ce_logit", settings.ce_threshold, inclusive=True)
