"""Matchers and scorers: boosted trees, and pluggable text scorers and embedders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.similarity import jaccard
from tessera.functions.text import tokens
from tessera.operators.features import FEATURES

#: A scorer of two text columns; the default needs no model file.
Scorer = Callable[[Column, Column], Column]


def lexical_scorer(a: Column, b: Column) -> Column:
    """Share of words that two texts have in common."""
    return lexical_words(tokens(a), tokens(b))


def lexical_words(a: Column, b: Column) -> Column:
    """:func:`lexical_scorer` of texts whose words are known."""
    return jaccard(a, b)


def train_matcher(pairs: DataFrame, features: list[str] = FEATURES, label: str = "label", held: str | None = None, rounds: int = 30, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees for pairs; with ``held`` (boolean column) boosting stops when held-out loss does."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", maxIter=rounds, seed=seed, validationTol=1e-4)
    if held:
        gbt = gbt.setValidationIndicatorCol(held)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt]).fit(pairs)


def score_pairs(model: PipelineModel, pairs: DataFrame, name: str = "match_prob") -> DataFrame:
    """Pairs with the probability of a match."""
    return model.transform(pairs).withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def save_matcher(model: PipelineModel, path: str) -> None:
    """Write a trained matcher, over an older one."""
    model.write().overwrite().save(path)


def load_matcher(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_index(embedded: DataFrame, path: str) -> None:
    """Write (id, embedding), over an older index; :func:`load_index` reads what dense search takes."""
    embedded.select("id", "embedding").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, embedding array<float>").parquet(path)


def hashed_embedder(size: int = 64) -> Callable[[Column], Column]:
    """An embedder that needs no model file: counts of a text's words in ``size`` hashed places."""

    def embed_(text: Column) -> Column:
        places = F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))

    return embed_


def importances(model: PipelineModel, features: list[str] = FEATURES, first: int = 15) -> list[tuple[str, float]]:
    """Features by importance, the largest first."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, values.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:first]


def rerank(pairs: DataFrame, query: DataFrame, index: DataFrame, scorer: Scorer = lexical_scorer, name: str = "ce_logit") -> DataFrame:
    """Pairs with a text scorer's value for both entities' search texts; missing texts are empty."""
    from tessera.functions.text import search_text

    q = query.select(F.col("entity_id").alias("s1_id"), F.trim(search_text()).alias("q_text"))
    x = index.select(F.col("entity_id").alias("c_id"), F.trim(search_text()).alias("x_text"))
    both = pairs.join(q, "s1_id", "left").join(x, "c_id", "left")
    return both.withColumn(name, scorer(F.coalesce("q_text", F.lit("")), F.coalesce("x_text", F.lit("")))).drop("q_text", "x_text")


def embed(entities: DataFrame, embedder: Callable[[Column], Column]) -> DataFrame:
    """(id, embedding) of entities with any column embedder; :func:`save_index` keeps it."""
    from tessera.functions.text import dense_text

    return entities.select(F.col("entity_id").alias("id"), embedder(dense_text()).alias("embedding"))
