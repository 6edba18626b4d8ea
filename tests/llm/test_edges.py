"""Clashing names, empty tables and very long texts for every operator."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontaminate, html, images, licenses, lm, minhash, suffix, toxicity

WORDS = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heath", "inlet", "knoll", "l3vel", "m@rsh"]


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of over 3 MB, one that shares its end, and a word of 1 MB."""
    rng = random.Random(1)
    text = " ".join(rng.choice(WORDS) + str(rng.randrange(10_000)) for _ in range(320_000))
    return spark.createDataFrame([(1, text), (2, "x y z " + text[-200_000:]), (3, "a" * 1_000_000)], "doc_id long, text string"), text


def lm_parts(spark, docs):
    training = lm._prepared(docs, "doc_id", "text")
    counted = lm.count_words(training)
    counts = lm.known_counts(counted)
    return counted, counts, lm.Model(counts)


def runs(spark, docs, keep):
    """Every operator on documents, with the columns ``keep`` carried along."""
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    return {
        "lm": lambda: lm.score(docs, keep, *lm_parts(spark, docs.limit(0))),
        "suffix": lambda: suffix.remove_repeats(docs, keep),
        "licenses": lambda: licenses.scan(docs, keep),
        "toxicity": lambda: toxicity.score(docs, toxicity.Lexicon({"idiot": 5.0}), keep),
        "minhash": lambda: minhash.near_duplicates(docs, keep),
        "bpe": lambda: bpe.encode(docs, bpe.default_ranks_path(), public_tokenizers.PATTERN, keep, digests_only=True),
        "html": lambda: html.extract(docs, keep, html="text"),
        "decontaminate": lambda: decontaminate.scan(docs, items, keep),
    }


RESULTS = {"lm": "base_score", "suffix": "n_removed", "licenses": "labels", "toxicity": "score", "minhash": "component_id", "bpe": "ids_sha256", "html": "n_chars", "decontaminate": "n_hit"}


@pytest.mark.parametrize("name", RESULTS)
def test_clashing_names(spark, name):
    """A kept column named like a result is refused; one named like an inner column is carried along."""
    docs = spark.createDataFrame([(1, "some words here", 7)], f"doc_id long, text string, {RESULTS[name]} int")
    with pytest.raises(ValueError):
        runs(spark, docs, ["doc_id", RESULTS[name]])[name]()
    odd = docs.withColumnRenamed(RESULTS[name], "__odd").withColumn("doc_id ", F.lit("b"))
    assert [tuple(r)[:3] for r in runs(spark, odd, ["doc_id", "__odd", "doc_id "])[name]().collect()] == [(1, 7, "b")]


@pytest.mark.parametrize("name", RESULTS)
def test_empty_tables(spark, name):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = runs(spark, docs, ["doc_id"])[name]()
    assert out.count() == 0 and RESULTS[name] in out.columns


def test_empty_conversations_and_images(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(none, chat.default_tokenizer_path()).count() == 0
    assert images.rendered(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_long_texts(spark, long_docs):
    docs, text = long_docs
    n = len(text.split())
    out = {k: {r.doc_id: r for r in f().collect()} for k, f in runs(spark, docs, ["doc_id"]).items()}
    assert out["lm"][1].n_tokens == n + 1 and out["lm"][3].n_tokens == 2
    assert out["suffix"][2].n_removed == 200_000 and out["suffix"][1].n_removed == 0 and out["suffix"][3].n_bytes == 1_000_000
    assert out["licenses"][1].n_words > 0 and out["licenses"][1].n_base == 0
    assert all(0 < r.score < 0.7 for r in out["toxicity"].values())
    assert out["minhash"][1].n_shingles > 300_000 and out["minhash"][2].component_id == 2
    assert out["bpe"][1].decoded_sha256 != out["bpe"][2].decoded_sha256 and out["bpe"][3].n_tokens > 0
    assert out["html"][1].text == text
    assert out["decontaminate"][1].n_hit == 0
