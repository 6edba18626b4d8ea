"""A corpus pipeline of five stages; each gets the documents its predecessor kept, written as Parquet and read again.

All stages but the last return the columns of documents.  Rows are told apart
by id and text, so null ids and repeated rows are defined: repeated rows of one
document are copies of which the near-duplicate stage keeps one.  Columns that
the stages do not know are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, minhash, suffix, toxicity
from tessera.llm.common import settle, table

#: SQL can't express the stages (a learned score, tokenizer merges): tests hold them against brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the pair (__ord, __key) that names a row."""
    return docs.select("doc_id", "text", *suffix.text_key())


def _with_key(docs: DataFrame) -> DataFrame:
    """Every column of ``docs`` under a name of ours, and the pair that names a row."""
    return docs.select(*[docs[c].alias(f"__c{i}") for i, c in enumerate(docs.columns)], *suffix.text_key())


def _own(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go; labels are learned from the training rows alone."""
    lexicon = toxicity.fit_on_training(docs, table(spark, sf_dir, "labels"))
    names = docs.columns
    held = docs.select(*[docs[c].alias(f"__c{i}") for i, c in enumerate(names)])
    scored = toxicity.score(held, lexicon, held.columns, text=f"__c{names.index('text')}")
    return _own(scored.filter(F.col("score") < toxicity.THRESHOLD), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest id stays."""
    found = minhash.near_duplicates(_keyed(docs), ["__ord", "__key"])
    first = found.groupBy("__component").agg(F.min(F.struct("__ord", "__key")).alias("f")).select("f.*")
    kept = _with_key(docs).join(first, ["__ord", "__key"], "left_semi").dropDuplicates(["__ord", "__key"])
    return _own(kept, docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also stand in a document with a smaller id are cut out; n_chars follows."""
    _, spans = suffix.repeated_spans(_keyed(docs), [])
    changed = suffix.changed_texts(docs, spans, with_text=True).select("__ord", "__key", "kept_text")
    names = docs.columns
    at = {c: f"__c{i}" for i, c in enumerate(names)}
    out = _with_key(docs).join(changed, ["__ord", "__key"], "left")
    new = {at["text"]: F.coalesce("kept_text", at["text"])}
    if "n_chars" in at:
        new[at["n_chars"]] = F.when(F.col("kept_text").isNull(), F.col(at["n_chars"])).otherwise(F.char_length("kept_text")).cast(docs.schema["n_chars"].dataType)
    return _own(out.withColumns(new), names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.scan(_keyed(docs), table(spark, sf_dir, "benchmark"), ["__ord", "__key"])
    bad = found.filter("contaminated").select("__ord", "__key").distinct()
    return _own(_with_key(docs).join(bad, ["__ord", "__key"], "left_anti"), docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text with the characters they end at, and digests of the ids and of the decoded bytes."""
    return bpe.encode(docs, bpe.default_ranks_path(), public_tokenizers.PATTERN, ["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-duplicates", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
