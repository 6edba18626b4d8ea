import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans.sql import ORACLES

SF = "/root/testdata/sf0.001"
FAST = ["normalize_entities", "truth_pairs", "b0_exact_match", "b0_validation", "block_acronym", "block_rare_token", "structural_lookup", "bucket_cap_200", "purge_over_200", "bm25_top50", "calibrate_threshold", "validate_output", "candidate_union", "char_cosine_top50", "word_cosine_top50", "recall_at_k", "bm25_entities", "bm25_recall", "ratio_feature", "hash_split_counts", "source_round_trip", "candidate_file", "truth_file", "validate_file", "stream_best_scores", "stream_running_frequency"]


def test_entry(spark):
    assert entry.entry(spark).columns == ["s1_id", "matched"]


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "customer", "supplier", "part", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want, got = c.execute(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, SF).toPandas()
    rows = lambda df: sorted(tuple(round(float(v), 6) if not isinstance(v, str) else v for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
