"""One query for each operator; :mod:`tessera.plans.sql` has the SQL for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.similarity import conflict, dot, jaccard, overlap, partial_ratio, ratio, unit
from tessera.functions.text import char_grams, dense_text, lexical_text, normalize, numeric_tokens, search_text, tokens, word_grams
from tessera.operators import blocking, decide, features, metrics, models, retrieve
from tessera.plans import pipelines
from tessera.plans.sql import ORACLES  # noqa: F401
from tessera.sources import files
from tessera.sources.adapter import entities, normalized, split, table, truth
from tessera.sources.shared import new_path, settle
from tessera.streaming import candidates as streaming

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sides' normalised entities, written once: several stages read them."""
    return split(settle(normalized(spark, sf_dir)))


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.withColumn("score", F.round("score", digits))


@query
def normalize_entities(spark, sf_dir):
    return normalized(spark, sf_dir).select("entity_id", "name_basic", "name_core", F.array_join("name_tokens", " ").alias("name_tokens"), "name_acronym", "address_basic", F.array_join("numeric_tokens", " ").alias("numeric_tokens"), "country_normalized")


@query
def numeric_tokens_(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(numeric_tokens(F.col("c_name")), " ").alias("numbers"))


@query
def profile_rowcounts(spark, sf_dir):
    return metrics.row_counts(entities(spark, sf_dir))


@query
def profile_missing(spark, sf_dir):
    return metrics.missing_counts(entities(spark, sf_dir), ["business_name", "business_address", "country"])


@query
def country_value_counts(spark, sf_dir):
    return metrics.value_counts(entities(spark, sf_dir), "country")


@query
def match_count_stats(spark, sf_dir):
    s1, _ = split(entities(spark, sf_dir))
    return metrics.match_counts(pipelines.as_lists(s1, truth(spark, sf_dir), "c_id"))


@query
def truth_pairs(spark, sf_dir):
    return truth(spark, sf_dir)


def _exact(spark, sf_dir):
    s1, s23 = split(normalized(spark, sf_dir))
    return blocking.pairs(blocking.key_table(s1, ("exact",)), blocking.key_table(s23, ("exact",))), s1, s23


def _scored(spark, sf_dir):
    """Exact pairs with word overlaps of addresses (score) and names."""
    columns = {c: F.col(c) for c in ("address_tokens", "name_tokens", "numeric_tokens")}
    overlaps = {"score": F.round(jaccard(F.col("q_address_tokens"), F.col("x_address_tokens")), 6), "name_jaccard": jaccard(F.col("q_name_tokens"), F.col("x_name_tokens"))}
    return features.exact_scored(*split(normalized(spark, sf_dir)), columns, overlaps, ("q_numeric_tokens", "x_numeric_tokens"))


def _ids(s1: DataFrame) -> DataFrame:
    return s1.select(F.col("entity_id").alias("s1_id"))


@query
def label_pairs(spark, sf_dir):
    return features.label(_exact(spark, sf_dir)[0].select("s1_id", "c_id"), truth(spark, sf_dir))


@query
def modulo_split_counts(spark, sf_dir):
    s1, _ = split(entities(spark, sf_dir))
    return decide.modulo_split(s1.withColumn("k", F.floor(F.col("ord") / 5)), "k").groupBy("held").agg(F.count("*").alias("n"))


@query
def hash_split_counts(spark, sf_dir):
    s1, _ = split(entities(spark, sf_dir))
    return decide.hash_split(s1, "entity_id").groupBy("held").agg(F.count("*").alias("n"))


def _listed(lists):
    return lists.select("s1_id", F.array_join("c_ids", ",").alias("matched"))


@query
def b0_exact_match(spark, sf_dir):
    return _listed(blocking.exact_match(*split(entities(spark, sf_dir))))


@query
def b0_allow_empty(spark, sf_dir):
    return _listed(blocking.exact_match(*split(entities(spark, sf_dir, blank_names=True))))


@query
def b0_validation(spark, sf_dir):
    return _listed(blocking.exact_match(*split(entities(spark, sf_dir, blank_names=True)), allow_empty=False))


@query
def block_exact(spark, sf_dir):
    return _exact(spark, sf_dir)[0].select("s1_id", "c_id")


def _block(spark, sf_dir, kind, limits=None):
    s1, s23 = split(normalized(spark, sf_dir))
    index = blocking.key_table(s23, (kind,))
    if limits:
        few = index.groupBy("country", "key").agg(F.count("*").alias("n")).filter(F.col("n") <= limits)
        index = index.join(few, ["country", "key"], "left_semi")
    return blocking.pairs(blocking.key_table(s1, (kind,)), index).select("s1_id", "c_id")


@query
def block_acronym(spark, sf_dir):
    return _block(spark, sf_dir, "acr")


@query
def block_rare_token(spark, sf_dir):
    return _block(spark, sf_dir, "tok", 100)


@query
def block_prefix5(spark, sf_dir):
    return _block(spark, sf_dir, "pfx")


@query
def block_numeric(spark, sf_dir):
    long_ = lambda c: F.explode(F.filter(numeric_tokens(F.col(c)), lambda t: F.length(t) >= 3)).alias("k")
    a = table(spark, sf_dir, "customer").select("c_custkey", long_("c_name"))
    return a.join(table(spark, sf_dir, "supplier").select("s_suppkey", long_("s_name")), "k").select("c_custkey", "s_suppkey").distinct()


def _part_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.struct(F.lit("brand").alias("key_type"), F.col("p_brand").alias("key")), F.struct(F.lit("type").alias("key_type"), F.col("p_type").alias("key")))).alias("k")).select("p_partkey", "k.*")


@query
def bucket_cap_200(spark, sf_dir):
    return blocking.bucket_cap(_part_keys(spark, sf_dir), order=("p_partkey",))


@query
def purge_over_200(spark, sf_dir):
    return blocking.purge(_part_keys(spark, sf_dir), by=("key_type", "key"), entity="p_partkey").select("p_partkey", "key_type", "key")


@query
def structural_lookup(spark, sf_dir):
    return blocking.structural_lookup(*_sides(spark, sf_dir)).select("s1_id", "c_id")


@query
def structural_running_freq(spark, sf_dir):
    return blocking.streamed_structural(*_sides(spark, sf_dir)).select("s1_id", "c_id")


@query
def b1_candidates_cap50(spark, sf_dir):
    return blocking.arrival_candidates(*_sides(spark, sf_dir)).select("s1_id", "c_id", "rank")


@query
def stream_b1_candidates(spark, sf_dir):
    return streaming.stream_candidates(spark, _streamed(entities(spark, sf_dir).filter("src > 1")), entities(spark, sf_dir).filter("src = 1"))


def _streamed(df: DataFrame) -> DataFrame:
    """``df``, written and read as a stream of files."""
    df = settle(df)
    return df.sparkSession.readStream.schema(df.schema).parquet(df.inputFiles()[0].rsplit("/", 1)[0])


@query
def stream_running_frequency(spark, sf_dir):
    """Words of streamed index rows while their running count is at most 500."""
    words = blocking.key_table(split(normalized(spark, sf_dir))[1], ("tok",)).select("country", "key", F.col("entity_id").alias("c_id"), "src", "ord")
    path = streaming.append_all(streaming.running_frequency(_streamed(words)))
    return spark.read.schema("country string, key string, c_id string, src int, ord long").parquet(path).select("country", "key", "c_id")


@query
def stream_best_scores(spark, sf_dir):
    """Each entity's best candidates from a stream of scored pairs."""
    return streaming.best_by_batch(_streamed(_scored(spark, sf_dir).select("s1_id", "c_id", "score")), new_path(spark))


@query
def char_cosine_top50(spark, sf_dir):
    return _rounded(retrieve.char_top(*_sides(spark, sf_dir)))


@query
def word_cosine_top50(spark, sf_dir):
    return _rounded(retrieve.word_top(*_sides(spark, sf_dir)))


@query
def cosine_threshold(spark, sf_dir):
    s1, s23 = _sides(spark, sf_dir)
    return _rounded(retrieve.cosine_best(s1, s23, {0.3: char_grams(search_text()), 0.2: word_grams(search_text())}))


@query
def merge_retrievers_top100(spark, sf_dir):
    s1, s23 = _sides(spark, sf_dir)
    return _rounded(retrieve.top_k(retrieve.merge_best(retrieve.char_top(s1, s23), retrieve.word_top(s1, s23)), 100))


@query
def merge_structural_base(spark, sf_dir):
    s1, s23 = _sides(spark, sf_dir)
    return _rounded(retrieve.add_base(retrieve.word_top(s1, s23), blocking.structural_lookup(s1, s23)))


def _bm25(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), "text")
    return retrieve.bm25(queries, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d_id"), "text"))


@query
def bm25_top50(spark, sf_dir):
    return _rounded(_bm25(spark, sf_dir))


@query
def bm25_recall(spark, sf_dir):
    """Recall of documents that share ten words in a row (parted by single spaces) with an item."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    runs = lambda df, name: df.select(F.col(df.columns[0]).alias(name), words.alias("w")).filter(F.size("w") >= 10).select(name, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 9), lambda i: F.md5(F.array_join(F.slice("w", i, 10), " ").cast("binary")))).alias("run")).distinct()
    t = runs(table(spark, sf_dir, "benchmark").select("item_id", "text"), "q_id").join(runs(table(spark, sf_dir, "documents").select("doc_id", "text"), "d_id"), "run").select("q_id", "d_id").distinct()
    hits = t.join(_bm25(spark, sf_dir).select("q_id", "d_id", "rank"), ["q_id", "d_id"], "left").groupBy("q_id").agg((F.count("rank") / F.count("*")).alias("h"))
    return hits.agg(F.round(100 * F.avg("h"), 6).alias("recall_at_50"), F.count("*").alias("n_queries"))


def _dense(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieve.dense_top(rows.filter("id % 100 = 0"), rows)


@query
def dense_top10(spark, sf_dir):
    return _rounded(_dense(spark, sf_dir), 5)


@query
def dense_recall(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    both = _dense(spark, sf_dir).join(labels.select(F.col("vec_id").alias("q_id"), F.col("label").alias("a")), "q_id").join(labels.select(F.col("vec_id").alias("c_id"), F.col("label").alias("b")), "c_id")
    return both.agg(F.round(100 * F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("same_label"), F.count("*").alias("n"))


@query
def l2_normalize(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").select("vec_id", unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(dot(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.get("u", 0), 6).alias("first"))


@query
def jaccard_features(spark, sf_dir):
    return _scored(spark, sf_dir).select("s1_id", "c_id", F.col("score").alias("addr_jaccard"), F.round("name_jaccard", 6).alias("name_jaccard"))


@query
def numeric_features(spark, sf_dir):
    a, b = F.col("q_numeric_tokens"), F.col("x_numeric_tokens")
    return _scored(spark, sf_dir).select("s1_id", "c_id", overlap(a, b).alias("num_overlap"), conflict(a, b).alias("num_conflict"))


@query
def ratio_feature(spark, sf_dir):
    value = F.round(ratio("q_address_basic", "x_address_basic"), 6)
    return features.exact_scored(*split(normalized(spark, sf_dir)), {"address_basic": F.col("address_basic")}, {"addr_ratio": value})


@query
def partial_ratio_feature(spark, sf_dir):
    value = F.round(partial_ratio("q_address_basic", "x_address_basic"), 6)
    return features.exact_scored(*split(normalized(spark, sf_dir)), {"address_basic": F.col("address_basic")}, {"addr_jaro": value})


@query
def pair_features(spark, sf_dir):
    s1, s23 = _sides(spark, sf_dir)
    return features.pair_features(blocking.arrival_candidates(s1, s23).select("s1_id", "c_id"), s1, s23)


@query
def macro_f05(spark, sf_dir):
    pairs, s1, _ = _exact(spark, sf_dir)
    return metrics.macro_f05(_ids(s1), truth(spark, sf_dir), pairs)


@query
def recall_at_k(spark, sf_dir):
    s1, s23 = _sides(spark, sf_dir)
    return metrics.recall_at(_ids(s1), truth(spark, sf_dir), retrieve.char_top(s1, s23, 100))


@query
def calibrate_threshold(spark, sf_dir):
    s1, _ = split(entities(spark, sf_dir))
    return decide.calibrate(_ids(s1), truth(spark, sf_dir), _scored(spark, sf_dir))


@query
def roc_auc(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return metrics.auc(rows.select(((F.col("n_chars") % 97) / F.lit(97.0)).alias("score"), F.col("toxic").alias("label")))


@query
def model_topk(spark, sf_dir):
    return _rounded(retrieve.top_k(_scored(spark, sf_dir), 10).select("s1_id", "c_id", "score", "rank"))


@query
def fuse_scores(spark, sf_dir):
    return decide.fuse(_scored(spark, sf_dir), "score", "name_jaccard").select("s1_id", "c_id", F.round("fused", 6).alias("fused"))


@query
def decision(spark, sf_dir):
    kept = decide.decide(_scored(spark, sf_dir), "score", 0.45, inclusive=True)
    return kept.select("s1_id", "c_id", (F.col("score") > 0.5).alias("strict"), (F.col("score") >= 0.45).alias("inclusive"))


@query
def gbt_match(spark, sf_dir):
    """Train on structural candidates labelled by truth, keep and load the model, then match first arrivals."""
    s1, s23 = _sides(spark, sf_dir)
    found = features.label(blocking.arrival_candidates(s1, s23).select("s1_id", "c_id"), truth(spark, sf_dir))
    rows = settle(features.pair_features(found, s1, s23, constant_score=True))
    path = new_path(spark)
    models.save_matcher(models.train_matcher(decide.hash_split(rows, "s1_id"), held="held"), path)
    return models.score_pairs(models.load_matcher(path), rows).select("s1_id", "c_id", "match_prob", "label")


@query
def cascade_match(spark, sf_dir):
    """The model's best ten of each entity and the reranker's decision."""
    s1, s23 = _sides(spark, sf_dir)
    found = settle(features.label(blocking.arrival_candidates(s1, s23).select("s1_id", "c_id"), truth(spark, sf_dir)))
    rows = decide.hash_split(settle(features.pair_features(found, s1, s23, constant_score=True)), "s1_id")
    model = models.train_matcher(rows, held="held")
    return pipelines.cascade(s1, s23, found.drop("label"), model)


@query
def ce_rerank(spark, sf_dir):
    """The reranker's value of exact pairs, once for each pair of search texts."""
    value = F.round(models.lexical_words(F.col("q_words"), F.col("x_words")), 6)
    return features.exact_scored(*split(normalized(spark, sf_dir)), {"words": tokens(F.trim(search_text()))}, {"ce_logit": value})


@query
def validate_output(spark, sf_dir):
    """Checks of an output with rows taken away, repeated and added."""
    s1, s23 = split(entities(spark, sf_dir))
    full = blocking.exact_match(s1, s23).join(s1.select(F.col("entity_id").alias("s1_id"), "ord"), "s1_id")
    odd = full.filter("ord % 100 <> 0").unionByName(full.filter("ord % 150 = 5")).select("s1_id", "c_ids")
    extra = spark.range(1).select(F.lit("X1").alias("s1_id"), F.array().cast("array<string>").alias("c_ids"))
    return metrics.checks(odd.unionByName(extra), _ids(s1))


@query
def compare_runs(spark, sf_dir):
    s1, s23 = split(entities(spark, sf_dir))
    return metrics.compare_runs(blocking.exact_match(s1, s23), pipelines.as_lists(s1, truth(spark, sf_dir), "c_id"))


@query
def missing_ids_anti(spark, sf_dir):
    pairs, s1, _ = _exact(spark, sf_dir)
    return s1.select("entity_id").join(pairs.select(F.col("s1_id").alias("entity_id")), "entity_id", "left_anti")


@query
def needed_ids_semi(spark, sf_dir):
    pairs, _, s23 = _exact(spark, sf_dir)
    return s23.join(pairs.select(F.col("c_id").alias("entity_id")).distinct(), "entity_id", "left_semi").select("entity_id", "name_basic")


@query
def sample_noise_pool(spark, sf_dir):
    _, s23 = split(entities(spark, sf_dir))
    return decide.noise_pool(s23, truth(spark, sf_dir).select(F.col("c_id").alias("entity_id")), "entity_id", F.col("ord") % 50 == 1).select("entity_id", "wanted")


@query
def candidate_union(spark, sf_dir):
    s1, s23 = _sides(spark, sf_dir)
    return blocking.structural_lookup(s1, s23).select("s1_id", "c_id").union(blocking.arrival_candidates(s1, s23).select("s1_id", "c_id")).distinct()


@query
def first_rows(spark, sf_dir):
    s1, _ = split(entities(spark, sf_dir))
    return s1.filter("ord < 100").select("entity_id")


@query
def source_round_trip(spark, sf_dir):
    """Entities written as a TSV and read as a source, rows of one country."""
    path = new_path(spark)
    rows = entities(spark, sf_dir).select("entity_id", "business_name", "business_address", "country")
    files.write_tsv(rows, path)
    return files.read_source(spark, path, columns=["entity_id", "business_name"], country="de")


@query
def truth_file(spark, sf_dir):
    """Match lists written as a result file and decoded as truth."""
    path = new_path(spark)
    s1, _ = split(entities(spark, sf_dir))
    files.write_lists(pipelines.as_lists(s1, truth(spark, sf_dir), "c_id"), path)
    return files.read_truth(spark, path).select("s1_id", F.array_join(F.array_sort("c_ids"), ",").alias("matched"))


@query
def truth_sample(spark, sf_dir):
    """50 rows of a truth file in hash order: a sampling operator."""
    path = new_path(spark)
    s1, _ = split(entities(spark, sf_dir))
    files.write_lists(pipelines.as_lists(s1, truth(spark, sf_dir), "c_id"), path)
    return files.truth_sample(spark, path, 50).select("s1_id", F.array_join(F.array_sort("c_ids"), ",").alias("matched"))


@query
def candidate_file(spark, sf_dir):
    """Exact candidates, written in the first source's order in two appended parts; the first 60 rows of the file as read."""
    path = new_path(spark)
    s1, s23 = split(entities(spark, sf_dir))
    lists = blocking.exact_match(s1, s23).join(s1.select(F.col("entity_id").alias("s1_id"), F.col("ord").alias("row")), "s1_id")
    files.write_lists(lists, path, "candidate_entity_ids", single=True)
    return files.read_candidates(spark, path, first=60).select("s1_id", F.array_join("c_ids", ",").alias("candidates"))


@query
def appended_results(spark, sf_dir):
    """A result file written country by country, each appended."""
    path = new_path(spark)
    s1, s23 = split(entities(spark, sf_dir))
    lists = settle(blocking.exact_match(s1, s23).join(s1.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id"))
    for i, r in enumerate(lists.select("country").distinct().orderBy("country").collect()):
        files.write_lists(lists.filter(F.col("country").eqNullSafe(F.lit(r.country))).drop("country"), path, append=i > 0)
    return files.read_truth(spark, path).select("s1_id", F.array_join("c_ids", ",").alias("matched"))


@query
def normalized_table(spark, sf_dir):
    """Normalised rows written with one folder a country, and read back by country."""
    path = new_path(spark)
    files.write_normalized(normalized(spark, sf_dir), path)
    kept = spark.read.parquet(path).filter("country_normalized = 'de'")
    return files.read_needed(kept, split(kept)[0], ["entity_id", "name_core", "numeric_tokens"]).select("entity_id", "name_core", F.array_join("numeric_tokens", " ").alias("numeric_tokens"))


@query
def report_file(spark, sf_dir):
    """Row counts written as a text report and read back."""
    path = new_path(spark)
    files.write_report(metrics.row_counts(entities(spark, sf_dir)), path)
    return spark.read.schema("src int, n long").option("sep", "\t").option("header", True).csv(path)


@query
def hash_sample(spark, sf_dir):
    """100 ids in hash order: a sampling operator."""
    return decide.hash_sample(split(entities(spark, sf_dir))[0], "entity_id", 100).select("entity_id")


@query
def retriever_texts(spark, sf_dir):
    return normalized(spark, sf_dir).select("entity_id", lexical_text().alias("lexical"), dense_text().alias("dense"))


@query
def bm25_entities(spark, sf_dir):
    """BM25 of first-source entities over the others' texts; ranks without a common word score 0."""
    s1, s23 = _sides(spark, sf_dir)
    side = lambda df, name: df.select(F.col("entity_id").alias(name), lexical_text().alias("text"))
    return _rounded(retrieve.bm25(side(s1, "q_id"), side(s23, "d_id"), zeros=True))


@query
def dense_index(spark, sf_dir):
    """Hashed word counts of entities, kept as an index and searched."""
    s1, s23 = _sides(spark, sf_dir)
    path = new_path(spark)
    embedder = models.hashed_embedder()
    models.save_index(models.embed(s23, embedder), path)
    ids = lambda df: df.select(F.substring("id", 2, 19).cast("long").alias("id"), "embedding")
    return _rounded(retrieve.dense_top(ids(models.embed(s1, embedder)), ids(models.load_index(spark, path)), 5))


@query
def random_negatives(spark, sf_dir):
    s1, s23 = split(entities(spark, sf_dir))
    return features.random_negatives(s1, s23, truth(spark, sf_dir))


@query
def inverted_index(spark, sf_dir):
    """Entities of each acronym and prefix, in order of arrival."""
    index = blocking.inverted_index(blocking.key_table(split(normalized(spark, sf_dir))[1], ("acr", "pfx")))
    return index.select("country", "key_type", "key", F.array_join("entity_ids", ",").alias("entity_ids"))


@query
def run_counters(spark, sf_dir):
    s1, s23 = split(entities(spark, sf_dir))
    return metrics.run_counters(_ids(s1), blocking.exact_match(s1, s23), _exact(spark, sf_dir)[0])


@query
def validate_file(spark, sf_dir):
    """Checks of a result file as written."""
    path = new_path(spark)
    s1, s23 = split(entities(spark, sf_dir))
    files.write_lists(blocking.exact_match(s1, s23), path)
    return metrics.file_checks(spark, path, _ids(s1))


@query
def sample_matches(spark, sf_dir):
    """The first three matched entities: a report."""
    return metrics.samples(blocking.exact_match(*split(entities(spark, sf_dir))))


QUERIES["numeric_tokens"] = QUERIES.pop("numeric_tokens_")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact-match result table: every first-source entity and its matches."""
    return b0_exact_match(spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship", "normalize"]
