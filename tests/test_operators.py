import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import char_grams, normalize, search_text, word_grams
from tessera.operators import blocking, cells, decide, features, metrics, models, retrieve
from tessera.plans import pipelines


def people(spark, rows):
    return normalize(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, src int, ord long"))


def test_first_arrivals_keep_fifty(spark):
    s1 = people(spark, [("q", "acme stone", "", "us", 1, 0)])
    s23 = people(spark, [(f"c{i}", "acme stone", "", "us", 2 if i < 30 else 3, i) for i in range(60)])
    got = sorted((r["rank"], r.c_id) for r in blocking.arrival_candidates(s1, s23).collect())
    assert got == [(i + 1, f"c{i}") for i in range(50)]


def test_purge_and_cap(spark):
    keys = lambda n: spark.range(n).select(F.concat(F.lit("e"), "id").alias("entity_id"), F.lit(2).alias("src"), F.col("id").alias("ord"), F.lit("us").alias("country"), F.lit("tok").alias("key_type"), F.lit("k").alias("key"))
    assert blocking.purge(keys(201)).count() == 0 and blocking.purge(keys(200)).count() == 200
    assert blocking.bucket_cap(keys(201)).agg(F.count("*"), F.max("ord")).first() == (200, 199)


def test_running_frequency_against_loop(spark, monkeypatch):
    monkeypatch.setattr(blocking.fixed, "RARE_RUNNING", 6)
    rng = random.Random(3)
    rows = [(f"c{i}", " ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(rng.randint(1, 4))), "", rng.choice(["us", "fr"]), 2 + i // 20, i) for i in range(40)]
    seen, want = {}, set()
    for e, name, _, country, _, _ in rows:
        for t in name.split():
            seen[country, t] = seen.get((country, t), 0) + 1
        want |= {(e, t) for t in name.split() if seen[country, t] <= 6}
    assert {(r.entity_id, r.key) for r in blocking.running_frequency(people(spark, rows)).collect()} == want


def test_exact_match_and_empty_names(spark):
    rows = [("a", " Acme ", "", "US", 1, 0), ("b", "", "", "US", 1, 1), ("x", "acme", "", "us", 3, 2), ("y", "ACME", "", "us ", 2, 9), ("z", "", "", "us", 2, 4)]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, src int, ord long")
    s1, s23 = df.filter("src = 1"), df.filter("src > 1")
    assert {r.s1_id: list(r.c_ids) for r in blocking.exact_match(s1, s23).collect()} == {"a": ["y", "x"], "b": ["z"]}
    assert {r.s1_id: list(r.c_ids) for r in blocking.exact_match(s1, s23, allow_empty=False).collect()} == {"a": ["y", "x"], "b": []}


def test_exact_match_moves_no_pairs(spark, monkeypatch):
    """Lists long or short, blank names and repeated ids; rows that meet their lists are as many as the entities."""
    monkeypatch.setattr(blocking, "LONG_LIST", 5)
    rows = [(f"q{i}", "" if i % 2 else f"n{i}", "de", 1, i) for i in range(20)] + [("q2", "n4", "de", 1, 99)]
    s1 = spark.createDataFrame(rows, "entity_id string, business_name string, country string, src int, ord long")
    index = [(f"x{i}", "" if i % 3 else f"n{i % 20}", "de", 2, 100 - i) for i in range(60)]
    s23 = spark.createDataFrame(index, s1.schema)
    want = {}
    for e, name, *_ in rows:
        want.setdefault(e, []).extend((r[4], r[0]) for r in index if r[1] == name)
    got = blocking.exact_match(s1, s23)
    assert {r.s1_id: list(r.c_ids) for r in got.collect()} == {e: [c for _, c in sorted(v)] for e, v in want.items()} and got.count() == 20
    # of the lists only those of repeated ids are put together behind the join
    assert got.filter("s1_id <> 'q2'")._jdf.queryExecution().optimizedPlan().toString().count("collect_list") <= 1


@pytest.mark.parametrize("cell", [3, 200_000])
def test_exact_pairs_by_class(spark, monkeypatch, cell):
    """Every pair of a frequent name once, whatever the cells; values are worked out for pairs of classes only and spread over all tasks."""
    monkeypatch.setattr(features, "CELL", cell)
    rows = lambda p, n: normalize(spark.createDataFrame([(f"{p}{i}", "acme" if i % 4 else f"other {i % 3}", f"street {i % 7}", "de" if i % 5 else "") for i in range(n)], "entity_id string, business_name string, business_address string, country string"))
    s1, s23 = rows("q", 40), rows("x", 60)
    got = features.exact_scored(s1, s23, {"address_basic": F.col("address_basic")}, {"same": F.col("q_address_basic") == F.col("x_address_basic")})
    q, x = s1.collect(), s23.collect()
    want = sorted((a.entity_id, b.entity_id, a.address_basic == b.address_basic) for a in q for b in x if (a.country_normalized, a.name_basic) == (b.country_normalized, b.name_basic))
    assert sorted(map(tuple, got.collect())) == want
    assert got.rdd.getNumPartitions() == 4


def test_cosine(spark):
    s1, s23 = people(spark, [("q", "prime money", "", "us", 1, 0)]), people(spark, [("c", "prime mony", "", "us", 2, 1), ("d", "prime money", "", "fr", 2, 2)])
    got = retrieve.cosine_pairs(s1, s23, char_grams(search_text())).collect()
    assert [(r.c_id, round(r.score, 6)) for r in got] == [("c", 0.707107)]


@pytest.mark.parametrize("gram", [char_grams, word_grams])
def test_cosine_against_loop(spark, monkeypatch, gram):
    """Pairs, thresholds and best lists of every block size, with ties, repeated grams and blank countries."""
    rng = random.Random(7)
    monkeypatch.setattr(retrieve, "PRODUCTS", 50)
    words = ["prime", "money", "mony", "stone", "works", "works works", "ab", "x"]
    rows = [(f"e{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), rng.choice(["", "high st", "12 low rd"]), rng.choice(["us", "fr", "", " "]), 1 + i % 3, i) for i in range(60)]
    everyone = people(spark, rows)
    s1, s23 = everyone.filter("src = 1"), everyone.filter("src > 1")
    grams = {r.entity_id: (r.c, Counter(r.g)) for r in everyone.select("entity_id", F.col("country_normalized").alias("c"), gram(search_text()).alias("g")).collect()}
    side = {r[0]: r[4] for r in rows}
    want = {}
    for a, (ca, ga) in grams.items():
        for b, (cb, gb) in grams.items():
            if side[a] == 1 and side[b] > 1 and ca == cb != "" and (both := sum(ga[g] * gb[g] for g in ga)):
                want[a, b] = round(both / math.sqrt(sum(v * v for v in ga.values()) * sum(v * v for v in gb.values())), 6)
    for block in (1, 3, 100):
        got = retrieve.cosine_pairs(s1, s23, gram(search_text()), block=block)
        assert {(r.s1_id, r.c_id): round(r.score, 6) for r in got.collect()} == pytest.approx(want)
        high = retrieve.cosine_pairs(s1, s23, gram(search_text()), 0.5, block)
        assert {(r.s1_id, r.c_id) for r in high.collect()} == {p for p, v in want.items() if v > 0.5}
        best = retrieve.cosine_top(s1, s23, gram(search_text()), 3, block)
        lists = defaultdict(list)
        for (a, b), v in want.items():
            lists[a].append((-v, b))
        assert {(r.s1_id, r["rank"], r.c_id) for r in best.collect()} == {(a, i + 1, b) for a, x in lists.items() for i, (_, b) in enumerate(sorted(x)[:3])}
    assert retrieve.cosine_top(s1.limit(0), s23, gram(search_text()), 3).count() == retrieve.cosine_top(s1, s23.limit(0), gram(search_text()), 3).count() == 0


def test_bm25(spark):
    corpus = spark.createDataFrame([(1, "a b"), (2, "a c c"), (3, "d"), (4, None)][:3], "d_id long, text string")
    q = spark.createDataFrame([(1, "c"), (2, "a"), (3, "a c"), (4, ""), (5, None)], "q_id long, text string")
    got = {(r.q_id, r.d_id): round(r.score, 6) for r in retrieve.bm25(q, corpus).collect()}
    assert got == {(1, 2): 0.628708, (2, 1): 0.063853, (2, 2): 0.052125, (3, 2): 0.680834, (3, 1): 0.063853}


def test_dense_in_blocks(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)], "id long, embedding array<double>")
    q = rows.filter("id % 10 = 0")
    whole = sorted(map(tuple, retrieve.dense_top(q, rows, 5).collect()))
    assert whole == sorted(map(tuple, retrieve.dense_top(q, rows, 5, block=2).collect())) and len(whole) == 30
    assert all(a != b for a, b, *_ in whole)


def test_cosine_of_copies(spark, monkeypatch):
    """Copies on both sides: every pair once with its better score, without a shuffle of pairs; the best k with ties by id."""
    monkeypatch.setattr(retrieve, "INDEX_ROWS", 3)
    names = ["acme steel works", "acme steel", "north sea fish", "sea fish", "steel"]
    s1 = people(spark, [(f"q{i}", names[i % 5], "main street" if i % 2 else "", "de", 1, i) for i in range(20)])
    s23 = people(spark, [(f"x{i:02}", names[i % 5], "main road" if i % 3 else "", "de", 2, i) for i in range(30)])
    char, word = char_grams(search_text()), word_grams(search_text())
    for block in (4, 4096):
        got = retrieve.cosine_best(s1, s23, {0.3: char, 0.2: word}, block)
        want = retrieve.merge_best(retrieve.cosine_pairs(s1, s23, char, 0.3), retrieve.cosine_pairs(s1, s23, word, 0.2))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
        assert "Exchange" not in got.filter("score > 0")._jdf.queryExecution().executedPlan().toString()
        ranked = sorted(retrieve.cosine_pairs(s1, s23, char).collect(), key=lambda r: (r.s1_id, -r.score, r.c_id))
        best = [(r.s1_id, r.c_id) for i, r in enumerate(ranked) if sum(o.s1_id == r.s1_id for o in ranked[:i]) < 4]
        assert sorted((r.s1_id, r.c_id) for r in retrieve.cosine_top(s1, s23, char, 4, block).collect()) == sorted(best)


def test_dense_passes_on_the_best_of_a_task(spark, monkeypatch):
    """Many equal vectors: a task passes on k rows a query, not k a batch, and ties go by id."""
    monkeypatch.setattr(retrieve, "PRODUCTS", 40)
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(120)], "id long, embedding array<float>")
    passed = []
    monkeypatch.setattr(retrieve, "top_k", lambda df, *a, top=retrieve.top_k: passed.append(df.count()) or top(df, *a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = retrieve.dense_top(rows.filter("id < 6"), rows, 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert passed[0] <= 6 * 4 * 4
    for q in range(6):
        assert [r.c_id for r in sorted(got, key=lambda r: r["rank"]) if r.q_id == q] == [i for i in range(120) if i % 3 == q % 3 and i != q][:4]


def test_metrics(spark):
    e = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "s1_id string")
    t = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a")], "s1_id string, c_id string")
    p = spark.createDataFrame([("1", "a"), ("2", "a"), ("2", "b"), ("4", "a")], "s1_id string, c_id string")
    got = {r.s1_id: round(r.f, 6) for r in metrics.entity_f05(e, t, p).collect()}
    assert got == {"1": 0.833333, "2": 0.555556, "3": 1.0, "4": 0.0}
    assert metrics.macro_f05(e, t, p).first().macro_f05 == 0.597222
    assert metrics.macro_f05(e.limit(0), t, p).first().macro_f05 == 0.0


def test_calibration(spark):
    e, t = spark.createDataFrame([("1",)], "s1_id string"), spark.createDataFrame([("1", "c1")], "s1_id string, c_id string")
    s = spark.createDataFrame([("1", "c1", 0.9), ("1", "c2", 0.405)], "s1_id string, c_id string, score double")
    assert tuple(decide.calibrate(e, t, s).first()) == (0.41, 1.0)


def test_auc_and_percentile(spark):
    s = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)], "score double, label int")
    assert metrics.auc(s).first().auc == 0.75
    rng = random.Random(5)
    rows = [(rng.randint(0, 9) / 10, rng.randint(0, 1)) for _ in range(200)]
    pos, neg = [x for x, y in rows if y], [x for x, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.auc(spark.createDataFrame(rows, "score double, label int")).first().auc == pytest.approx(want, abs=1e-6)
    assert spark.sql("SELECT percentile(c, 0.95) FROM VALUES 1, 2, 3, 10 AS t(c)").first()[0] == pytest.approx(8.95)


def test_base_score_only_where_absent(spark):
    a = spark.createDataFrame([("1", "a", 0.05)], "s1_id string, c_id string, score double")
    b = spark.createDataFrame([("1", "a"), ("1", "b")], "s1_id string, c_id string")
    assert sorted(map(tuple, retrieve.add_base(a, b).collect())) == [("1", "a", 0.05), ("1", "b", 0.1)]


def test_matcher_and_cascade(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    s1 = people(spark, [(f"q{i}", f"{n} works", f"{i} main", "us", 1, i) for i, n in enumerate(names)])
    s23 = people(spark, [(f"c{i}", f"{n} works", f"{i} main", "us", 2, 100 + i) for i, n in enumerate(names)])
    truth = spark.createDataFrame([(f"q{i}", f"c{i}") for i in range(40)], "s1_id string, c_id string")
    model, table = pipelines.train(s1, s23, truth, rounds=3)
    scores = models.score_pairs(model, table)
    assert scores.filter("match_prob < 0 OR match_prob > 1").count() == 0 and len(models.importances(model)) == 9
    found = blocking.arrival_candidates(s1, s23).select("s1_id", "c_id", "rank")
    kept = pipelines.cascade(s1, s23, found, model)
    assert {(r.s1_id, r.c_id) for r in kept.collect()} >= {(f"q{i}", f"c{i}") for i in range(40)}
    assert features.random_negatives(s1, s23, truth).join(truth, ["s1_id", "c_id"]).count() == 0


def test_blank_countries_have_no_pairs(spark):
    """Entities without a country, and index countries that no query entity has, against the plain rules."""
    s1 = people(spark, [("q1", "acme stone", "12 high", "us", 1, 0), ("q2", "acme stone", "12 high", " ", 1, 1)])
    s23 = people(spark, [("a", "acme stone", "12 high", "us", 2, 2), ("b", "acme stone", "12 high", "", 2, 3), ("c", "acme stone", "12 high", "fr", 3, 4)])
    found = lambda df: {(r.s1_id, r.c_id) for r in df.collect()}
    assert found(blocking.structural_lookup(s1, s23)) == {("q1", "a")}
    assert found(blocking.structural_lookup(s1, s23, same_country=False)) == {("q1", "a"), ("q1", "c")}
    assert found(blocking.streamed_structural(s1, s23)) == {("q1", "a"), ("q2", "a")}
    assert found(retrieve.cosine_pairs(s1, s23, char_grams(search_text()))) == {("q1", "a")}
    assert found(blocking.arrival_candidates(s1, s23)) == {("q1", "a")}


def test_unknown_candidates(spark):
    s1, s23 = people(spark, [("q", "acme", "", "us", 1, 0)]), people(spark, [("a", "acme", "", "us", 2, 1)])
    pairs = spark.createDataFrame([("q", "a"), ("q", "gone"), ("who", "a")], "s1_id string, c_id string")
    rows = lambda **kw: {(r.s1_id, r.c_id) for r in features.pair_features(pairs, s1, s23, **kw).collect()}
    assert rows() == {("q", "a"), ("q", "gone"), ("who", "a")} and rows(known=True) == {("q", "a"), ("who", "a")}


def test_products_at_once(monkeypatch):
    """Scores are the same however few products are worked out at once."""
    rng = random.Random(4)
    lists = lambda n: pa.array([[rng.randint(0, 9) for _ in range(rng.randint(0, 8))] for _ in range(n)], pa.list_(pa.int64()))
    q, x = lists(12), lists(40)
    postings = retrieve.Postings(np.array([f"q{i}" for i in range(12)]), q)
    every = lambda: {(a, b): s for part in postings.scores(x) for a, b, s in zip(*(v.tolist() for v in part), strict=True)}
    want = every()
    for n in (1, 7, 100):
        monkeypatch.setattr(retrieve, "PRODUCTS", n)
        assert every() == pytest.approx(want)
    unit = lambda g: {k: v / math.sqrt(sum(c * c for c in Counter(g).values())) for k, v in Counter(g).items()}
    for i, a in enumerate(map(unit, q.to_pylist())):
        for j, b in enumerate(map(unit, x.to_pylist())):
            assert want.get((i, j), 0) == pytest.approx(sum(w * b.get(k, 0) for k, w in a.items()), abs=1e-8)


def test_bm25_zero_ranks(spark):
    corpus = spark.createDataFrame([(1, "a b"), (2, "a c c"), (3, "d"), (4, "e"), (5, "f")], "d_id long, text string")
    q = spark.createDataFrame([(1, "c"), (2, "zz")], "q_id long, text string")
    got = {(r.q_id, r["rank"]): (r.d_id, round(r.score, 6)) for r in retrieve.bm25(q, corpus, k=3, zeros=True).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 1): 2, (1, 2): 1, (1, 3): 3, (2, 1): 1, (2, 2): 2, (2, 3): 3}
    assert got[1, 1][1] > 0 == got[1, 2][1] == got[2, 1][1]


def test_auc_of_any_scores(spark):
    rng = random.Random(6)
    for scale in (0.0, 1e6, -50.0):
        rows = [(scale * rng.random(), rng.randint(0, 1)) for _ in range(150)]
        pos, neg = [x for x, y in rows if y], [x for x, y in rows if not y]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        assert metrics.auc(spark.createDataFrame(rows, "score double, label int")).first().auc == pytest.approx(want, abs=1e-6)


def test_models_and_indexes_are_kept(spark, tmp_path):
    e = people(spark, [("a", "acme stone", "", "us", 2, 1), ("b", "", "", "", 2, 2)])
    models.save_index(models.embed(e, models.hashed_embedder(8)), str(tmp_path / "i"))
    got = {r.id: sum(r.embedding) for r in models.load_index(spark, str(tmp_path / "i")).collect()}
    assert got == {"a": 3.0, "b": 0.0}
    rng = random.Random(1)
    rows = spark.createDataFrame([(float(i % 2), *[i % 2 + 0.1 * rng.random() for _ in range(9)]) for i in range(60)], ["label", *features.FEATURES])
    model = models.train_matcher(rows, rounds=2)
    models.save_matcher(model, str(tmp_path / "m"))
    score = lambda m: [r.match_prob for r in models.score_pairs(m, rows).collect()]
    assert score(models.load_matcher(str(tmp_path / "m"))) == score(model)


def _texts(seed, n):
    """Cleaned texts of few words, with copies, repeated words and empty ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcd0") for _ in range(rng.randint(1, 5))) for _ in range(25)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["char", "word"])
@pytest.mark.parametrize("limits", [{}, {"ROWS": 7, "TEXTS": 5, "PRODUCTS": 3, "HELD": 1, "TABLE": 0}, {"DENSE_SHARE": 2.0, "HELD": 1}, {"DENSE_SHARE": 0.0, "ROWS": 3}])
def test_cell_against_loop(monkeypatch, kind, limits):
    """The k best of a cell by exact cosine and smallest id, whatever is dense and however it is cut."""
    for name, value in limits.items():
        monkeypatch.setattr(cells, name, value)

    def grams(text):
        if kind == "char":
            return Counter(p[i : i + n] for p in (f" {w} " for w in text.split()) for n in (3, 4) for i in range(len(p) - n + 1))
        words = [w for w in text.split() if len(w) >= 2]
        return Counter(words + [" ".join(p) for p in zip(words, words[1:], strict=False)])

    q, x = _texts(1, 40), _texts(2, 150)
    # many rows of one score
    x += ["abc dcb"] * 30
    first = random.Random(3).sample(range(len(x)), len(x))
    length = lambda g: math.sqrt(sum(v * v for v in g.values()))
    want = []
    for a, t in enumerate(q):
        ga, found = grams(t), []
        for b, u in enumerate(x):
            gb = grams(u)
            if both := sum(n * gb[g] for g, n in ga.items()):
                found.append((-round(both / length(ga) / length(gb), 9), first[b], b))
        want += [(a, b, -s) for s, _, b in sorted(found)[:4]]
    got = cells.Cell(kind, pa.array(q), pa.array(x), np.array(first), 4).best()
    assert list(zip(*(c.tolist() for c in got[:2]), strict=True)) == [w[:2] for w in want]
    assert got[2].tolist() == pytest.approx([s for _, _, s in want], abs=1e-8)


@pytest.mark.parametrize("top,gram", [("char_top", char_grams), ("word_top", word_grams)])
def test_top_in_cells(spark, monkeypatch, top, gram):
    """As the retriever for any grams; where a country's rows fit a cell, no more than the k best of a query are passed on, in how many tasks the index ever is."""
    side = lambda p, src, n, seed: people(spark, [(f"{p}{i:03}", t, u, ["de", "fr", "", None, "de"][i % 5], src, i) for i, (t, u) in enumerate(zip(_texts(seed, n), _texts(seed + 1, n), strict=True))] + [(f"{p}c{i}", "abc dcb", "a", "de", src, n + i) for i in range(9)])
    s1, s23 = side("q", 1, 60, 5), side("x", 2, 200, 7)
    want = sorted(map(tuple, retrieve.cosine_top(s1, s23, gram(search_text()), 3).select("s1_id", "c_id", "score", "rank").collect()))
    assert len(want) > 60
    passed = []
    monkeypatch.setattr(retrieve, "top_k", lambda df, *a, top=retrieve.top_k: passed.append(df.count()) or top(df, *a))
    s23 = s23.repartition(4)
    got = getattr(retrieve, top)(s1, s23, 3)
    assert sorted(map(tuple, got.select("s1_id", "c_id", "score", "rank").collect())) == want and passed == [len(want)]
    for name, value in {"CELL_ROWS": 20, "LEAST_QUERIES": 4, "QUERY_IDS": 2}.items():
        monkeypatch.setattr(cells, name, value)
    got = getattr(retrieve, top)(s1, s23, 3, 6)
    assert sorted(map(tuple, got.select("s1_id", "c_id", "score", "rank").collect())) == want
    assert getattr(retrieve, top)(s1.limit(0), s23, 3).count() == getattr(retrieve, top)(s1, s23.limit(0), 3).count() == 0
