import os
import random
import zipfile
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import blocking, metrics
from tessera.plans import pipelines
from tessera.plans.queries import QUERIES
from tessera.sources import files
from tessera.sources.adapter import entities
from tessera.streaming import candidates as streaming

SF = "/root/testdata/sf0.001"


def test_tsv_round_trip(spark, tmp_path):
    p = tmp_path / "s.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\n1\tNone\t"a\nb"\tNA\n2\t"say ""x"""\t\tde\n', encoding="utf-8")
    rows = {r.entity_id: tuple(r)[1:] for r in files.read_source(spark, str(p)).collect()}
    assert rows == {"1": ("", "a\nb", ""), "2": ('say "x"', "", "de")}
    assert files.read_source(spark, str(p), pandas_na=False).filter("entity_id = 1").first().business_name == "None"
    assert files.read_source(spark, str(p), ["entity_id"], country="de").collect() == [("2",)]


def test_lists_zip_and_search(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], 1), ("b", [], 0)], "s1_id string, c_ids array<string>, row int")
    out = str(tmp_path / "out")
    files.write_lists(df, out, single=True)
    back = {r.s1_id: list(r.c_ids) for r in files.read_truth(spark, out).collect()}
    assert back == {"a": ["x", "y"], "b": []}
    target = str(tmp_path / "r.zip")
    assert files.zip_result(out, target, []) and not files.zip_result(out, target, ["bad"])
    assert files.find_file("r.zip", [str(tmp_path)]) == target
    c = tmp_path / "c.tsv"
    c.write_text("source1_entity_id\tcandidate_entity_ids\nb\t x , y\na\t\n")
    assert [(r.s1_id, list(r.c_ids)) for r in files.read_candidates(spark, str(c), first=1).collect()] == [("b", ["x", "y"])]
    try:
        files.find_file("nothing.tsv", [str(tmp_path)])
    except FileNotFoundError:
        pass
    else:
        raise AssertionError


def test_stream_equals_batch(spark):
    batch = {tuple(r) for r in QUERIES["b1_candidates_cap50"](spark, SF).collect()}
    assert {tuple(r) for r in QUERIES["stream_b1_candidates"](spark, SF).collect()} == batch


def test_capped_state_over_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i in range(3):
        spark.range(30).select(F.lit("q").alias("s1_id"), F.concat(F.lit(f"c{i}-"), "id").alias("c_id"), F.lit(2).alias("src"), (F.col("id") + 100 * i).alias("ord")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("s1_id string, c_id string, src int, ord long").option("maxFilesPerTrigger", 1).parquet(folder)
    path = streaming.append_all(streaming.capped(stream, 50))
    got = spark.read.parquet(path)
    assert got.count() == 50 and got.agg(F.max("rank")).first()[0] == 50 and os.path.exists(path.removeprefix("file:"))


def test_blocks_do_not_lose_entities(spark):
    s1 = entities(spark, SF).filter("src = 1")
    assert blocking.exact_match(s1, entities(spark, SF).filter("src > 1")).count() == s1.count()


def test_running_frequency_state_over_batches(spark, tmp_path):
    """What the state lets pass over three batches is what the batch form lets pass."""
    folder = str(tmp_path / "in")
    rng = random.Random(5)
    rows = [(rng.choice(["us", "fr"]), rng.choice("abc"), f"c{i // 2}", 2 + i // 120, i // 2) for i in range(180)]
    for i in range(3):
        spark.createDataFrame(rows[60 * i : 60 * i + 60], "country string, key string, c_id string, src int, ord long").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("country string, key string, c_id string, src int, ord long").option("maxFilesPerTrigger", 1).parquet(folder)
    got = {(r.country, r.key, r.c_id) for r in spark.read.parquet(streaming.append_all(streaming.running_frequency(stream, 20))).collect()}
    seen, want = Counter((c, k) for c, k, *_ in []), set()
    for c, e in dict.fromkeys((r[0], r[2]) for r in rows):
        for k, n in Counter(r[1] for r in rows if (r[0], r[2]) == (c, e)).items():
            seen[c, k] += n
            if seen[c, k] <= 20:
                want.add((c, k, e))
    assert got == want


def test_best_scores_state_over_batches(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rng = random.Random(8)
    rows = [(f"q{rng.randint(0, 2)}", f"c{rng.randint(0, 9)}", rng.randint(0, 99) / 100) for _ in range(90)]
    for i in range(3):
        spark.createDataFrame(rows[30 * i : 30 * i + 30], "s1_id string, c_id string, score double").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("s1_id string, c_id string, score double").option("maxFilesPerTrigger", 1).parquet(folder)
    streaming.each_batch(streaming.best_scores(stream, 4), lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out), str(tmp_path / "state"), "update")
    last = {}
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: r.batch):
        last.setdefault(r.s1_id, {}).setdefault(r.batch, []).append((r.c_id, r.score))
    for q in {r[0] for r in rows}:
        best = {}
        for _, c, s in (r for r in rows if r[0] == q):
            best[c] = max(s, best.get(c, s))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:4]
        assert sorted(last[q][max(last[q])], key=lambda x: (-x[1], x[0])) == want


def test_best_scores_by_batch(spark, tmp_path):
    """Several batches of repeated pairs: each entity's best of all of them, and the state of those that later batches do not touch."""
    rng = random.Random(5)
    kind = "s1_id string, c_id string, score double"
    rows = [[(f"q{rng.randrange(6 - b)}", f"x{rng.randrange(9)}", rng.randrange(20) / 20) for _ in range(40)] for b in range(3)]
    for b, part in enumerate(rows):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    for r in streaming.best_by_batch(stream, str(tmp_path / "out"), 4).collect():
        got.setdefault(r.s1_id, []).append((-r.score, r.c_id))
    want = {}
    for q, c, v in sum(rows, []):
        want.setdefault(q, {})[c] = max(v, want.get(q, {}).get(c, v))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted((-v, c) for c, v in best.items())[:4] for q, best in want.items()}
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3


def test_file_checks(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b",)], "s1_id string")
    n = lambda path: {r.name: r.n for r in metrics.file_checks(spark, str(tmp_path / path), ids).collect()}
    assert n("nothing") == {"missing_file": 1}
    (tmp_path / "good").write_text("source1_entity_id\tmatched_entity_ids\na\tx,y\nb\t\n")
    good = n("good")
    assert good["matched"] == good["singletons"] == 1 and not any(v for k, v in good.items() if k not in ("matched", "singletons"))
    (tmp_path / "index").write_text("\tsource1_entity_id\tmatched_entity_ids\n0\ta\tx\n1\ta\t\n")
    bad = n("index")
    assert bad["index_column"] == bad["wrong_columns"] == bad["repeated_ids"] == bad["missing_ids"] == 1
    (tmp_path / "other").write_text("id\tmatched\na\tx\n")
    assert n("other") == {"missing_file": 0, "wrong_columns": 1, "index_column": 0}


def test_appended_parts_samples_and_numbers(spark, tmp_path):
    out = str(tmp_path / "out")
    part = lambda rows: spark.createDataFrame(rows, "s1_id string, c_ids array<string>")
    files.write_lists(part([("a", ["x "])]), out)
    files.write_lists(part([("b", [])]), out, append=True)
    assert {r.s1_id: list(r.c_ids) for r in files.read_truth(spark, out).collect()} == {"a": ["x"], "b": []}
    t = tmp_path / "t.tsv"
    t.write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"e{i}\t x{i} ,nan,,\n" for i in range(30)))
    got = files.truth_sample(spark, str(t), 10).collect()
    assert len(got) == 10 and all(list(r.c_ids) == ["x" + r.s1_id[1:]] for r in got) and got == files.truth_sample(spark, str(t), 10).collect()
    df = spark.range(100).repartition(7)
    assert sorted(r.row for r in files.numbered(df).collect()) == list(range(100))
    assert files.numbered(spark.range(0)).count() == 0
    assert [r.row for r in files.numbered(spark.range(50, numPartitions=3)).orderBy("id").collect()] == list(range(50))
    assert metrics.samples(part([("b", ["x"]), ("a", ["y", "z"]), ("c", [])]), 1).collect() == [("a", "y,z")]


def test_unpacked_from_an_archive_and_guards(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "test.zip", "w") as z:
        z.writestr("deep/needed.tsv", "x")
    assert open(files.find_file("needed.tsv", [str(tmp_path)], archive="test.zip")).read() == "x"
    assert files.have_all([str(tmp_path)]) and not files.have_all([str(tmp_path), "/nowhere"])
    got = files.read_needed(spark.range(10).withColumn("v", F.col("id") * 2), spark.range(3), ["v"], key="id")
    assert sorted(r.v for r in got.collect()) == [0, 2, 4]


def test_settings():
    got = pipelines.settings_from(["--mode", "validate", "--n-val", "5", "--top-k", "3"])
    assert (got.mode, got.n_val, got.top_k, got.ce_threshold) == ("validate", 5, 3, 0.45)
