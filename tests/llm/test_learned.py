"""Operators that learn, the page operator, and the pipeline."""

import html as html_lib
import math
import random
import re
import time
from collections import Counter

import corpus_pipeline
from conftest_llm import SPACED, lower
from pyspark.sql import functions as F

from tessera.llm import html, toxicity

SF = "/root/testdata/sf0.001"


def test_toxicity_restores_and_generalises(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    bad = ["grumpkin", "snorble", "blathis"]
    rows = []
    for i in range(900):
        w = [word() for _ in range(30)]
        toxic = i % 3 == 0
        if toxic:
            w[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame(rows + [(5000, None, None), (5001, "", None)], "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(docs.filter("doc_id < 600").select("doc_id", "text"), docs.filter("doc_id < 600").select("doc_id", "toxic"))
    assert set(bad) <= {k.rstrip("*") for k in lexicon.weights} | set(lexicon.weights)
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon, ["doc_id"]).collect()}
    assert all((got[i] >= 0.7) == bool(t) for i, _, t in rows[600:])
    assert 0 < got[5000] == got[5001] < 0.7
    scorer = toxicity.Scorer(lexicon)
    for hidden in ("grumpk1n", "bl4th1s", "snorbl3", "s n o r b l e", "snooooorble", "sn0rble!!", "b.l.a.t.h.i.s"):
        assert scorer.score(f"{word()} {hidden} {word()}") >= 0.7, hidden
    assert toxicity.fit(docs.limit(0), docs.limit(0).select("doc_id", "toxic")).weights == {}
    assert toxicity.score(docs.limit(0), lexicon, ["doc_id"]).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """A word that only late rows in any order have is learned, whatever the number of labelled rows; tasks may pass on sums early."""
    monkeypatch.setattr(toxicity, "HELD_ENTRIES", 50)
    seen = spark.range(26_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic", "row_number() OVER (PARTITION BY id % 2 ORDER BY xxhash64(id), id) AS place")
    # 13,000 rows a label; the telling word stands in 60 of the last ones in hash order
    word = "CASE WHEN toxic = 1 AND place > 12940 THEN ' grumpkin' ELSE '' END"
    docs = seen.selectExpr("doc_id", f"concat('common words w', translate(CAST(doc_id AS STRING), '0123456789', 'abcdefghij'), {word}) AS text", "toxic").repartition(3)
    lexicon = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert {k.rstrip("*") for k in lexicon.weights} & {"grumpkin", "grump", "grum"}
    assert lexicon.mass > math.log(2) * 26_000


def test_toxicity_restores_whole_tokens_and_runs():
    """Words stay found whatever the length of the token or run that hides them, and wherever they stand in it."""
    common = ["you", "are", "a", "an", "the", "this", "that", "is", "hello", "there", "house", "people", "garden", "window", "morning", "water", "never", "always", "such"]
    scorer = toxicity.Scorer(toxicity.Lexicon({"idiot": 6.0, "stupid": 6.0}, -2.5, toxicity.trigrams(dict.fromkeys(common, 3.0)), 3.0 * len(common)))
    spaced = lambda t: " ".join(t.replace(" ", ""))
    long = "you are such a stupid people in the morning house there"
    for hidden in (
        "i" * 41 + "diot", "1" * 60 + "d10t", "1d10t" + "!" * 40, "hello-there-people-garden-window-1d10t-morning-water", "_".join(common[4:]) + "_1d10t",
        spaced("a stupid"), spaced("you are stupid"), spaced(long), spaced(" ".join(common) + " stupid " + " ".join(common)), "-".join("youarestupid"), spaced("you are an id10t"),
    ):
        assert scorer.score(f"garden {hidden} window") >= 0.7, hidden
    for clean in (spaced(" ".join(common)), "hello-there-people-garden-window-4lways-morning-water", "http://house.garden/" + "water/never_" * 30, "a" * 300):
        assert scorer.score(f"garden {clean} window") < 0.7, clean
    assert toxicity.restore("x1" * 20_000, scorer.model, toxicity.ANYWHERE)


def test_toxicity_held_out_accuracy(spark):
    """Held-out rows; some labels are noise (toxic rows without any word that toxic rows share), so recall is over the others."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.op5_toxicity(spark, sf).join(labels, "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").toPandas()
    words = rows.text.map(lambda t: set(re.findall(r"[^\W\d_]+", (t or "").lower())))
    count = lambda toxic: Counter(w for ws in words[~rows.held_out & (rows.toxic == toxic)] for w in ws)
    bad, clean = count(1), count(0)
    telling = {w for w, n in bad.items() if n >= 5 and not clean[w]}
    got = rows[rows.held_out]
    told = words[rows.held_out].map(lambda ws: bool(ws & telling))
    assert (got.predicted == got.toxic).mean() > 0.93 and got[got.toxic == 0].predicted.mean() < 0.02
    assert (told & (got.toxic == 1)).sum() >= 10 and got[told & (got.toxic == 1)].predicted.mean() >= 0.9


def test_toxicity_viterbi_against_all_readings():
    """The decoded word costs as little as the cheapest of all ways to read a short token."""
    model = toxicity.CharModel(toxicity.trigrams({"idiot": 3.0, "stupid": 3.0, "total": 2.0, "lots": 1.0, "sit": 1.0}))

    def readings(token):
        """(cost, word) of every way: keep a letter, read a sign, drop a sign, merge a character with the one before."""
        states = [("^^", 0.0, "")]
        for i, c in enumerate(token):
            ways = [(c, 0.0)] if c.isalpha() else [(x, toxicity._SIGN_COST) for x in toxicity.SIGNS.get(c, "")]
            new = []
            for s, cost, out in states:
                new += [(s[1] + x, cost + own + model.cost(s, x), out + x) for x, own in ways]
                if (i and c == token[i - 1]) or (out and any(x == s[1] for x, _ in ways)):
                    new.append((s, cost + toxicity._REPEAT_COST, out))
                if not c.isalpha():
                    new.append((s, cost + toxicity._DROP_COST, out))
            states = new
        return [(cost + model.cost(s, "$"), out) for s, cost, out in states]

    rng = random.Random(4)
    for _ in range(150):
        token = "".join(rng.choice("idotslap1034!$-") for _ in range(rng.randint(1, 7)))
        ways = readings(toxicity._RUN.sub(r"\1\1\1", token))
        best = min(c for c, _ in ways)
        assert any(out == toxicity.restore(token, model) and c <= best + 1e-9 for c, out in ways), token


def test_html_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html.extract(pages, ["page_id", "html"], html.fit(pages)).collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(" ".join(html_lib.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", body))
        assert r.text == " ".join(want.split()) and r.n_chars == len(r.text)


def test_html_odd_pages(spark):
    page = """<html><head><title>T</title></head><body><header class="site-header"><a href=/>Home</a></header><div id="cookie-notice">We use cookies here and there</div>
      <div class="sidebar"><p>Links of the side with many words</p></div><div class="content"><h2>Title &amp; more</h2><p>First para with  some\ntext<b>bold</b>.<ul><li>one item<li>two item</ul>
      <form><label>Name</label><input></form><blockquote>Quote&nbsp;here</blockquote></div><section class="comments"><p>Reader comment that is long long long</p></section><footer>Foot</footer>"""
    rows = [(1, page), (2, None), (3, ""), (4, "plain words only"), (5, "<script>var a='<p>no</p>'"), (6, "<p>cut off <b"), (7, "a < b <p>c</p>")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {r.page_id: r.text for r in html.extract(df, ["page_id"]).collect()}
    assert got[1] == "Title & more First para with some textbold. one item two item Quote here"
    assert got[2] == got[3] == got[5] == "" and got[4] == "plain words only" and got[6] == "cut off"
    assert html.extract(df.limit(0), ["page_id"]).count() == 0


def test_html_parts_by_name_and_pages_without_articles(spark):
    """Menus, comments and related links go whatever their name says besides; contexts learned from articles serve pages without one."""
    words = lambda x, n: " ".join([x] * n)
    page = f"""<body class="has-sidebar"><div class="main-menu"><p>{words("menu", 40)}</p></div><div class="main-content with-sidebar a b c d e"><div class="article-header"><h1>Title here</h1></div><p>{words("real", 60)}</p>
      <div class="story-related">{words("related", 18)}</div><p>{words("more", 60)}</p></div><div class="article-comments"><p>{words("comment", 60)}</p></div><article class="comment"><p>{words("another", 60)}</p></article></body>"""
    want = " ".join(["Title here", words("real", 60), words("more", 60)])
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    learned = html.fit(pages)
    assert learned["ul"] < 0 < learned["p"] and learned["<p"] > learned["<ul"]
    assert html.main_text(page, html.FIXED) == html.main_text(page, learned) == want
    for r in pages.collect():
        bare = re.sub(r"<(/?)article>", r"<\1div>", r.html)
        assert html.main_text(bare, learned) == html.main_text(r.html, learned)


def test_html_state_follows_the_open_elements():
    """The kept-up sums equal those of the elements that are open, at every push and cut."""
    rng = random.Random(3)
    tags = ["div", "p", "b", "article", "header", "h1", "nav", "span"]
    weights = {"div": -0.5, "p": 1.25, "b": 0.25, "nav": -2.0, "div.ad": -1.0}
    now = html.Open(weights, learn=True)
    for _ in range(3000):
        if now.stack and rng.random() < 0.48:
            rng.choice([lambda: now.cut(len(now.stack) - 1), lambda: now.close(rng.choice(tags)), lambda: now.end_of({"p", "div"})])()
        else:
            now.push(html.Element(rng.choice(tags), rng.choice(["", ' class="ad"']), now.inside > 0))
        keys = {k for e in now.stack for k in e.keys}
        assert math.isclose(now.score, 1 + sum(weights.get(k, 0) for k in keys), abs_tol=1e-9)
        inside, heading = any(e.tag in html.CONTENT for e in now.stack), any(e.tag in html.HEADINGS for e in now.stack)
        assert now.left_out == any(e.out and not (inside and heading and e.tag in html.HEADER) for e in now.stack)
        assert now.solid == [i for i, e in enumerate(now.stack) if e.tag not in html.INLINE]


def test_html_long_and_unclosed_pages():
    """Work grows with the page, not with its square."""
    for page in ("<div>x" * 100_000, "<div>x</span>" * 50_000, "<b>" * 50_000 + "<p>y" * 50_000, "<p>" + "<b>x" * 50_000 + "<li>z" * 50_000):
        began = time.process_time()
        assert html.main_text(page, html.FIXED) is not None
        assert time.process_time() - began < 20


def test_best_run_against_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 9))]
        a, b = html.best_run(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


def test_pipeline_stages(spark):
    """Each stage's decisions on its own input, against the plain definitions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit_on_training(docs, spark.read.parquet(f"{SF}/labels.parquet")), ["doc_id"]).collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == [n for n, _ in corpus_pipeline.STAGES] and len(stage) == 5
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == names and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < 0.7}

    def sets(rows):
        w = {r.doc_id: re.findall(SPACED, lower(r.text)) for r in rows}
        return {i: {tuple(x[k : k + 5]) for k in range(len(x) - 4)} if len(x) >= 5 else {tuple(x)} if x else set() for i, x in w.items()}

    rows = docs.collect()
    s = sets(rows)
    group = {i: i for i in s}
    for i in sorted(s):
        for j in s:
            if i < j and s[i] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if v in (a, b) else v for k, v in group.items()}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == {i for i, g in group.items() if i == g}

    clean = corpus_pipeline.drop_contaminated(spark, docs, SF)
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wins = {" ".join(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9)) if w}
    words = {r.doc_id: f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', lower(r.text)))} " for r in rows}
    assert {r.doc_id for r in clean.collect()} == {i for i, t in words.items() if not any(f" {w} " in t for w in wins)}

    cut = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert set(cut) == set(s) and all(r.n_chars == len(r.text) for r in cut.values())
    seen, texts = {}, {r.doc_id: r.text.encode() for r in rows}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            seen.setdefault(texts[i][k : k + 50], i)
    for i, data in texts.items():
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if seen[data[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        assert cut[i].text == bytes(b for b, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
    assert corpus_pipeline.encode_tokens(spark, docs, SF).filter("n_tokens <> size(ids)").count() == 0


def test_pipeline_with_nulls_repeats_and_odd_columns(spark, corpus):
    docs, rows = corpus
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.filter("doc_id = 7").count() == 1


def test_pipeline_learns_toxicity_from_every_labelled_row(spark, tmp_path):
    """A word that only the last of 13,000 toxic training rows in hash order have is learned by the first stage."""
    seen = spark.range(40_000).filter(~toxicity.held_out(F.col("id"))).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic", "row_number() OVER (PARTITION BY id % 2 ORDER BY xxhash64(id) DESC, id) AS place")
    word = "CASE WHEN toxic = 1 AND place <= 60 THEN ' grumpkin' ELSE '' END"
    docs = seen.selectExpr("doc_id", f"concat('common words w', translate(CAST(doc_id AS STRING), '0123456789', 'abcdefghij'), {word}) AS text", "toxic", "place").repartition(3)
    docs.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    gone = docs.join(corpus_pipeline.drop_toxic(spark, docs.select("doc_id", "text"), str(tmp_path)), "doc_id", "left_anti")
    assert gone.count() == gone.filter("text LIKE '%grumpkin'").count() == 60
