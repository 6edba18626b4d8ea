import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity, text
from tessera.functions.similarity import best_window_ratio, conflict, indel_ratio, jaccard, overlap, partial_ratio, ratio, unit


def test_normalize(spark):
    rows = [("1", "Orelee's Barbershop Inc.", "1795 Westchester Drive, High Point, NC", " US\t"), ("2", "The Company Ltd", "", None), ("3", "", None, ""), ("4", "Café 12", "3-4 Rue", "FR"), ("5", None, None, None)]
    df = text.normalize(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"))
    got = {r.entity_id: (r.name_basic, r.name_core, list(r.name_tokens), r.name_acronym, list(r.numeric_tokens), r.country_normalized) for r in df.collect()}
    assert got["1"] == ("orelee s barbershop inc", "orelee s barbershop", ["orelee", "s", "barbershop"], "osb", ["1795"], "us")
    assert got["2"] == ("the company ltd", "the company ltd", ["the", "company", "ltd"], "tcl", [], "")
    assert got["3"] == got["5"] == ("", "", [], "", [], "")
    assert got["4"] == ("caf 12", "caf 12", ["caf", "12"], "c1", ["12", "3", "4"], "fr")


@pytest.mark.parametrize(
    ("a", "b", "whole", "part"),
    [("prime money llc", "prime money", 0.846154, 1.0), ("abcd", "bxd", 0.571429, 0.666667), ("abc", "axbxc", 0.75, 0.666667), ("abcd", "cdab", 0.5, 0.666667), ("barber shop", "orelee barbershop inc", 0.625, 0.909091), ("", "x", 0, 0), ("", "", 1, 1)],
)
def test_ratios(a, b, whole, part):
    assert indel_ratio(a, b) == pytest.approx(whole, abs=1e-6) and indel_ratio(b, a) == pytest.approx(whole, abs=1e-6)
    assert best_window_ratio(a, b) == pytest.approx(part, abs=1e-6)


def test_ratio_columns(spark):
    df = spark.createDataFrame([("abc", "axbxc"), (None, "x"), (None, None)], "a string, b string").select(ratio("a", "b").alias("r"), partial_ratio("a", "b").alias("p"))
    assert [(round(r.r, 4), round(r.p, 4)) for r in df.collect()] == [(0.75, 0.6667), (0.0, 0.0), (1.0, 1.0)]


def test_lists(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a"]), ([], []), ([], ["a"]), (None, ["a"]), (None, None)], "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in df.select(jaccard(a, b)).collect()] == [0.5, 1.0, 0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(jaccard(a, b, None)).collect()] == [0.5, 1.0, 0.0, 0.0, 1.0]
    nums = spark.createDataFrame([(["12", "3"], ["3"]), (["12"], ["3"]), ([], ["3"]), (None, ["3"])], "a array<string>, b array<string>")
    assert [tuple(r) for r in nums.select(overlap(a, b), conflict(a, b)).collect()] == [(1, 0), (0, 1), (0, 0), (0, 0)]


def test_grams(spark):
    df = spark.createDataFrame([("ab a",), ("",), ("x yy zz",)], "t string")
    got = [(sorted(r.c), list(r.w)) for r in df.select(text.char_grams(F.col("t")).alias("c"), text.word_grams(F.col("t")).alias("w")).collect()]
    assert got[0] == (sorted([" ab", "ab ", " ab ", " a "]), ["ab"])
    assert got[1] == ([], []) and got[2][1] == ["yy", "zz", "yy zz"]


def test_unit(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [list(r[0]) for r in df.select(unit(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_ratios_of_many_pairs_against_one_by_one():
    """Pairs at once, of all lengths around the words' borders, against the plain table of common subsequences."""
    rng = random.Random(3)
    text = lambda n, letters="abcd é😀": "".join(rng.choice(letters) for _ in range(n))
    pairs = [(text(rng.choice([0, 1, 2, 5, 30, 63, 64, 65, 127, 128, 129, 140])), text(rng.choice([0, 1, 3, 30, 64, 65, 100, 128, 129]))) for _ in range(150)]
    pairs += [(x, x) for x in (text(64), text(128))] + [("abcd", "cdab"), ("prime money llc", "prime money"), ("abc", "axbxc")]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b):
                new.append(max(new[j], row[j + 1], row[j] + (c == d)))
            row = new
        return row[-1]

    got, best = similarity.ratios(pairs), similarity.ratios(pairs, windows=True)
    for (a, b), r, w in zip(pairs, got, best, strict=True):
        assert r == pytest.approx(similarity.indel_ratio(a, b)) and w == pytest.approx(similarity.best_window_ratio(a, b)), (a, b)
        if len(a) + len(b) < 100:
            assert r == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a and b else float(a == b))


def test_windows_of_a_pair_come_from_one_table(monkeypatch):
    """All windows of many pairs at once, none worked out by itself, against the plain form."""
    rng = random.Random(8)
    pairs = []
    for letters in ("ab", "abcdefgh ", "".join(chr(200 + 7 * i) for i in range(300)), "aé🙂日\ud800"):
        text = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        pairs += [(text(rng.choice([0, 1, 2, 30, 127, 128])), text(rng.choice([1, 3, 79, 80, 128]))) for _ in range(60)] + [(text(n), text(n)) for n in range(0, 129, 8)]
    want = [similarity.best_window_ratio(a, b) for a, b in pairs]
    monkeypatch.setattr(similarity, "_WINDOW_PAIRS", 50)
    for one in ("_step", "best_window_ratio"):
        monkeypatch.setattr(similarity, one, None)
    assert similarity.ratios(pairs, windows=True).tolist() == want
    a, b = "abcab", "cabbage"
    h, v = similarity._combed(*(np.frombuffer(x.encode(), np.uint8)[:, None] for x in (a, b)))
    for i in range(len(b)):
        for j in range(i, len(b) + 1):
            common = similarity.lcs_prefixes(similarity.position_bits(a), len(a), b[i:j])[-1] if j > i else 0
            assert common == j - i - int((v[:j, 0] >= len(a) + i).sum())
