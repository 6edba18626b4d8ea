"""The language model against plain loops, and its gain on held-out rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest_llm import SPACED, lower

from tessera.llm import lm

SF = "/root/testdata/sf0.001"


def lm_fitted(docs, frequent):
    training = lm._prepared(docs.filter(~lm.held_out(docs["doc_id"])), "doc_id", "text")
    counted = lm.count_words(training)
    counts = lm.known_counts(counted, frequent=frequent)
    return training, counted, counts, lm.train(training, counts)


def lm_path(counts, h):
    """(class, outcome) on the path of the word hashed to ``h``, one choice after the other."""
    at = np.flatnonzero(counts.hashes == np.uint64(h))
    leaf = int(at[0]) if len(at) else len(counts.hashes)
    path = [(int(counts.node[leaf, d]), int(counts.digit[leaf, d])) for d in range(int(counts.depth[leaf]))]
    for k in range(counts.levels if not len(at) else 0):
        above = h & ((1 << (4 * k)) - 1)
        path.append((int(lm.mix(np.array([above + ((k + 1) << 56)], np.uint64))[0]) | 1 << 63, (h >> (4 * k)) & 15))
    return path


def lm_log(model, feats, path):
    """Log probability of a path after a history with the feature hashes ``feats``, by plain sums over each class."""
    c, total = model.counts, 0.0
    for cls, outcome in path:
        spread = int(lm.mix(np.array([cls + 77], np.uint64))[0])
        rows = [cls if cls < 1 << 63 else int(c.first_row[0]) + (spread >> (64 - c.row_bits[0]))]
        rows += [int(c.first_row[k + 1]) + ((((f ^ spread) * 0x9E3779B97F4A7C15) & (1 << 64) - 1) >> (64 - c.row_bits[k + 1])) for k, f in enumerate(feats)]
        s = [sum(float(model.params[r, j]) for r in rows) for j in range(lm.WIDTH)]
        total += s[outcome] - math.log(sum(map(math.exp, s)))
    return total


def test_lm_against_brute_force(spark, corpus):
    """Counts, base and score of every row by plain loops, and that the words' probabilities sum to one after any history."""
    docs, rows = corpus
    rows = [(i, t) for i, t in rows if i != 205]
    docs = docs.filter("doc_id <> 205 OR doc_id IS NULL")
    _, counted, counts, model = lm_fitted(docs, 50)
    assert counts.levels >= 1 and 0 < len(counts.hashes) <= 50 and np.abs(model.params[len(counts.shares) :]).max() > 0
    got = lm.score(docs, ["doc_id", "text"], counted, counts, model).collect()
    tokens = lambda t: [*re.findall(SPACED, lower(t)), None]
    c = Counter(x for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for x in tokens(t))
    n, v = sum(c.values()), len(c)
    words = list({x for _, t in rows for x in tokens(t)} - {None})
    hashed = dict(zip([*words, None], map(int, lm.tokens(pa.array([" ".join(words)]), 0, 1)[0]), strict=True))
    rare = {hashed[x]: k for x, k in c.items() if k < counts.least}
    bins = {}
    for h, k in rare.items():
        bins.setdefault(h & counts.bin_mask, []).append(k)
    share = lambda x: (c[x] + 0.5) / (sum(b := bins.get(hashed[x] & counts.bin_mask, [])) + 0.5 * (len(b) + 1)) if c[x] < counts.least else 1.0

    def feats(w, i):
        h, first = np.array([hashed[x] for x in w], np.uint64), np.array([0, len(w)])
        return [int(f[i]) for f in lm.features(h, first)]

    for r in got:
        w = tokens(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        if len(w) < 40:
            want = sum(lm_log(model, feats(w, i), lm_path(counts, hashed[x])) / math.log(10) + math.log10(share(x)) for i, x in enumerate(w))
            assert math.isclose(r.score, want, rel_tol=1e-4, abs_tol=1e-3), (r.doc_id, r.score, want)
    f = feats(tokens(rows[0][1]), 5)
    total = sum(math.exp(lm_log(model, f, lm_path(counts, int(h)))) for h in counts.hashes)
    total += sum(math.exp(lm_log(model, f, lm_path(counts, b | 1 << 62))) for b in range(counts.bin_mask + 1))
    assert math.isclose(total, 1, abs_tol=1e-3)
    assert lm.score(docs.limit(0), ["doc_id"], counted, counts, model).count() == 0
    none = lm_fitted(docs.limit(0), 50)
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in lm.score(docs.limit(3), ["doc_id"], *none[1:]).collect())


def test_lm_sums_and_tasks(spark, corpus):
    """Observed and expected counts by plain loops; the model does not depend on the number of tasks."""
    docs, _ = corpus
    docs = docs.filter("doc_id < 20")
    training, _, counts, model = lm_fitted(docs, 30)
    again = lm.train(training.repartition(7), counts)
    assert np.allclose(model.params, again.params, atol=1e-3)
    h, first = lm.tokens(pa.array(["a b c a", "b é"]), 0, 2)
    for m in (model, lm.Model(counts)):
        sums = lm.Sums(m)
        sums.add(h, first, counts.find(h)[2])
        list(sums.blocks())
        observed, expected = np.zeros_like(sums.observed), np.zeros_like(sums.expected)
        for _, rows, outcome, e, total in m.batches(h, first, counts.find(h)[2]):
            for i in range(len(outcome)):
                for r in rows[:, i]:
                    observed[r, outcome[i]] += 1
                    expected[r] += e[i] / total[i]
        assert np.allclose(sums.observed, observed) and np.allclose(sums.expected, expected, atol=1e-5)
        assert np.isclose(observed.sum(), expected.sum(), rtol=1e-4)


def test_lm_observed_is_counted_in_the_first_round_only(spark, corpus):
    """Later rounds hand in half as much, and the model is the one of rounds that count everything in one process."""
    docs, _ = corpus
    training, _, counts, model = lm_fitted(docs.filter("doc_id < 20"), 30)
    h, first = lm.tokens(pa.array([r.text for r in training.collect()]), 0, training.count())
    leaf, plain = counts.find(h)[2], lm.Model(counts)
    for rate in lm.STEPS:
        every, later = lm.Sums(plain), lm.Sums(plain, observe=False)
        for sums in (every, later):
            sums.add(h, first, leaf)
        whole, half = dict(every.blocks()), dict(later.blocks())
        assert later.observed is None and whole.keys() == half.keys()
        assert all(len(half[k]) * 2 == len(whole[k]) and whole[k].startswith(half[k]) for k in half)
        plain = lm.Model(counts, plain.params + lm.step(every.observed, every.expected, rate))
    assert np.allclose(model.params, plain.params, atol=1e-3)


def test_lm_finds_frequent_words():
    """Words whose hashes begin with the same bits, lie before, between and behind the known ones, and the largest hash."""
    top, r = (1 << 64) - 1, np.random.Generator(np.random.PCG64(3))
    spread = [int(x) for x in r.integers(0, top, 300, dtype=np.uint64)]
    for known in ([], [7], [top], [0, top], [*range(1 << 40, (1 << 40) + 50), *spread], spread):
        known = np.array(sorted(known), np.uint64)
        n = len(known)
        counts = lm.Counts(known, np.arange(n) + 3, 3, 10_000, n + 5)
        place = {int(x): i for i, x in enumerate(known)}
        asked = [0, 1, 7, 8, top - 1, top, 1 << 40, (1 << 40) + 50, *place, *(x ^ 1 for x in place)]
        is_known, c, leaf = counts.find(np.array(asked, np.uint64))
        assert is_known.tolist() == [x in place for x in asked]
        assert leaf.tolist() == [place.get(x, n) for x in asked]
        assert c.tolist() == [place[x] + 3 if x in place else 0 for x in asked]


def test_lm_huffman():
    r = np.random.Generator(np.random.PCG64(2))
    for n in (1, 2, 15, 16, 17, 300):
        w = r.zipf(1.5, n).astype(float)
        depth, node, digit, shares = lm.huffman(w)
        p = [sum(shares[node[i, d], digit[i, d]] for d in range(depth[i])) for i in range(n)]
        assert np.allclose(np.exp(p), w / w.sum(), rtol=1e-3)
        assert len({tuple(zip(node[i, : depth[i]], digit[i, : depth[i]], strict=True)) for i in range(n)}) == n


def test_lm_beats_the_base_on_held_out_rows(spark):
    got = lm.op2_lm(spark, SF).filter("held_out").selectExpr("sum(score) AS a", "sum(base_score) AS b", "sum(n_tokens) AS n").first()
    assert got.a > got.b
    # bits a token gained over the base on rows the model never saw
    assert (got.a - got.b) / got.n / math.log10(2) > 0.1
