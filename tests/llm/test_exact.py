"""Operators with one right result, against brute force."""

import base64
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from conftest_llm import ALNUM, SPACED, lower, sha
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontaminate, licenses, minhash, suffix


def by_row(got, *columns):
    return sorted(tuple(r[c] for c in columns) for r in got.collect()) if columns[0] != "doc_id" else sorted(((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in columns[1:])) for r in got.collect()), key=repr)


def want_rows(rows):
    return sorted(((i is None, i or 0, *rest) for i, *rest in rows), key=repr)


def test_bpe(spark, corpus):
    docs, rows = corpus
    path = bpe.default_ranks_path()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs, path, public_tokenizers.PATTERN, ["doc_id"])
    want = [(i, sha(b"".join(x.to_bytes(4, "little") for x in enc.encode_ordinary(t or ""))), sha(t or "")) for i, t in rows]
    assert by_row(got, "doc_id", "ids_sha256", "decoded_sha256") == want_rows(want)
    codec = bpe.Codec.of(path, public_tokenizers.PATTERN)
    odd = ["a　b \u0085c 'll 日本語🙂 ½x²  \n\n q", "<|endoftext|> it's 12345"]
    for t, ids in zip(odd, codec.encode_many(odd), strict=True):
        assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == enc.encode_ordinary(t)
        spans = codec.offsets(t, ids)
        assert spans[0][0] == 0 and spans[-1][1] == len(t) and all(a < b for a, b in spans.tolist())
        assert codec.decode(ids).decode() == t


def test_bpe_empty_and_clash(spark, corpus):
    docs, _ = corpus
    assert bpe.encode(docs.limit(0), bpe.default_ranks_path(), public_tokenizers.PATTERN, ["doc_id"]).count() == 0


def test_chat(spark):
    rng = random.Random(4)
    marks = ["<|im_end|>", "<|im_start|>assistant\n", "<\\|", "<\\\\|im_end|>", "\n\n", "é🙂", "x", " ", "<", "|>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\n|\\b", None]), rng.choice([None, "", "".join(rng.choice(marks) for _ in range(rng.randint(0, 12)))])) for c in range(30) for t in range(rng.randint(1, 6))]
    rows += [(5, 0, "user", "again"), (None, None, "assistant", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df, chat.default_tokenizer_path()).collect()}
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns = [(t[3], t[5]) for t in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.formatted_chars == len(r.formatted)
        assert [(a, b) for a, b, _, _ in chat.read_back(r.formatted)] == turns and len(r.loss_mask) == len(r.ids) == r.n_tokens


def test_chat_long_conversation_in_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f"text {t} \n" * 5) for t in range(60)], "conv_id long, turn long, role string, text string")
    encoder = chat._Encoder.of(chat.default_tokenizer_path())
    results = []
    for size in (50, 1 << 20):
        monkeypatch.setattr(chat, "PIECE_CHARS", size)
        c = chat._Conversation(encoder, True)
        for t in range(60):
            c.add("assistant" if t % 2 else "user", f"text {t} \n" * 5)
        c.flush()
        results.append((c.loss.hexdigest(), c.n_tokens, c.loss_tokens, [int(x) for p in c.ids for x in p]))
    assert results[0] == results[1] and df.count() == 60


@pytest.mark.parametrize(("seed_stretches", "hot_share"), [(suffix.SEED_STRETCHES, suffix.HOT_SHARE), (0, 1 << 40), (1, 1)])
def test_suffix(spark, corpus, monkeypatch, seed_stretches, hot_share):
    """In every way a seed's stretches may meet (in a task, spread over tasks) and a class may be told (to all tasks, by a shuffle)."""
    monkeypatch.setattr(suffix, "SEED_STRETCHES", seed_stretches)
    monkeypatch.setattr(suffix, "HOT_SHARE", hot_share)
    docs, rows = corpus
    last = 1 << 62
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - 49):
            s = data[k : k + 50]
            first[s] = min(first.get(s, last + 1), last if i is None else i)
    want = []
    for i, t in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < (last if i is None else i):
                gone[k : k + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone, strict=True) if not g))))
    got = suffix.remove_repeats(docs, ["doc_id"])
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want_rows(want)
    assert suffix.remove_repeats(docs.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("held", [1 << 21, 200])
def test_suffix_keeps_no_anchors_of_short_repeats(spark, monkeypatch, held):
    """Strings of 30 bytes that many documents share leave at the first step; one of 50 bytes is found wherever its anchor lies."""
    monkeypatch.setattr(suffix, "HELD_NAMES", held)
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    short = [text(30) for _ in range(8)]
    rows = [(i, "".join(x for s in short for x in (s, text(40)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = suffix._shared(suffix._keyed(docs, "doc_id", "text"))
    found = suffix._found(docs, ["doc_id"], "doc_id", "text", suffix.bitmap.build(names, "k"))
    assert names.count() == 0 and found.filter("size(__found) > 0").count() == 0
    long = [text(50) for _ in range(40)]
    rows = [(i, text(60) + "|" + s + "|" + text(60)) for i, s in enumerate(long)] + [(100 + i, text(70) + s + text(70)) for i, s in enumerate(long)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ["doc_id"]).collect()}
    assert all(got[i] == (0, 0) and got[100 + i][0] >= 50 and got[100 + i][1] == 1 for i in range(40))


@pytest.mark.parametrize(("name_bits", "spots", "copies"), [(30, 1 << 22, 1 << 22), (15, 1, 1 << 22), (16, 50, 2)])
def test_suffix_in_parts(spark, monkeypatch, name_bits, spots, copies):
    """Names in several sieves, documents in several shares, and copies told or not: the bytes are those of brute force; whole copies have no stretches."""
    monkeypatch.setattr(suffix, "NAME_BITS", name_bits)
    monkeypatch.setattr(suffix, "SPOTS", spots)
    monkeypatch.setattr(suffix, "COPIES", copies)
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    shared = [text(rng.randint(45, 3000)) for _ in range(12)]
    own = [text(rng.randint(0, 90)) + rng.choice(shared) + text(rng.randint(0, 90)) for _ in range(40)] + ["short"] * 3
    rows = [(rng.randint(1, 200) if i % 9 else None, rng.choice(own)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    last, first = 1 << 62, {}
    for i, t in rows:
        data = t.encode()
        for k in range(len(data) - 49):
            first[data[k : k + 50]] = min(first.get(data[k : k + 50], last), last if i is None else i)
    want = []
    for i, t in rows:
        data = t.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < (last if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        want.append((i, len(data), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), sha(bytes(b for b, g in zip(data, gone, strict=True) if not g))))
    assert by_row(suffix.remove_repeats(docs, ["doc_id"], with_text=True), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want_rows(want)
    found, spans = suffix.repeated_spans(docs, ["doc_id"])
    changed = {(r["__ord"], r["__key"]): r.n_removed for r in suffix.changed_texts(docs, spans).collect()}
    removed = [(r.doc_id, changed.get((r["__ord"], r["__key"]), 0)) for r in found.collect()]
    assert sorted(removed, key=repr) == sorted([(w[0], w[2]) for w in want], key=repr)
    if copies > 2:
        least = {}
        for i, t in rows:
            least[t] = min(least.get(t, last), last if i is None else i)
        rest = sum((last if i is None else i) > least[t] and len(t.encode()) >= 50 for i, t in rows)
        assert suffix.Repeats(docs, [], "doc_id", "text").rows.filter("__copy AND size(__found) = 0").count() == rest > 20


def test_sieve_grows_with_its_keys(spark):
    """Of other numbers few pass, however many keys there are, and every key passes."""
    rng = np.random.Generator(np.random.PCG64(3))
    keys, others = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (150_000, 100_000))
    frame = spark.createDataFrame(pd.DataFrame({"k": keys.view(np.int64)}))
    held = suffix.bitmap.sieve(frame, "k", 21)
    assert suffix.bitmap.test(held, keys).all() and suffix.bitmap.test(held, others).mean() < 0.02
    # one name in many documents: keys that differ in their last bits only
    assert suffix.bitmap.test(held, keys[0] ^ np.arange(1, 1 << 15, dtype=np.uint64)).mean() < 0.03
    assert suffix.bitmap.parts(150_000, 21) == 1 and suffix.bitmap.parts(150_000, 20) == 2
    assert suffix.bitmap.test(suffix.bitmap.build(frame, "k", 18), others).mean() > 0.3


def test_suffix_stretches_do_not_depend_on_the_piece():
    """A text's stretches are the same alone, among others, and behind a very long text."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(40, 400))).encode() for _ in range(30)] + [b"x" * 300, b"ab" * 200, b"", b"z" * 50]
    data, offsets = lambda parts: np.frombuffer(b"".join(parts), np.uint8), lambda parts: np.cumsum([0, *map(len, parts)])
    long = bytes(rng.randrange(256) for _ in range(70_000))

    def of(s, row, base):
        at = s.row == row
        return list(zip((s.lo[at] - base).tolist(), (s.hi[at] - base).tolist(), s.seed[at].tolist(), s.name[at].tolist(), strict=True))

    together, behind = [suffix.Stretches(data(x), offsets(x)) for x in (texts, [long, *texts])]
    for i, t in enumerate(texts):
        alone = of(suffix.Stretches(data([t]), offsets([t])), 0, 0)
        assert alone == of(together, i, offsets(texts)[i]) == of(behind, i + 1, offsets([long, *texts])[i + 1])
        assert sum(hi - lo + 1 for lo, hi, _, _ in alone) == max(0, len(t) - 49)


def test_licenses(spark, corpus):
    docs, rows = corpus
    want = []
    for i, t in rows:
        words = re.findall(ALNUM, lower(t))
        places, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = licenses.scan(docs, ["doc_id"])
    assert by_row(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want_rows(want)
    assert got.filter("doc_id = 206").first().labels == "apache,apache-2.0,mit" and got.filter("score < 0 OR score > 1").count() == 0
    assert len(licenses.rules()) > 300 and licenses.scan(docs.limit(0), ["doc_id"]).count() == 0
    assert "MapInArrow" not in got._jdf.queryExecution().toString() and "Python" not in got._jdf.queryExecution().toString()


def test_license_rules_against_loop(spark):
    """Containment and priority by the sweep, against comparing every pair of matches."""
    text = " licensed under the terms of the gnu general public license version 3 or mit license text all rights reserved spdx license identifier apache 2 0 gpl 2 bsd 3 clause license "
    found = [(m.start(), m.end(), r["priority"], r["label"]) for r in licenses.rules() if r["keyword"] in text for m in re.finditer(r["re"], text)]
    keep = {d[3] for d in found if not any(x[0] <= d[0] and x[1] >= d[1] and x[2] >= d[2] and (x[:3] != d[:3]) for x in found)}
    labels = set(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first().labels.split(",")) - {"gpl", "mit", "apache"}
    assert labels <= keep and {"gpl-3.0", "apache-2.0", "bsd-3-clause"} <= labels


def made_for(pattern):
    """Texts that match a rule's pattern: every choice of an alternative, with and without each optional part, up to 400."""
    import re._parser as parser

    def grow(items):
        texts = [""]
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                more = [chr(arg)]
            elif op == "NOT_LITERAL":
                more = ["x"]
            elif op == "IN":
                more = ["x"] if str(arg[0][0]) == "NEGATE" else [chr(c) for _, c in arg]
            elif op == "BRANCH":
                more = [x for branch in arg[1] for x in grow(branch)]
            elif op == "SUBPATTERN":
                more = grow(arg[3])
            elif op == "MAX_REPEAT":
                more = ([] if arg[0] else [""]) + grow(arg[2])
            else:
                assert op in ("ASSERT", "ASSERT_NOT"), op
                more = [""]
            texts = list(dict.fromkeys(a + b for a in texts for b in more))[:400]
        return texts

    return grow(parser.parse(pattern))


def test_license_rules_against_ungated_loop(spark):
    """Every rule finds the texts made for it: no keyword and no gate hides a match."""
    texts = []
    for r in licenses.rules():
        made = made_for(r["re"])
        assert all(re.search(r["re"], f" {x} ") and r["keyword"] in x and re.search(licenses.GATE, x) for x in made), r
        texts += [made[0], made[len(made) // 2], made[-1]]
    spdx = "GPL-1.0 GPL-2.0-or-later GPL-3.0-or-later LGPL-2.1 LGPL-3.0-only AGPL-3.0 MPL-2.0 EPL-2.0 CDDL-1.0 EUPL-1.2 CC-BY-4.0 CC-BY-SA-4.0 OFL-1.1 BUSL-1.1 ODbL-1.0".split()
    want_spdx = "gpl-1.0 gpl-2.0 gpl-3.0 lgpl-2.1 lgpl-3.0 agpl-3.0 mpl-2.0 epl-2.0 cddl eupl cc-by-4.0 cc-by-sa-4.0 ofl-1.1 bsl-1.1 odbl-1.0".split()
    texts = list(dict.fromkeys(texts)) + [f"// SPDX-License-Identifier: {x}" for x in spdx]
    texts += ["the Expat License", "Zero Clause BSD", "GNU Library General Public License", "do what the fuck you want to public license", "General Public License version 1"]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()}
    rules = licenses.rules()
    for i, t in enumerate(texts):
        line = " " + " ".join(re.findall(ALNUM, lower(t))) + " "
        found = sorted({(m.start(), -m.end(), -r["priority"], r["label"]) for r in rules for m in re.finditer(r["re"], line)})
        kept = {d[3] for k, d in enumerate(found) if not any(x[0] <= d[0] and x[1] <= d[1] and x[2] <= d[2] for x in found[:k])}
        assert got[i] == kept | {label for phrase, label in licenses.BASE if f" {phrase} " in line}, t
    n = len(texts) - len(spdx) - 5
    assert all(label in got[n + k] for k, label in enumerate(want_spdx))
    assert [label in got[n + len(spdx) + k] for k, label in enumerate(("mit", "0bsd", "lgpl", "wtfpl", "gpl-1.0"))] == [True] * 5


def shingle_sets(rows, width):
    out = []
    for i, t in rows:
        w = re.findall(SPACED, lower(t))
        out.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    return out


def test_minhash(spark, corpus):
    docs, rows = corpus
    for width, percent in ((3, 85), (5, 80)):
        sets = shingle_sets(rows, width)
        parent = list(range(len(sets)))

        def root(k, parent=parent):
            while parent[k] != k:
                k = parent[k]
            return k

        for a in range(len(sets)):
            for b in range(a):
                x, y = sets[a][1], sets[b][1]
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    parent[root(a)] = root(b)
        least = {}
        for k, (i, _) in enumerate(sets):
            if i is not None:
                least[root(k)] = min(i, least.get(root(k), i))
        want = [(i, len(s), c, (i == c if i is not None and c is not None else c is None)) for k, (i, s) in enumerate(sets) for c in [least.get(root(k))]]
        got = minhash.near_duplicates(docs, ["doc_id"], width=width, percent=percent)
        assert by_row(got, "doc_id", "n_shingles", "component_id", "kept") == want_rows(want)
    assert minhash.near_duplicates(docs.limit(0), ["doc_id"]).count() == 0


def test_minhash_chain_is_one_component(spark):
    """Each document resembles only the next one: links between different texts must not be lost."""
    words = [f"w{i}" for i in range(260)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], width=3, percent=85)
    assert {r.component_id for r in got.collect()} == {0}


def test_decontaminate(spark, corpus):
    docs, rows = corpus
    words = lambda t: re.findall(ALNUM, lower(t))
    items = [(1, rows[0][1]), (2, "one"), (2, "One, one"), (30, None), (4, " "), (None, "zz yy xx"), (5, " ".join(rows[1][1].split()[2:14]))]
    got = decontaminate.scan(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"])
    want = []
    for i, t in rows:
        w, hit, held = words(t), set(), set()
        for item, it in items:
            v = words(it)
            n = min(10, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    held.add("" if item is None else str(item))
        want.append((i, len(w), len(hit), len(held), sha(",".join(sorted(held))), bool(hit)))
    assert by_row(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want_rows(want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs, none, ["doc_id"]).filter("contaminated").count() == 0
    assert decontaminate.scan(docs.limit(0), none, ["doc_id"]).count() == 0
