"""Toxicity: noisy-channel restoration of disguised words, then a learned lexicon score.

Disguised spellings (leetspeak, letters spaced or repeated) become character
lattices; Viterbi decoding under a character trigram model restores the
likeliest word, or words where several are run together.  Restored and plain words are scored with weights learned from
labelled rows: entries are whole words or word beginnings found in so many
different toxic documents, and so few others, that chance does not explain it;
copies of one document count once.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm.common import lean, settle, table

MIN_SUPPORT, MIN_PRECISION = 3, 0.9
#: Entries expected by chance; documents of an entry that must not be copies; what a beginning must explain beyond its best word.
CHANCE, KIN_SHARE, BEGINNING_GAIN = 0.05, 0.3, 1.5
#: So many different kin are enough, however many documents there are.
KIN_ENOUGH = 1200
#: Entries that a task sums up before it passes them on.
HELD_ENTRIES = 200_000
THRESHOLD = 0.7
PREFIXES = (3, 4, 5)

#: What a sign may stand for (fixed values).
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "&": "a", "€": "e", "£": "l", "¡": "i",
}
_SIGN_COST, _DROP_COST, _REPEAT_COST, _KEEP_COST, _END_COST = 0.7, 1.5, 0.3, 0.0, 0.5
#: Pieces up to so many characters are remembered once decoded.
_MEMO_CHARS = 80
_KIN = (1 << 62) - 1
#: Where words may end inside a piece: nowhere, at a sign, behind any character.
NOWHERE, SIGN, ANYWHERE = range(3)

_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNSET = re.escape("".join(SIGNS))
_MIXED = re.compile(rf"(?<!\S)(?=\S*[^\W\d_])(?=\S*[{_SIGNSET}*.\-_][^\W\d_]|[{_SIGNSET}]|\S*[^\W\d_][0-9@$€£])\S{{3,}}(?!\S)")
_SPACED = re.compile(rf"(?<!\S)(?:[^\W_]|[{_SIGNSET}])(?:[ ._*\-](?:[^\W_]|[{_SIGNSET}])){{3,}}(?!\S)")
_REPEATED = re.compile(r"(?<!\S)\S*([^\W\d_])\1\1\S*(?!\S)")
_RUN = re.compile(r"(.)\1{3,}", re.DOTALL)
_EDGE = ".,;:!?\"'()[]{}<>*%&#$-_|+"


def trigrams(words: dict[str, float]) -> dict[str, float]:
    """Weighted character trigrams of words; ``^`` begins and ``$`` ends one."""
    out: dict[str, float] = defaultdict(float)
    for w, n in words.items():
        s = f"^^{w}$"
        for i in range(len(s) - 2):
            out[s[i : i + 3]] += n
    return dict(out)


class CharModel:
    """Interpolated character trigrams of words."""

    def __init__(self, tri: dict[str, float]):
        self.tri = tri
        self.bi: dict[str, float] = defaultdict(float)
        self.uni: dict[str, float] = defaultdict(float)
        self.two: dict[str, float] = defaultdict(float)
        self.one: dict[str, float] = defaultdict(float)
        for t, n in tri.items():
            self.two[t[:2]] += n
            self.bi[t[1:]] += n
            self.one[t[1]] += n
            self.uni[t[2]] += n
        self.total = sum(tri.values()) + 1
        self.memo: dict[tuple[str, str], float] = {}

    def cost(self, before: str, c: str) -> float:
        key = (before, c)
        if key not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            p = 0.7 * self.tri.get(before + c, 0.0) / self.two[before] if before in self.two else 0.0
            p += 0.2 * self.bi.get(before[1] + c, 0.0) / self.one[before[1]] if before[1] in self.one else 0.0
            self.memo[key] = -math.log(p + 0.1 * (self.uni.get(c, 0.0) + 0.01) / self.total)
        return self.memo[key]


def restore(token: str, model: CharModel, ends: int = NOWHERE) -> str:
    """The likeliest word behind the whole ``token``, or words with spaces between (Viterbi over its character lattice)."""
    token = _RUN.sub(r"\1\1\1", token)
    # what is put out is a chain (before, character), and a state is the last two: the work grows with the length alone
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for i, c in enumerate(token):
        new: dict[str, tuple[float, tuple | None]] = {}

        def put(state: str, cost: float, out: tuple | None, new=new) -> None:
            if state not in new or cost < new[state][0]:
                new[state] = (cost, out)

        letter = c.isalpha()
        ways = [(c, _KEEP_COST)] if letter else [(x, _SIGN_COST) for x in SIGNS.get(c, "")]
        again = i > 0 and (c == token[i - 1])
        for state, (cost, out) in states.items():
            for x, own in ways:
                put(state[1] + x, cost + own + model.cost(state, x), (out, x))
            if again or (out and any(x == state[1] for x, _ in ways)):
                put(state, cost + _REPEAT_COST, out)
            if not letter:
                put(state, cost + _DROP_COST, out)
                if ends and state != "^^":
                    put("^^", cost + _DROP_COST + model.cost(state, "$"), (out, " "))
        if ends == ANYWHERE:
            at, (cost, out) = min(((s, v) for s, v in new.items() if s != "^^"), key=lambda v: v[1][0] + model.cost(v[0], "$"), default=("^^", (0.0, None)))
            if at != "^^":
                put("^^", cost + _END_COST + model.cost(at, "$"), (out, " "))
        states = new
    _, out = min(((cost + (model.cost(state, "$") if state != "^^" or not out else 0.0), out) for state, (cost, out) in states.items()), key=lambda v: v[0], default=(0.0, None))
    found = []
    while out:
        out, x = out
        found.append(x)
    return "".join(reversed(found)).strip()


def disguised(text: str) -> list[tuple[str, int]]:
    """The pieces of lower-cased ``text`` that may hide a word, and where words may end in each."""
    out = []
    for m in _MIXED.finditer(text):
        t = m[0].strip(".,;:?\"'#%*")
        core = t.strip(_EDGE)
        if core and not core.isalpha():
            out += [(core, NOWHERE), (core, SIGN)]
        if t != core and not (core.isalpha() and t.startswith(core)):
            out.append((t, NOWHERE))
    for m in _SPACED.finditer(text):
        run = re.sub(r"[ ._*\-]", "", m[0])
        out += [(run, NOWHERE), (run, ANYWHERE)]
    out += [(m[0].strip(_EDGE), NOWHERE) for m in _REPEATED.finditer(text)]
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    prior: float = -2.5
    tri: dict[str, float] = field(default_factory=dict)
    mass: float = 1.0

    def matches(self, word: str) -> list[str]:
        return [k for k in (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)) if k in self.weights]


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.words = {k for k in lexicon.weights if not k.endswith("*")}
        self.begins = {k[:-1] for k in lexicon.weights if k.endswith("*")}
        self.lengths = sorted({len(k) for k in self.begins})
        # the entries share a fifth of the weight of all words
        boost = 0.2 * max(1.0, lexicon.mass) / max(1, len(lexicon.weights))
        tri = dict(lexicon.tri)
        for t, n in trigrams({k.rstrip("*"): boost for k in lexicon.weights}).items():
            tri[t] = tri.get(t, 0.0) + n
        self.model = CharModel(tri)
        self.memo: dict[tuple[str, int], list[str]] = {}

    def hits(self, text: str) -> set[str]:
        text = text.lower()
        words = set(_LETTERS.findall(text))
        found = words & self.words
        for n in self.lengths:
            found |= {f"{w}*" for w in {x[:n] for x in words if len(x) > n} & self.begins}
        for piece in disguised(text):
            words_ = self.memo.get(piece)
            if words_ is None:
                if len(self.memo) > 50_000:
                    self.memo.clear()
                words_ = restore(piece[0], self.model, piece[1]).split()
                if len(piece[0]) <= _MEMO_CHARS:
                    self.memo[piece] = words_
            for word in words_:
                found.update(self.lexicon.matches(word))
        return found

    def score(self, text: str) -> float:
        total = self.lexicon.prior + sum(self.lexicon.weights[k] for k in self.hits(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def _entries(words: list[str]) -> set[str]:
    """The words and their beginnings."""
    return {*words, *(f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n)}


def _words_of(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(toxic, kin, words) of each labelled text.

    words are the distinct letter runs of the lower-cased text.  kin is made of
    the two smallest hashes of its long, so rare, words: near copies mostly
    share it.  Texts stay where they are read; a bitmap of the labelled ids
    thins what is emitted, and the words then meet the labels in an exact join.
    """
    import pyspark.sql.types as T

    needed = docs.sparkSession.sparkContext.broadcast(bitmap.build(labels.select(F.xxhash64(doc_id).alias("k")), "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bitmap.test(needed.value, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))))
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                words = [sorted(set(_LETTERS.findall((t or "").lower()))) for t in part.column(2).to_pylist()]
                least = [heapq.nsmallest(2, (zlib.crc32(w.encode()) for w in ([x for x in ws if len(x) >= 10] or ws))) for ws in words]
                kin = [sum(h << (31 * k) for k, h in enumerate(hs)) & _KIN for hs in least]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kin, pa.int64()), pa.array(words, pa.list_(pa.string()))], [doc_id, "kin", "words"])

    schema = T.StructType([docs.schema[doc_id], T.StructField("kin", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))])
    found = docs.select(doc_id, F.xxhash64(doc_id).alias("__k"), F.col(text).cast("string").alias("__text")).mapInArrow(lean(run), schema)
    # always by a shuffle: labels grow with the documents
    return found.join(labels.hint("merge"), doc_id).select(F.col("toxic").cast("int").alias("toxic"), "kin", "words")


def _counted(rows: DataFrame) -> DataFrame:
    """(f, t, n): in how many toxic and in how many of all ``rows`` an entry stands; tasks pass on sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = Counter(), Counter()

        def out() -> pa.RecordBatch:
            names = list(every)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()), pa.array(list(every.values()), pa.int64())], ["f", "t", "n"])

        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                for bad, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    entries = _entries(words)
                    every.update(entries)
                    if bad:
                        toxic.update(entries)
                if len(every) > HELD_ENTRIES:
                    yield out()
                    every, toxic = Counter(), Counter()
        if every:
            yield out()

    return rows.select("toxic", "words").mapInArrow(lean(run), "f string, t long, n long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def _kinds(rows: DataFrame, wanted: set[str]) -> DataFrame:
    """(f, kinds): how many different kin the toxic ``rows`` with a wanted entry have."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                found = [(f, k) for k, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for f in _entries(words) & shared.value]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([k for _, k in found], pa.int64())], ["f", "kin"])

    return rows.filter("toxic = 1").select("kin", "words").mapInArrow(lean(run), "f string, kin long").distinct().groupBy("f").agg(F.count("*").alias("kinds"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Lexicon:
    """Learn the lexicon from all ``labels`` (doc_id, toxic) rows and all words of their texts; null labels are left out."""
    labels = labels.filter("toxic IS NOT NULL").withColumn(doc_id, F.col(doc_id).cast(docs.schema[doc_id].dataType)).groupBy(doc_id).agg(F.max("toxic").alias("toxic"))
    rows = settle(_words_of(docs, labels, doc_id, text))
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return Lexicon()
    every = settle(_counted(rows))
    counted = every.filter(F.col("t") >= MIN_SUPPORT)
    share = n[1] / (n[1] + n.get(0, 0))
    # so many different documents that chance gives no such entry among all that are looked at
    least = max(MIN_SUPPORT, math.ceil(math.log(CHANCE / max(1, counted.count())) / math.log(min(share, 0.5))))
    maybe = {r.f: (r.t, r.n) for r in counted.filter((F.col("t") >= least) & (F.col("t") >= MIN_PRECISION * F.col("n"))).collect()}
    # support is counted in different kin, so copies count once
    kinds = {r.f: r.kinds for r in _kinds(rows, set(maybe)).collect()}
    stats = {f: (t, all_ - t) for f, (t, all_) in maybe.items() if kinds[f] >= least and kinds[f] >= min(KIN_SHARE * t, KIN_ENOUGH)}
    best_word: dict[str, int] = defaultdict(int)
    for f, (t, _) in stats.items():
        if not f.endswith("*"):
            for k in PREFIXES:
                best_word[f[:k]] = max(best_word[f[:k]], t)
    weights: dict[str, float] = {}
    taken: dict[str, int] = defaultdict(int)
    # words, then beginnings from the longest: one must explain clearly more than a word or a longer one
    for f, (t, clean) in sorted(stats.items(), key=lambda x: (x[0].endswith("*"), -len(x[0]) if x[0].endswith("*") else -x[1][0], x[0])):
        if f.endswith("*"):
            f_ = f[:-1]
            if t < BEGINNING_GAIN * best_word[f_] or t < 1.05 * taken[f_]:
                continue
            for k in PREFIXES:
                taken[f_[:k]] = max(taken[f_[:k]], t)
        weights[f] = min(7.0, math.log((t + 0.5) / (n[1] + 1)) - math.log((clean + 0.1) / (n.get(0, 0) + 1)))
    words = every.filter(~F.col("f").endswith("*")).select(F.col("f").alias("w"), F.log1p("n").alias("n"))
    padded = words.select(F.concat(F.lit("^^"), "w", F.lit("$")).alias("s"), "n")
    each = padded.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 2), lambda i: F.substring("s", i, F.lit(3)))).alias("t"))
    # as many as the alphabet allows, whatever the number of words
    tri = {r.t: r.n for r in each.groupBy("t").agg(F.sum("n").alias("n")).collect()}
    mass = words.agg(F.sum("n")).first()[0]
    total = labels.agg(F.avg("toxic")).first()[0] or 0.1
    prior = max(-4.0, min(-1.5, math.log(total / (1 - total)) if total < 1 else -1.5))
    return Lexicon(weights, prior, tri, mass or 1.0)


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score`` (0 to 1) of each row's whole text; null reads as empty.

    An empty text gets the prior.  The score depends on the text alone, so
    repeated rows agree; ``score`` must not be among ``keep``.
    """
    import pyspark.sql.types as T

    if "score" in keep:
        raise ValueError("score is a result column")
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    k = len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                scores = [scorer.score(t or "") for t in part.column(k).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(scores, pa.float64())], [f.name for f in schema])

    return docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("__text")).mapInArrow(lean(run), schema)


def held_out(doc_id):
    """Rows that labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_training(docs: DataFrame, labels: DataFrame) -> Lexicon:
    return fit(docs, labels.filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = fit_on_training(docs, table(spark, sf_dir, "labels"))
    out = score(docs, lexicon, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
