"""Main-text extraction by maximum-scoring subsequence.

A page is one sequence of words and tags.  Words score positive or, among
elements that labelled pages show outside their article, negative; every tag
scores negative, the more the rarer it is inside articles.  One linear scan
finds the contiguous region with the largest sum.  Parts of the region that are
menus, headers, footers, sidebars, notices, adverts, forms or reader comments by
their own or an enclosing element are left out.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lean, table

#: Pages the weights are fitted on, at most: those with one article element, first in hash order.
SAMPLE_PAGES = 1000
#: What a tag costs at least and at most, the most a word scores either way, and what a word costs that is left out anyway.
TAG_COST, MOST_TAG_COST, CLIP, LEFT_OUT_COST = 0.15, 1.5, 4.0, 0.25
#: Contexts seen in fewer sampled pages keep the fixed weights.
MIN_PAGES = 3

#: Elements whose text is never content (fixed values).
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
LEFT_OUT = frozenset("head title script style noscript template iframe nav footer aside form fieldset button select option textarea input label svg math canvas object embed audio video map menu dialog".split())
HEADER = frozenset(["header", "hgroup"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr nobr ruby rb rt rp".split())
#: Elements that end another open one of their kind.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of class, id or role that tell such parts apart.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert comment comments respond disqus discussion "
    "sidebar side rail widget widgets nav navbar navigation menu breadcrumb breadcrumbs footer header masthead share sharing social related recommended recommendations popular trending newsletter subscribe "
    "subscription signup login popup modal overlay pagination pager toolbar skip search searchbox copyright legal disclaimer complementary contentinfo tags".split()
)
#: Those that an article element may be told by, too.
ARTICLE_HINTS = frozenset("ad ads advert adverts advertisement advertising sponsored promo comment comments respond related recommended recommendations".split())
#: Names beside which "header" is an article's own.
OF_ARTICLE = frozenset("article entry post story".split())
CONTENT, HEADINGS, WHOLE = frozenset(["article", "main"]), frozenset(["h1", "h2", "h3"]), frozenset(["html", "body"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>?",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|$|=)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_NAME = re.compile(r"[a-z]+")
_BESIDE = re.compile(r"\b(?:has|with|without|no)[-_]+[a-z]+")


class Element:
    __slots__ = ("keys", "out", "tag")

    def __init__(self, tag: str, attrs: str, inside: bool):
        self.tag = tag
        self.keys = [tag]
        names: set[str] = set()
        if attrs:
            for m in _ATTR.finditer(attrs):
                if m[1].lower() in ("class", "id", "role"):
                    value = (m[2] or m[3] or m[4] or "").lower()
                    self.keys += [f"{tag}.{v}" for v in value.split()]
                    names.update(_NAME.findall(_BESIDE.sub(" ", value)))
        hints = names & (ARTICLE_HINTS if tag in CONTENT else HINTS)
        if hints == {"header"} and (inside or names & OF_ARTICLE):
            hints = frozenset()
        self.out = tag in LEFT_OUT or bool(hints and tag not in WHOLE) or (tag in HEADER and not inside) or bool(attrs and _HIDDEN.search(attrs))


class Open:
    """The open elements, and what follows from them, kept up to date at every tag."""

    def __init__(self, weights: dict[str, float], learn: bool = False):
        self.weights = weights
        self.stack: list[Element] = []
        #: places in the stack of elements that are not inline
        self.solid: list[int] = []
        self.tags: Counter[str] = Counter()
        self.keys: Counter[str] = Counter()
        self.score = 1.0
        self.inside = self.lost = self.lost_headers = self.headings = 0
        #: words so far in and outside content, the same when each key began, and of all the time it was open
        self.words = [0, 0]
        self.since: dict[str, tuple[int, int]] | None = {} if learn else None
        self.of_key: dict[str, list[int]] = {}

    @property
    def left_out(self) -> bool:
        """Whether text here is left out; a header inside content is not where it holds a heading."""
        return self.lost > (self.lost_headers if self.inside and self.headings else 0)

    def push(self, e: Element) -> None:
        if e.tag not in INLINE:
            self.solid.append(len(self.stack))
        self.stack.append(e)
        self._count(e, 1)
        for k in e.keys:
            self.keys[k] += 1
            if self.keys[k] == 1:
                self.score += self.weights.get(k, 0.0)
                if self.since is not None:
                    self.since[k] = tuple(self.words)

    def _count(self, e: Element, n: int) -> None:
        self.tags[e.tag] += n
        self.inside += n * (e.tag in CONTENT)
        self.lost += n * e.out
        self.lost_headers += n * (e.out and e.tag in HEADER)
        self.headings += n * (e.tag in HEADINGS)

    def cut(self, size: int) -> None:
        """Close all elements from place ``size`` of the stack on."""
        while len(self.stack) > size:
            e = self.stack.pop()
            if self.solid and self.solid[-1] == len(self.stack):
                self.solid.pop()
            self._count(e, -1)
            for k in e.keys:
                self.keys[k] -= 1
                if not self.keys[k]:
                    self.score -= self.weights.get(k, 0.0)
                    if self.since is not None:
                        begun, held = self.since.pop(k), self.of_key.setdefault(k, [0, 0])
                        held[0] += self.words[0] - begun[0]
                        held[1] += self.words[1] - begun[1]

    def close(self, tag: str) -> Element | None:
        """Close the last open ``tag`` and all inside it; None if there is none."""
        if not self.tags[tag]:
            return None
        i = len(self.stack) - 1
        while self.stack[i].tag != tag:
            i -= 1
        e = self.stack[i]
        self.cut(i)
        return e

    def end_of(self, kinds: set[str]) -> None:
        """Close elements of ``kinds`` that stand innermost but for inline ones."""
        while self.solid and self.stack[self.solid[-1]].tag in kinds:
            self.cut(self.solid[-1])


class Item:
    """A run of tags (text is empty) or a block of words, with its score."""

    __slots__ = ("left_out", "score", "text", "words")

    def __init__(self, text: str, words: int, score: float, left_out: bool):
        self.text, self.words, self.score, self.left_out = text, words, score, left_out


def tag_score(tag: str, weights: dict[str, float]) -> float:
    return weights.get(f"<{tag}", -TAG_COST)


def read(page: str, weights: dict[str, float], learn: bool = False) -> tuple[list[Item], Open, dict[str, list[int]]]:
    """(items, elements, tags) of a page: its words and tags in order, and with ``learn`` what was met in and outside content."""
    now = Open(weights, learn)
    out: list[Item] = []
    parts: list[str] = []
    tags: dict[str, list[int]] = {}
    cost = 0.0

    def end() -> None:
        nonlocal cost
        text = " ".join(html_lib.unescape("".join(parts)).split())
        parts.clear()
        if text:
            left_out, words = now.left_out, text.count(" ") + 1
            now.words[not now.inside or left_out] += words
            if cost:
                out.append(Item("", 0, cost, True))
                cost = 0.0
            out.append(Item(text, words, words * (-LEFT_OUT_COST if left_out else max(-CLIP, min(CLIP, now.score))), left_out))

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            parts.append(page[at:])
            break
        m = _TOKEN.match(page, lt)
        if m is None:
            parts.append(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            parts.append(page[at:lt])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag not in INLINE and tag != "br":
            end()
        cost += tag_score(tag, weights)
        if learn:
            tags.setdefault(tag, [0, 0])[not now.inside or now.left_out] += 1
        if tag == "br":
            parts.append(" ")
            continue
        if closing:
            if tag in INLINE and now.tags[tag] and now.lost:
                end()
            now.close(tag)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        if tag in CLOSES or tag in ENDS_P:
            now.end_of(CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set()))
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            e = Element(tag, attrs, now.inside > 0)
            if e.out and tag in INLINE:
                end()
            now.push(e)
    end()
    now.cut(0)
    return out, now, tags


#: Context weights before any page is seen (fixed values).
FIXED = {"article": 2.0, "main": 1.5, "p": 0.5, "h1": 0.5, "a": -1.5, "nav": -3.0, "footer": -3.0, "aside": -3.0, "form": -3.0}


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run with the largest sum; the first and longest of equals; (0, 0) if none is positive."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and best > 0 and start == where[0]):
            best, where = total, (start, i + 1)
    return where


def main_text(page: str, weights: dict[str, float]) -> str:
    items = read(page, weights)[0]
    start, end = best_run([x.score for x in items])
    return " ".join(x.text for x in items[start:end] if x.text and not x.left_out)


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights of elements and tags from pages with exactly one article element.

    An element's (its tag, and its tag with each class, id or role) is the log odds
    of a word under it being content: inside the article and not left out; a
    tag's is a cost that grows with its odds of standing elsewhere.  The sample
    is bounded, a documented parameter; it is the first pages in hash order.
    Without labelled pages the fixed weights remain.
    """
    marked = pages.select(F.col(html).cast("string").alias("html")).filter(F.regexp_count("html", F.lit("(?i)<article[\\s>]")) == 1)
    # only hashes are ordered; the pages themselves stay where they are
    first = marked.select(F.xxhash64("html").alias("hash")).distinct().orderBy("hash").limit(sample)
    marked = marked.withColumn("hash", F.xxhash64("html")).join(F.broadcast(first), "hash").select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: dict[str, list[int]] = {}
            for page in batch.column(0):
                _, now, tags = read(page.as_py(), FIXED, learn=True)
                for k, (a, b) in [*now.of_key.items(), *((f"<{t}", n) for t, n in tags.items())]:
                    one = met.setdefault(k, [0, 0, 0])
                    one[0] += a
                    one[1] += b
                    one[2] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), *(pa.array([v[i] for v in met.values()], pa.int64()) for i in range(3))], ["key", "a", "b", "pages"])

    counts = marked.mapInArrow(lean(run), "key string, a long, b long, pages long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pages").alias("pages"))
    weights = dict(FIXED)
    for r in counts.filter(F.col("pages") >= MIN_PAGES).collect():
        odds = 0.5 * math.log((r.a + 5) / (r.b + 5))
        if r.key.startswith("<"):
            weights[r.key] = -max(TAG_COST, min(MOST_TAG_COST, TAG_COST - odds))
        elif r.key not in WHOLE:
            weights[r.key] = max(-2.0, min(2.0, odds))
    return weights


def extract(pages: DataFrame, keep: list[str], weights: dict[str, float] | None = None, html: str = "html") -> DataFrame:
    """``keep``, text and n_chars (code points) of each row's main text.

    Null, empty and text-less pages give an empty text.  Cut-off pages are read
    to their end; repeated rows give equal results.  ``text`` and ``n_chars``
    must not be among ``keep``.
    """
    import pyspark.sql.types as T

    if {"text", "n_chars"} & set(keep):
        raise ValueError("text and n_chars are result columns")
    weights = dict(FIXED) if weights is None else weights
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                texts = [main_text(p or "", weights) for p in part.column(k).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [f.name for f in schema])

    return pages.select(*[pages[c] for c in keep], pages[html].cast("string").alias("__html")).mapInArrow(lean(run), schema)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, ["page_id", "url"], fit(pages))
