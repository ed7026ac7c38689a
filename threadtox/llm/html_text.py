"""Main text of web pages: a linear-chain CRF over DOM leaf blocks, decoded by Viterbi.

A page becomes its leaf blocks in page order: runs of text between block-level tags, each with the chain of
elements around it. A block's features are its ancestors' tags, words in their class, id and role attributes
(grouped by meaning), which of the sectioning ancestors is nearest, and shape of the text (length, links,
punctuation). The CRF labels blocks as main text or not; main blocks join in page order.

Training pages (``training_pages``): of the ``sample`` pages with the smallest hash of their id, those that
have one ``<article>`` label themselves (blocks inside it, but not inside menus, asides, footers, forms or
comment sections within it, are main text). As real pages differ in layout, the texts of the same pages are
also laid out anew in ``layouts`` ways each, with other containers for the article, adverts and asides
between its paragraphs, lists, tables and captions of a few words, notices, sidebars, forms and reader comments, so that
the chain learns from labelled pages of many shapes. Only training is bounded; every page is decoded whole.

Defined results: a null or empty page, and one without main text, has an empty text. Character references are
decoded, white space inside a block (``<br>`` included) becomes one space. Scripts, styles, templates, the head
and markup comments are no text, nor is what shows only without scripts (``<noscript>``). A head whose end tag is
omitted ends where something stands that no head can hold. Formulas are text. Broken markup is read on as far as it goes. Rows are read one by one, whatever
their id; repeated rows alike; an empty table gives an empty result; other columns are ignored. Without any
training page the chain is trained on layouts of a fixed sample sentence. Very long pages and blocks are read whole, and
reading is linear in the page's length, however deep its elements nest.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadtox.llm import crf
from threadtox.llm import textarrays as ta
from threadtox.llm.rows import arrow_map, typed

DIMS = 1024

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                    "strike strong sub sup time tt u var wbr img br").split())
MATH = frozenset(("math semantics annotation annotation-xml merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms "
                  "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover").split())
INLINE |= MATH
NO_TEXT = frozenset("script style template noscript head title iframe object svg annotation annotation-xml canvas audio video".split())
#: What can stand in a head; any other element ends an open one.
IN_HEAD = frozenset("head title base basefont bgsound link meta noframes noscript script style template".split())
#: Elements whose open tag ends an open one of the named kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
SECTIONS = frozenset("article main section nav aside header footer form div body table ul ol dialog menu details".split())
#: Words in class, id and role attributes, by what they say of an element.
MEANS = {word: kind for kind, words in {
    "main": "article main content post entry story body text page prose blog news document read",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs topbar toolbar skip links",
    "head": "header masthead head banner logo brand hero title",
    "foot": "footer foot copyright legal bottom colophon",
    "side": "sidebar side aside rail widget related recommended popular trending more teaser archive tags category categories complementary",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense commercial affiliate",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog warning message privacy disclaimer announcement toast",
    "form": "form login signin signup register search subscribe newsletter contact input survey poll",
    "talk": "comment comments respond reply replies discussion disqus thread feedback review reviews responses talk guestbook",
    "share": "share social follow like tweet facebook twitter print byline author meta date",
}.items() for word in words.split()}
#: A tag that the page breaks off in.
_UNFINISHED = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def kinds_of(attrs: list[tuple[str, str | None]]) -> frozenset[str]:
    words = (w.lower() for name, value in attrs if name in ("class", "id", "role") and value for w in _PARTS.findall(value))
    return frozenset(MEANS[w] for w in words if w in MEANS)


_NOT_MAIN = frozenset("nav aside footer form dialog menu".split())
_IN_MAIN = frozenset(("main", "share", "head"))


class Node:
    """A block element and what its ancestors say, added up from its parent: no walk along the path, however deep."""

    __slots__ = ("tag", "tags", "kinds", "near", "named", "in_article", "own_main")

    def __init__(self, tag: str = "", kinds: frozenset[str] = frozenset(), parent: Node | None = None):
        self.tag = tag
        if parent is None:
            self.tags, self.kinds, self.near, self.named, self.in_article, self.own_main = frozenset(), frozenset(), "none", None, False, False
            return
        self.tags = parent.tags if tag in parent.tags else parent.tags | {tag}
        self.kinds = parent.kinds if kinds <= parent.kinds else parent.kinds | kinds
        self.near = tag if tag in SECTIONS and tag not in ("div", "body") else parent.near
        self.named = kinds or parent.named
        self.in_article = parent.in_article or tag == "article"
        # inside the first article, with nothing between that says otherwise
        fits = tag not in _NOT_MAIN and kinds <= _IN_MAIN
        self.own_main = fits and (parent.own_main if parent.in_article else tag == "article")


ROOT = Node()


@dataclass
class Leaf:
    """A leaf block: the element around it, its text, and its characters inside links."""

    node: Node
    text: str
    linked: int = 0
    features: list[int] = field(default_factory=list)


class Leaves(HTMLParser):
    """Splits a page into leaf blocks, in time linear in the page: places of open elements are kept by tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.blocks: list[Node] = [ROOT]  # the open elements that are blocks
        self.places: dict[str, list[int]] = {}
        self.parts: list[str] = []
        self.linked = 0
        self.silent = 0  # open elements without text
        self.leaves: list[Leaf] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.leaves.append(Leaf(self.blocks[-1], text, self.linked))
        self.parts, self.linked = [], 0

    def _push(self, tag: str, attrs) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(tag)
        self.silent += tag in NO_TEXT
        if tag not in INLINE:
            self.blocks.append(Node(tag, kinds_of(attrs), self.blocks[-1]))

    def _pop(self, at: int) -> None:
        flushed = False
        while len(self.open) > at:
            tag = self.open[-1]
            if tag not in INLINE:
                if not flushed:
                    self.flush()  # before an element goes: the leaf belongs to the innermost
                    flushed = True
                self.blocks.pop()
            self.open.pop()
            self.places[tag].pop()
            self.silent -= tag in NO_TEXT

    def _last(self, tags, within=()) -> int:
        """Place of the last open element of the tags, if none of ``within`` is open inside it, else -1."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        return at if at >= max((self.places[t][-1] for t in within if self.places.get(t)), default=-1) else -1

    def _end_head(self) -> None:
        at = self._last(("head",), ("template", "noscript", "title"))
        if at >= 0:
            self._pop(at)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "body"):
            at = self._last(("head", "title"))
            if at >= 0:
                self._pop(at)
        if tag not in IN_HEAD:
            self._end_head()
        if tag == "br" or (tag in VOID and tag in INLINE):
            self.parts.append(" ")
            return
        if tag in VOID:
            self.flush()
            return
        if tag not in INLINE:
            at = self._last(("p",), SECTIONS) if tag not in NO_TEXT else -1
            if at >= 0:
                self._pop(at)
            if tag in ENDS:
                at = self._last(ENDS[tag], ("ul", "ol", "dl", "table"))
                if at >= 0:
                    self._pop(at)
            if tag not in NO_TEXT:
                self.flush()
        self._push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "svg" and tag not in MATH:
            return
        if tag == "svg" or tag in MATH:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        at = self._last((tag,))
        if at >= 0:
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] == "head" and data.strip():
            self._end_head()
        if not self.silent:
            self.parts.append(data)
            if self.places.get("a"):
                self.linked += len(data)


def leaves(page: str) -> list[Leaf]:
    """The leaf blocks of a page, with features."""
    p = Leaves()
    p.feed(_UNFINISHED.sub("", page))
    if p.cdata_elem is None and p.rawdata.startswith("<!--"):
        p.rawdata = ""  # a comment that never ends; in a script or an attribute it is none
    p.close()
    p.flush()
    for leaf in p.leaves:
        leaf.features = [_slot(x) for x in dict.fromkeys(_named(leaf))]
    return p.leaves


@lru_cache(maxsize=1 << 16)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMS


def _named(leaf: Leaf) -> Iterator[str]:
    node = leaf.node
    yield "one"
    for t in node.tags:
        yield f"in {t}"
    yield f"own {node.tag or 'none'}"
    yield f"near {node.near}"
    for k in node.kinds:
        yield f"kind {k}"
    yield "near kind " + (" ".join(sorted(node.named)) if node.named else "none")
    if node.kinds - {"main", "share"}:
        yield "some other kind"
    after = "article" in node.tags or "main" in node.tags or "main" in node.kinds
    for t in ("nav", "aside", "footer", "form", "header", "dialog"):
        if t in node.tags:
            yield f"{t} with main {after}"
    words = leaf.text.split()
    size = len(leaf.text)
    yield f"words {min(5, len(words).bit_length())}"
    yield f"links {min(3, round(3 * leaf.linked / size))}"
    yield f"stop {leaf.text[-1] in '.!?:;'}"
    yield f"commas {min(2, leaf.text.count(','))}"
    if "©" in leaf.text:
        yield "copyright"
    yield f"heading {node.tag in ('h1', 'h2', 'h3', 'h4')} {node.near}"


def matrix(pages: list[list[Leaf]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix of all leaves, and the number of leaves of each page."""
    own = [leaf.features for p in pages for leaf in p]
    x = np.zeros((len(own), DIMS), dtype=np.float32)
    x[np.repeat(np.arange(len(own)), [len(f) for f in own]), [i for f in own for i in f]] = 1
    return x, np.array([len(p) for p in pages], dtype=np.int64)


# ---- labelled pages

def own_labels(page: list[Leaf]) -> list[int]:
    """Labels by the page's own ``<article>``: inside it, and in none of its menus, asides, forms or comments."""
    return [int(leaf.node.own_main) for leaf in page]


_FALLBACK = ["One sentence of a text, as long as it goes on, ends here.", "Another one follows it. It has two parts.", "A short one."]


class Layout:
    """Lays texts out as a page of some shape, every piece of text marked as main (1) or not (0)."""

    def __init__(self, seed: int, main: list[str], other: list[str]):
        self.r = random.Random(seed)
        self.main, self.other = (main or _FALLBACK)[:self.r.randint(1, 12)], other or _FALLBACK
        self.out: list[str] = []
        self.labels: list[tuple[str, int]] = []

    def cls(self, words: str) -> str:
        """An attribute with one of the words, alone or in a compound."""
        r = self.r
        w = r.choice(words.split())
        w = r.choice([w, w, f"{w}-{r.choice(['box', 'wrap', 'area', 'block', 'list', 'inner', 'container', '1'])}", f"{r.choice(['site', 'page', 'the', 'js', 'c'])}-{w}"])
        return f' {r.choice(["class", "class", "id"])}="{w}"'

    def put(self, tag: str, text: str, label: int, attrs: str = "") -> None:
        text = " ".join(text.split())
        if not text:
            return
        body = html.escape(text, quote=False)
        if self.r.random() < 0.2:
            body = f"<{self.r.choice(['b', 'em', 'strong', 'span'])}>{body}</{'b'}>"
        if label == 0 and self.r.random() < 0.25:
            body = f'<a href="/x">{html.escape(text, quote=False)}</a>'
        self.out.append(f"<{tag}{attrs}>{body}" + (f"</{tag}>" if self.r.random() < 0.95 or tag != "p" else ""))
        self.labels.append((text, label))

    def words(self, lo: int, hi: int) -> str:
        w = self.r.choice(self.other).split() or ["x"]
        at = self.r.randrange(len(w))
        return " ".join(w[at:at + self.r.randint(lo, hi)]) or w[0]

    def wrap(self, tag: str, attrs: str, fill) -> None:
        self.out.append(f"<{tag}{attrs}>")
        fill()
        self.out.append(f"</{tag}>")

    def menu(self) -> None:
        r = self.r
        tag, attrs = r.choice([("nav", ""), ("div", self.cls("menu nav navbar navigation")), ("ul", self.cls("menu nav links tabs")), ("header", "")])
        self.wrap(tag, attrs, lambda: [self.out.append("<ul>"), *[self.put("li", self.words(1, 3), 0) for _ in range(r.randint(2, 7))], self.out.append("</ul>")])

    def head(self) -> None:
        tag, attrs = self.r.choice([("header", ""), ("header", self.cls("header masthead")), ("div", self.cls("header masthead banner topbar"))])
        self.wrap(tag, attrs, lambda: [self.put(self.r.choice(["h1", "h2", "p", "div", "span"]), self.words(1, 8), 0) for _ in range(self.r.randint(1, 2))])

    def foot(self) -> None:
        tag, attrs = self.r.choice([("footer", ""), ("footer", ""), ("div", self.cls("footer copyright legal bottom"))])
        self.wrap(tag, attrs, lambda: [self.put(self.r.choice(["p", "div", "span"]), self.r.choice(["© ", ""]) + self.words(3, 25), 0) for _ in range(self.r.randint(1, 3))])

    def side(self) -> None:
        tag, attrs = self.r.choice([("aside", ""), ("aside", self.cls("sidebar related")), ("div", self.cls("sidebar widget related recommended popular")), ("section", self.cls("related sidebar popular"))])
        def fill():
            self.put(self.r.choice(["h2", "h3", "h4"]), self.words(1, 4), 0)
            for _ in range(self.r.randint(1, 4)):
                self.put(self.r.choice(["li", "p", "div"]), self.words(2, 30), 0)
        self.wrap(tag, attrs, fill)

    def ad(self) -> None:
        tag, attrs = self.r.choice([("div", self.cls("ad ads advert sponsored promo")), ("aside", self.cls("ad advert promo sponsor")), ("section", self.cls("advertisement ad"))])
        self.wrap(tag, attrs, lambda: self.put(self.r.choice(["p", "div", "span"]), self.words(3, 30), 0))

    def bare_ad(self) -> None:
        self.put("div", self.words(3, 30), 0, self.cls("ad ads advert sponsored promo"))

    def notice(self) -> None:
        tag, attrs = self.r.choice([("div", self.cls("cookie consent notice alert popup modal")), ("section", self.cls("cookie notice gdpr")), ("dialog", ""), ("div", ' role="alert"'), ("div", ' role="dialog"')])
        self.wrap(tag, attrs, lambda: self.put(self.r.choice(["p", "div", "span"]), self.words(4, 40), 0))

    def bare_notice(self) -> None:
        self.put(self.r.choice(["div", "p"]), self.words(4, 40), 0, self.cls("cookie consent notice alert"))

    def form(self) -> None:
        def fill():
            for _ in range(self.r.randint(1, 3)):
                self.put(self.r.choice(["p", "div", "legend", "button"]), self.words(1, 15), 0)
        self.wrap("form", self.r.choice(["", self.cls("login search subscribe newsletter contact")]), fill)

    def comments(self) -> None:
        tag, attrs = self.r.choice([("section", self.cls("comments discussion responses")), ("div", self.cls("comments disqus replies respond")), ("ol", self.cls("comments")), ("aside", self.cls("comments"))])
        def one():
            if self.r.random() < 0.5:
                self.put(self.r.choice(["h4", "div", "cite"]), self.words(1, 4), 0)
            self.put(self.r.choice(["p", "p", "div"]), self.r.choice(self.other) if self.r.random() < 0.5 else self.words(5, 60), 0)
        def fill():
            if self.r.random() < 0.7:
                self.put(self.r.choice(["h2", "h3"]), self.words(1, 4), 0)
            for _ in range(self.r.randint(1, 5)):
                kind = self.r.choice([None, "article", "div", "li"])
                self.wrap(kind, self.r.choice(["", self.cls("comment reply")]), one) if kind else one()
        self.wrap(tag, attrs, fill)

    def items(self) -> None:
        """Short blocks that belong to the article: list items, table cells, terms and what they mean, a caption."""
        r = self.r
        kind = r.choice(["list", "list", "table", "terms", "figure"])
        def short() -> str:
            return r.choice([str(r.randint(0, 2100)), f"{r.randint(1, 99)} {self.words(1, 2)}", self.words(1, 2), self.words(1, 4), self.words(2, 9)])
        if kind == "list":
            self.wrap(r.choice(["ul", "ul", "ol"]), "", lambda: [self.put("li", short(), 1) for _ in range(r.randint(2, 8))])
        elif kind == "table":
            def rows():
                if r.random() < 0.3:
                    self.put("caption", self.words(2, 8), 1)
                n = r.randint(2, 4)
                for i in range(r.randint(2, 5)):
                    self.wrap("tr", "", lambda i=i: [self.put("th" if i == 0 and r.random() < 0.8 else "td", short(), 1) for _ in range(n)])
            self.wrap("table", "", rows)
        elif kind == "terms":
            self.wrap("dl", "", lambda: [self.put(t, short(), 1) for _ in range(r.randint(1, 4)) for t in ("dt", "dd")])
        else:
            self.wrap("figure", "", lambda: (self.out.append('<img src="/x.png">'), self.put("figcaption", self.words(2, 12), 1)))

    def article(self) -> None:
        r = self.r
        tag, attrs = r.choice([("article", ""), ("article", ""), ("article", self.cls("post entry story")), ("main", ""), ("main", self.cls("content main")),
                               ("div", self.cls("content article post entry story body text main")), ("section", self.cls("content article post story"))])
        inside = [x for x in (self.ad, self.bare_ad, self.side, self.form, self.bare_notice) if r.random() < 0.15]
        def fill():
            if r.random() < 0.9:
                self.put(r.choice(["h1", "h1", "h2"]), " ".join(self.main[0].split()[:r.randint(2, 12)]), 1)
            spots = {r.randrange(1, len(self.main) + 1): f for f in inside}
            listed = r.choice([0, 0, 0.15, 0.4])
            for i, t in enumerate(self.main):
                if i in spots:
                    spots[i]()
                if r.random() < listed:
                    self.items()
                kind = r.random()
                if kind < 0.06 and len(t.split()) > 6:
                    self.put(r.choice(["h2", "h3"]), " ".join(t.split()[:5]), 1)
                if kind > 0.94:
                    self.wrap(r.choice(["blockquote", "ul", "div", "section", "figure"]), "", lambda t=t: self.put(r.choice(["p", "li", "figcaption"]), t, 1))
                else:
                    self.put(r.choice(["p"] * 9 + ["div", "pre"]), t, 1)
            if r.random() < 0.15:
                self.comments()
        self.wrap(tag, attrs, fill)

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        r = self.r
        some, more = r.choice([0, 0.3, 0.4, 0.5]), r.choice([0, 0.4, 0.5, 0.6])
        before = [f for f in (self.head, self.menu, self.notice, self.ad, self.bare_ad, self.form, self.bare_notice, self.side) if r.random() < some]
        after = [f for f in (self.side, self.comments, self.comments, self.ad, self.form, self.notice, self.menu, self.foot, self.foot) if r.random() < more]
        outer = r.choice([None, None, ("div", ' class="wrapper"'), ("div", ' id="page"'), ("main", "")])
        self.out.append("<html><head><title>x</title></head><body>")
        def fill():
            for f in before:
                f()
            self.article()
            for f in after:
                f()
        self.wrap(*outer, fill) if outer else fill()
        self.out.append("</body></html>")
        return "".join(self.out), self.labels


def training_pages(pages: DataFrame, sample: int = 150, layouts: int = 4) -> list[tuple[list[Leaf], list[int]]]:
    """Labelled pages; the sample is at most ``sample`` pages of at most 200 blocks of 400 characters."""
    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, texts in ta.sliced(batch, "html"):
            rows = []
            for t in texts:
                page = leaves(t.decode("utf-8", "replace"))
                if any(leaf.node.in_article for leaf in page) and t.lower().count(b"<article") == 1:
                    cut = page[:200] if len(page) <= 200 else page[:100] + page[-100:]
                    label = dict(zip(map(id, page), own_labels(page), strict=True))
                    rows.append(([label[id(x)] for x in cut], [x.text[:400] for x in cut], [i for x in cut for i in (len(x.features), *x.features)]))
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.string())), pa.array(c, pa.list_(pa.int32()))],
                                                 names=["labels", "texts", "features"])

    chosen = typed(pages, page_id="long", html="string").filter("html IS NOT NULL").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = arrow_map(chosen.select("html"), of, "labels array<int>, texts array<string>, features array<int>").collect()
    rows = sorted(rows, key=lambda r: r.texts)
    out = []
    mains = [[t for t, y in zip(r.texts, r.labels, strict=True) if y] for r in rows] or [_FALLBACK]
    for r in rows:
        page, at = [], 0
        for t in r.texts:
            n = r.features[at]
            page.append(Leaf(ROOT, t, 0, list(r.features[at + 1:at + 1 + n])))
            at += n + 1
        out.append((page, list(r.labels)))
    for k in range(max(len(rows), 30) * layouts):
        main = mains[k % len(mains)]
        other = mains[(k * 7 + 3) % len(mains)] or main
        text, marked = Layout(k, main[1:] or main, other).page()
        page = leaves(text)
        if [leaf.text for leaf in page] == [t for t, _ in marked]:  # else a layout's markup ran blocks together
            out.append((page, [y for _, y in marked]))
    return out


def train(pages: DataFrame, sample: int = 150, layouts: int = 4) -> crf.Chain:
    labelled = training_pages(pages, sample, layouts)
    x, lengths = matrix([p for p, _ in labelled])
    used = np.flatnonzero(x.any(axis=0))  # a feature that no training page has keeps a weight of 0
    chain = crf.fit(x[:, used], np.array([y for _, own in labelled for y in own]), lengths, epochs=80)
    w = np.zeros(DIMS)
    w[used] = chain.w
    return crf.Chain(w, chain.start, chain.step)


def main_texts(pages: list[str], chain: crf.Chain) -> list[str]:
    """The main text of each page."""
    split = [leaves(p) for p in pages]
    w = chain.w.astype(np.float32)
    x = np.array([w[leaf.features].sum() for p in split for leaf in p], dtype=np.float64).reshape(-1, 1)
    scored = crf.Chain(np.ones(1), chain.start, chain.step)  # the features' weights are summed already
    label = crf.viterbi(scored, x, np.array([len(p) for p in split], dtype=np.int64))
    out, at = [], 0
    for p in split:
        out.append("\n".join(leaf.text for leaf, y in zip(p, label[at:at + len(p)], strict=True) if y))
        at += len(p)
    return out


def extract(pages: DataFrame, chain: crf.Chain) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html)."""
    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, texts in ta.sliced(batch, "html"):
            part = batch.slice(rows.start, rows.stop - rows.start)
            out = main_texts([t.decode("utf-8", "replace") for t in texts], chain)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return arrow_map(typed(pages, page_id="long", url="string", html="string"), of, "page_id long, url string, text string, n_chars long")
