"""Main text of web pages: flat text blocks, shallow features, a decision tree.

A page is cut into flat blocks at block-level tags. Each block is described by its word count and
link density, those of the blocks before and after it, and what its elements say (article, page
furniture, heading). A small decision tree, grown once per job on the labelled blocks below, tells
content from furniture. Class names are no features: an element whose class, id or role names it a
comment, advert, notice or other furniture is taken out as declared, as are hidden elements and
sections under a heading that reads "Comments"; the tree judges what declares nothing. Pages are
independent rows: nothing is shuffled. Reading a page takes time linear in its length.

Defined results: a null or empty page has an empty text; an unclosed tag or comment ends with the
page; after the first attribute quote that hides the rest of the page, quotes no longer protect a
">"; a page without content blocks has an empty text; rows are judged one by one, so null or
repeated page ids change nothing; an empty table gives an empty result; further columns pass
through ``extract``, and one named like a result column is replaced.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetlens.llm import textkit as K

# HTML element names by their part in the layout.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span"
    " strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea select svg iframe object canvas title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav header footer aside form dialog button menu".split())
CONTENT_TAGS = frozenset({"article", "main"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
# Elements that end where one of these begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
            "th": {"td", "th", "tr"}, "option": {"option"}}
# Parts of class, id and role names that declare furniture, and parts that say nothing.
FURNITURE_PARTS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies"
    " consent gdpr notice notices alert popup modal comment comments commentlist reply replies discussion disqus sidebar"
    " menu navbar navigation nav breadcrumb breadcrumbs footer share sharing social related recommended newsletter"
    " subscribe login signup search toolbar pagination pager".split())
TITLE_PARTS = frozenset("header masthead topbar".split())  # furniture outside the article
NEUTRAL_PARTS = frozenset(
    "area article bar block body bottom box btn button buttons container content div entry form google group header holder"
    " icons inner item items left link links list main outer page panel post reader right section site slot sticky story"
    " text thread title top unit user widget wrap wrapper".split())
# Headings that open a section of reader comments.
COMMENT_HEADING = re.compile(
    r"(?i)(\d+ )?(reader |user )?(comments?|responses|replies|leave a (comment|reply)|kommentare|commentaires|comentarios)"
    r"( \(?\d+\)?)?:?")

_TAG = re.compile(r"<[a-zA-Z/!?]")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRS = re.compile(r"((?>[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>")
_VALUE = re.compile(r"(?i)(?<![^\s\"'/])(class|id|role|style|data-label|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)")
_RAW_END = {name: re.compile(rf"(?i)</{name}\b[^>]*>") for name in RAW}


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    words: int = 0
    link_words: int = 0
    article: bool = False
    furniture_tag: bool = False
    heading: bool = False
    declared: bool = False  # taken out as declared furniture, but still a neighbour
    label: int | None = None

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


@dataclass
class Open:
    """An open block-level element and what it says of the blocks inside."""

    name: str
    article: bool = False
    furniture_tag: bool = False
    declared: bool = False
    hidden: bool = False
    label: int | None = None


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _VALUE.finditer(raw)} if raw else {}


def declares_furniture(said: dict[str, str], in_article: bool) -> bool:
    """Whether a class, id or role consists of furniture parts and parts that say nothing."""
    if not said:
        return False
    for name in f"{said.get('class', '')} {said.get('id', '')} {said.get('role', '')}".lower().split():
        parts = [p for p in re.split(r"[-_\d]+", name) if p]
        named = any(p in FURNITURE_PARTS for p in parts) or (not in_article and any(p in TITLE_PARTS for p in parts))
        if named and all(p in FURNITURE_PARTS or p in TITLE_PARTS or p in NEUTRAL_PARTS for p in parts):
            return True
    return False


def is_hidden(said: dict[str, str]) -> bool:
    return "hidden" in said or "display:none" in said.get("style", "").lower().replace(" ", "")


class _Reader:
    """Blocks in page order; counts of open elements make each step independent of the depth."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.open: list[Open] = []
        self.labels: list[int] = []
        self.count = {"article": 0, "furniture_tag": 0, "declared": 0, "hidden": 0}
        self.names: dict[str, int] = {}
        self.block = Block()
        self.muted: list[str] = []  # inline elements whose text is left out
        self.links = self.level = 0  # level of the open heading
        self.comments: tuple[int, int] | None = None  # level and depth of a section of comments

    def text(self, raw: str) -> None:
        if self.muted:
            return
        text = html.unescape(raw)
        n = len(text.split())
        self.block.parts.append(text)
        self.block.words += n
        self.block.link_words += n if self.links else 0

    def close(self) -> None:
        """End of the block."""
        self.links = 0
        if not self.block.parts:
            return
        block, self.block = self.block, Block()
        if not block.words or self.count["hidden"]:
            return
        if self.level:
            block.heading = True
            if self.comments and self.level <= self.comments[0]:
                self.comments = None
            if not self.comments and COMMENT_HEADING.fullmatch(block.text):
                self.comments = (self.level, len(self.open) - 1)  # the heading itself is open
        block.article = self.count["article"] > 0
        block.furniture_tag = self.count["furniture_tag"] > 0
        block.declared = self.count["declared"] > 0 or self.comments is not None
        block.label = self.labels[-1] if self.labels else None
        self.out.append(block)

    def push(self, name: str, said: dict[str, str]) -> None:
        inside = self.count["article"] > 0
        role = said.get("role", "").lower()
        new = Open(name, article=name in CONTENT_TAGS or role in CONTENT_TAGS,
                   # a header inside an article holds the article's own title
                   furniture_tag=name in FURNITURE_TAGS and not (name == "header" and inside),
                   declared=name not in ("html", "body", "main") and declares_furniture(said, inside), hidden=is_hidden(said),
                   label=int(said["data-label"]) if said.get("data-label", "").isdigit() else None)
        self.open.append(new)
        self.names[name] = self.names.get(name, 0) + 1
        if said or new.article or new.furniture_tag:
            for key in self.count:
                self.count[key] += getattr(new, key)
        if new.label is not None:
            self.labels.append(new.label)

    def pop(self) -> str:
        old = self.open.pop()
        self.names[old.name] -= 1
        if old.article or old.furniture_tag or old.declared or old.hidden:
            for key in self.count:
                self.count[key] -= getattr(old, key)
        if old.label is not None:
            self.labels.pop()
        if self.comments and len(self.open) < self.comments[1]:
            self.comments = None
        return old.name

    def begin(self, name: str, attrs: str) -> None:
        said = attributes(attrs)
        if name in INLINE:
            if name in ("br", "wbr", "img"):
                self.block.parts.append(" " if name != "wbr" else "")
            elif self.muted:
                if name == self.muted[0]:
                    self.muted.append(name)
            elif is_hidden(said) or declares_furniture(said, self.count["article"] > 0):
                self.muted.append(name)
            elif name == "a":
                self.links = 1
            return
        self.close()
        if self.open and (self.open[-1].name == "p" or name in ENDED_BY.get(self.open[-1].name, ())):
            last = self.pop()
            if last in ("td", "th") and name == "tr" and self.open and self.open[-1].name == "tr":
                self.pop()
        if name in HEADINGS:
            self.level = int(name[1])
        if name not in VOID and not (attrs.endswith("/") and name not in ("p", "div")):
            self.push(name, said)

    def end(self, name: str) -> None:
        if name in INLINE:
            if self.muted:
                if name == self.muted[-1]:
                    self.muted.pop()
            elif name == "a":
                self.links = 0
            return
        self.close()
        if name in HEADINGS:
            self.level = 0
        if self.names.get(name):
            self.muted.clear()
            while self.pop() != name:
                pass


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order, without empty ones."""
    reader, at, last, quotes = _Reader(), 0, page.rfind(">"), True
    while at < len(page):
        found = _TAG.search(page, at)  # other "<" are text
        if not found:
            reader.text(page[at:])
            break
        lt = found.start()
        named = _NAME.match(page, lt)
        if lt > at:
            reader.text(page[at:lt])
        if page.startswith("<!--", lt):
            found = page.find("-->", lt + 4)
            at = found + 3 if found >= 0 else len(page)
            continue
        if lt > last:  # a tag that the page doesn't close
            break
        if not named:
            at = page.find(">", lt) + 1
            continue
        found = _ATTRS.match(page, named.end()) if quotes else None
        if found:
            attrs, at = found[1], found.end()
        else:
            quotes, at = False, page.find(">", named.end()) + 1
            attrs = page[named.end() : at - 1]
        name = named[2].lower()
        if name in RAW and not named[1]:
            if not attrs.endswith("/"):
                found = _RAW_END[name].search(page, at)
                at = found.end() if found else len(page)
            if name in ("svg", "iframe", "object", "canvas"):
                reader.block.parts.append(" ")
        elif name not in RAW:
            reader.end(name) if named[1] else reader.begin(name, attrs)
    reader.close()
    return reader.out


FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "article", "furniture_tag", "heading"]


def features(found: list[Block]) -> np.ndarray:
    """One row per block, in the order of FEATURES. A missing neighbour counts as 0; article is 1
    inside an article element, -1 outside on a page that has one, 0 on a page without."""
    words = np.array([0.0, *(b.words for b in found), 0.0])
    density = np.array([0.0, *(b.link_words / b.words for b in found), 0.0])
    outside = -1 if any(b.article and not b.declared for b in found) else 0
    flags = [[1 if b.article else outside, b.furniture_tag, b.heading] for b in found]
    shallow = [words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:]]
    return np.column_stack([*shallow, np.array(flags, float).reshape(len(found), 3)])


# The labelled table: blocks of these pages, content (1) or furniture (0) by data-label.
LABELLED_PAGES = [
    """<body><nav data-label=0><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport today</a></li></ul></nav>
    <div class=ad data-label=0>Buy two pairs of shoes now and get the third one for free in all our shops.</div>
    <article data-label=1><h1>Rain expected in the north</h1><p>The weather office expects rain in the north for the whole week.</p>
    <p>Farmers say that the <a href=/w>water</a> comes late but is welcome all the same.</p><p>More soon.</p></article>
    <footer data-label=0>&copy; 2020 The Daily Page. All rights reserved by the publisher.</footer></body>""",
    """<body><header data-label=0><p>The Evening Post, your paper since 1901</p><a href=/login>Log in</a></header>
    <main data-label=1><h2>Council votes on bridge</h2><p>The council voted for the new bridge on Monday night after a long debate.</p>
    <ul><li>Seven members were for it</li><li>Two were against it</li></ul><blockquote>We need this bridge.</blockquote>
    <section class=comments data-label=0><h3>Comments</h3><p>I don't think that we need a bridge at all, what a waste of money it is.</p></section></main>
    <aside data-label=0><p>Most read stories of the week are collected here for you.</p><a href=/1>Storm over the bay</a></aside></body>""",
    """<body><div id=menu data-label=0><a href=/>Start</a> <a href=/a>About us</a> <a href=/c>Contact</a></div>
    <div data-label=1><p>She opened the door and looked into the garden, where nobody had been for years, and saw the old tree.</p>
    <p>It had grown over the wall, and its branches reached into the street where the children played.</p>
    <p>Nobody had told her about it, neither her mother nor the neighbours who came by every Sunday afternoon.</p></div>
    <div class=cookie-notice data-label=0><p>We use cookies to give you the best experience on our pages and in our shop.</p></div>
    <form data-label=0><p>Sign up for our letter and read the news before all others do.</p></form></body>""",
    """<body><div data-label=0><a href=/x>Five easy recipes</a></div><div data-label=0><a href=/y>Ten cheap hotels by the sea</a></div>
    <div data-label=1><p>The recipe needs two eggs, a cup of flour and some patience, as my grandmother used to say in her kitchen.</p>
    <p>Beat the eggs first and add the flour slowly while the milk warms on the stove beside you.</p></div>
    <div data-label=0><a href=/z>Read on: what to do with old bread</a></div><div data-label=0>Share</div></body>""",
    """<body><article data-label=1><header><h1>A short note</h1></header><p>Done.</p><p>The work took three weeks.</p><p><a href=/plan>See the whole plan of the house</a></p>
    <p><a href=/team>The team</a></p><h2><a href=#costs>Costs</a></h2><p>Nobody knows.</p>
    <div class=related data-label=0><p>More notes of this kind that you may like to read as well</p></div>
    <table><tr><td>Weeks</td><td>Three</td></tr></table></article><div class=sidebar data-label=0><p>About the author of these notes, who lives by the sea and writes.</p></div>
    <div id=comments data-label=0><p>Great note, thank you so much for writing it down for all of us!</p><p>Agreed.</p></div></body>""",
]


# Labelled blocks of pages that declare nothing, in page order: + content or - furniture, a in an article,
# n in a furniture element, h heading, words/words in links. Menus and teasers are runs of links; short plain lines belong to what is
# beside them; prose is content whatever stands next to it.
LABELLED_SHAPES = """
-1/1 -2/2 -1/1 -3/3 +h6/0 +45/0 +61/3 +38/0 +2/0 +52/6 -3/3 -2/2 -4/4 -5/0
-1/1 -1/1 -2/2 -2/2 -9/0 -1/1 +h4/0 +28/2 +33/0 +h3/0 +47/0 +19/0 -2/2 -6/6 -7/7 -8/0
-4/4 -3/3 +h9/0 +12/0 +80/4 +95/10 +3/0 +70/0 -5/5 -6/6 -4/4 -3/0 -2/2
+h5/0 +24/0 +31/0 +8/0 +26/1 +5/0 +44/0
+h3/0 +4/0 +2/0 +6/0 +3/0 +5/0
+2/0
+7/0 +5/0
+14/0
+30/0
+22/3
+90/0 +110/12 +75/0
+h8/0 +6/0 +9/0 +4/0 +7/0 +3/0 +8/0 +5/0
-2/2 -2/2 -3/3 +41/0 +16/0 +11/0 +9/0 +4/0 +22/0 -3/3 -2/2 -1/1
-6/6 -5/5 -8/8 -h2/0 -7/7 -6/6 -9/9 -h3/0 -4/4 -5/5 -8/8
-3/3 -h2/0 -5/5 -4/4 -7/7 -6/0 -2/2 -1/1
-1/1 -4/4 -2/0 -3/3 -12/9 -14/11 +55/0 +60/2 -18/15 -22/18 -3/3
-2/2 -8/0 -3/3 +h7/0 +36/0 +29/5 +40/9 +25/0 -11/11 -9/9 -12/12 -7/0
-3/2 -4/3 -5/4 +h5/0 +50/0 +10/0 +48/0 -7/6 -8/7 -6/5 -4/0
-25/22 -30/24 +64/4 +58/0 -40/33 -28/25
-1/1 -1/1 +17/0 +13/0 +15/0 +18/2 -1/1 -2/2
-5/5 +h4/0 +20/0 +6/0 +21/0 +3/0 +27/0 -5/5 -5/0 -6/6
-2/2 -3/3 -2/2 -2/0 -2/2 -3/0 -2/2 +h6/0 +34/0 +37/0 -2/2 -7/0 -2/2
+h4/0 +18/4 +26/7 +31/9 +24/0 +35/11
+46/0 -6/6 -5/5 -7/7
+39/0 +42/0 -8/8 +51/0 +35/0 -6/6 +47/2 +20/0
+66/0 -7/6 -9/8 -2/0
-4/4 -4/4 -4/4 -4/4
-1/1
-6/6
-9/8
-15/12 -13/10 -16/14
-2/2 -3/3 -8/0 -2/2 +h5/0 +11/0 +13/0 +9/0 +14/0 -3/3 -3/3 -9/0
-1/1 -6/0 -1/1 +h3/0 +23/0 +7/0 +1/0 +4/0 +30/0 -1/1 -4/0 -2/2
+h2/0 +120/3 +h2/0 +140/0 +h4/0 +7/0 +9/0 +6/0 +130/8 +h2/0 +85/0
-3/3 +200/0 -3/3
-2/2 +30/0 -4/4 -2/2
-1/1 -5/5 +22/0 -3/3
-6/6 +64/2 -5/5 -6/6
-3/3 +16/0 -2/2 -3/3 +48/1 -7/7
-4/4 +90/0 -1/1 +27/0 -2/2 +19/0 -5/5
-2/2 +13/0 -3/3 +120/4 -2/2
-n2/2 -n3/3 +ah4/0 +a3/0 +a2/0 -n6/0
-n1/1 -n1/1 +ah2/0 +a1/0 +a5/5 +a8/0 +a2/2 -n3/3 -n4/0
-4/4 -5/5 +ah3/0 +a6/0 +a4/4 +a3/3 +a7/0 -2/2 -9/0
-3/3 +a5/0 +a9/0 -2/2 -6/6
-2/2 +ah1/0 +a2/0 -3/3
-n5/5 -n2/0 +a3/0 +ah4/0 +a6/0 +a4/4 +a5/5 +a6/6 +a12/0 -n14/0 -n22/0
-1/1 -9/0 +ah7/0 +a30/0 +a4/0 +a18/15 +a2/0 -25/0 -6/6
-12/0 +a40/0 +a33/0 -31/0
-n3/3 -17/0 +ah5/0 +a52/0 +a6/0 -n40/0 -n8/0
-n8/0 +h5/0 +33/0 +28/0 -n19/0 -n24/0 -n11/4
-2/2 -5/5 +21/1 +16/0 +18/0 -4/4 -6/6
+12/0 +9/0 +10/0 +15/0 +11/0 +8/0
-5/5 -6/6 -3/3 +h10/0 +40/0 +12/0 +32/6 +8/0 +28/0 +h6/0 +33/0 -9/9 -10/10 -8/8 -6/0
-7/7 -6/6 -h3/0 -8/8 -9/9 +h5/0 +44/0 +38/3 +20/0 -h3/0 -6/6 -7/7
"""


def shaped_blocks(page: str) -> list[Block]:
    found = (re.fullmatch(r"([+-])([anh]*)(\d+)/(\d+)", b) for b in page.split())
    return [Block(words=int(m[3]), link_words=int(m[4]), article="a" in m[2], furniture_tag="n" in m[2], heading="h" in m[2],
                  label=int(m[1] == "+")) for m in found]


@dataclass
class Tree:
    """A binary decision tree: a leaf holds a label, a node asks feature <= cut."""

    label: int = 0
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.label)
        go = x[:, self.feature] <= self.cut
        out = np.empty(len(x), int)
        out[go], out[~go] = self.low.predict(x[go]), self.high.predict(x[~go])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 2) -> Tree:
    """CART: the cut with the smallest Gini impurity, until leaves are pure, small or deep enough."""
    leaf = Tree(label=int(2 * y.sum() >= len(y)))
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return leaf
    best = (len(y) * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            go = x[:, f] <= cut
            n = int(go.sum())
            if least <= n <= len(y) - least:
                p, q = y[go].mean(), y[~go].mean()
                best = min(best, (n * p * (1 - p) + (len(y) - n) * q * (1 - q), f, float(cut)))
    if best[1] < 0:
        return leaf
    go = x[:, best[1]] <= best[2]
    return Tree(feature=best[1], cut=best[2], low=grow(x[go], y[go], depth - 1, least), high=grow(x[~go], y[~go], depth - 1, least))


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled blocks that declare nothing."""
    pages = [*map(blocks, LABELLED_PAGES), *map(shaped_blocks, LABELLED_SHAPES.strip().splitlines())]
    open_ = np.array([not b.declared for found in pages for b in found])
    x, y = np.concatenate([features(found) for found in pages]), np.array([b.label for found in pages for b in found])
    return x[open_], y[open_]


def trained_tree() -> Tree:
    return grow(*labelled())


def main_text(page: str | None, tree: Tree) -> tuple[str, int, int]:
    """Text, number of blocks, number of content blocks."""
    found = blocks(page or "")
    if not found:
        return "", 0, 0
    kept = [b.text for b, good in zip(found, tree.predict(features(found))) if good and not b.declared]
    return "\n".join(kept), len(found), len(kept)


MADE = ["text", "n_chars", "n_blocks", "n_content_blocks"]


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all but the html by default) with text, n_chars (code points) and
    block counts."""
    K.ship(pages.sparkSession)
    own = [c for c in (keep if keep is not None else pages.columns) if c != html_col and c not in MADE]
    tree = trained_tree()
    long_ = T.LongType()
    schema = T.StructType([*(pages.schema[c] for c in own), T.StructField("text", T.StringType()),
                           *(T.StructField(c, long_) for c in MADE[1:])])

    def task(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [main_text(p.as_py(), tree) for p in part.column(html_col)]
                cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *cols], names=[*own, *MADE])

    return pages.select(*K.named([*own, html_col])).mapInArrow(task, schema)
