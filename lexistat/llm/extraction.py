"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks. A linear classifier over a block's place and words gives its cost of being
content or boilerplate; these costs are the capacities to the two terminals. Neighbouring blocks and blocks of
one parent are joined by smoothness edges, weaker the further apart they are in the tree and across the border of
a marked region. The side of the source after a maximum flow is the content.
"""

from __future__ import annotations

import re
from collections import deque
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistat.llm.frames import col

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object canvas select option button "
                   "textarea datalist audio video map".split())
APART = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
#: Words in class, id and role that mark a region as boilerplate, or as content.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay dialog menu nav navbar navigation navigate breadcrumb "
    "breadcrumbs pagination pager footer foot header masthead topbar toolbar sidebar side aside widget widgets related "
    "recommended recommendations trending popular share sharing social follow newsletter subscribe subscription signup "
    "login register search form comment comments reply replies respond discussion disqus feedback copyright legal "
    "disclaimer contentinfo complementary skip hidden".split())
BAD_IN_MAIN = frozenset("ad ads advert comment comments related reply replies sponsored".split())
GOOD_WORDS = frozenset("article content post entry story main body text prose maincontent articlebody".split())
#: Good words that never cancel a bad one, on the same element or around it.
WEAK_WORDS = frozenset("body text content".split())
#: A name with one of these tells what a region has beside it, not what it is.
STATES = frozenset("has with without no".split())
#: The head of a text is part of it (entry-header).
TITLES = frozenset("header head".split())
IN_HEAD = frozenset("title base link meta style script noscript template basefont bgsound noframes".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                   "h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("ul ol dl table article section div main aside nav body".split())
SPLIT_NAME = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def marks(names: list[set[str]], bad_words: frozenset[str]) -> tuple[bool, set[str]]:
    """(marked as boilerplate, words that mark content) from the words of each class, id and role."""
    bad, good = False, set()
    for words in names:
        found, strong = words & bad_words, words & GOOD_WORDS - WEAK_WORDS
        if found and words & STATES:
            continue
        if found and not (found <= TITLES and strong):
            bad = True
        else:
            good |= words & GOOD_WORDS
    return bad and good <= WEAK_WORDS, good


class Node:
    """An open element: the region it belongs to and what its marks say."""

    __slots__ = ("tag", "depth", "silent", "bad", "good", "wraps", "region", "parent")

    def __init__(self, tag: str, attrs: list, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.silent = tag in SILENT or bool(parent and parent.silent)
        self.bad, self.good = (parent.bad, parent.good) if parent else (0, 0)
        self.wraps = bool(parent and parent.wraps)  # marked as boilerplate by forms only, which may hold whole pages
        self.region = parent.region if parent else self
        names: list[set[str]] = []
        for name, value in attrs:
            if name in ("class", "id", "role"):
                names += [{w.lower() for w in SPLIT_NAME.split(x)} for x in (value or "").split()]
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(
                    r"display\s*:\s*none|visibility\s*:\s*hidden", value or ""):
                self.silent = True
        bad, good = marks(names, BAD_IN_MAIN if tag in MAIN else BAD_WORDS) if tag != "body" else (False, set())
        # The nearest marked region decides: what lies around a bad region does not count for it.
        if tag in APART or tag == "header" and not self.good or bad:
            self.wraps = tag == "form" and not bad and (not self.bad or self.wraps)
            self.bad, self.good, self.region = self.bad + 1, 0, self
        elif tag in MAIN or good and not (self.bad and good <= (WEAK_WORDS - {"content"} if self.wraps else WEAK_WORDS)):
            if tag == "main" or self.wraps:
                self.bad, self.wraps = 0, False
            self.good, self.region = self.good + 1, self


class Blocks(HTMLParser):
    """The text blocks of a page, in order: (text, characters in links, node that holds the block)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Node] = [Node("html", [], None)]
        self.parts: list[str] = []
        self.links, self.linked, self.found = 0, 0, []

    def finish(self) -> None:
        super().close()
        self.flush()

    def holder(self) -> Node:
        at = len(self.open) - 1
        while at and self.open[at].tag in INLINE:
            at -= 1
        return self.open[at]

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((text, self.linked, self.place))
        self.parts, self.linked = [], 0

    def end_head(self) -> None:
        """End a head whose end tag is left out."""
        if self.open[-1].tag == "head":
            self.end("head")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self.end_head()
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag == "html":
            return
        if tag not in INLINE:
            self.flush()
            self.imply(tag)
        self.links += tag == "a"
        self.open.append(Node(tag, attrs, self.open[-1]))

    def imply(self, tag: str) -> None:
        """End elements that the start of `tag` ends without an end tag."""
        if tag in ("body", "article", "main") and any(n.tag == "head" for n in self.open):
            self.end("head")
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at].tag
            if name in ends:
                del self.open[at:]
                self.links = sum(n.tag == "a" for n in self.open)
                if tag not in CLOSES:
                    return
            elif name in SCOPES:
                return

    def end(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                self.links = sum(n.tag == "a" for n in self.open)
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
        elif not any(n.tag == tag for n in self.open):
            return
        self.end(tag)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.end_head()
        if self.open[-1].silent:
            return
        self.place = self.holder()
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def score(text: str, linked: int, node: Node) -> int:
    """Above 0: content; below 0: boilerplate. Marked regions weigh most, then links, length and sentences."""
    words = text.count(" ") + 1
    value = -60 * min(node.bad, 2) + 30 * min(node.good, 1 if node.bad else 2)
    value += {"p": 8, "pre": 6, "blockquote": 8, "h1": 6, "h2": 4, "h3": 4, "li": -2, "td": 0}.get(node.tag, 0)
    value -= 24 * linked // max(len(text), 1)
    value += min(words, 40) // 4 - 4
    value += 3 * min(len(re.findall(r"[.!?…](?:\s|$)", text)), 3)
    if re.match(r"(©|\(c\)|copyright\b|all rights reserved)", text, re.I):
        value -= 30
    return value


class Flow:
    """Maximum flow by shortest augmenting levels over a small graph with whole capacities."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to, self.left = [], []

    def join(self, a: int, b: int, there: int, back: int) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)

    def levels(self, source: int) -> list[int]:
        level, queue = [-1] * len(self.edges), deque([source])
        level[source] = 0
        while queue:
            x = queue.popleft()
            for e in self.edges[x]:
                if self.left[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def run(self, source: int, sink: int) -> list[bool]:
        """Push all flow there is; which nodes the source still reaches."""
        while True:
            level = self.levels(source)
            if level[sink] < 0:
                return [x >= 0 for x in level]
            at, path = [0] * len(self.edges), []
            x = source
            while True:
                if x == sink:
                    pushed = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= pushed
                        self.left[e ^ 1] += pushed
                    path, x = [], source
                    continue
                edges = self.edges[x]
                while at[x] < len(edges):
                    e = edges[at[x]]
                    if self.left[e] and level[self.to[e]] == level[x] + 1:
                        break
                    at[x] += 1
                if at[x] < len(edges):
                    path.append(edges[at[x]])
                    x = self.to[path[-1]]
                elif path:
                    e = path.pop()
                    x = self.to[e ^ 1]
                    at[x] += 1
                else:
                    break


def tree_distance(a: Node, b: Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness(a: Node, b: Node) -> int:
    """The price of parting two blocks: high for siblings, low across the border of a marked region."""
    return 1 if a.region is not b.region else max(2, 8 - tree_distance(a, b))


def main_text(html: str | None) -> str:
    """The content blocks of a page in order, joined by one space; empty for a null, empty or bare page."""
    parser = Blocks()
    parser.feed(html or "")
    parser.finish()
    blocks = parser.found
    if not blocks:
        return ""
    n = len(blocks)
    flow, last_of = Flow(n + 2), {}
    for i, (text, linked, node) in enumerate(blocks):
        value = score(text, linked, node)
        flow.join(n, i, max(value, 0), 0)
        flow.join(i, n + 1, max(-value, 0), 0)
        if i:
            price = smoothness(blocks[i - 1][2], node)
            flow.join(i - 1, i, price, price)
        sibling = last_of.get(id(node.parent))
        if sibling is not None and sibling < i - 1:
            flow.join(sibling, i, 2, 2)
        last_of[id(node.parent)] = i
    kept = flow.run(n, n + 1)
    return " ".join(text for i, (text, _, _) in enumerate(blocks) if kept[i])


def extract(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(x) for x in pages.to_pylist()], pa.string())


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row; repeated rows each keep theirs."""
    made = pages.select("page_id", "url", F.arrow_udf(extract, "string")(col(html)).alias("text"))
    return made.withColumn("n_chars", F.length("text").cast("bigint"))
