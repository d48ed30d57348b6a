"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of blocks, each with its word count, its link density and those of its neighbours. A decision
tree, trained at start-up on ``LABELLED``, tells main text from the rest. It asks counts and densities first; only where
these leave a mixed group does it also ask what the block lies in (``container``): an article or main element, an element
that says that it is something else (by its tag, class, id, role), or neither. That last question is needed because a
heading of one word and an advert of six have the same counts. The innermost telling element counts, but an article
inside a navigation or hidden element stays that; words of a wrapper's class or id (``has-sidebar``) do not hold for an
article or main element inside it.

Null html gives an empty text. White space (Unicode's, after character references are decoded) becomes one space
within a block; blocks without words vanish. Tags may be unclosed, attributes unquoted, comments cut off, elements nested
to any depth; the walk is linear in the page. Ties in the tree's training go to the earlier feature and the lower cut, so
every worker grows the same tree. Repeated rows come back as they are, an empty table gives no rows, and columns other
than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from html.entities import html5
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "container")
#: Features that the upper levels of the tree may ask, and how many levels these are.
COUNTS, COUNT_LEVELS = 6, 3
#: Labelled blocks, one group a kind: FEATURES and whether the block is main text. Container: 1 article, 0 neither, -1 something else.
LABELLED = {
    "menu entries": """1 1.0 0 0.0 1 1.0 -1 0 | 1 1.0 1 1.0 1 1.0 -1 0 | 2 1.0 1 1.0 2 1.0 -1 0 | 1 1.0 1 1.0 6 0.0 -1 0 | 3 1.0 2 1.0 9 0.0 -1 0
        1 1.0 1 1.0 1 1.0 0 0 | 2 1.0 2 1.0 3 1.0 0 0 | 3 1.0 2 1.0 60 0.0 0 0 | 1 1.0 0 0.0 2 1.0 0 0 | 2 1.0 1 1.0 1 1.0 1 0 | 1 1.0 1 1.0 2 1.0 1 0
        1 1.0 0 0.0 40 0.0 0 0 | 2 1.0 0 0.0 90 0.0 0 0 | 1 1.0 40 0.0 1 1.0 0 0 | 1 1.0 1 1.0 0 0.0 0 0 | 2 1.0 80 0.0 3 1.0 0 0 | 1 1.0 1 1.0 12 0.0 0 0 | 3 1.0 0 0.0 20 0.0 0 0""",
    "link lists beside the text": """8 0.9 5 1.0 6 1.0 0 0 | 9 1.0 8 1.0 7 1.0 0 0 | 20 0.9 10 0.8 12 0.9 0 0 | 6 1.0 4 1.0 7 1.0 -1 0 | 12 1.0 9 1.0 11 1.0 -1 0 | 17 0.6 8 1.0 9 1.0 0 0""",
    "adverts and notices": """4 0.0 1 1.0 12 0.0 -1 0 | 6 0.0 1 1.0 9 0.0 -1 0 | 8 0.0 2 1.0 14 0.0 -1 0 | 11 0.0 1 1.0 7 0.0 -1 0 | 17 0.1 3 1.0 8 0.0 -1 0 | 25 0.1 12 0.3 40 0.0 -1 0
        9 0.0 60 0.0 45 0.0 -1 0 | 30 0.1 2 1.0 11 0.0 -1 0 | 40 0.0 55 0.0 38 0.0 -1 0 | 7 0.6 30 0.0 40 0.0 0 0 | 40 0.7 30 0.0 50 0.0 0 0""",
    "footers": """9 0.0 120 0.0 0 0.0 -1 0 | 12 0.0 48 0.0 0 0.0 -1 0 | 18 0.0 75 0.0 0 0.0 -1 0 | 6 0.2 40 0.0 8 0.4 -1 0 | 3 1.0 9 0.0 3 1.0 -1 0
        5 0.0 50 0.0 0 0.0 0 0 | 4 0.0 3 1.0 2 1.0 0 0 | 3 0.0 4 0.0 2 0.0 0 0 | 2 0.0 0 0.0 5 1.0 0 0 | 9 0.0 5 0.0 3 0.0 0 0""",
    "sidebars and comments": """60 0.0 40 0.0 0 0.0 -1 0 | 90 0.0 80 0.0 70 0.0 -1 0 | 30 0.0 20 0.0 25 0.0 -1 0 | 120 0.0 60 0.0 60 0.0 -1 0 | 22 0.0 3 0.0 4 0.0 -1 0 | 3 0.0 22 0.0 18 0.0 -1 0
        55 0.0 4 1.0 12 0.0 -1 0 | 1 0.0 2 0.0 1 0.0 -1 0 | 200 0.0 150 0.0 140 0.0 -1 0 | 70 0.1 5 0.0 80 0.0 -1 0""",
    "paragraphs": """40 0.0 35 0.0 60 0.0 1 1 | 90 0.0 80 0.0 70 0.0 1 1 | 200 0.1 30 0.0 12 0.0 1 1 | 120 0.0 11 0.0 64 0.0 1 1 | 60 0.0 40 0.0 9 0.0 1 1 | 25 0.1 9 0.0 80 0.0 1 1
        30 0.0 60 0.0 22 0.0 1 1 | 150 0.0 140 0.0 17 0.0 1 1 | 35 0.4 40 0.0 35 0.0 1 1 | 22 0.0 3 0.0 4 0.0 1 1 | 55 0.0 4 1.0 12 0.0 1 1 | 18 0.0 120 0.0 0 0.0 1 1
        40 0.0 35 0.0 60 0.0 0 1 | 18 0.0 50 0.0 20 0.0 0 1 | 25 0.1 3 1.0 80 0.0 0 1 | 90 0.2 20 0.0 4 0.9 0 1 | 60 0.0 0 0.0 0 0.0 0 1 | 22 0.3 40 0.0 35 0.0 0 1
        33 0.0 2 1.0 2 1.0 0 1 | 40 0.0 1 1.0 40 0.0 0 1 | 75 0.0 60 0.0 5 0.0 0 1
        40 0.0 0 0.0 0 0.0 0 1 | 20 0.0 0 0.0 0 0.0 0 1 | 110 0.0 0 0.0 0 0.0 0 1 | 41 0.0 40 0.0 1 1.0 0 1 | 60 0.1 80 0.0 2 1.0 0 1 | 30 0.0 6 0.0 45 0.0 0 1 | 45 0.0 0 0.0 30 0.0 0 1 | 28 0.1 45 0.0 0 0.0 0 1""",
    "short paragraphs": """1 0.0 60 0.0 2 0.0 1 1 | 2 0.0 1 0.0 90 0.0 1 1 | 4 0.0 40 0.0 12 0.0 1 1 | 6 0.0 25 0.0 8 0.0 1 1 | 8 0.0 12 0.0 0 0.0 1 1 | 9 0.0 9 0.0 9 0.0 1 1 | 12 0.0 1 0.0 0 0.0 1 1
        1 0.0 2 0.0 1 0.0 1 1 | 5 0.0 50 0.0 0 0.0 1 1 | 3 0.0 22 0.0 18 0.0 1 1 | 11 0.0 30 0.0 9 0.0 1 1 | 3 0.0 30 0.0 25 0.0 0 1 | 8 0.0 20 0.0 18 0.0 0 1 | 1 0.0 90 0.0 60 0.0 0 1
        16 0.0 22 0.1 17 0.0 0 1 | 9 0.0 60 0.0 40 0.0 0 1 | 5 0.1 16 0.0 40 0.0 0 1""",
    "headings": """12 0.0 6 0.0 70 0.0 1 1 | 9 0.0 8 0.0 30 0.0 1 1 | 11 0.0 4 0.0 25 0.0 1 1 | 1 0.0 80 0.0 2 0.0 1 1 | 7 0.0 11 0.0 1 0.0 1 1 | 14 0.0 3 1.0 90 0.0 1 1 | 8 0.0 2 1.0 14 0.0 1 1
        6 0.0 2 1.0 70 0.0 0 1 | 11 0.0 0 0.0 55 0.0 0 1 | 2 0.0 45 0.0 30 0.0 0 1
        6 0.0 1 1.0 40 0.0 0 1 | 8 0.0 0 0.0 40 0.0 0 1 | 4 0.0 2 1.0 90 0.0 0 1 | 3 0.0 0 0.0 60 0.0 0 1 | 5 0.0 70 0.0 80 0.0 0 1""",
    "links in the text": """3 1.0 20 0.0 30 0.0 1 1 | 9 1.0 60 0.0 45 0.0 1 1 | 8 1.0 40 0.0 7 1.0 1 1 | 12 1.0 9 1.0 11 1.0 1 1 | 6 0.5 5 0.4 9 0.6 1 1 | 1 1.0 70 0.0 80 0.0 1 1 | 40 0.8 30 0.0 50 0.0 1 1 | 17 0.6 8 1.0 9 1.0 1 1""",
}
SKIPPED = frozenset("script style noscript template textarea select option button svg math iframe object canvas audio video head title datalist".split())
#: Elements that leave a head open; any other ends it, as text does.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
#: Of these, an unclosed one takes the rest of the page; the others' tags are passed over.
RAW_TO_THE_END = frozenset("script style textarea title".split())
#: Elements that hold no blocks: a block ends them where they were left open.
CONTROLS = ("select", "option", "button", "datalist")
FLOW = frozenset("address article aside blockquote div dl figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements that end one of their kind before them.
ENTRIES = frozenset("li dt dd tr td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr".split())
OTHER_TAGS = frozenset("nav header footer aside form menu dialog".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
OTHER_NAMES = frozenset(
    """nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side aside widget footer header masthead topbar
    ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
    alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment
    comments respond reply replies disqus pagination pager toolbar copyright legal disclaimer hidden""".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A character reference with its semicolon: a number, or a name.
_REFERENCE = re.compile(r"&(?:#(?:\d+|[xX][0-9a-fA-F]+)|([a-zA-Z][a-zA-Z0-9]*));")


def _tells(tag: str, attributes: str) -> int:
    """What an element says about its content: 1 article, -1 something else by its names, -2 by its tag, role or as it is hidden, 0 nothing."""
    if attributes.strip(" /\n\t"):
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
            return -2
        if tag not in ("html", "body", "main") and found.get("role", "").lower() in OTHER_ROLES:
            return -2
        named = tag not in ("html", "body", "main") and {w.lower() for w in _NAME.findall(found.get("class", "") + " " + found.get("id", ""))} & OTHER_NAMES
        if named:
            return -2 if tag in OTHER_TAGS else -1
        if found.get("role", "").lower() in ("main", "article"):
            return 1
    return -2 if tag in OTHER_TAGS else 1 if tag in ("article", "main") else 0


class Open(NamedTuple):
    """An open element, with what holds inside it: its container and whether that is final, whether nothing is read,
    whether text is a link, and where the innermost open element that is not inline stands."""

    tag: str
    container: int = 0
    firm: bool = False
    silent: int = 0
    link: bool = False
    block: int = -1


class Stack:
    """Open elements; where each tag stands is kept, so that an end tag finds its element without a search."""

    def __init__(self):
        self.items: list[Open] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.top = self.none = Open("")

    def push(self, tag: str, attributes: str) -> None:
        under, tells = self.top, _tells(tag, attributes)
        firm = under.firm or tells == -2
        container = (-1 if firm or tells < 0 else 1) if tells else under.container
        link = under.link or tag == "a" and "href" in attributes.lower()
        here = len(self.items)
        self.top = Open(tag, container, firm, under.silent + (tag in SKIPPED), link, under.block if tag in INLINE else here)
        self.items.append(self.top)
        self.at[tag].append(here)

    def close(self, k: int) -> None:
        """End the elements from place ``k`` on."""
        while len(self.items) > k:
            self.at[self.items.pop().tag].pop()
        self.top = self.items[-1] if self.items else self.none

    def end(self, tag: str) -> None:
        if self.at[tag]:
            self.close(self.at[tag][-1])

    def implied(self, tag: str) -> None:
        """End what the start of ``tag`` ends: a head, controls that hold no blocks, a paragraph, an entry of the same kind, a link."""
        if self.top.tag == "head" and tag not in IN_HEAD:
            self.close(len(self.items) - 1)
        if tag in FLOW and self.top.silent and (opened := [self.at[t][0] for t in CONTROLS if self.at[t]]):
            self.close(min(opened))
        if tag in ("article", "main") and self.at["nav"]:
            self.close(self.at["nav"][0])
        if tag == "a":
            self.end("a")
        if tag not in INLINE:
            for kind in ("p", tag if tag in ENTRIES else ""):
                if self.top.block >= 0 and self.items[self.top.block].tag == kind:
                    self.close(self.top.block)


def ended_references(text: str) -> str:
    """``text`` with those character references decoded that have their semicolon; of others every letter stays."""
    return _REFERENCE.sub(lambda m: html.unescape(m[0]) if m[1] is None or f"{m[1]};" in html5 else m[0], text)


def blocks(page: str, decode=html.unescape) -> list[tuple[str, int, int, int]]:
    """(text, words, words in links, container) of each block with words, in page order. decode: for character references."""
    out: list[tuple[str, int, int, int]] = []
    parts: list[tuple[str, bool]] = []
    stack = Stack()

    def flush() -> None:
        if parts and (words := "".join(p for p, _ in parts).split()):
            linked = len(" ".join(p for p, in_link in parts if in_link).split())
            out.append((" ".join(words), len(words), min(linked, len(words)), stack.top.container))
        parts.clear()

    at = 0
    while (m := _TOKEN.match(page, at)) and at < len(page):
        at = m.end()
        closing, tag, attributes, text = m.groups()
        if text is not None:
            text = decode(text)
            if stack.top.tag == "head" and text.strip():
                stack.close(len(stack.items) - 1)
            if not stack.top.silent:
                parts.append((text, stack.top.link))
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if closing:
            stack.end(tag)
            continue
        stack.implied(tag)
        if tag in VOID:
            if tag == "br":
                parts.append((" ", False))
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page) if tag in RAW_TO_THE_END else at
        else:
            stack.push(tag, attributes)
    flush()
    return out


class Tree:
    """A decision tree by Gini impurity, in flat arrays; its upper ``levels`` ask the first ``narrow`` features only."""

    def __init__(self, x: np.ndarray, y: np.ndarray, narrow: int = COUNTS, levels: int = COUNT_LEVELS, depth: int = 8):
        nodes: list[list[float]] = []
        todo = [(x, y, 0, None, 0)]
        while todo:
            x, y, level, parent, side = todo.pop()
            here = len(nodes)
            nodes.append([-1, 0.0, here, here, float(y.mean() >= 0.5)])
            if parent is not None:
                nodes[parent][2 + side] = here
            best = None
            for j in range(x.shape[1] if level >= levels else narrow) if level < depth and 0 < y.mean() < 1 else ():
                values = np.unique(x[:, j])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[:, j] <= cut
                    p, q = y[low].mean(), y[~low].mean()
                    impure = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
                    if best is None or impure < best[0] - 1e-12:
                        best = (impure, j, cut, low)
            if best:
                _, nodes[here][0], nodes[here][1], low = best
                todo += [(x[low], y[low], level + 1, here, 0), (x[~low], y[~low], level + 1, here, 1)]
        f, t, left, right, v = (np.array(c) for c in zip(*nodes, strict=True))
        self.feature, self.threshold, self.left, self.right, self.value, self.depth = f.astype(int), t, left.astype(int), right.astype(int), v > 0, depth

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        for _ in range(self.depth + 1):
            f = self.feature[node]
            low = x[np.arange(len(x)), np.maximum(f, 0)] <= self.threshold[node]
            node = np.where(f < 0, node, np.where(low, self.left[node], self.right[node]))
        return self.value[node]


def labelled() -> tuple[np.ndarray, np.ndarray]:
    rows = [r.split() for group in LABELLED.values() for r in group.replace("\n", "|").split("|") if r.strip()]
    table = np.array(rows, float)
    return table[:, :-1], table[:, -1]


def train() -> Tree:
    return Tree(*labelled())


def features(found: list[tuple[str, int, int, int]]) -> np.ndarray:
    words = np.array([w for _, w, _, _ in found], float)
    density = np.array([n for _, _, n, _ in found]) / np.maximum(words, 1)
    around = lambda a: (np.concatenate([[0], a[:-1]]), np.concatenate([a[1:], [0]]))
    (w0, w1), (d0, d1) = around(words), around(density)
    return np.stack([words, density, w0, d0, w1, d1, np.array([c for *_, c in found], float)], 1)


def extract(page: str | None, tree: Tree, decode=html.unescape) -> str:
    """The main text of one page."""
    found = blocks(page or "", decode)
    return "\n".join(b[0] for b, kept in zip(found, tree(features(found)), strict=True) if kept) if found else ""


def main_text(pages: DataFrame, decode=html.unescape) -> DataFrame:
    """(page_id, url, text, n_chars) of every page of ``pages`` (page_id, url, html). No shuffle.

    decode: for character references. As HTML has it, some names need no semicolon (a heading cut to ``R&amp`` is "R&");
    ``ended_references`` asks for one always.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = train()
        for b in batches:
            texts = [extract(h, tree, decode) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
