"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks at block-level tags. A classifier's odds for content become capacities to the source and the sink;
blocks next to each other in the page, and siblings in the DOM, are joined by smoothness edges that weaken with DOM distance.
The minimum cut, found by max-flow, separates content from boilerplate.

The costs are set by hand, since the pages carry no labels. They follow an order: a boilerplate element outweighs whatever else a
block can have, at any length. Where articles hold a quarter of the other words or more, being inside or outside one decides next (a
``main`` around them adds only its ``h1``); else being inside ``main`` does. Length, tags of text and the share of link text decide
among blocks that none of these settles, and smoothness only where these are close. ``article`` and ``main`` keep their role whatever
their class is named; other elements are boilerplate by tag, by ARIA role, or by a word of their class or id. A header inside an
article is the article's own. ``html`` and ``body`` have no role. An element that is boilerplate by a class name only, but holds an
article, ``main`` or ``h1`` and over half of the words that are left then, is layout and has no role. Buttons and labels are left out of the
text around them. What a style sheet or ``hidden`` would not show is text like any other.

Edge cases: null or empty html gives an empty text; unclosed and truncated markup is read as far as it goes, at any depth, in time
linear in the page; a ``>`` inside a quoted attribute ends no tag; character references are decoded after the markup is gone; a page
of any length is read whole; ties (a cut of equal cost) count as boilerplate; repeated rows give equal results; null ids and urls are
kept; an empty table gives no rows; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|select|iframe|object|title)\b(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+>.*?(?:</\1\s*>|\Z)|<!?/?[a-zA-Z](?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+(?:>|\Z)|<\?[^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)(.*)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_BLANK = re.compile(r"\s+")
_NAME = re.compile(r"[^\s\"']+")
_PART = re.compile(r"[a-z]+")

# HTML elements by role.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav footer header aside form menu dialog head fieldset".split())
BOILER_ROLES = frozenset("complementary navigation banner contentinfo search form dialog alert alertdialog menu menubar toolbar status".split())
MUTED = frozenset("button label".split())
BOILER_NAMES = frozenset("ad ads advert advertisement adverts banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup login share sharing social related recommended comments comment commentlist discussion review reviews reply replies respond disqus widget toolbar copyright legal search".split())
CONTENT_NAMES = frozenset("article content post entry story main body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS, CELL_TAGS = frozenset("p pre blockquote".split()) | HEADINGS, frozenset("li td dd dt".split())
#: A class name that starts so says what a page has or lacks, not what the element is; so does what follows "with" and the like.
STATE_WORDS = frozenset("has with no without is hide show".split())

#: Log-odds of content: a page's prior, then what speaks for or against. Smoothness: strength of neighbours and of siblings.
PRIOR, IN_CONTENT, OUTSIDE, IN_BOILER, IN_CONTENT_NAME, IN_TEXT_TAG, IN_CELL, PER_LOG_WORD, LINKS = -1.0, 6.0, -6.0, -40.0, 1.5, 1.1, 0.5, 0.35, -4.0
NEIGHBOUR, SIBLING = 0.6, 0.4


class Element:
    """An open element, with what it inherits: nothing has to look at the whole path of a block."""

    __slots__ = ("name", "block", "parent", "depth", "article", "main", "boiler", "named", "content", "muted")

    def __init__(self, name: str = "", up: Element | None = None, serial: int = 0):
        self.name = name
        if up is None:
            self.block = self.parent = self.depth = 0
            self.article = self.main = self.boiler = self.content = self.muted = False
            self.named = -1
            return
        own = name in BLOCKS
        self.block, self.parent, self.depth = (serial, up.block, up.depth + 1) if own else (up.block, up.parent, up.depth)
        self.article, self.main, self.boiler, self.content, self.muted, self.named = up.article, up.main, up.boiler, up.content, up.muted, up.named


class Block:
    """A block's text, its innermost element, the characters of its links, and the depth at which it parts from the block before."""

    __slots__ = ("text", "at", "tag", "links", "low", "words")

    def __init__(self, text: str, at: Element, tag: str, links: int, low: int):
        self.text, self.at, self.tag, self.links, self.low = text, at, tag, links, low
        self.words = text.count(" ") + 1


def names_of(attributes: str) -> tuple[set[str], set[str]]:
    """Words of an element's class and id, and of its role."""
    parts: set[str] = set()
    roles: set[str] = set()
    for key, value in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        key = key.lower()
        if key == "role":
            roles.update(_PART.findall(value.lower()))
        elif key in ("class", "id"):
            for word in _NAME.findall(value.lower()):
                for part in _PART.findall(word):
                    if part in STATE_WORDS:
                        break
                    parts.add(part)
    return parts, roles


def blocks_of(page: str) -> tuple[list[Block], list[bool]]:
    """Non-empty blocks in page order, and for each element that is named like boilerplate whether it, or one around it, is no layout."""
    stack = [Element()]
    places: dict[str, list[int]] = {}  # where in the stack a name is open
    block_places = [0]
    found: list[Block] = []
    words: list[str] = []
    named: list[tuple[int, bool]] = []  # (the one around, holds an article, main or h1)
    links = serial = low = 0
    in_link = False

    def close() -> None:
        nonlocal links, low
        text = _BLANK.sub(" ", html.unescape("".join(words))).strip()
        if text:
            found.append(Block(text, stack[-1], stack[block_places[-1]].name, links, low))
            low = stack[-1].depth
        words.clear()
        links = 0

    def pop_to(size: int) -> None:
        nonlocal low
        while len(stack) > size:
            gone = stack.pop()
            places[gone.name].pop()
            if block_places[-1] == len(stack):
                block_places.pop()
        low = min(low, stack[-1].depth)

    for m in _TOKEN.finditer(page):
        token = m[0]
        if token[0] != "<":
            if not stack[-1].muted:
                words.append(token)
                links += len(token) if in_link else 0
            continue
        t = None if m[1] else _TAG.match(token)
        if not t:
            if token == "<":
                words.append(token)
            continue
        name = t[2].lower()
        if name in BLOCKS:
            close()
        elif name == "br":
            words.append(" ")
        if name == "a":
            in_link = not t[1]
        if name in VOID:
            continue
        if t[1]:
            if places.get(name) and (name in BLOCKS or places[name][-1] > block_places[-1]):
                pop_to(places[name][-1])
            continue
        if name in BLOCKS:
            alike = name in ("li", "tr", "td", "th", "dt", "dd")
            while len(stack) > 1 and (stack[-1].name == "p" or stack[-1].name not in BLOCKS or (alike and stack[-1].name == name)):
                pop_to(len(stack) - 1)
        serial += 1
        up, e = stack[-1], Element(name, stack[-1], serial)
        holds = set_role(e, up, t[3], named)
        if holds and not e.boiler and e.named >= 0:
            named[e.named] = (named[e.named][0], True)
        if name in BLOCKS:
            block_places.append(len(stack))
        places.setdefault(name, []).append(len(stack))
        stack.append(e)
    close()
    return found, settled(found, named)


def set_role(e: Element, up: Element, attributes: str, named: list[tuple[int, bool]]) -> bool:
    """What an element adds to what it inherits; is it the page's text, as far as its tag and names say?"""
    name = e.name
    e.muted = up.muted or name in MUTED
    parts, roles = names_of(attributes)
    if name == "article" or "article" in roles:
        e.article = True
    elif name == "main" or "main" in roles:
        e.main = True
    elif name in BOILER_TAGS and not (name == "header" and up.article) or roles & BOILER_ROLES:
        e.boiler = True
    elif name in ("html", "body"):
        pass
    elif (parts - {"header"} if up.article or name in HEADINGS else parts) & BOILER_NAMES:
        named.append((up.named, False))
        e.named = len(named) - 1
    elif parts & CONTENT_NAMES:
        e.content = True
    return name == "h1" or (e.article > up.article or e.main > up.main) and not parts & BOILER_NAMES


def settled(blocks: list[Block], named: list[tuple[int, bool]]) -> list[bool]:
    """For each element named like boilerplate: is it, or one around it, boilerplate, and not layout around the page's text?

    Layout holds over half of the words that are neither in boilerplate tags nor in such elements that hold no article, main or h1.
    """
    size, holds = [0] * len(named), [h for _, h in named]
    for b in blocks:
        if b.at.named >= 0 and not b.at.boiler:
            size[b.at.named] += b.words
    for i in range(len(named) - 1, -1, -1):  # an element comes after those around it
        around = named[i][0]
        if around >= 0:
            size[around] += size[i]
            holds[around] |= holds[i]
    total = sum(b.words for b in blocks if not b.at.boiler and (b.at.named < 0 or holds[b.at.named]))
    boiler: list[bool] = []
    for i, (around, _) in enumerate(named):
        layout = holds[i] and 2 * size[i] > total
        boiler.append(not layout or (around >= 0 and boiler[around]))
    return boiler


def odds(blocks: list[Block], named: list[bool]) -> list[float]:
    """The classifier's log-odds that each block of a page is content."""
    boiler = [b.at.boiler or (b.at.named >= 0 and named[b.at.named]) for b in blocks]
    fair = sum(b.words for b, bad in zip(blocks, boiler, strict=True) if not bad)
    inside = sum(b.words for b, bad in zip(blocks, boiler, strict=True) if b.at.article and not bad)
    articles = inside > 0 and 4 * inside >= fair
    out = []
    for b, bad in zip(blocks, boiler, strict=True):
        e = b.at
        z = PRIOR + PER_LOG_WORD * float(np.log1p(b.words)) + IN_BOILER * bad + IN_CONTENT_NAME * e.content
        z += IN_TEXT_TAG * (b.tag in TEXT_TAGS) + IN_CELL * (b.tag in CELL_TAGS)
        if articles:
            z += IN_CONTENT if e.article or (e.main and b.tag == "h1") else OUTSIDE
        else:
            z += IN_CONTENT * e.main
        out.append(z + LINKS * min(1.0, b.links / max(1, len(b.text))))
    return out


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between page neighbours, and between a block and the next one under the same parent."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEIGHBOUR / (1 + blocks[i - 1].at.depth + b.at.depth - 2 * b.low)))
        parent = b.at.parent
        if last.get(parent, i - 1) != i - 1:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return edges


def minimum_cut(z: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least total cost: softplus of the odds against a label, plus each edge cut.

    Blocks whose odds outweigh all their edges are fixed first and folded into their neighbours' odds; max-flow, by augmenting
    along shortest paths, decides the rest.
    """
    n = len(z)
    z = list(z)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(z[i]) >= sum(near[i].values()):
            label[i] = z[i] > 0
            for j, c in near[i].items():
                z[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return [bool(x) for x in label]
    source, sink = n, n + 1
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
    for i in rest:
        a, b = (source, i) if z[i] > 0 else (i, sink)
        room[a][b] = abs(z[i])
        room[b].setdefault(a, 0.0)
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            break
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        flow = min(room[i][j] for i, j in path)
        for i, j in path:
            room[i][j] -= flow
            room[j][i] = room[j].get(i, 0.0) + flow
    for i in rest:
        label[i] = i in came
    return [bool(x) for x in label]


def main_text(page: str) -> str:
    """The content blocks of one page, joined by blank lines."""
    blocks, named = blocks_of(page)
    keep = minimum_cut(odds(blocks, named), smoothness(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([main_text(x or "") for x in b], dtype=object)

    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
