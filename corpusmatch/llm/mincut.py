"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into blocks: runs of text between block-level tags. The graph has a node for each block and for each
element with blocks below it. A linear classifier over a block's text (length, link share, sentence end, heading,
list item, signs) gives its cost of being called content and of being called boilerplate; their difference is the
block's capacity to a terminal. An element whose name, role or class tells what it is (article, menu, advert) has a
capacity of its own, in proportion to the blocks below it. Each node is tied to the element around it, and blocks to
their neighbours in page order, the stronger the nearer they are in the tree. The maximum flow, found on level
graphs, gives the minimum cut: the cheapest labelling of the whole page. The content blocks, character references
decoded and white space inside a block made one blank, are joined by an empty line.

The classifier's weights are learned from blocks whose surroundings tell what they are, over all pages: Spark counts
them by their features, a table of a few hundred rows, and a logistic regression drawn towards fixed weights is fitted to it.
Both labels weigh the same, whatever their number. Without blocks of both labels the fixed weights stay.

Scripts, styles and the like, and everything in the head, are no blocks at all.

Nulls: a null or empty page has an empty text. A tag or comment that never ends takes the rest of the page, as in a
browser; a quoted value that never ends goes up to the next ">". Repeated rows come back as often. An empty table gives
an empty result. Time and memory grow in proportion to a page, deep nesting included.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# A quote opens a value after "=" only, and only if it is closed.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>=]++|=)*+)(?:>|\Z)",
    re.S,
)
_HINTS = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# What never holds text of the page.
SKIPPED = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "title"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog",
    "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "label", "legend", "li", "main", "menu", "nav", "ol", "optgroup",
    "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# A start tag ends an open element of these names, up to the next element that holds it.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
BARRIER = {"ul", "ol", "dl", "table", "select", "div", "article", "section", "main", "body", "menu"}
AWAY = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "label", "legend"}
AWAY_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu",
    "menubar", "form", "toolbar",
}
AWAY_HINTS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "disclaimer", "discussion", "disqus", "footer", "form", "gdpr", "header", "login",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay",
    "pagination", "popup", "promo", "promotion", "related", "replies", "reply", "respond", "search", "share",
    "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
HERE_HINTS = {"article", "body", "content", "entry", "main", "post", "story", "text"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

ITEMS = {"li", "dt", "dd", "td", "th", "option"}
_SIGNS = re.compile("[©®·|»›→•]")

# Features: six classes of length, link share below and above a half, sentence end, heading, item, sign.
_LENGTHS = (20, 40, 80, 160, 320)
PRIOR = (-0.8, -0.5, 0.0, 1.0, 2.3, 2.3, -0.8, -2.5, 1.5, 0.8, -0.3, -0.5)
# Capacities: the most a block's text can say, an element's word per block below it, and the ties.
_MOST, _AWAY, _HERE, _ELSEWHERE = 4.0, -8.0, 5.0, -2.5
_INSIDE, _PARENT, _ORDER = 5.0, 1.5, 1.4


class Element:
    """An open or closed element; ``hint`` is 1 where an article starts, -1 where boilerplate does, else 0."""

    __slots__ = ("parent", "depth", "hint", "here", "away", "blocks")

    def __init__(self, parent, hint, here, away):
        self.parent, self.hint, self.here, self.away, self.blocks = parent, hint, here, away, 0
        self.depth = 0 if parent is None else parent.depth + 1


class Block:
    __slots__ = ("text", "features", "element")

    def __init__(self, text, features, element):
        self.text, self.features, self.element = text, features, element


def _features(text: str, linked: int, heading: bool, item: bool) -> int:
    """The features as bits."""
    n = len(text)
    out = 1 << sum(n >= x for x in _LENGTHS)
    if linked:
        out |= 1 << (6 if 2 * linked < n else 7)
    return out | (text[-1] in ".!?…\"')”»") << 8 | heading << 9 | item << 10 | bool(_SIGNS.search(text)) << 11


def _context(name: str, attributes: str, here: bool, away: bool) -> tuple[bool, bool]:
    """Whether what is inside stands in the article, and whether in something that is none of it."""
    if name in ("html", "body"):
        return here, away
    if name in ("article", "main"):
        here = True
    away = away or name in AWAY or name == "header" and not here
    if attributes:
        words, roles = set(), set()
        for kind, *values in _HINTS.findall(attributes):
            value = "".join(values)
            (roles if kind.lower() == "role" else words).update(x.lower() for x in _WORDS.findall(value))
        good = words & HERE_HINTS
        if good or roles & {"main", "article"}:
            here = True
        elif words & AWAY_HINTS and name not in ("article", "main"):
            away = True
        away = away or bool(words & {"comment", "comments"}) or bool(roles & AWAY_ROLES) or bool(_HIDDEN.search(attributes))
    return here, away


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    root = Element(None, 0, False, False)
    # open elements: name, element, skipped, in a link, in a heading, in an item, place of the paragraph that a block ends
    stack: list[tuple] = [("", root, False, False, False, False, 0)]
    open_ = Counter()
    parts: list[str] = []
    linked, at, end = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, element, _, _, heading, item, _ = stack[-1]
                out.append(Block(text, _features(text, linked, heading, item), element))
            parts.clear()
        linked = 0

    def close(place: int) -> None:
        open_.subtract(x[0] for x in stack[place:])
        del stack[place:]

    while at < end:
        found = _MARKUP.search(page, at)
        stop = found.start() if found else end
        if stop > at and not stack[-1][2]:
            text = page[at:stop]
            parts.append(text)
            if stack[-1][3]:
                linked += len(text)
        if not found:
            break
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if name in ("br", "hr"):
            parts.append(" ")
        if name in BLOCKS:
            flush()
        if found[1]:
            if open_[name]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if stack[i][0] in BARRIER and name not in BLOCKS:
                        break
            continue
        if name in VOID:
            continue
        if name in BLOCKS and stack[-1][6]:
            # a new block ends an open paragraph
            close(stack[-1][6])
        ended = CLOSES.get(name, ())
        if any(open_[x] for x in ended):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ended:
                    close(i)
                    break
                if stack[i][0] in BARRIER:
                    break
        if found[3].endswith("/") and name not in BLOCKS:
            continue
        _, parent, skipped, link, heading, item, paragraph = stack[-1]
        here, away = _context(name, found[3], parent.here, parent.away)
        if (here, away) != (parent.here, parent.away) or name in BLOCKS:
            hint = -1 if away and not parent.away else 1 if here and not parent.here and not away else 0
            element = Element(parent, hint, here, away)
        else:
            element = parent
        paragraph = len(stack) if name == "p" else 0 if name in BARRIER else paragraph
        skipped = name != "body" and (skipped or name in SKIPPED or name == "head")
        stack.append(
            (name, element, skipped, link or name == "a", heading or name in HEADINGS, item or name in ITEMS, paragraph)
        )
        open_[name] += 1
        if name in RAW:
            ending = re.compile(f"</{name}", re.I).search(page, at)
            at = ending.start() if ending else end
    flush()
    return out


def costs(found: list[Block], weights: tuple[float, ...] = PRIOR) -> list[float]:
    """Cost of calling each block boilerplate less that of calling it content, by its text alone."""
    known: dict[int, float] = {}
    for b in found:
        if b.features not in known:
            score = sum(w for i, w in enumerate(weights) if b.features >> i & 1)
            known[b.features] = max(-_MOST, min(_MOST, score))
    return [known[b.features] for b in found]


def graph(found: list[Block], weights: tuple[float, ...] = PRIOR) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Capacities of all nodes, blocks first, and their ties."""
    capacity, ties = costs(found, weights), []
    # elements with blocks below them, each after those inside it
    held: dict[int, Element] = {}
    for b in found:
        e = b.element
        while e is not None and id(e) not in held:
            held[id(e)] = e
            e.blocks = 0
            e = e.parent
    inner = sorted(held.values(), key=lambda e: -e.depth)
    for b in found:
        b.element.blocks += 1
    for e in inner:
        if e.parent is not None:
            e.parent.blocks += e.blocks
    number = {id(e): len(found) + i for i, e in enumerate(inner)}
    marked = any(b.element.here and not b.element.away for b in found)
    for e in inner:
        capacity.append(e.blocks * (_AWAY if e.hint < 0 else _HERE if e.hint > 0 else 0.0))
        if e.parent is not None:
            same = not e.hint and (e.here or e.away)
            ties.append((number[id(e)], number[id(e.parent)], _INSIDE * e.blocks if same else _PARENT))
    last = None
    for i, b in enumerate(found):
        e = b.element
        ties.append((i, number[id(e)], _INSIDE if e.here or e.away else _PARENT))
        if marked and not (e.here or e.away):
            capacity[i] += _ELSEWHERE
        if last is not None:
            # one step up and one down for each block, and the way between their elements
            ties.append((i - 1, i, _ORDER / (2 + _apart(last, e))))
        last = e
    return capacity, ties


def _apart(a: Element, b: Element, most: int = 8) -> int:
    """Steps between two elements; ``most`` stands for all that is farther."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def cut(capacity: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source when the flow is at its most.

    ``capacity`` is to the source where positive, to the sink where negative; a tie carries both ways.
    """
    n, tiny = len(capacity), 1e-9
    left = list(capacity)
    to: list[list[int]] = [[] for _ in range(n)]
    ends, room = [], []
    for a, b, c in ties:
        # what a tie can settle between its own ends needs no search
        x, y = (a, b) if left[a] > 0 else (b, a)
        flow = min(left[x], -left[y], c) if left[x] > 0 > left[y] else 0.0
        left[x] -= flow
        left[y] += flow
        for v, w, r in ((x, y, c - flow), (y, x, c + flow)):
            to[v].append(len(ends))
            ends.append(w)
            room.append(r)
    while True:
        # levels from all nodes with supply, as far as the nearest demand
        level = [-1] * n
        layer = [i for i in range(n) if left[i] > tiny]
        for i in layer:
            level[i] = 0
        starts, depth, reached = layer, 0, False
        while layer and not reached:
            depth += 1
            after = []
            for i in layer:
                for e in to[i]:
                    j = ends[e]
                    if level[j] < 0 and room[e] > tiny:
                        level[j] = depth
                        reached = reached or left[j] < -tiny
                        after.append(j)
            layer = after
        if not reached:
            return [x >= 0 for x in level]
        # shortest ways, each arc given up once it leads nowhere
        arc = [0] * n
        for start in starts:
            way: list[int] = []
            i = start
            while left[start] > tiny:
                if left[i] < -tiny:
                    flow = min(left[start], -left[i], *(room[e] for e in way))
                    left[start] -= flow
                    left[i] += flow
                    full = len(way)
                    for k, e in enumerate(way):
                        room[e] -= flow
                        room[e ^ 1] += flow
                        if room[e] <= tiny and k < full:
                            full = k
                    if full < len(way):
                        i = ends[way[full] ^ 1]
                        del way[full:]
                    continue
                out, tried = to[i], arc[i]
                if level[i] < depth:
                    while tried < len(out) and not (room[out[tried]] > tiny and level[ends[out[tried]]] == level[i] + 1):
                        tried += 1
                else:
                    tried = len(out)
                arc[i] = tried
                if tried < len(out):
                    way.append(out[tried])
                    i = ends[out[tried]]
                elif way:
                    i = ends[way.pop() ^ 1]
                    arc[i] += 1
                else:
                    break


def main_text(page: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    found = blocks(page or "")
    kept = cut(*graph(found, weights))
    return "\n\n".join(b.text for b, k in zip(found, kept) if k)


def fit(counts: dict[tuple[int, bool], int], pull: float = 5.0) -> tuple[float, ...]:
    """Weights by logistic regression; ``counts`` by features and whether the block is content.

    Each label weighs 500 in all; ``pull`` draws the weights to ``PRIOR``.
    """
    total = {label: sum(n for (_, x), n in counts.items() if x == label) for label in (False, True)}
    if not all(total.values()):
        return PRIOR
    rows = sorted(counts.items())
    x = np.array([[f >> i & 1 for i in range(len(PRIOR))] for (f, _), _ in rows], float)
    y = np.array([label for (_, label), _ in rows], float)
    weight = np.array([500 * n / total[label] for (_, label), n in rows])
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - pull * (w - prior)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-10:
            break
    return tuple(round(float(v), 6) for v in w)


def learn(pages: DataFrame, page: str = "html") -> tuple[float, ...]:
    """Weights from all blocks whose surroundings tell what they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                for b in blocks(x.as_py() or ""):
                    if b.element.away or b.element.here:
                        counts[b.features, not b.element.away] += 1
        rows = [pa.array([f for f, _ in counts], pa.int32()), pa.array([c for _, c in counts], pa.bool_())]
        yield pa.RecordBatch.from_arrays([*rows, pa.array(counts.values(), pa.int64())], ["f", "content", "n"])

    counted = pages.select(page).mapInArrow(run, "f int, content boolean, n long")
    rows = counted.groupBy("f", "content").agg(F.sum("n").alias("n")).collect()
    return fit({(r["f"], r["content"]): r["n"] for r in rows})


def extract(
    pages: DataFrame, page: str = "html", into: str = "text", weights: tuple[float, ...] = PRIOR
) -> DataFrame:
    """The other columns of ``pages`` and the main text; a column that is named like it is left out."""
    rest = [c for c in pages.columns if c not in (page, into)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py(), weights) for x in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], [*rest, into])

    rows = pages.select(page, *rest)
    return rows.mapInArrow(run, rows.drop(page).schema.add(into, "string"))
