"""Main text of web pages by minimum-cut labelling.

A page is parsed into text blocks with their open elements. A logistic classifier, fitted on the labelled pages of html_pages,
gives each block a cost for being called boilerplate or content (its terminal capacity); neighbours in page order, and blocks
and the elements that hold them, are tied by smoothness edges, looser where an element's class or tag says that a part of another kind
begins. The minimum cut is the labelling of least total cost,
found by maximum flow after all nodes whose own evidence outweighs their edges are settled.

Class words are evidence, not a verdict: a class that tells a state (has-sidebar, comments-open) says nothing, and an element
that holds all of the page's article, or all that looks like content, is no boilerplate by its class or as a form.

Text is the content blocks in page order: character references decoded, white space inside a block turned
into one space, trimmed, blocks joined by one space; nothing else is dropped or capped. Null, empty and
textless pages give an empty text. Broken markup is read as browsers do: unclosed elements end with their
parents, stray end tags are ignored, a tag cut off at the end of the page is no text. A tag with an unclosed
quote ends at its next `>`.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship, texts
from .html_pages import PAGES

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.\-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html head legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul
    button template noscript svg caption""".split()
)
#: A start tag ends these open elements first, looking no further than the scope that follows.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ()),
}
ENDS_P = BLOCKS - frozenset("button option optgroup html head body template noscript svg caption td th tr tbody thead tfoot".split())
HOLDS_P = frozenset("button td th caption table html template".split())

#: Boilerplate by their tag, and those of them that cannot hold content at all.
BAD_TAGS = frozenset("nav footer aside form menu dialog button select template noscript svg option head fieldset".split())
NEVER = BAD_TAGS - {"form", "fieldset"}
STRONG_WORDS = frozenset(
    """nav navbar navigation menu breadcrumb breadcrumbs footer masthead ad ads advert adverts advertisement advertising adsense sponsor
    sponsored cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments commentlist
    respond replies disqus pagination pager outbrain taboola discussion discussions guestbook userpost userposts hidden""".split()
)
WEAK_WORDS = frozenset(
    """sidebar side header banner promo promotion notice notices notification alert share sharing social related recommend recommended
    recommendations widget widgets toolbar search copyright legal disclaimer tags tagcloud feedback reviews review teaser reply thread reactions
    opinions visitors""".split()
)
#: Class names with one of these words tell a state of the page, not what the element is.
STATE_WORDS = frozenset("has no not with without is are can allow allows open closed enabled disabled".split())
#: Parts of compound words (topnav, sitefooter, usercomments).
STEMS = ("navbar", "topnav", "subnav", "leftnav", "menu", "footer", "sidebar", "banner", "comment", "cookie", "newsletter", "advert", "sponsor", "breadcrumb", "userpost", "readerpost", "guestbook")
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
GOOD_WORDS = frozenset("article post content entry story main body text".split())
_READERS = frozenset("user users reader readers visitor visitors guest guests member members".split())
_POSTS = frozenset("post posts comment comments content contents reply replies review reviews opinion opinions".split())
_SENTENCE_END = re.compile(r"[.!?…。！？]")
_CUE = re.compile(
    r"\W*(?:\d+ (?:comments?|replies)|comments?\b|leave a |reply\b|replies\b|share\b|tweet\b|subscribe|sign (?:in|up)|log ?in|read (?:also|more)|related |advertisement|sponsored|"
    r"copyright|©|all rights reserved|we use cookies|posted by|[\w .]{1,30}(?:, | · | - )?\d+ (?:minutes?|hours?|days?|weeks?|months?|years?) ago|\w[\w .]{0,30} (?:wrote|says|said):$)",
    re.I,
)
_NAMES = ("base", "inside", "outside", "links", "short", "words", "sentence", "heading", "good", "structure", "strong", "weak", "cue")
STRUCTURE, CLASS = 1, 2


@dataclass(frozen=True)
class Costs:
    weights: tuple  # one for each of _NAMES
    neighbour: float = 2.0
    container: float = 0.8
    class_edge: float = 0.1  # share of the smoothness that stays over the edge of an element whose class says boilerplate
    tag_edge: float = 0.02  # the same for a tag or role


@lru_cache(1 << 14)
def class_words(value: str) -> tuple[bool, bool, bool]:
    """(good, strong, weak): what a class or id says about its element."""
    good = strong = weak = False
    for name in value.split():
        words = {w.lower() for w in _TOKEN.findall(name)}
        fine = bool(words & GOOD_WORDS)
        state = bool(words & STATE_WORDS) and words != {"is", "hidden"}
        compound = any(len(w) >= 6 and (w.startswith(STEMS) or w.endswith(STEMS) or w.endswith(tuple(x + "s" for x in STEMS))) for w in words)
        own = not state and (bool(words & STRONG_WORDS) or compound or bool(words & _READERS and words & _POSTS))
        maybe = not state and bool(words & WEAK_WORDS) and not (fine and words & {"header"} and not words & (WEAK_WORDS - {"header"}))
        strong, weak, good = strong or own, weak or maybe, good or (fine and not own and not maybe)
    return good, strong, weak


class Element:
    __slots__ = ("tag", "parent", "structure", "strong", "weak", "inside", "good", "number", "excused", "depth")

    def __init__(self, tag: str, parent: Element | None, attributes: str, number: int):
        self.tag, self.parent, self.number, self.excused, self.depth = tag, parent, number, False, parent.depth + 1 if parent else 0
        self.inside = bool(parent and parent.inside) or tag in ("article", "main")
        self.good = bool(parent and parent.good)
        self.structure, self.strong, self.weak = tag in BAD_TAGS or (tag == "header" and not self.inside), False, False
        if attributes and not attributes.isspace():
            for name, *values in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), next((v for v in values if v), "")
                if name in ("class", "id") and tag not in ("html", "body"):
                    good, strong, weak = class_words(value)
                    self.good |= good
                    self.strong |= strong
                    self.weak |= weak
                elif name == "role":
                    self.structure |= value.lower() in BAD_ROLES
                    self.inside |= value.lower() in ("main", "article")
                elif name == "itemprop":
                    self.inside |= value.lower() == "articlebody"
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
                    self.structure = True

    @property
    def kind(self) -> int:
        """What the element's own tag and class begin: STRUCTURE, CLASS, or 0 for nothing new."""
        if self.excused:
            return STRUCTURE if self.structure and self.tag in NEVER else 0
        return STRUCTURE if self.structure else CLASS if self.strong or self.weak else 0

    def above(self) -> list[Element]:
        """The element and those that hold it."""
        out, e = [], self
        while e is not None:
            out.append(e)
            e = e.parent
        return out


@dataclass
class Block:
    text: str
    element: Element
    link_chars: int


def blocks_of(html: str) -> list[Block]:
    """The page's text blocks in order."""
    root = element = Element("html", None, "", 0)
    stack, out = [root], []
    parts: list[str] = []
    links = inline_links = number = 0
    at, size = 0, len(html)

    def flush():
        nonlocal links
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(text, element, links))
            parts.clear()
        links = 0

    def add(text: str):
        nonlocal links
        if text:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if inline_links:
                links += len(text.strip())

    def close(k: int):
        nonlocal element, inline_links
        flush()
        del stack[k:]
        element, inline_links = stack[-1], 0

    while at < size:
        m = _TAG.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        if not m[4]:  # a stray quote: the tag goes on to the next >, or the page ends in it
            at = html.find(">", at) + 1
            if not at:
                break
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == name:
                        close(k)
                        break
                else:
                    if name == "p":
                        flush()
            elif name == "a":
                inline_links = 0
            continue
        if name == "br":
            parts.append(" ")
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else size
        elif name == "a":
            inline_links = 1
        elif name in BLOCKS and name not in ("html", "hr"):
            flush()
            ends, scope = ENDS.get(name, ((), ()))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    close(k)
                    break
                if stack[k].tag in scope:
                    break
            if name in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in HOLDS_P:
                        break
            if not m[3].endswith("/") or name not in ("svg", "option"):
                number += 1
                inline_links = 0
                element = Element(name, stack[-1], m[3], number)
                stack.append(element)
        elif name == "hr":
            flush()
    flush()
    return out


def excuse(blocks: list[Block]) -> bool:
    """Marks the elements whose class (or being a form) is no evidence, as they hold all that looks like content; whether the page has an article.

    Where an article or main element has such blocks, only these count. Without one, only weak words are excused.
    """
    lines = [b for b in blocks if b.text.count(" ") >= 5 and _SENTENCE_END.search(b.text) and 2 * b.link_chars < len(b.text) and not any(e.structure and e.tag != "form" for e in b.element.above())]
    inside = [b for b in lines if b.element.inside]
    marked: dict[int, list] = {}
    for b in inside or lines:
        for e in b.element.above():
            if e.strong or e.weak or e.tag == "form":
                marked.setdefault(e.number, [e, 0])[1] += 1
    for e, n in marked.values():
        if n == len(inside or lines) and (inside or not e.strong):
            e.excused = True
    return any(b.element.inside and not any(e.kind for e in b.element.above()) for b in blocks)


def features(block: Block, has_article: bool) -> list[float]:
    """The values that _NAMES names."""
    words, e = block.text.count(" ") + 1, block.element
    above = e.above()
    kinds = [x.kind for x in above]
    strong, weak = any(k == CLASS and x.strong for k, x in zip(kinds, above)), any(k == CLASS and x.weak for k, x in zip(kinds, above))
    return [
        1.0, e.inside, not e.inside and has_article, min(1.0, block.link_chars / len(block.text)), words < 4, min(words, 40) / 40, bool(_SENTENCE_END.search(block.text)),
        e.tag in ("h1", "h2", "h3"), e.good, STRUCTURE in kinds, strong, weak, words <= 30 and bool(_CUE.match(block.text)),
    ]


def fit_costs(pages=PAGES, penalty: float = 0.04, **smooth) -> Costs:
    """Terminal costs by ridge-penalised logistic regression on labelled pages (in whose texts a plus sign begins a content block)."""
    x, y = [], []
    for page in pages:
        blocks = blocks_of(page)
        labels = [b.text.startswith("+") for b in blocks]
        blocks = [Block(b.text.lstrip("+"), b.element, b.link_chars) for b in blocks]
        has_article = excuse(blocks)
        x += [features(b, has_article) for b in blocks]
        y += labels
    x, y = np.array(x, float), np.array(y, float)
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return Costs(tuple(float(v) for v in w), **smooth)


@lru_cache(1)
def default_costs() -> Costs:
    return fit_costs()


def evidence(block: Block, has_article: bool, costs: Costs) -> float:
    """Positive: calling the block boilerplate costs so much; negative: calling it content does."""
    return sum(w * v for w, v in zip(costs.weights, features(block, has_article)))


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling x of least cost: -unary[i] where x[i], and w for each edge (i, j, w) with x[i] != x[j].

    Of equal labellings the one with fewest content nodes. A node whose evidence exceeds its undecided edges
    is settled by it, and gives its edges to its neighbours' evidence; the rest is cut by maximum flow.
    """
    n = len(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    own, label = list(unary), [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(own[i]) > sum(w for j, w in near[i].items() if label[j] is None):
            label[i] = own[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    own[j] += w if label[i] else -w
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, x in zip(rest, _flow([own[i] for i in rest], near, rest)):
            label[i] = x
    return label


def _flow(own: list[float], near: list[dict[int, float]], nodes: list[int]) -> list[bool]:
    """Source side of a minimum cut, by shortest augmenting paths in level graphs."""
    place = {v: k for k, v in enumerate(nodes)}
    n = len(nodes)
    source, sink = n, n + 1
    cap: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for k, v in enumerate(nodes):
        if own[k] > 0:
            cap[source][k], cap[k][source] = own[k], 0.0
        elif own[k] < 0:
            cap[k][sink], cap[sink][k] = -own[k], 0.0
        for j, w in near[v].items():
            if j in place:
                cap[k][place[j]] = w
    tiny = 1e-9
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [k in level for k in range(n)]
        tried = {u: iter(list(cap[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))
                back = len(path)
                for k, (a, b) in enumerate(zip(path, path[1:])):
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                    if cap[a][b] <= tiny:
                        back = min(back, k + 1)
                path = path[:back]
                continue
            for v in tried[u]:
                if level.get(v) == level[u] + 1 and cap[u].get(v, 0.0) > tiny:
                    path.append(v)
                    break
            else:
                path.pop()


def label_blocks(blocks: list[Block], costs: Costs | None = None) -> list[bool]:
    """Content or not, for each block."""
    costs = costs or default_costs()
    has_article = excuse(blocks)
    unary = [evidence(b, has_article, costs) for b in blocks]
    edges, nodes = [], {}

    def share(k: int) -> float:
        return costs.tag_edge if k == STRUCTURE else costs.class_edge if k == CLASS else 1.0

    def node(last: Element) -> int:
        e, own = last, None
        while True:  # up to the first element that is known
            known = e.number in nodes
            k = nodes.setdefault(e.number, len(unary))
            if not known:
                unary.append(0.0)
            if own is not None:
                edges.append((own[0], k, costs.container * own[1]))
            if known or e.parent is None:
                return nodes[last.number]
            own = k, costs.tag_edge if e.inside != e.parent.inside else share(e.kind)
            e = e.parent

    def loosest(a: Element, b: Element) -> float:
        """The least share over the elements that hold only one of two blocks."""
        least = costs.tag_edge if a.inside != b.inside else 1.0
        while a is not b:
            if a.depth >= b.depth:
                least, a = min(least, share(a.kind)), a.parent
            else:
                least, b = min(least, share(b.kind)), b.parent
        return least

    for k, b in enumerate(blocks):
        edges.append((k, node(b.element), costs.container))
        if k:
            a = blocks[k - 1].element
            near = 1.0 if a is b.element or a.parent is b.element.parent else 0.5
            edges.append((k - 1, k, costs.neighbour * near * loosest(a, b.element)))
    return min_cut(unary, edges)[: len(blocks)]


def main_text(html: str | None, costs: Costs | None = None) -> str:
    blocks = blocks_of(html) if html else []
    return " ".join(b.text for b, keep in zip(blocks, label_blocks(blocks, costs)) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", costs: Costs | None = None) -> DataFrame:
    """(id, url, text, n_chars) for each row of pages."""
    ship(pages.sparkSession)
    costs = costs or default_costs()

    def run(batches):
        for b in batches:
            out = [main_text(h, costs) for h in texts(b, html_col)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [id_col, url_col, "text", "n_chars"])

    fields = [T.StructField(c, pages.schema[c].dataType) for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
