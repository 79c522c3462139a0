"""A small forgiving HTML reader: block elements as nodes, their text runs, and features of every node."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np

#: Possessive, so that a match gives up where it stands: comments, declarations, tags.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: Tags of a page where a quote is never closed: they end at the first >.
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.S)
_OPENS = re.compile(r"<(?=[!?]|/?[a-zA-Z])")
_RAW = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style", "noscript", "template", "title", "textarea", "svg", "iframe", "xmp", "noframes")}
_ATTR = re.compile(r"""\b(?:class|id|role|itemprop)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body div section article main nav header footer aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend "
    "blockquote pre figure figcaption address details summary menu hgroup center dialog".split()
)
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}
_CONTROLS = frozenset("input select textarea button label option".split())
_HEAD = frozenset("meta link base title script style noscript template head html".split())

#: Tag groups and attribute words that features tell apart.
TAG_GROUPS = (("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("div", "center"), ("section",), ("article",), ("main",), ("nav", "menu"), ("header", "hgroup"), ("footer",), ("aside", "dialog"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("form", "fieldset", "legend"), ("blockquote", "pre", "figure", "figcaption"), ("#text",))
WORD_GROUPS = (
    ("article", "content", "main", "post", "entry", "story", "body", "text"), ("nav", "navigation", "menu", "breadcrumb", "breadcrumbs", "tabs", "pager", "pagination", "toc"),
    ("header", "masthead", "banner", "top", "logo", "branding"), ("footer", "foot", "bottom", "contentinfo", "copyright", "legal"),
    ("sidebar", "aside", "widget", "related", "recommended", "complementary", "rail", "teaser", "trending", "popular"), ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner"),
    ("cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "gdpr", "overlay", "paywall", "warning"), ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "reader", "thread"),
    ("form", "search", "login", "signup", "register", "contact", "poll"), ("byline", "author", "share", "social", "tags", "meta", "date"),
)
_TAG = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}
_WORDS: dict[str, tuple[int, ...]] = {}
for _i, _g in enumerate(WORD_GROUPS):
    for _w in _g:
        _WORDS[_w] = (*_WORDS.get(_w, ()), _i)
_ANCESTORS = (7, 8, 9, 10, 14, 5, 6)
N_FEATURES = 18 + len(TAG_GROUPS) + 2 * len(WORD_GROUPS) + len(_ANCESTORS)


class Node:
    """A block element, or a text run (#text) that stands beside block elements."""

    __slots__ = ("tag", "parent", "kids", "groups", "runs", "chars", "links", "tags", "marks", "blocks", "paras", "p_chars", "items", "controls", "begin", "label")

    def __init__(self, tag: str, parent: Node | None, groups: tuple[int, ...] = ()) -> None:
        self.tag, self.parent, self.groups = tag, parent, groups
        self.kids: list[Node] = []
        self.runs: list[list] = []
        self.chars = self.links = self.tags = self.marks = self.blocks = self.paras = self.p_chars = self.items = self.controls = self.begin = 0
        self.label = 0


def _groups(attributes: str) -> tuple[int, ...]:
    if "=" not in attributes:
        return ()
    out = set()
    for m in _ATTR.finditer(attributes):
        for w in _PART.findall(m[1]):
            out.update(_WORDS.get(w.lower(), ()))
    return tuple(out)


def _tokens(html: str) -> Iterator[tuple[int, re.Match | None]]:
    """Tokens in page order, as (where the text before one begins, match); the reader may send where it went on.

    No byte is read more often than a fixed number of times: a tag that fails means a quote that is never closed, after
    which quotes count no more, or that no > follows, after which there is no token.
    """
    at = look = 0
    pattern = _TOKEN
    while True:
        opens = _OPENS.search(html, look)
        if opens is None:
            yield at, None
            return
        m = pattern.match(html, opens.start())
        if m is None and pattern is _TOKEN:
            pattern = _LOOSE
            m = pattern.match(html, opens.start())
        if m is None:
            yield at, None
            return
        moved = yield at, m
        at = look = moved or m.end()


def parse(html: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """(root, runs): every run of text in page order with its node and how many of its characters are link text.

    Reads a page in one pass, in time linear in its length: open elements are found by their tags' places on the stack.
    """
    root = Node("body", None)
    here, stack, runs, text, links = root, [root], [], [], 0
    anchors = 0
    places: dict[str, list[int]] = {t: [] for t in BLOCKS}

    def flush() -> None:
        nonlocal links
        if text:
            run = " ".join("".join(text).split())
            if run:
                runs.append((here, run, min(links, len(run))))
            text.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        s = unescape(raw) if "&" in raw else raw
        text.append(s)
        if anchors:
            links += len(s.strip())

    def close(k: int) -> None:
        """End the elements from place k on."""
        while len(stack) > k:
            places[stack.pop().tag].pop()

    def last(tags: frozenset | set) -> int:
        return max(places[t][-1] if places[t] else -1 for t in tags)

    tokens = _tokens(html)
    moved: int | None = None
    while True:
        at, m = tokens.send(moved)
        if m is None:
            rest = html[at:]
            k = rest.rfind("<")
            add(rest[:k] if k >= 0 and _OPENS.match(rest, k) else rest)
            break
        moved = None
        if m.start() > at:
            add(html[at : m.start()])
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                if places[tag]:
                    flush()
                    close(places[tag][-1])
                    here = stack[-1]
                    anchors = 0
                elif tag != "body" and tag != "html":
                    flush()
            elif tag == "a" and anchors:
                anchors -= 1
            continue
        if tag in _RAW:
            moved = _RAW[tag].search(html, m.end()).end()
            if tag == "textarea":
                here.controls += 1
            continue
        if tag == "br" or tag == "hr":
            text.append(" ")
            here.tags += 1
            continue
        if tag in ("html", "body", "head"):
            if tag == "body":
                root.groups = _groups(m[3])
            continue
        here.tags += 1
        if tag in BLOCKS:
            flush()
            anchors = 0
            if stack[-1].tag == "p":  # every block ends a paragraph, so one can be open on top only
                close(len(stack) - 1)
            if tag in _ENDS:
                same, stop = _ENDS[tag]
                k = last(same)
                if k > last(stop):
                    close(k)
            here = Node(tag, stack[-1], _groups(m[3]))
            stack[-1].kids.append(here)
            places[tag].append(len(stack))
            stack.append(here)
        elif tag == "a":
            anchors += 1
        elif tag in _CONTROLS:
            here.controls += 1
    flush()
    return root, runs


def _marks(s: str) -> int:
    return s.count(".") + s.count(",") + s.count(";") + s.count("!") + s.count("?")


def nodes_of(html: str) -> tuple[list[Node], list[tuple[Node, str]], np.ndarray]:
    """(nodes, runs, features), nodes with text in page order, parents before children; each run names the node that decides on it."""
    root, found = parse(html)
    runs: list[tuple[Node, str]] = []
    total = 0
    for node, run, links in found:
        owner = node
        if node.kids:
            owner = Node("#text", node)
            node.kids.append(owner)
        n = len(run)
        if not owner.blocks:
            owner.begin = total
        owner.chars += n
        owner.links += links
        owner.marks += _marks(run)
        owner.blocks += 1
        if owner.tag == "p":
            owner.p_chars += n
        runs.append((owner, run))
        total += n
    order: list[Node] = []
    depth: dict[int, int] = {}
    todo = [(root, 0)]
    while todo:
        node, d = todo.pop()
        depth[id(node)] = d
        order.append(node)
        todo.extend((k, d + 1) for k in reversed(node.kids))
    for node in reversed(order):
        node.paras += node.tag == "p"
        node.items += node.tag == "li"
        up = node.parent
        if up is not None:
            if node.chars and (not up.chars or node.begin < up.begin):
                up.begin = node.begin
            up.chars += node.chars
            up.links += node.links
            up.tags += node.tags + 1
            up.marks += node.marks
            up.blocks += node.blocks
            up.paras += node.paras
            up.p_chars += node.p_chars
            up.items += node.items
            up.controls += node.controls
    order = [n for n in order if n.chars or n is root]
    rows = np.empty((len(order), N_FEATURES), dtype=np.float32)
    inherited: dict[int, tuple[int, int]] = {}
    whole = max(total, 1)
    log = math.log1p
    n_tags, n_words = len(TAG_GROUPS), len(WORD_GROUPS)
    place: dict[int, tuple[int, int, float, float]] = {}
    for at, node in enumerate(order):
        if node.kids:
            k = len(node.kids)
            mean = sum(x.chars for x in node.kids) / k
            for i, x in enumerate(node.kids):
                if not x.chars:
                    continue
                place[id(x)] = (i, k, mean, sum(y.tag == x.tag for y in node.kids[max(0, i - 2) : i + 3]) - 1.0)
        i, k, mean, alike = place.get(id(node), (0, 1, float(node.chars), 0.0))
        c = max(node.chars, 1)
        above_tags, above_words = inherited.get(id(node.parent), (0, 0))
        tag = _TAG.get(node.tag, -1)
        row = [
            float(depth[id(node)]), i / max(k - 1, 1), log(k), log(node.chars), node.links / c, min(node.tags / c, 1.0), node.marks / c,
            node.chars / max(node.blocks, 1), node.chars / whole, node.begin / whole, (node.begin + node.chars) / whole, log(node.paras), node.p_chars / c,
            log(node.items), log(node.controls), log(mean), alike, log(total),
        ]
        own = [0.0] * (n_tags + 2 * n_words)
        if tag >= 0:
            own[tag] = 1.0
        words = 0
        for g in node.groups:
            own[n_tags + g] = 1.0
            words |= 1 << g
        if above_words:
            for g in range(n_words):
                if above_words >> g & 1:
                    own[n_tags + n_words + g] = 1.0
        row += own
        row += [1.0 if above_tags >> g & 1 else 0.0 for g in _ANCESTORS]
        rows[at] = row
        inherited[id(node)] = (above_tags | (1 << tag if tag >= 0 else 0), above_words | words)
    return order, runs, rows
