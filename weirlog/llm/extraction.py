"""HTML extraction: gradient-boosted trees over DOM nodes and a decoding without contradictions between ancestors and descendants."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .dom import N_FEATURES, Node, nodes_of

#: Pages that the model is trained on; they are made by page(), so the bound does not depend on the input.
TRAINING_PAGES = 500
TREES, DEPTH, BINS, RATE, RIDGE = 60, 4, 24, 0.25, 1.0
#: Nodes that are scored at once.
BATCH = 20_000


@dataclass(frozen=True)
class Boosted:
    """Trees of one depth as arrays: feature and threshold of inner nodes, values of leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Boosted:
    """Logistic gradient boosting with histogram splits, level by level."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    p0 = y.mean()
    base = float(np.log(p0 / (1 - p0)))
    z = np.full(len(y), base)
    inner = 2**DEPTH - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        f, t = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            slot = at - first
            best = np.full(width, 1e-6)
            total_g, total_h = np.bincount(slot, g, width), np.bincount(slot, h, width)
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                m = len(c) + 1
                key = slot * m + binned[:, k]
                lg = np.bincount(key, g, width * m).reshape(width, m).cumsum(axis=1)[:, :-1]
                lh = np.bincount(key, h, width * m).reshape(width, m).cumsum(axis=1)[:, :-1]
                rg, rh = total_g[:, None] - lg, total_h[:, None] - lh
                gain = lg**2 / (lh + RIDGE) + rg**2 / (rh + RIDGE) - (total_g**2 / (total_h + RIDGE))[:, None]
                gain[(lh < 1.0) | (rh < 1.0)] = 0
                i = gain.argmax(axis=1)
                top = gain[np.arange(width), i]
                better = top > best
                best[better] = top[better]
                f[first : first + width][better] = k
                t[first : first + width][better] = c[i[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > t[at])
        slot = at - inner
        v = RATE * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + RIDGE)
        z += v[slot]
        features.append(f)
        thresholds.append(t)
        leaves.append(v)
    return Boosted(base, np.array(features), np.array(thresholds), np.array(leaves))


class _Maker:
    """Makes labelled pages: article text is written with a marker character that the labels are read from."""

    MARK = "⁣"

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        r = self.r
        self.parts = ["".join(r.choice("bcdfghlmnprstvw") + r.choice("aeiouéäó") + r.choice(["", "n", "r", "s", "t", "l"]) for _ in range(r.choice((1, 1, 2)))) for _ in range(400)]

    def words(self, n: int) -> list[str]:
        return ["".join(self.r.choice(self.parts) for _ in range(self.r.choice((1, 1, 2, 3)))) for _ in range(n)]

    def sentence(self, n: int) -> str:
        w = self.words(max(n, 1))
        w[0] = w[0].capitalize()
        for i in range(4, len(w) - 1, 7):
            if self.r.random() < 0.5:
                w[i] += ","
        return " ".join(w) + self.r.choice((".", ".", ".", "!", "?"))

    def prose(self, n: int) -> str:
        out = []
        while n > 0:
            k = min(n, self.r.randint(3, 22))
            out.append(self.sentence(k))
            n -= k
        return " ".join(out)

    def pick(self, *names: str) -> str:
        """An attribute from one of the names, a meaningless one, or none."""
        r = self.r
        x = r.random()
        if x < 0.62:
            return f' {r.choice(("class", "class", "id"))}="{r.choice(names)}{r.choice(("", "", "-wrap", " clearfix", "-1", " box"))}"'
        return f' class="{r.choice(("c", "x", "row", "col", "css", "sc", "u"))}-{r.randint(1, 99)}"' if x < 0.85 else ""

    def link(self, n: int) -> str:
        w = " ".join(self.words(n))
        return f'<a href="/{w.replace(" ", "-")}">{w}</a>'

    def menu(self) -> str:
        r = self.r
        tag = r.choice(("nav", "nav", "div", "ul"))
        items = [self.link(r.randint(1, 3)) for _ in range(r.randint(3, 14))]
        inner = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if r.random() < 0.7 else r.choice((" ", " | ")).join(items)
        return f"<{tag}{self.pick('nav', 'menu', 'navigation', 'breadcrumb', 'tabs') if tag != 'nav' or r.random() < 0.4 else ''}>{inner}</{tag}>"

    def head(self) -> str:
        r = self.r
        tag = r.choice(("header", "header", "div"))
        name = " ".join(self.words(r.randint(1, 4))).title()
        more = r.choice(("", f"<p>{self.sentence(r.randint(3, 9))}</p>", self.menu(), self.search()))
        return f"<{tag}{self.pick('header', 'masthead', 'top', 'banner', 'logo')}>{r.choice((f'<h1>{name}</h1>', f'<div>{name}</div>', f'<a href=/>{name}</a>', f'<p>{name}</p>'))}{more}</{tag}>"

    def foot(self) -> str:
        r = self.r
        tag = r.choice(("footer", "footer", "div"))
        attr = self.pick("footer", "bottom", "copyright", "legal") if tag == "div" or r.random() < 0.4 else ""
        text = f"&copy; {r.randint(1999, 2030)} {' '.join(self.words(2))} &middot; {self.prose(r.randint(4, 25))}"
        return f"<{tag}{attr}>{r.choice((text, f'<p>{text}</p>', f'<div>{self.menu()}<p>{text}</p></div>', f'<ul>' + ''.join(f'<li>{self.link(2)}</li>' for _ in range(5)) + f'</ul><p>{text}</p>'))}</{tag}>"

    def advert(self) -> str:
        r = self.r
        tag = r.choice(("div", "div", "aside", "section"))
        attr = f' class="{r.choice(("ad", "ads", "advert", "sponsored", "promo", "ad-box", "advertisement"))}"' if r.random() < 0.9 else ""
        text = self.prose(r.randint(3, 30)).replace(". ", r.choice((". ", ".\n")))
        return f"<{tag}{attr}>{r.choice((text, text, f'<p>{text}</p>', f'<a href=x>{text}</a>', f'<h3>{self.sentence(4)}</h3><p>{text}</p>'))}</{tag}>"

    def side(self) -> str:
        r = self.r
        tag = r.choice(("aside", "aside", "div"))
        body = "".join(r.choice((f"<h3>{' '.join(self.words(2))}</h3>", f"<p>{self.prose(r.randint(5, 40))}</p>", f"<ul>{''.join(f'<li>{self.link(r.randint(2, 9))}</li>' for _ in range(r.randint(3, 8)))}</ul>")) for _ in range(r.randint(1, 5)))
        return f"<{tag}{self.pick('sidebar', 'related', 'widget', 'rail', 'trending', 'popular')}>{body}</{tag}>"

    def notice(self) -> str:
        r = self.r
        tag = r.choice(("div", "div", "section", "aside", "p"))
        text = self.prose(r.randint(6, 45))
        button = r.choice(("", "<button>OK</button>", "<button>Accept</button>"))
        inner = text + button if tag == "p" or r.random() < 0.5 else f"<p>{text}</p>{button}"
        return f'<{tag} class="{r.choice(("cookie", "cookie-banner", "consent", "notice", "alert", "newsletter", "popup", "gdpr-notice", "subscribe"))}">{inner}</{tag}>'

    def search(self) -> str:
        r = self.r
        label = " ".join(self.words(r.randint(1, 4)))
        more = "".join(f"<label>{' '.join(self.words(2))}</label><input name=q{i}>" for i in range(r.randint(0, 4)))
        return f"<form{self.pick('search', 'login', 'contact', 'signup')}><p>{label}</p><input type=text>{more}<select><option>{self.words(1)[0]}</option></select><button>{self.words(1)[0]}</button></form>"

    def remarks(self) -> str:
        r = self.r
        tag = r.choice(("section", "div", "ul", "ol"))
        one = lambda: r.choice((f"<p>{self.prose(r.randint(3, 60))}</p>", f"<b>{self.words(1)[0]}</b><p>{self.prose(r.randint(3, 40))}</p><a href=#>{self.words(1)[0]}</a>"))
        item = "li" if tag in ("ul", "ol") else r.choice(("div", "article"))
        posts = "".join(f"<{item}{self.pick('comment', 'reply', 'comment-body')}>{one()}</{item}>" for _ in range(r.randint(1, 12)))
        title = f"<h2>{' '.join(self.words(2))}</h2>" if tag not in ("ul", "ol") else ""
        return f'<{tag} {r.choice(("class", "id"))}="{r.choice(("comments", "comment-list", "reader-comments", "discussion", "replies", "respond"))}">{title}{posts}{r.choice(("", self.search()))}</{tag}>'

    def paragraph(self) -> str:
        r = self.r
        n = r.choice((1, 3, 8, 20, 40, 60, 90, 140))
        text = self.prose(n)
        w = text.split(" ")
        if len(w) > 6 and r.random() < 0.3:
            i = r.randrange(len(w) - 2)
            w[i] = r.choice(("<b>{}</b>", "<i>{}</i>", "<a href=/x>{}</a>", "<em>{}</em>", "<span>{}</span>")).format(w[i])
        return self.MARK + " ".join(w)

    def blocks(self) -> str:
        r = self.r
        out, n = [], r.choice((1, 2, 3, 5, 8, 12, 20))
        loose = r.random() < 0.25
        for _ in range(n):
            x = r.random()
            text = self.paragraph()
            if x < 0.08:
                out.append(f"<h2>{self.MARK}{' '.join(self.words(r.randint(1, 8)))}</h2>")
            elif x < 0.13:
                out.append(f"<blockquote>{text}</blockquote>")
            elif x < 0.19:
                out.append("<ul>" + "".join(f"<li>{self.paragraph()}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.22:
                out.append("<table>" + "".join(f"<tr><td>{self.MARK}{self.words(1)[0]}</td><td>{self.MARK}{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif x < 0.25:
                out.append(self.advert())
            elif loose and x < 0.6:
                out.append(f"<p><b>{text}<br>")
            elif x < 0.30:
                out.append(f"<div>{text}</div>")
            else:
                out.append(f"<p>{text}</p>")
        return "".join(out)

    def page(self) -> str:
        r = self.r
        title = self.MARK + " ".join(self.words(r.randint(2, 14))).capitalize()
        kind = r.random()
        heading = f"<h1>{title}</h1>" if r.random() < 0.85 else f"<h2>{title}</h2>"
        if kind < 0.45:
            byline = f"<p{self.pick('byline', 'author', 'date', 'meta')}>{' '.join(self.words(3))}</p>" if r.random() < 0.15 else ""
            body = f"<article{self.pick('post', 'article', 'story') if r.random() < 0.3 else ''}>{heading}{byline}{self.blocks()}</article>"
        elif kind < 0.62:
            body = f"<main>{heading}{self.blocks()}</main>"
        elif kind < 0.92:
            inner = f"<div{self.pick('entry', 'text', 'body')}>{self.blocks()}</div>" if r.random() < 0.5 else self.blocks()
            body = f"<div{self.pick('content', 'main', 'post', 'article', 'story')}>{heading}{inner}</div>"
        else:
            body = heading + self.blocks()
        if r.random() < 0.15:
            body = body.replace("</article>", self.remarks() + "</article>", 1)
        before = [f() for f, p in ((self.head, 0.4), (self.menu, 0.75), (self.notice, 0.3), (self.advert, 0.5), (self.search, 0.15), (self.side, 0.15)) if r.random() < p]
        after = [f() for f, p in ((self.remarks, 0.35), (self.side, 0.35), (self.advert, 0.3), (self.menu, 0.2), (self.search, 0.15), (self.notice, 0.15)) if r.random() < p]
        r.shuffle(after)
        if r.random() < 0.6:
            r.shuffle(before)
        foot = self.foot() if r.random() < 0.8 else ""
        if r.random() < 0.4:
            body = f"<div{self.pick('container', 'wrapper', 'page', 'row')}>{body}{''.join(after)}</div>"
            after = []
        return f"<!DOCTYPE html><html><head><title>{' '.join(self.words(4))}</title></head><body>{''.join(before)}{body}{''.join(after)}{foot}</body></html>"


def labelled(pages: int = TRAINING_PAGES, seed: int = 11) -> list[tuple[str, str]]:
    """(html, expected text) of made pages."""
    maker = _Maker(seed)
    out = []
    for _ in range(pages):
        html = maker.page()
        _, runs, _ = nodes_of(html)
        text = "\n\n".join(t for t in (" ".join(run.replace(maker.MARK, "").split()) for _, run in runs if maker.MARK in run) if t)
        out.append((html.replace(maker.MARK, ""), text))
    return out


@lru_cache(maxsize=4)
def train(pages: int = TRAINING_PAGES, seed: int = 11) -> Boosted:
    """Train on made pages: a node's label is whether article text lies in it."""
    maker = _Maker(seed)
    xs, ys = [], []
    for _ in range(pages):
        html = maker.page()
        marked, runs, _ = nodes_of(html)
        good = {id(n) for n, run in runs if maker.MARK in run}
        for n in reversed(marked):
            n.label = int(id(n) in good or any(k.label for k in n.kids))
        plain, _, rows = nodes_of(html.replace(maker.MARK, ""))
        if len(plain) == len(marked):
            xs.append(rows)
            ys += [n.label for n in marked]
    return boost(np.concatenate([np.zeros((0, N_FEATURES), np.float32), *xs]).astype(np.float64), np.array(ys, dtype=float))


def decode(nodes: list[Node], odds: np.ndarray) -> set[int]:
    """Ids of kept nodes: the likeliest choice in which a dropped node has no kept descendant."""
    p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    yes, no = np.log(np.maximum(p, 1e-12)), np.log(np.maximum(1 - p, 1e-12))
    at = {id(n): i for i, n in enumerate(nodes)}
    drop, keep = no.copy(), yes.copy()
    for i in range(len(nodes) - 1, 0, -1):
        up = at[id(nodes[i].parent)]
        drop[up] += drop[i]
        keep[up] += max(keep[i], drop[i])
    kept: set[int] = set()
    for i, n in enumerate(nodes):
        if keep[i] > drop[i] and (n.parent is None or id(n.parent) in kept):
            kept.add(id(n))
    return kept


def extract(pages: list[str], model: Boosted) -> list[str]:
    """Main texts of whole pages."""
    parsed = [nodes_of(h) for h in pages]
    x = np.concatenate([np.zeros((0, N_FEATURES), np.float32), *(rows for _, _, rows in parsed)])
    odds = np.concatenate([np.zeros(0), *(model.log_odds(x[k : k + BATCH].astype(np.float64)) for k in range(0, len(x), BATCH))])
    at, out = 0, []
    for nodes, runs, rows in parsed:
        kept = decode(nodes, odds[at : at + len(rows)])
        at += len(rows)
        out.append("\n\n".join(run for node, run in runs if id(node) in kept))
    return out


def _extract(batches: Iterator[pa.RecordBatch], model: Boosted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            texts = extract([h or "" for h in part.column(2).to_pylist()], model)
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, model: Boosted | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page, (page_id, url, text): blocks of kept nodes in page order, joined by two newlines.

    Trees score every block element from its own and its subtree's statistics (text, links, tags, attribute words,
    depth, siblings, position); decoding keeps a node only with its ancestors. Pages are read where they lie, nothing
    is shuffled. Null, empty or unreadable html: an empty text. Null and repeated ids are carried. Empty table: no rows.
    """
    ship(pages.sparkSession)
    trees = model or train()
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return p.mapInArrow(lambda it: _extract(it, trees), p.drop("html").schema.add("text", "string"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
