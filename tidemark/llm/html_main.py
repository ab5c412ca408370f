"""Main text of web pages: boosted trees over DOM nodes, with hierarchical decoding.

A page is cut into block nodes; inline markup is transparent. Each node has features of its tag, attribute tokens, depth,
subtree density, links and siblings. Gradient-boosted trees, trained here on made pages whose main text is known, give each
node's odds of belonging to the main text. Decoding maximises the sum of log odds over the page under one rule: a node
can be kept only if its parent is. So no kept node lies inside a dropped one. Pages are independent; nothing is shuffled.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, with raw content, of inline markup, and what closes an open paragraph.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "template", "noscript", "iframe", "title", "textarea", "svg", "noembed", "noframes", "xmp", "canvas", "audio", "video", "select"}
#: Of these, those that a slash in the tag closes; and of the others, those whose content is text to the end tag, whatever it holds.
FOREIGN = {"svg"}
VERBATIM = {"script", "style", "textarea", "title", "xmp"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "meter", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "math", "mi", "mn", "mo", "mrow", "msup", "msub", "mfrac", "msqrt", "mtext", "semantics", "object"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"datalist"})}

TAGS = [{"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li"}, {"ul", "ol", "dl", "menu"}, {"div"}, {"section"}, {"article", "main"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "button", "fieldset", "dialog"}, {"table", "tr", "td", "th", "tbody"}, {"blockquote", "pre", "figure", "figcaption"}, {"html", "body", "head"}]
WORDS = [
    {"article", "content", "main", "post", "entry", "story", "text", "body", "prose"},
    {"ad", "ads", "advert", "advertisement", "adverts", "banner", "promo", "promoted", "sponsor", "sponsored"},
    {"nav", "navigation", "menu", "navbar", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "topbar"},
    {"comment", "comments", "discussion", "reply", "replies", "respond", "reader"},
    {"cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "newsletter", "subscribe", "alert", "paywall", "overlay", "signup"},
    {"sidebar", "aside", "widget", "related", "recommended", "share", "sharing", "social", "trending", "popular", "tags"},
    {"header", "masthead", "footer", "copyright", "foot", "legal", "bottom", "top"},
    {"form", "search", "login", "hidden", "none", "contact"},
]
_TAG = {t: k for k, group in enumerate(TAGS) for t in group}
_GROUP = {w: k for k, group in enumerate(WORDS) for w in group}
#: A quote opens a value only behind an equals sign; elsewhere it is a character of the tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^<>\"'=]+|=\s*+(?>\"[^\"]*\"|'[^']*')|[=\"'])*+)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"(class|id|role|style|hidden|aria-label|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    tags: list[str]
    attrs: list[str]
    parents: list[int]
    depths: list[int]
    blocks: list[tuple[int, str]]  # (node, text) in page order
    link_chars: list[int]


def raw_end(source: str, at: int, tag: str, attrs: str, parent: str) -> int:
    """Where the content of a raw element ends: behind its end tag; one without an end tag ends where its parent does, or at once."""
    if tag in FOREIGN and attrs.rstrip().endswith("/"):
        return at
    close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
    if close and (tag in VERBATIM or not re.compile(rf"<{re.escape(tag)}[\s>]", re.I).search(source, at, close.start()) or tag in FOREIGN):
        return close.end()
    end = re.compile(rf"</{re.escape(parent)}\s*>", re.I).search(source, at) if parent != "#" else None
    return end.start() if end else at


def parse(source: str) -> Page:
    """Block nodes in page order, parents before children, and the runs of text that lie directly in them."""
    page = Page(["#"], [""], [-1], [0], [], [0])
    stack, text, owner = [0], [], 0
    in_link = False

    def end_run() -> None:
        nonlocal text
        if text:
            run = " ".join(html.unescape("".join(text)).split())
            if run:
                page.blocks.append((owner, run))
            text = []

    at = 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        piece = source[at : m.start()] if m else source[at:]
        if piece:
            text.append(piece)
            if in_link:
                page.link_chars[stack[-1]] += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in INLINE:
                pass
            else:
                k = next((k for k in range(len(stack) - 1, 0, -1) if page.tags[stack[k]] == tag), 0)
                if k:
                    end_run()
                    del stack[k:]
                    owner, in_link = stack[-1], False
            continue
        if tag in RAW:
            at = raw_end(source, at, tag, m[3], page.tags[stack[-1]])
            text.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = True
            elif tag == "br":
                text.append(" ")
            continue
        end_run()
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            k = len(stack) - 1
            if page.tags[stack[k]] == "p":
                del stack[k:]
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if page.tags[stack[k]] in stops:
                    break
                if page.tags[stack[k]] in ends:
                    del stack[k:]
                    break
        page.tags.append(tag)
        page.attrs.append(m[3])
        page.parents.append(stack[-1])
        page.depths.append(len(stack))
        page.link_chars.append(0)
        if not m[3].rstrip().endswith("/"):
            stack.append(len(page.tags) - 1)
        owner, in_link = stack[-1], False
    end_run()
    return page


HASHED = 24


def attribute_features(attrs: str) -> np.ndarray:
    out = np.zeros(len(WORDS) + HASHED)
    if attrs.strip():
        for m in _ATTR.finditer(attrs):
            value = next((x for x in m.groups()[1:] if x is not None), m[1])
            for w in _PART.findall(value.replace("-", " ").replace("_", " ")):
                w = w.lower()
                group = _GROUP.get(w, _GROUP.get(w.rstrip("s")))
                if group is not None:
                    out[group] = 1
                else:
                    out[len(WORDS) + zlib.crc32(w.encode()) % HASHED] = 1
            if m[1].lower() == "hidden":
                out[7] = 1
    return out


_EMPTY = attribute_features("")


def features(page: Page) -> np.ndarray:
    n = len(page.tags)
    parent = np.array(page.parents)
    depth = np.array(page.depths, float)
    tag = np.zeros((n, len(TAGS)))
    for k, t in enumerate(page.tags):
        if t in _TAG:
            tag[k, _TAG[t]] = 1
    attrs = np.array([attribute_features(a) if a else _EMPTY for a in page.attrs])
    own, marks = np.zeros(n), np.zeros(n)
    for k, t in page.blocks:
        own[k] += len(t)
        marks[k] += t.count(".") + t.count(",") + t.count("。")
    chars, links, tags, punct = own.copy(), np.array(page.link_chars, float), np.ones(n), marks
    paragraphs = tag[:, 0] * (own > 40)
    for k in range(n - 1, 0, -1):  # children come after their parents
        p = parent[k]
        chars[p] += chars[k]
        links[p] += links[k]
        tags[p] += tags[k]
        punct[p] += punct[k]
        paragraphs[p] += paragraphs[k]
    up = np.maximum(parent, 0)
    children = np.bincount(up[1:], minlength=n).astype(float)
    order, seen, same, last = np.zeros(n), {}, np.zeros(n), {}
    for k in range(1, n):
        order[k] = seen[parent[k]] = seen.get(parent[k], -1) + 1
        same[k] = last[(parent[k], page.tags[k])] = last.get((parent[k], page.tags[k]), 0) + 1
    siblings = children[up]
    alike = np.array([last.get((parent[k], page.tags[k]), 1) for k in range(n)], float) / np.maximum(siblings, 1)
    number = np.stack([
        depth, np.log1p(chars), np.log1p(own), np.log1p(chars / tags), links / np.maximum(chars, 1), children, order / np.maximum(siblings - 1, 1), siblings, alike,
        chars / max(chars[0], 1), chars / np.maximum(chars[up], 1), punct / np.maximum(chars, 1) * 100, np.log1p(paragraphs), np.arange(n) / n, (links / np.maximum(chars, 1))[up],
    ], axis=1)
    return np.concatenate([number, tag, attrs, tag[up], attrs[up][:, : len(WORDS)]], axis=1)


@dataclass
class Trees:
    """Boosted trees of one depth: feature, cut and value arrays in heap order, a row for each tree."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while node[0] < inner if len(node) else False:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 16, ridge: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss with histograms of at most bins values."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(n, base)
    inner = 2**depth - 1
    features_, cuts_, values_ = (np.zeros((trees, k), t) for k, t in ((inner, int), (inner, float), (inner + 1, float)))
    column = np.arange(d) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * d * bins + column + binned).reshape(-1)
            gs = np.bincount(key, np.repeat(g, d), minlength=width * d * bins).reshape(width, d, bins).cumsum(2)
            hs = np.bincount(key, np.repeat(h, d), minlength=width * d * bins).reshape(width, d, bins).cumsum(2)
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (g_all - gs) ** 2 / (h_all - hs + ridge) - g_all**2 / (h_all + ridge)
            gain[:, :, -1] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                features_[t, first + k] = j
                good = b < len(cuts[j]) and gain[k, j, b] > 1e-9
                cuts_[t, first + k] = cuts[j][b] if good else np.inf
            f = features_[t, node]
            node = 2 * node + 1 + (x[np.arange(n), f] > cuts_[t, node])
        leaf = node - inner
        values_[t] = rate * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + ridge)
        score += values_[t][leaf]
    return Trees(base, features_, cuts_, values_)


def made_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page from a family of layouts, and its texts that belong to the main text. Words are made of random syllables."""
    syllables = ["ka", "lo", "mi", "ren", "tu", "ves", "an", "or", "pel", "sho", "di", "ni", "é", "ü", "за", "кон"]

    def word() -> str:
        return "".join(rng.choices(syllables, k=rng.randrange(1, 5)))

    def prose(least: int, most: int) -> str:
        out = []
        for _ in range(rng.randrange(least, most)):
            w = [word() for _ in range(rng.randrange(3, 18))]
            out.append(w[0].capitalize() + " " + " ".join(w[1:]) + ".")
        return " ".join(out)

    def title() -> str:
        return rng.choice([" ", " ", " ", ", ", " | ", "*** "]).join(word() for _ in range(rng.randrange(1, 14))) + rng.choice(["", "", ".", " |", ","])

    pick = lambda *x: rng.choice(x)
    chance = lambda p: rng.random() < p
    main: set[str] = set()

    def own(t: str) -> str:
        main.add(" ".join(t.split()))
        return t

    def named(kind: str) -> str:
        return pick(f' class="{kind}"', f' id="{kind}"', f' class="{kind} box"', f' class="site-{kind}"', f' id="{kind}-{rng.randrange(9)}"')

    def menu() -> str:
        items = "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(rng.randrange(2, 9)))
        return pick(f"<nav><ul>{items}</ul></nav>", f"<nav>{items}</nav>", f"<div{named('menu')}><ul>{items}</ul></div>", f'<div{named("breadcrumb")}>{" ".join(f"<a href=/>{word()}</a>" for _ in range(4))}</div>')

    def junk() -> str:
        kind = rng.randrange(9)
        short = prose(1, 3)
        if kind == 0:
            return f"<div{named(pick('ad', 'advert', 'sponsor', 'promo', 'banner'))}>{short}</div>"
        if kind == 1:
            return f"<aside{pick('', named('sidebar'))}><h3>{word()}</h3><p>{prose(1, 4)}</p></aside>"
        if kind == 2:
            return f"<div{named(pick('cookie', 'consent', 'notice', 'newsletter'))}>{pick('<p>', '')}{short} <button>{word()}</button></div>"
        if kind == 3:
            return f'<form action="/s"{pick("", named("search"))}><label>{word()}</label> <input name="q"> {short}<button>{word()}</button></form>'
        if kind == 4:
            return f"<div{named(pick('sidebar', 'widget', 'related', 'share'))}><h4>{word()}</h4><ul>" + "".join(f"<li><a href=/>{prose(1, 2)}</a></li>" for _ in range(rng.randrange(2, 6))) + "</ul></div>"
        if kind == 5:
            said = "".join(f"<div class=\"comment\"><b>{word()}</b><p>{prose(1, 5)}</p></div>" for _ in range(rng.randrange(1, 5)))
            return pick(f"<section{named('comments')}><h3>{word()}</h3>{said}</section>", f"<div{named('comments')}>{said}</div>", f"<ol{named('comments')}>" + said.replace("<div", "<li").replace("</div>", "</li>") + "</ol>")
        if kind == 6:
            return menu()
        if kind == 7:
            return f"<p{named(pick('notice', 'legal', 'promo'))}>{short}</p>"
        return f"<div{named(pick('ad', 'ads'))}><p>{short}</p><p>{prose(1, 2)}</p></div>"

    def junk_some(p: float) -> str:
        return "".join(junk() for _ in range(4) if chance(p))

    parts = []
    if chance(0.9):
        parts.append(f"<h1>{own(title())}</h1>")
    closing = chance(0.7)
    for _ in range(rng.randrange(1, 9)):
        kind = rng.random()
        if kind < 0.72:
            start = pick("<p>", "<p>", "<p>", "<p><b>", '<p class="text">', "<div>" if closing else "<p>")
            t = own(prose(1, 9) if chance(0.9) else title())
            parts.append(f"{start}{t}" + (pick("<br>", "") + "</p>" if start[1] == "p" and closing else "</div>" if start == "<div>" else pick("<br>", "")))
        elif kind < 0.8:
            parts.append(f"<h2>{own(title())}</h2>")
        elif kind < 0.88:
            parts.append("<ul>" + "".join(f"<li>{own(prose(1, 3))}</li>" for _ in range(rng.randrange(2, 5))) + "</ul>")
        elif kind < 0.92:
            parts.append(f"<blockquote>{own(prose(1, 4))}</blockquote>")
        elif kind < 0.935:
            parts.append(f"<details><summary>{own(title())}</summary><p>{own(prose(1, 4))}</p></details>")
        elif kind < 0.945:
            parts.append(f"<figure><img src=/{word()}.png><figcaption>{own(prose(1, 2))}</figcaption></figure>")
        elif kind < 0.965:
            parts.append(f"<table><tr><td>{own(prose(1, 2))}</td><td>{own(prose(1, 2))}</td></tr></table>")
        else:
            parts.append(junk())
    body = "".join(parts) + (junk() if chance(0.15) else "")
    open_, close = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div{named(pick('content', 'article', 'post', 'main'))}>", "</div>"), (f"<section{named('content')}>", "</section>"), ("<div>", "</div>"))
    head = pick("", f"<header{pick('', named('header'))}><h2>{word()}</h2><p>{prose(1, 2)}</p></header>", f"<div{named('header')}>{word()} {word()}</div>")
    foot = pick(f"<footer>&copy; {word()} &middot; {prose(1, 3)}</footer>", f"<footer><p>{prose(1, 3)}</p>{menu()}</footer>", f"<div{named('footer')}>&copy; {prose(1, 3)}</div>", "")
    inside = head + (menu() if chance(0.85) else "") + junk_some(0.2) + open_ + body + close + junk_some(0.25) + foot
    if chance(0.3):
        inside = f"<div{pick('', named('page'), named('wrapper'))}>{inside}</div>"
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{word()}</title>{pick("", f"<style>.{word()}{{color:red}}</style>")}{pick("", f"<script>{word()}()</script>", f"<script>if(1<2){{{word()}()}}</script>")}</head><body>{inside}' + pick("</body></html>", ""), main


_TRAINED: dict[tuple[int, int], Trees] = {}


def labelled(page: Page, main: set[str]) -> np.ndarray:
    """1 for nodes that hold or contain main text."""
    y = np.zeros(len(page.tags))
    for k, t in page.blocks:
        if t in main:
            y[k] = 1
    for k in range(len(y) - 1, 0, -1):
        y[page.parents[k]] = max(y[page.parents[k]], y[k])
    return y


def trained(pages: int = 400, seed: int = 3) -> Trees:
    """A model fitted on made pages; the same for the same arguments, on any machine."""
    if (pages, seed) not in _TRAINED:
        rng = random.Random(seed)
        xs, ys = [], []
        for _ in range(pages):
            source, main = made_page(rng)
            page = parse(source)
            xs.append(features(page))
            ys.append(labelled(page, main))
        _TRAINED[(pages, seed)] = boost(np.concatenate(xs), np.concatenate(ys))
    return _TRAINED[(pages, seed)]


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """The kept nodes: the best sum of log probabilities of which each node's parent is kept too. The root is kept."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    drop = no.copy()  # the whole subtree dropped
    best = np.zeros(len(odds))  # of the children of a kept node
    n = len(odds)
    keep = np.zeros(n, bool)
    parents = page.parents
    for k in range(n - 1, 0, -1):
        keep[k] = yes[k] + best[k] > drop[k]
        best[parents[k]] += max(yes[k] + best[k], drop[k])
        drop[parents[k]] += drop[k]
    keep[0] = True
    for k in range(1, n):
        keep[k] &= keep[parents[k]]
    return keep


def main_texts(sources: list[str], model: Trees) -> list[str]:
    pages = [parse(s) for s in sources]
    x = [features(p) for p in pages]
    odds = model.odds(np.concatenate(x)) if x else np.empty(0)
    out, at = [], 0
    for p in pages:
        keep = decode(p, odds[at : at + len(p.tags)])
        at += len(p.tags)
        out.append("\n".join(t for k, t in p.blocks if keep[k]))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Trees | None = None) -> DataFrame:
    """One row per row of pages: the id, url, text of the main content (empty if none), n_chars (its code points).

    Null or empty pages have an empty text. Ids and urls may be null or repeated; other columns don't matter. An empty table gives an empty
    result. Raw elements (scripts, frames, drawings) count for nothing; one that never ends costs the rest of its parent at most.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model or trained())  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = 0
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            while i < batch.num_rows:
                j, size = i + 1, sizes[i]
                while j < batch.num_rows and j - i < 256 and size < 1 << 20:
                    size += sizes[j]
                    j += 1
                texts = main_texts([x or "" for x in batch.column(2).slice(i, j - i).to_pylist()], shipped.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])
                i = j

    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
