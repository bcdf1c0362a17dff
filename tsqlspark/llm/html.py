"""Operator 4, main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into block nodes (inline markup belongs to the block around it).  Each
node has features of its tag, attribute tokens, depth, siblings, subtree density and
ancestors.  Boosted trees give the log odds that a node belongs to the main text.
Decoding is hierarchical: a node can be kept only if its ancestors are, and the choice
with the largest sum of log odds over the tree is taken by dynamic programming.  If that is
to keep nothing although text stands outside links and what tags or attributes mark as
besides the article, the blocks of that text with the best odds are kept with their ancestors.

The trees are trained here, on generated pages whose templates and labels are known
(``training_pages``), not on the pages that are to be extracted: articles in telling
elements, in plain nested blocks, in cells of layout tables and directly in the body.

Defined results: a null, empty or text-free page gives an empty text; cut-off markup at
the end of a page is dropped, open elements end there; repeated rows each get a row; an empty
table gives no rows.  Only page_id, url and html are read.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import small_batches, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg(?=[\s/>])[^>]*/>|<(script|style|textarea|iframe)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(?:svg|noscript|template|select)(?=[\s>])[^>]*>(?:[^<]|<(?!/(?:svg|noscript|template|select)\s*>))*+</(?:svg|noscript|template|select)\s*>"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"'<]|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|<[a-zA-Z/!?][^<>]*\Z""",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?:class|id|role|itemprop|aria-label|data-component)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[a-z]+|[0-9]+")
_BLOCK = frozenset(
    "html head body title article main section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption form fieldset address details summary dialog menu hr center option button label video audio".split()
)
_CLOSES_P = _BLOCK - frozenset("html head body title p option button label video audio summary caption".split()) | {"p"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table html body".split())
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())

AWAY = frozenset(
    "nav navbar navigation menu header masthead footer foot side sidebar aside ad ads advert advertisement adverts promo promotion sponsor sponsored cookie cookies "
    "notice consent banner popup modal overlay comment comments discussion reply replies respond form login signup subscribe newsletter share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager widget toolbar search tags meta byline copyright legal privacy disclaimer gdpr alert toc contentinfo complementary".split()
)
TOWARDS = frozenset("article content main post entry body text story page maincontent".split())
_GROUPS = [
    ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "button", "label", "option", "dialog"), ("article",), ("main",), ("p", "blockquote", "pre"),
    ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("ul", "ol", "dl"), ("div", "section", "center"), ("table", "tr", "td", "th", "tbody"), ("body", "html"), ("head", "title"),
]
_GROUP_OF = {t: i for i, g in enumerate(_GROUPS) for t in g}


class Node:
    __slots__ = ("tag", "attrs", "up", "kids", "runs", "depth", "links", "chars", "marks", "index", "at")

    def __init__(self, tag, attrs, up, at=0):
        self.tag, self.attrs, self.up, self.at = tag, attrs, up, at
        self.depth = up.depth + 1 if up else 0
        self.kids, self.runs = [], []  # runs: (order, text)
        self.links = self.chars = self.marks = 0
        self.index = len(up.kids) if up else 0


def parse(html: str) -> tuple[Node, list[Node]]:
    """Root and all block nodes in page order.  A run of text between block tags goes to
    its block; what comes first and last in the page keeps its order."""
    root = Node("html", (), None)
    nodes, here, link, order, pending = [root], root, 0, 0, []

    def flush():
        nonlocal pending
        if pending:
            text = " ".join(unescape("".join(pending)).split())
            pending = []
            if text:
                here.runs.append((order, text))
                here.chars += len(text)
                here.marks += text.count(",") + text.count(".")

    def close(tag, stop):
        """Ends the innermost open ``tag`` unless a tag in ``stop`` is around it."""
        nonlocal here, order
        x = here
        while x.up is not None and x.tag != tag:
            if x.tag in stop:
                return
            x = x.up
        if x.up is not None:
            flush()
            order += 1
            here = x.up

    def text(s):
        if s:
            pending.append(s)
            if link:
                here.links += len(s)

    at = 0
    for m in _TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        tag, closing, attrs = name.lower(), (m[2] or m[5]) == "/", m[4] or m[7] or ""
        if tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            pending.append("\n")
        elif tag in _BLOCK:
            if closing:
                link = 0
                if tag not in ("html", "body"):
                    close(tag, ())
                continue
            if tag in ("html", "body"):
                if tag == "body":
                    flush()
                    here = Node("body", (), root, m.start())
                    root.kids.append(here)
                    nodes.append(here)
                continue
            if tag in _CLOSES_P:
                close("p", _SCOPE | {"div", "article", "section", "main", "li", "td", "aside", "nav"})
            for other in _SIBLING.get(tag, ()):
                close(other, _SCOPE)
            flush()
            order += 1
            if tag == "hr":
                continue
            words = frozenset(w for a in _ATTR.findall(attrs) for w in _SPLIT.findall(" ".join(a).lower())) if attrs else ()
            here = Node(tag, words, here, m.start())
            here.up.kids.append(here)
            nodes.append(here)
            link = 0
    text(html[at:])
    flush()
    return root, nodes


def features(nodes: list[Node], size: int) -> np.ndarray:
    """One row of features for each node of a page, in the order of ``nodes`` (ancestors first)."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    up = np.array([place[id(x.up)] if x.up is not None else -1 for x in nodes])
    chars, links, marks = (np.array([getattr(x, k) for x in nodes], dtype=np.float64) for k in ("chars", "links", "marks"))
    own, count, paragraphs = chars.copy(), np.ones(n), np.array([float(x.tag == "p") for x in nodes])
    away = np.array([float(len(AWAY.intersection(x.attrs))) if x.attrs else 0.0 for x in nodes])
    towards = np.array([float(len(TOWARDS.intersection(x.attrs))) if x.attrs else 0.0 for x in nodes])
    group = np.array([_GROUP_OF.get(x.tag, -1) for x in nodes])
    for i in range(n - 1, 0, -1):
        for a in (chars, links, marks, count, paragraphs):
            a[up[i]] += a[i]
    above = np.zeros((n, 5))  # away tokens, towards tokens, nav/header/footer/aside/form, article/main, head
    for i in range(1, n):
        p = up[i]
        above[i] = above[p]
        above[i] += (away[p], towards[p], 0 <= group[p] <= 4, group[p] in (5, 6), group[p] == 15)
    siblings = np.array([len(x.up.kids) if x.up is not None else 1 for x in nodes], dtype=np.float64)
    index = np.array([x.index for x in nodes], dtype=np.float64)
    around = np.array([chars[u] if u >= 0 else chars[0] for u in up])
    return np.column_stack([
        np.minimum([x.depth for x in nodes], 30), index / siblings, np.minimum(siblings, 50), np.minimum([len(x.kids) for x in nodes], 50), np.log1p(own), np.log1p(chars),
        links / np.maximum(chars, 1), chars / count, marks / np.maximum(chars, 1), np.log1p(paragraphs), chars / np.maximum(around, 1), np.minimum(away, 3),
        np.minimum(towards, 3), above, np.array([x.at for x in nodes]) / max(size, 1), *[group == i for i in range(len(_GROUPS))],
    ]).astype(np.float64)


class Boosted:
    """Gradient-boosted regression trees for log loss, on at most 32 bins a feature."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, least: int = 8):
        self.n, self.depth, self.rate, self.least = trees, depth, rate, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)])
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-9
            feature = np.full(2**self.depth - 1, -1)
            cut = np.full(2**self.depth - 1, np.inf)
            at = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                pick = np.full((width, 2), -1)
                for f in range(x.shape[1]):
                    bins = len(cuts[f]) + 1
                    if bins < 2:
                        continue
                    key = (at - first) * bins + binned[:, f]
                    sg, sh, sn = (np.bincount(key, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h, None))
                    tg, th, tn = sg[:, -1:], sh[:, -1:], sn[:, -1:]
                    gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    gain[(sn < self.least) | (tn - sn < self.least)] = 0
                    b = gain[:, :-1].argmax(1)
                    got = gain[np.arange(width), b]
                    better = got > best
                    best[better] = got[better]
                    pick[better, 0], pick[better, 1] = f, b[better]
                for k in range(width):
                    if pick[k, 0] >= 0:
                        feature[first + k], cut[first + k] = pick[k, 0], cuts[pick[k, 0]][pick[k, 1]]
                at = 2 * at + 1 + self._right(x, feature[at], cut[at])
            leaf = at - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    @staticmethod
    def _right(x, feature, cut):
        return (feature >= 0) & (x[np.arange(len(x)), np.maximum(feature, 0)] > cut)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + self._right(x, feature[at], cut[at])
            out += value[at - (2**self.depth - 1)]
        return out


def training_pages(n: int, seed: int = 4):
    """Generated pages with a label for each block: (html, texts of the main blocks)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(r.randint(1, 10)))
    prose = lambda a, b: " ".join(word() + ("," if r.random() < 0.08 else "." if r.random() < 0.1 else "") for _ in range(r.randint(a, b)))
    links = lambda k: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k))
    cls = lambda *names: r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{word()} {r.choice(names)}"'])

    plain = lambda: r.choice([f' class="{r.choice(["row", "col", "wrap", "container", "inner", "box", "page", "grid"])}"', f' id="{word()}"', f' class="{word()} {word()}"'])

    def away(kind):
        if kind == "nav":
            return r.choice([f"<nav><ul>{links(r.randint(2, 12))}</ul></nav>", f"<div{cls('nav', 'menu', 'navbar', 'main-menu', 'breadcrumbs')}><ul>{links(r.randint(2, 12))}</ul></div>"])
        if kind == "header":
            return r.choice([f"<header><h2>{word()}</h2><p>{prose(1, 8)}</p></header>", f"<div{cls('header', 'masthead', 'site-header')}><p>{prose(1, 8)}</p></div>"])
        if kind == "footer":
            return r.choice([f"<footer>&copy; {prose(1, 30)}</footer>", f"<footer><p>{prose(1, 30)}</p></footer>", f"<div{cls('footer', 'site-footer', 'copyright')}><p>{prose(1, 30)}</p></div>"])
        if kind == "aside":
            return r.choice([f"<aside><h3>{word()}</h3><p>{prose(2, 60)}</p><ul>{links(3)}</ul></aside>", f"<div{cls('sidebar', 'side', 'widget', 'related')}><p>{prose(2, 60)}</p></div>"])
        if kind == "notice":
            return f"<{'div' if r.random() < 0.8 else 'section'}{cls('cookie-notice', 'cookie', 'consent', 'notice', 'banner', 'alert')}><p>{prose(4, 50)}</p><button>{word()}</button></div>"
        if kind == "ad":
            return r.choice([f"<div{cls('ad', 'ads', 'advert', 'promo', 'sponsored')}>{prose(1, 30)}</div>", f"<div{cls('ad', 'advert', 'promo')}><p>{prose(1, 40)}</p></div>"])
        if kind == "form":
            return f"<form><label>{word()}</label><input name=q><p>{prose(1, 12)}</p><button>{word()}</button></form>"
        tag = r.choice(["div", "section", "ul"])
        item = "li" if tag == "ul" else "div"
        return f"<{tag}{cls('comments', 'discussion', 'replies', 'comment-list')}>" + "".join(f'<{item} class="comment"><p>{prose(3, 60)}</p></{item}>' for _ in range(r.randint(1, 5))) + f"</{tag}>"

    kinds = ["nav", "header", "footer", "aside", "notice", "ad", "form", "comments"]
    for _ in range(n):
        main = []

        def put(tag, a, b, end=None, main=main):
            t = prose(a, b)
            main.append(t)
            return f"<{tag}>{'<b>' if r.random() < 0.1 else ''}{t}{f'</{tag}>' if end is None and r.random() < 0.9 else '' if tag == 'p' else f'</{tag}>'}"

        body = [put("h1", 2, 14)] if r.random() < 0.9 else []
        for _ in range(r.choice([1, 2, 3, 5, 8, 20])):
            p = r.random()
            if p < 0.75:
                body.append(put("p", 1, r.choice([3, 20, 120])))
            elif p < 0.82:
                body.append(put(r.choice(["h2", "h3"]), 1, 8))
            elif p < 0.88:
                body.append("<ul>" + "".join(put("li", 1, 15) for _ in range(r.randint(2, 5))) + "</ul>")
            elif p < 0.92:
                body.append("<blockquote>" + put("p", 3, 40) + "</blockquote>")
            elif p < 0.94:
                body.append("<table><tr>" + "".join(put("td", 1, 4) for _ in range(3)) + "</tr></table>")
            elif p < 0.96:
                body.append(f"<div>{put('p', 3, 60)}</div>")
            else:
                body.append(away(r.choice(["ad", "aside", "notice", "form"])))
        inner = "".join(body)
        before, after = ([away(k) for k in r.sample(kinds, r.randint(0, 4))] for _ in range(2))
        wrap = r.random()
        if wrap < 0.4:
            inner = f"<article>{inner}</article>" if r.random() < 0.8 else f"<main><article>{inner}</article></main>"
        elif wrap < 0.5:
            inner = f"<main>{inner}</main>"
        elif wrap < 0.6:
            inner = f"<div{cls('content', 'post', 'entry-content', 'main', 'article-body', 'story')}>{inner}</div>"
        elif wrap < 0.75:  # blocks whose names tell nothing
            for _ in range(r.randint(1, 3)):
                inner = f"<{(tag := r.choice(['div', 'div', 'section']))}{r.choice(['', plain(), plain()])}>{inner}</{tag}>"
        elif wrap < 0.88:  # layout tables
            menu = f"<td><ul>{links(r.randint(3, 9))}</ul></td>" if r.random() < 0.6 else "<td>" + " ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(r.randint(3, 9))) + "</td>"
            side = f"<td{cls('sidebar', 'ads', 'promo', 'related')}>{prose(3, 40)}</td>" if r.random() < 0.4 else ""
            if r.random() < 0.3:
                main.clear()
                inner = prose(20, 200)
                main.append(inner)
            inner = f"<table><tr>{menu if r.random() < 0.7 else ''}<td>{inner}</td>{side}</tr></table>"
        page = f"<!DOCTYPE html><html><head><title>{prose(2, 8)}</title></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>"
        yield (page[: page.rfind("</p>") + 4] if r.random() < 0.05 and not after else page), main


TRAIN_PAGES = 900


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES) -> Boosted:
    xs, ys = [], []
    for html, main in training_pages(pages):
        _, nodes = parse(html)
        want, place = set(main), {id(x): i for i, x in enumerate(nodes)}
        y = np.zeros(len(nodes))
        for i in range(len(nodes) - 1, -1, -1):
            x = nodes[i]
            if any(t in want for _, t in x.runs):
                y[i] = 1
            if y[i] and x.up is not None:
                y[place[id(x.up)]] = 1
        xs.append(features(nodes, len(html)))
        ys.append(y)
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


#: Log odds by which a block may be worse than the best one where no block is likely to be main text.
NEAR_BEST = 1.5


def decode(nodes: list[Node], score: np.ndarray) -> list[bool]:
    """The kept nodes: closed under ancestors, with the largest sum of log odds."""
    place = {id(x): i for i, x in enumerate(nodes)}
    best = [float(s) for s in score]
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[place[id(nodes[i].up)]] += best[i]
    keep = [False] * len(nodes)
    for i, x in enumerate(nodes):
        keep[i] = best[i] > 0 and (x.up is None or keep[place[id(x.up)]])
    if not any(k and x.runs for x, k in zip(nodes, keep, strict=True)):
        beside = [False] * len(nodes)
        for i, x in enumerate(nodes):
            own = _GROUP_OF.get(x.tag, -1)
            beside[i] = 0 <= own <= 4 or own == 15 or bool(AWAY.intersection(x.attrs)) or (x.up is not None and beside[place[id(x.up)]])
        plain = [i for i, x in enumerate(nodes) if x.runs and not beside[i] and 2 * x.links < x.chars]
        top = max((score[i] for i in plain), default=0.0)
        for i in plain:
            x = nodes[i] if score[i] >= top - NEAR_BEST else None
            while x is not None and not keep[place[id(x)]]:
                keep[place[id(x)]] = True
                x = x.up
        for i, x in enumerate(nodes):  # ancestors lend no text of their own here
            keep[i] = keep[i] and (i in plain or not x.runs)
    return keep


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    parsed = [parse(h)[1] for h in (p or "" for p in pages)]
    if not parsed:
        return []
    scores = model.score(np.concatenate([features(n, len(p or "")) for n, p in zip(parsed, pages, strict=True)]))
    out, at = [], 0
    for nodes in parsed:
        keep = decode(nodes, scores[at : at + len(nodes)])
        at += len(nodes)
        runs = sorted(run for x, k in zip(nodes, keep, strict=True) if k for run in x.runs)
        out.append("\n".join(t for _, t in runs))
    return out


def main_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    small_batches(pages.sparkSession, 500)
    model = model or trained()

    def run(batches):
        for b in batches:
            text = extract(b.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
