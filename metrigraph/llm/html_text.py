"""Main-text extraction from HTML by minimum-cut labelling.

A page becomes blocks of text in page order. A classifier of rules gives each block the cost of calling
it content and the cost of calling it boilerplate; these are its terminal capacities. Neighbouring blocks
share smoothness edges, stronger the nearer they stand in the DOM. The minimum cut of that graph, found
by maximum flow (Dinic), is the cheapest labelling of all blocks together; content blocks are joined.

The rule weights are fixed parameters: the pages carry no labels to learn from.

Defined results: null and empty html give empty text; broken markup never fails: a stray end tag is
ignored, an open element ends with its parent, an open comment, script or tag runs to the page's end.
White space is what str.split() splits at, decoded no-break spaces included. Text of formulas, drawings, objects and
noscript elements is text like any other. Ties of the cut go to boilerplate. Very long pages are labelled whole.
Repeated rows give equal rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|template|textarea|select|iframe|title)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_HINT = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = re.compile(r"[.!?…:;]")

# Element names by their meaning in HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
FOREIGN = frozenset(
    "svg g path circle ellipse line polygon polyline rect defs use symbol text tspan textpath desc marker mask pattern clippath lineargradient radialgradient stop filter "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mtable mtr mtd mspace mstyle mpadded mphantom menclose mfenced semantics annotation".split()
)
INLINE |= FOREIGN | {"object"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table tbody thead tfoot article section div body main aside nav form header footer blockquote".split())
#: Weight of an element among a block's ancestors; above 0 speaks for content.
TAGS = {"article": 4.0, "main": 3.0, "nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "button": -8.0, "head": -20.0, "header": -7.0, "noscript": -2.0}
#: Weight of a word in a class, id or role.
HINTS = {
    **dict.fromkeys("article content entry post story body text main".split(), 1.5),
    **dict.fromkeys("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner".split(), -8.0),
    **dict.fromkeys("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sidebar aside widget widgets related recommended trending teaser teasers".split(), -8.0),
    **dict.fromkeys("footer header masthead topbar copyright legal".split(), -7.0),
    **dict.fromkeys("comment comments commentlist disqus reply replies respond discussion reactions".split(), -9.0),
    **dict.fromkeys("cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login paywall".split(), -8.0),
    **dict.fromkeys("share sharing social tags form search".split(), -7.0),
}


@dataclass(frozen=True)
class Params:
    bias: float = -0.8
    per_char: float = 0.012
    most_length: float = 2.5
    sentence: float = 0.8
    links: float = -4.0
    heading: float = 0.5
    near: float = 1.2
    fall: float = 0.35


def _hints(attrs: str) -> float:
    total = 0.0
    for m in _HINT.finditer(attrs):
        found = {HINTS.get(w.lower(), 0.0) for w in _PIECE.findall(m[1] or m[2] or m[3] or "")}
        low, high = min(found, default=0.0), max(found, default=0.0)
        total += low if low < 0 else high
    return total


class Blocks:
    """Blocks of a page: text, characters inside links, weight of the ancestors, path, whether a heading."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.link: list[int] = []
        self.weight: list[float] = []
        self.path: list[tuple[int, ...]] = []
        self.heading: list[bool] = []
        stack: list[tuple[str, int, float]] = []  # name, number, weight of it and what is around it
        parts: list[str] = []
        self._n, in_link, linked, at = 0, 0, 0, 0

        def flush() -> None:
            nonlocal linked
            if parts and (text := " ".join("".join(parts).split())):
                blocks = [x for x in stack if x[0] not in INLINE]
                self.text.append(text)
                self.link.append(linked)
                self.weight.append(stack[-1][2] if stack else 0.0)
                self.path.append(tuple(x[1] for x in blocks))
                self.heading.append(any(x[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for x in blocks[-2:]))
            parts.clear()
            linked = 0

        def put(raw: str) -> None:
            nonlocal linked
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

        def close(k: int) -> None:
            nonlocal in_link
            in_link -= sum(x[0] == "a" for x in stack[k:])
            del stack[k:]

        for m in _TOKEN.finditer(page):
            if m.start() > at:
                put(page[at : m.start()])
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if name == "br" or name == "img":
                parts.append(" ")
                continue
            if name not in INLINE:
                flush()
            if m[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                    if name in INLINE and stack[k][0] not in INLINE:
                        break  # an inline end tag doesn't close blocks
            elif name not in VOID:
                if name not in INLINE:
                    for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                        if stack[k][0] == "p":
                            close(k)
                            break
                        if stack[k][0] in SCOPE:
                            break
                    ends = CLOSES.get(name, ())
                    for k in range(len(stack) - 1, -1, -1) if ends else ():
                        if stack[k][0] in ends:
                            close(k)
                            break
                        if stack[k][0] in SCOPE:
                            break
                around = stack[-1][2] if stack else 0.0
                own = TAGS.get(name, 0.0)
                if name == "header" and any(x[0] in ("article", "main") for x in stack):
                    own = 0.0  # an article's own heading
                if name not in ("html", "body") and m[4]:
                    own += _hints(m[4])
                self._n += 1
                if name in FOREIGN and m[4].rstrip().endswith("/"):
                    continue  # in drawings and formulas such an element is empty
                stack.append((name, self._n, around + own))
                in_link += name == "a"
        if at < len(page):
            put(page[at:])
        flush()


def costs(b: Blocks, p: Params) -> list[float]:
    """Of each block, how much cheaper "content" is than "boilerplate"."""
    out = []
    for text, link, weight, heading in zip(b.text, b.link, b.weight, b.heading, strict=True):
        x = p.bias + weight + min(p.most_length, p.per_char * len(text)) + p.links * min(1.0, link / len(text))
        x += p.sentence * bool(_END.search(text)) + p.heading * heading
        out.append(x)
    return out


def edges(b: Blocks, p: Params) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours in page order, and between blocks next but one under the same parent."""
    out = []
    for i in range(len(b.text) - 1):
        for j in (i + 1, i + 2):
            if j == len(b.text):
                break
            x, y = b.path[i], b.path[j]
            k = 0
            for s, t in zip(x, y):  # noqa: B905
                if s != t:
                    break
                k += 1
            far = len(x) + len(y) - 2 * k
            if j == i + 1:
                out.append((i, j, p.near * p.fall ** max(0, far - 2)))
            elif x[:-1] == y[:-1]:
                out.append((i, j, p.near / 2))
    return out


def min_cut(gain: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of the minimum cut: node i prefers True by gain[i]; a cut link costs its capacity. Dinic's maximum flow."""
    n = len(gain)
    if all(g > 0 for g in gain) or not any(g > 0 for g in gain):
        return [g > 0 for g in gain]  # no edge is worth cutting
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def add(u: int, v: int, forth: float, back: float) -> None:
        head[u].append(len(to))
        head[v].append(len(to) + 1)
        to.extend((v, u))
        cap.extend((forth, back))

    for i, g in enumerate(gain):
        if g > 0:
            add(s, i, g, 0.0)
        elif g < 0:
            add(i, t, -g, 0.0)
    for u, v, w in links:
        add(u, v, w, w)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for u in queue:
            for e in head[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        place = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while place[u] < len(head[u]):
                e = head[u][place[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                place[u] += 1
            if place[u] < len(head[u]):
                path.append(head[u][place[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                place[u] += 1
            else:
                break


def main_text(page: str | None, p: Params = Params()) -> str:
    b = Blocks(page or "")
    keep = min_cut(costs(b, p), edges(b, p))
    return " ".join(t for t, k in zip(b.text, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url"), p: Params = Params()) -> DataFrame:
    """The carried columns with the page's main text."""
    kept = pages.select(*carry, F.col(html_col).alias("_html"))
    schema = kept.drop("_html").withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x.as_py(), p) for x in batch["_html"]], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in carry], text], [*carry, "text"])

    return kept.mapInArrow(run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
