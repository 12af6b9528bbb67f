"""HTML extraction by minimum-cut labelling.

A page is cut into text blocks at its block elements.  A linear classifier of each block (where it stands, its length, its
share of links) gives the cost of calling it content or boilerplate; these costs are the terminal capacities of a flow network.
Smoothness edges run between neighbouring blocks, weighted by how near they are in the tree, and between blocks of one parent.  The minimum
cut (maximum flow by Dinic's method) separates content from boilerplate; content blocks are joined in page order.

The classifier's weights are fitted by logistic regression to pages that ``templates`` makes, of which every block's label is known (``fitted``).  Names
in class, id and role are evidence and no verdict: negated ones (``ad-free``) say nothing, and a container named like boilerplate that holds
most of the text of a page without other content is not believed.

The scanner reads a page from left to right once.  Scripts, styles, markup, comments of the markup and form controls hold no text.  Character references
are decoded, white space inside a block becomes one space.

Defined results
* null or empty html, or no content block: the empty text; text outside any element: a block of its own;
* unclosed or wrongly nested elements are closed by what follows; a script or comment that does not end goes on to the end;
* a tag that does not end at the end of the page is dropped with what follows it; where a quote in a tag does not end before the next tag, the tag ends at its first ``>``;
* very long pages: memory and scanning time in proportion to the page; repeated rows alike; empty tables give empty results; extra columns are left alone.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without text of the page; those in the second list are skipped only where they are closed.
_RAW = frozenset("script style noscript textarea title iframe".split())
_SKIP = frozenset("template svg object select button".split())
_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_QUOTE_OR_END = re.compile("[>\"']")
# Elements that begin a block of text (fixed list, by HTML's own rules of display).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
_ENDS_P = BLOCKS
#: Words in class, id or role that tell what a container is for.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr header legal login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification notifications pager pagination popup promo promoted related replies respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe teaser toolbar warning widget".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())
_BOILER_TAGS = frozenset("nav footer aside menu dialog".split())
_CONTENT_TAGS = frozenset("article main".split())
#: Parts of a name that turn its meaning, and boilerplate words that are none beside a content word (article-header).
_TURNS = frozenset("free less no non not without with has".split())
_HEADS = frozenset("header banner".split())
_WORDS = re.compile(r"[a-z0-9]+")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
FEATURES = ("bias", "content", "boiler_tag", "boiler_name", "header_tag", "length", "links", "paragraph", "heading")
NEIGHBOUR, SIBLING, REACH = 1.2, 0.6, 4


class Block(NamedTuple):
    text: str
    node: int
    tag: str
    boiler: bool
    named: int
    content: bool
    header: bool
    links: float


class Page(NamedTuple):
    """Text blocks in order, and of every element its parent."""

    blocks: list[Block]
    parent: list[int]


def _tag_end(page: str, at: int, far: dict[str, int]) -> int:
    """The position of the ``>`` that ends the tag whose attributes begin at ``at``, or -1.  ``far`` remembers quotes that do not come any more."""
    while True:
        m = _QUOTE_OR_END.search(page, at)
        if not m:
            return -1
        if m[0] == ">":
            return m.start()
        k = m.start() - 1
        while page[k].isspace():
            k -= 1
        if page[k] != "=":  # no value begins here
            at = m.end()
            continue
        close = -1 if far.get(m[0], len(page)) <= m.end() else page.find(m[0], m.end())
        if close < 0:
            far[m[0]] = min(far.get(m[0], len(page)), m.end())
        first = page.find(">", m.end(), close if close >= 0 else len(page))
        if close < 0 or (first >= 0 and page.find("<", first, close) >= 0):
            return first
        at = close + 1


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``kind, name, attributes or text`` of texts ("text"), begin tags ("open") and end tags ("close"), in one pass."""
    at, n = 0, len(page)
    far: dict[str, int] = {}
    unclosed: set[str] = set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        close = page.startswith("</", lt)
        m = _NAME.match(page, lt + 1 + close)
        if not m:
            if close or page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "", "<"
                at = lt + 1
            continue
        end = _tag_end(page, m.end(), far)
        if end < 0:
            return
        name, attributes = m[0].lower(), page[m.end() : end]
        at = end + 1
        if close:
            yield "close", name, ""
        elif (name in _RAW or name in _SKIP) and not (name in _SKIP and (attributes.endswith("/") or name in unclosed)):
            stop = re.compile(rf"</{name}\b", re.I).search(page, at)
            if stop:
                end = page.find(">", stop.end())
                at = n if end < 0 else end + 1
            elif name in _RAW:
                return
            else:
                unclosed.add(name)
        else:
            yield "open", name, attributes


def _named(attributes: str) -> tuple[bool, bool]:
    """Whether class, id and role speak for boilerplate, and for content."""
    boiler = content = False
    for found in _NAMES.findall(attributes):
        for token in (found[0] or found[1] or found[2]).split():
            words = set(_WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower())) | set(_WORDS.findall(token.lower()))
            good, bad = words & CONTENT_WORDS, words & BOILER_WORDS
            content |= bool(good)
            boiler |= bool(bad - _HEADS if good else bad) and not words & _TURNS
    return boiler, content and not boiler


def page_blocks(page: str) -> Page:
    out: list[Block] = []
    parent = [-1]
    # an open element: number, tag, in boilerplate by tag, number of the outermost container named so (0: none), in content, in a header
    stack: list[tuple[int, str, bool, int, bool, bool]] = [(0, "", False, 0, False, False)]
    open_tags: Counter[str] = Counter()
    buffer: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                node, tag, boiler, named, content, header = stack[-1]
                out.append(Block(text, node, tag, boiler, named, content, header, min(1.0, linked / max(1, len(text)))))
            buffer.clear()
        linked = 0

    def pop() -> None:
        open_tags[stack.pop()[1]] -= 1

    for kind, tag, rest in _tokens(page):
        if kind == "text":
            buffer.append(rest)
            if in_link:
                linked += len(rest.strip())
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag == "a":
            in_link = kind == "open"
            continue
        if tag not in BLOCKS:
            continue
        flush()
        in_link = False
        if kind == "close":
            if open_tags[tag] > 0:
                while stack[-1][1] != tag:
                    pop()
                pop()
            continue
        while len(stack) > 1 and (stack[-1][1] == "p" or stack[-1][1] in ("li", "dd", "dt", "td", "th", "tr") and tag == stack[-1][1]):
            pop()
        if tag in _VOID:
            continue
        above, _, boiler, named, content, header = stack[-1]
        number = len(parent)
        parent.append(above)
        bad, good = _named(rest) if "=" in rest and tag not in ("html", "body") else (False, False)
        if tag in _BOILER_TAGS:
            boiler, content = True, False
        elif bad:
            named, content = named or number, False
        elif tag in _CONTENT_TAGS:
            named, content = 0, not boiler
        elif tag == "form":
            named, content = named or number, False
        elif good:
            content = content or not (boiler or named)
        stack.append((number, tag, boiler, named, content, header or (tag == "header" and not content)))
        open_tags[tag] += 1
    flush()
    return Page(_believed(out), parent)


def _believed(blocks: list[Block]) -> list[Block]:
    """Without the evidence of a named container that holds most of a page's text, if nothing else on the page is content by its place."""
    if any(b.content for b in blocks):
        return blocks
    size = Counter()
    for b in blocks:
        if not b.boiler:
            size[b.named] += len(b.text) * (1 - b.links)
    most = {k for k, n in size.items() if k and 2 * n > sum(size.values())}
    return [b._replace(named=0) if b.named in most else b for b in blocks]


def features_of(b: Block) -> list[float]:
    """The values of ``FEATURES``."""
    return [
        1.0, float(b.content), float(b.boiler), float(b.named > 0), float(b.header), math.log1p(min(len(b.text), 4000) / 40), b.links,
        float(b.tag in ("p", "blockquote", "pre", "li", "td")), float(b.tag in ("h1", "h2", "h3") and not b.header),
    ]


def content_score(b: Block, weights: tuple[float, ...]) -> float:
    """Log odds of content."""
    return sum(w * x for w, x in zip(weights, features_of(b), strict=True))


def templates(n: int, seed: int = 1) -> Iterator[str]:
    """Pages of which every block that begins with "good" is content and every other is not."""
    r = random.Random(seed)
    boiler, content = sorted(BOILER_WORDS - _HEADS), sorted(CONTENT_WORDS)

    def words(kind: str, lo: int, hi: int) -> str:
        return " ".join([kind, *("".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(lo, hi)))])

    def name(of: list[str], extra: tuple[str, ...]) -> str:
        return f' {r.choice(("class", "id"))}="{r.choice(of)}{r.choice(extra)}"'

    def links() -> str:
        return "<ul>" + "".join(f"<li><a href=/{k}>{words('bad', 0, 3)}</a></li>" for k in range(r.randint(2, 8))) + "</ul>"

    def aside(tag: str = "") -> str:
        inner = links() if r.random() < 0.4 else "".join(f"<p>{words('bad', 2, 40)}</p>" for _ in range(r.randint(1, 4)))
        tag = tag or r.choice(("div", "section", "nav", "footer", "aside", "div"))
        named = name(boiler, ("", "-box", "_area", " left")) if tag in ("div", "section") or r.random() < 0.3 else ""
        return f"<{tag}{named}>{inner}</{tag}>"

    for _ in range(n):
        body = [f"<h1>{words('good', 2, 10)}</h1>"]
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.72:
                link = f' <a href="/x">{words("good", 0, 2)}</a>' if r.random() < 0.15 else ""
                body.append(f"<p>{words('good', 2, 70)}{link}</p>")
            elif kind < 0.8:
                body.append(f"<h2>{words('good', 1, 6)}</h2>")
            elif kind < 0.88:
                body.append("<ul>" + "".join(f"<li>{words('good', 1, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                body.append(f"<blockquote>{words('good', 5, 40)}</blockquote>")
            else:
                body.append(aside("div"))
        around = r.random()
        tag, named = ("article", "") if around < 0.4 else ("main", "") if around < 0.6 else ("div", name(content, ("", "-body", " wide"))) if around < 0.85 else ("div", "")
        top = f"<header><div>{words('bad', 0, 4)}</div>{links()}</header>" if r.random() < 0.6 else ""
        sides = [aside() for _ in range(r.randint(1, 5))]
        at = r.randint(0, len(sides))
        loose = f"<div>{words('bad', 1, 5)}</div>" if r.random() < 0.3 else ""
        yield f"<html><body>{top}{''.join(sides[:at])}<{tag}{named}>{''.join(body)}</{tag}>{''.join(sides[at:])}{loose}<footer>{words('bad', 2, 12)}</footer></body></html>"


@functools.lru_cache(maxsize=4)
def fitted(pages: int = 240, seed: int = 1, ridge: float = 1.0, rounds: int = 12) -> tuple[float, ...]:
    """The classifier's weights in the order of ``FEATURES``: ridge logistic regression by Newton's method on blocks of ``templates``."""
    blocks = [b for page in templates(pages, seed) for b in page_blocks(page).blocks]
    x, y = np.array([features_of(b) for b in blocks]), np.array([b.text.startswith("good") for b in blocks], float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return tuple(np.round(w, 6).tolist())


class Flow:
    """Maximum flow by Dinic's method; nodes 0 .. n-1, source n, sink n+1."""

    def __init__(self, n: int) -> None:
        self.n, self.to, self.room, self.out = n, [], [], [[] for _ in range(n + 2)]

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.room.append(there)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def source_side(self) -> list[bool]:
        """Which nodes are on the source's side of a minimum cut."""
        n, to, room, out = self.n, self.to, self.room, self.out
        while True:
            level = [-1] * (n + 2)
            level[n] = 0
            todo = deque([n])
            while todo:
                a = todo.popleft()
                for e in out[a]:
                    if room[e] > 1e-9 and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        todo.append(to[e])
            if level[n + 1] < 0:
                return [x >= 0 for x in level[:n]]
            at = [0] * (n + 2)
            path: list[int] = []
            a = n
            while True:
                if a == n + 1:
                    push = min(room[e] for e in path)
                    for e in path:
                        room[e] -= push
                        room[e ^ 1] += push
                    k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                    a = to[path[k] ^ 1]
                    del path[k:]
                    continue
                while at[a] < len(out[a]):
                    e = out[a][at[a]]
                    if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] < len(out[a]):
                    path.append(out[a][at[a]])
                    a = to[path[-1]]
                elif path:
                    a = to[path.pop() ^ 1]
                    at[a] += 1
                else:
                    break


def _distance(a: int, b: int, parent: list[int]) -> int:
    """Steps in the tree between two elements, or REACH + 1 if there are more than REACH (numbers grow from the root down)."""
    steps = 0
    while a != b and steps <= REACH:
        if a > b:
            a = parent[a]
        else:
            b = parent[b]
        steps += 1
    return steps


def label(page: Page, weights: tuple[float, ...]) -> list[bool]:
    """Content or not, by a minimum cut."""
    blocks, parent = page
    n = len(blocks)
    net = Flow(n)
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        s = content_score(b, weights)
        if s > 0:
            net.edge(n, i, s)
        else:
            net.edge(i, n + 1, -s)
        if i:
            d = _distance(blocks[i - 1].node, b.node, parent)
            if d <= REACH:
                net.edge(i - 1, i, NEIGHBOUR / (1 + d), NEIGHBOUR / (1 + d))
        above = parent[b.node]
        if above in last and last[above] != i - 1:
            net.edge(last[above], i, SIBLING, SIBLING)
        last[above] = i
    return net.source_side()


def main_text(html: str | None, weights: tuple[float, ...] | None = None) -> str:
    page = page_blocks(html or "")
    if not page.blocks:
        return ""
    return "\n\n".join(b.text for b, yes in zip(page.blocks, label(page, weights or fitted()), strict=True) if yes)


def extract(pages: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars``; no shuffle.  The weights are fitted once, where the query is made."""
    weights = weights or fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = [main_text(h.as_py(), weights) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
