"""Main text of HTML pages by minimum-cut labelling.

A page is read once into blocks (runs of text between block-level tags).  A
fixed linear classifier gives every block its log-odds of being content, from its
ancestors, tags, length and links: the capacity to the source where they are
positive, to the sink where negative.  Smoothness edges join neighbours in page
order, the weaker the more containers lie between them, and blocks that follow
each other under the same parent.  The minimum cut, found by maximum flow,
separates content from boilerplate.  Blocks inside containers that the page marks
as boilerplate get a capacity no edges outweigh; all other capacities are of the
edges' order, so a short line among paragraphs stays and a run of bare links goes.

A boilerplate container keeps all it holds, marked content too.  Only if nothing
is left of a page that way, an ``article`` or ``main`` inside a form or a
container with a boilerplate name counts (a form or a layout around the page).

Scripts, styles, buttons and the like never become blocks.  Character references
are decoded, white space inside a block becomes one space, blocks are joined in
page order by one space; nothing is dropped from a content block and no length
is capped.  Broken markup is read as far as it goes: a ``<`` that opens no tag
is text, a quote that never closes is part of its tag up to the next ``>``,
unclosed elements end with their parent, hidden ones without any end tag ahead at
the next block; only unclosed scripts, styles and other raw text reach the end.

A null page counts as empty; a page without content has the text ``''`` and
n_chars 0.  Every row is handled alone, so repeated rows give repeated results
and an empty table an empty one.  Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwise.llm.worker_cache import per_worker

_MARKUP = re.compile(
    r"""<!--(?:(?!-->).)*+(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s]++))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea iframe noembed noframes".split())
HIDDEN_TAGS = frozenset("audio button canvas noscript object select svg template video".split())
MAY_HOLD_ARTICLES = frozenset(["noscript", "template"])  # the other hidden tags end where an article starts
CLOSED_BY_BLOCK = frozenset(["p"])
SAME_KIND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
BOILER_TAGS = frozenset("nav footer aside form head menu dialog search fieldset label".split())
CONTENT_TAGS = frozenset(["article", "main"])
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies "
    "copyright cta dialog disclaimer disqus donate footer gdpr login menu menus modal nav navbar navigation newsletter notice notices notification "
    "pager pagination paywall popup promo promotion promotions recommended register related reply replies respond response responses search share "
    "sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription survey tags teaser toc toolbar trending widget widgets".split()
)
CONTENT_NAMES = frozenset("article articlebody body content entry main post story text".split())
NOT_NAMES = frozenset("has no not with without".split())

ATTRIBUTES_KEPT = 4096  # per worker
NEIGHBOUR, SIBLING = 1.6, 0.8  # capacities of the smoothness edges; a neighbour's is divided by 1 + half the containers between
HARD = 1000.0  # capacity of marked boilerplate, above all its edges
HIDDEN = -2  # kind of a container whose text is not read at all


def _kind(tag: str, attributes: str) -> int:
    """-1 boilerplate container, 1 content container, 0 neither, from the tag and its attributes."""
    if tag in BOILER_TAGS:
        return -1
    kind = 1 if tag in CONTENT_TAGS else 0
    if attributes.strip():
        known = per_worker("attributes", dict)
        key = (tag, attributes, kind)
        if key not in known:
            if len(known) >= ATTRIBUTES_KEPT:
                known.clear()
            known[key] = _attribute_kind(tag, attributes, kind)
        kind = known[key]
    return kind


def _attribute_kind(tag: str, attributes: str, kind: int) -> int:
    found = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] else value)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return -1
    role = found.get("role", "").lower()
    if role in BOILER_ROLES:
        return -1
    if role in ("main", "article"):
        return 1
    if tag in ("html", "body"):
        return kind
    for value in (*found.get("class", "").split(), *found.get("id", "").split(), found.get("itemprop", "")):
        ordered = [n.lower() for n in _NAME.findall(value)]
        names = set(ordered)
        if names & NOT_NAMES:
            continue
        # classes of an article name its topic too, so only a leading name tells (comment, related-item)
        if ordered[0] in BOILER_NAMES if kind and tag in CONTENT_TAGS and ordered else names & BOILER_NAMES:
            return -1
        if names & CONTENT_NAMES:
            kind = 1
    return kind


class _Reader:
    """Blocks of one page: (text, parent number, kind, kind if articles in boilerplate count, tag, linked characters, containers since the last block)."""

    def __init__(self, page: str):
        self.page = page
        self.blocks: list[tuple[str, int, int, int, str, int, int]] = []
        self.stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # tag, number, the two kinds of the nearest marked container
        self.number = 0
        self.parts: list[str] = []
        self.links = 0
        self.linked = 0
        self.depth = self.low = 1  # of the last block; least since
        self.last_end: dict[str, int] = {}  # where the last end tag of a hidden kind starts

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                tag, number, kind, loose = self.stack[-1]
                apart = self.depth + len(self.stack) - 2 * self.low
                self.blocks.append((text, number, kind, loose, tag, min(self.linked, len(text)), apart))
                self.depth = self.low = len(self.stack)
            self.parts = []
        self.linked = 0

    def cut(self, i: int) -> None:
        del self.stack[i:]
        self.low = min(self.low, i)

    def end_ahead(self, tag: str, at: int) -> bool:
        if tag not in self.last_end:
            self.last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", self.page, re.I)), default=-1)
        return self.last_end[tag] >= at

    def open(self, tag: str, attributes: str, at: int) -> None:
        self.flush()
        while self.stack[-1][0] in HIDDEN_TAGS and (
            not self.end_ahead(self.stack[-1][0], at) or (tag in CONTENT_TAGS and self.stack[-1][0] not in MAY_HOLD_ARTICLES)
        ):
            self.cut(len(self.stack) - 1)
        if self.stack[-1][0] in CLOSED_BY_BLOCK:
            self.cut(len(self.stack) - 1)
        for i in range(len(self.stack) - 1, 0, -1) if tag in SAME_KIND else ():
            if self.stack[i][0] in SAME_KIND[tag]:
                break
            if self.stack[i][0] == tag:
                self.cut(i)
                break
        self.number += 1
        _, _, inside, loose = self.stack[-1]
        own = _kind(tag, attributes)
        if tag == "header" and inside != 1:  # a page header; the header of an article belongs to it
            own = -1
        again = own == 1 and tag in CONTENT_TAGS and loose != HIDDEN and all(x[0] not in ("nav", "aside", "footer") for x in self.stack[-64:])
        self.stack.append((tag, self.number, inside if inside < 0 else own or inside, own or loose if loose >= 0 or again else loose))

    def close(self, tag: str) -> None:
        if tag not in HIDDEN_TAGS:
            self.flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.cut(i)
                break

    def read(self) -> list[tuple[str, int, int, int, str, int, int]]:
        page = self.page
        at, end = 0, len(page)
        while at < end:
            m = _MARKUP.search(page, at)
            text = page[at : m.start() if m else end]
            if text and self.stack[-1][2] != HIDDEN:
                text = html.unescape(text)
                self.parts.append(text)
                if self.links:
                    self.linked += len(text.strip())
            if not m:
                break
            at, tag = m.end(), (m[2] or "").lower()
            if tag in RAW_TAGS and not m[1]:
                if not m[3].endswith("/"):
                    done = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                    at = done.end() if done else end
            elif tag in HIDDEN_TAGS:
                if m[1]:
                    self.close(tag)
                elif not m[3].endswith("/"):
                    self.number += 1
                    self.stack.append((tag, self.number, HIDDEN, HIDDEN))
            elif tag in BLOCK_TAGS:
                if tag in VOID_TAGS:
                    self.flush()
                elif m[1]:
                    self.close(tag)
                else:
                    self.open(tag, m[3], at)
            elif tag == "br":
                self.parts.append(" ")
            elif tag == "a":
                self.links = 0 if m[1] else 1
        self.flush()
        return self.blocks


def block_score(text: str, kind: int, tag: str, linked: int, marked: bool) -> float:
    """Log-odds that a block is content; ``marked`` tells whether the page marks its content."""
    if kind < 0:
        return -HARD
    words = text.count(" ") + 1
    score = 3.0 if kind > 0 else -2.5 if marked else -1.2
    score += 2.0 * min(words, 25) / 25 - 3.5 * linked / len(text)
    if tag in ("p", "blockquote", "pre"):
        score += 0.8
    elif tag in ("h1", "h2", "h3"):
        score += 0.6
    return score


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the content side of the minimum cut.

    A node whose score outweighs all its edges has its label in every minimum
    cut; such nodes are settled first, their edges become costs of their
    neighbours, and maximum flow labels the rest.
    """
    n = len(scores)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    pull = list(scores)
    slack = [sum(w for _, w in x) for x in near]
    label: list[bool | None] = [None] * n
    todo = [i for i in range(n) if abs(pull[i]) > slack[i]]
    while todo:
        i = todo.pop()
        if label[i] is not None:
            continue
        label[i] = pull[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                pull[j] += w if label[i] else -w
                slack[j] -= w
                if abs(pull[j]) > slack[j] + 1e-9:
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {v: k for k, v in enumerate(rest)}
        side = _max_flow([pull[v] for v in rest], [(place[a], place[b], w) for a, b, w in edges if a in place and b in place])
        for v, content in zip(rest, side):
            label[v] = content
    return [bool(x) for x in label]


def _max_flow(pull: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of a minimum cut: capacity from the source for a positive pull, to the sink for a negative one."""
    n = len(pull)
    source, sink = n, n + 1
    graph: list[list[list]] = [[] for _ in range(n + 2)]  # [target, capacity, index of the reverse edge]

    def add(a: int, b: int, there: float, back: float) -> None:
        graph[a].append([b, there, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for v, p in enumerate(pull):
        if p > 0:
            add(source, v, p, 0.0)
        elif p < 0:
            add(v, sink, -p, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    while True:
        came: dict[int, list] = {source: []}
        queue = deque([source])
        while queue and sink not in came:
            v = queue.popleft()
            for e in graph[v]:
                if e[1] > 1e-9 and e[0] not in came:
                    came[e[0]] = e
                    queue.append(e[0])
        if sink not in came:
            return [v in came for v in range(n)]
        path, v = [], sink
        while v != source:
            e = came[v]
            path.append(e)
            v = graph[e[0]][e[2]][0]
        amount = min(e[1] for e in path)
        for e in path:
            e[1] -= amount
            graph[e[0]][e[2]][1] += amount


def _labelled(blocks: list[tuple], kinds: list[int]) -> str:
    marked = any(kind > 0 for kind in kinds)
    scores, edges, last = [], [], {}
    for i, ((text, parent, _, _, tag, linked, apart), kind) in enumerate(zip(blocks, kinds)):
        scores.append(block_score(text, kind, tag, linked, marked))
        if i:
            edges.append((i - 1, i, NEIGHBOUR / (1 + apart / 2)))
        if last.get(parent, i - 1) != i - 1:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    keep = minimum_cut(scores, edges)
    return " ".join(b[0] for b, k in zip(blocks, keep) if k)


def main_text(page: str | None) -> str:
    blocks = _Reader(page).read() if page else []
    text = _labelled(blocks, [b[2] for b in blocks])
    if not text and any(b[3] > 0 for b in blocks):
        text = _labelled(blocks, [b[3] for b in blocks])
    return text


def extract_text(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """(keys, text, n_chars) of every page, in the scan."""
    rows = pages.select(*keys, F.col(html_col).alias("__html"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p) for p in batch["__html"]]
            out = batch[list(keys)].copy()
            yield out.assign(__text=texts, __n=[len(t) for t in texts])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInPandas(extract, f"{fields}, __text string, __n long")
    return out.select(*keys, F.col("__text").alias("text"), F.col("__n").alias("n_chars"))
