"""Main text of web pages by minimum-cut labelling.

Method. A tolerant scan cuts a page into blocks of inline text. A logistic classifier over a block's own text alone, trained
here (see learn), gives its cost of being content or boilerplate; it becomes the capacity from the source (content) or
to the sink (boilerplate). The elements of the page are nodes too: what an element's tag, role and class say is its own
capacity, for every block below it. Edges are adjacency of blocks and the tree itself: an element is joined to the one
around it, strongly where it only formats text and weakly where a page's parts meet. A maximum flow is sent through; the blocks that the
source still reaches are the main text. So a short line inside an article stays, and a long one inside an advert goes, against
their own costs.

Words of a class count by name: the first or last word of a name that has no word of state (no-, has-, -open, ..); the
names of html, body and main are never held against them, those of an article only if they are one word. An element with a name of
several words that holds most of the page's text is suspected less.

Training. Labels are the pages' own: a block inside article or main is content, one inside nav, footer, a class of adverts and
the like is boilerplate, others aren't used. Of PAGES pages in order of a hash of the row, all blocks take part. Where
one kind is missing, PRIOR is used.

Rows. Null and empty html gives empty text. Repeated rows each get a row; a null id or url stays null. Columns that
the input has besides are left out. Broken markup (tags that never close, stray brackets, unended comments or scripts)
is read as browsers do, roughly. A cost of exactly zero that no edge decides is boilerplate. A very long page is one task's work, in memory
that follows its length. No rows in, no rows out.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of the public HTML standard, by what they do.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title noscript template textarea select option button iframe object svg canvas audio video map datalist".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
CONTENT_TAGS = frozenset("article main".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
CELL_TAGS = frozenset("li dd dt td th caption".split())
PART_TAGS = frozenset("section article main header footer nav aside form menu dialog fieldset search".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert menu nav navbar navigation sidebar"
    " sidebars aside widget widgets footer masthead comment comments commentlist reply replies disqus respond share sharing social related recommended subscribe subscription newsletter popup modal overlay"
    " breadcrumb breadcrumbs login signin signup register search form pagination pager copyright legal disclaimer toolbar topbar skip".split()
)
CONTENT_WORDS = frozenset("article content post entry story main body text prose".split())
STATE_WORDS = frozenset("no not non has have with without is free open closed hide hidden enabled disabled active above below before after".split())
SMALL_PRINT = re.compile(r"©|\(c\) ?\d{4}|cookie|all rights reserved|subscribe|newsletter|log ?in\b|sign ?(?:in|up)\b|advertis|sponsored|privacy policy|terms of (?:use|service)", re.I)
SENTENCE_END = tuple('.!?:;。！？…"”»')
# Ends of fixed values.

#: What an element says of each block below it, in units of flow: above zero for content.
LEANS = {"tag": -6.0, "role": -6.0, "class": -4.0, "header": -4.0, "content_tag": 4.0, "content_class": 1.5}
#: An element with more than this share of the page's text is suspected so much less for a name of several words.
MOST, LESS = 0.7, 0.25
#: Capacity between an element and the one around it: one that formats text, a plain one, a part of the page; of a block and its element.
EDGES = {"text": 4.0, "plain": 2.0, "part": 0.4}
#: Capacity between neighbouring blocks at tree distance d is NEXT / (1 + d). A block's own cost is at most OWN.
NEXT, OWN = 0.6, 2.5
#: Pages of the training sample at most; weight of the squares of the classifier's weights.
PAGES, RIDGE = 2000, 1.0
#: Weights where there is nothing to learn from: bias, words, links, sentence end, small print.
PRIOR = (-1.5, 3.0, -3.0, 0.8, -2.0)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_P_ENDERS = frozenset("address article aside blockquote center dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class Node:
    """An element: how it leans, and what it has inherited."""

    __slots__ = ("tag", "parent", "depth", "unseen", "link", "bad", "good", "lean", "by_class", "blocks", "chars")

    def __init__(self, tag: str, parent: "Node | None", attrs: str = ""):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.lean, self.by_class, self.blocks, self.chars = 0.0, False, 0, 0
        if not parent:
            self.unseen = self.link = self.bad = self.good = False
            return
        self.unseen, self.link = parent.unseen or tag in UNSEEN, parent.link or tag == "a"
        self.bad, self.good = parent.bad, parent.good
        against, in_favour, by_class, compound = 0.0, 0.0, 0.0, False
        if tag in BOILERPLATE_TAGS:
            against = LEANS["tag"]
        elif tag == "header" and not self.good:
            against = LEANS["header"]
        elif tag in CONTENT_TAGS:
            in_favour = LEANS["content_tag"]
        if attrs and not attrs.isspace():
            for name, value in _ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id") and tag not in ("html", "body", "main"):
                    kind, several = named(value, tag, self.good)
                    if kind < by_class:
                        by_class, compound = kind, several
                    in_favour = max(in_favour, kind)
                elif name == "role":
                    if value.lower() in BOILERPLATE_ROLES:
                        against = min(against, LEANS["role"])
                    elif value.lower() in CONTENT_TAGS:
                        in_favour = max(in_favour, LEANS["content_tag"])
        self.lean = min(against, by_class) or (0.0 if self.bad else in_favour)
        self.by_class = compound and by_class < against
        self.bad |= self.lean < 0
        self.good |= self.lean >= LEANS["content_tag"]


def named(value: str, tag: str, good: bool) -> tuple[float, bool]:
    """How the names in a class or id lean, and whether the name that decides has several words."""
    found = 0.0, False
    for name in sorted(value.split(), key=lambda name: len(_WORDS.findall(name))):
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words or STATE_WORDS.intersection(words):
            continue
        ends, several = {words[0], words[-1]}, len(words) > 1
        if several and tag == "article":
            continue
        if ends & BOILERPLATE_WORDS:
            return LEANS["class"], several
        if "header" in ends and not good and tag not in ("h1", "h2"):
            return LEANS["header"], several
        if ends & CONTENT_WORDS:
            found = LEANS["content_class"], several
    return found


def blocks(page: str) -> list[tuple[str, Node, int]]:
    """(text, element, characters inside links) of each block that has visible text, in page order."""
    out: list[tuple[str, Node, int]] = []
    top = node = Node("", None)
    held: list[str] = []
    home, links, at = top, 0, 0

    def end():
        nonlocal held, links
        if held:
            if text := " ".join(entities.unescape("".join(held)).split()):
                out.append((text, home, links))
            held, links = [], 0

    def say(text: str):
        nonlocal home, links
        if text and not node.unseen:
            if not held:
                home = node
                while home.tag in INLINE and home.parent:
                    home = home.parent
            held.append(text)
            if node.link:
                links += len(text)

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br" or tag == "hr" or tag not in INLINE and tag not in UNSEEN:
            if tag == "br":
                if held:
                    held.append(" ")
                continue
            end()
        if m[1]:
            up = node
            while up.parent and up.tag != tag:
                up = up.parent
            if up.parent:
                node = up.parent
            continue
        if tag in _P_ENDERS or tag == "li" or tag == "body":
            up, stop = node, ("li", "ul", "ol", "menu") if tag == "li" else ("head",) if tag == "body" else ("p", "td", "th", "li", "div", "section", "article", "body")
            while up.parent and up.tag not in stop:
                up = up.parent
            if up.parent and up.tag == ("head" if tag == "body" else "li" if tag == "li" else "p"):
                node = up.parent
        if tag in VOID or m[3].endswith("/") and tag not in RAW and tag not in INLINE and tag in ("svg", "path"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else n
            continue
        node = Node(tag, node, m[3])
    end()
    return out


def features(text: str, node: Node, links: int) -> tuple[float, ...]:
    """Of a block's own text: bias, words, links, sentence end, small print."""
    words = min(1.0, math.log2(2 + text.count(" ")) / 6)
    return (1.0, words, min(1.0, links / max(1, len(text))), float(text.endswith(SENTENCE_END)), float(bool(SMALL_PRINT.search(text))))


def distance(a: Node, b: Node) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node stays on the source's side. costs: above zero to the source, below to the sink; edges undirected.

    Dinic's algorithm: levels by breadth first from the nodes that still have source capacity, then blocking flows.
    """
    n = len(costs)
    supply, demand = [max(0.0, c) for c in costs], [max(0.0, -c) for c in costs]
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, c in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        room += [c, c]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if supply[i] > tiny)
        for i in queue:
            level[i] = 0
        hit = False
        while queue:
            i = queue.popleft()
            hit |= demand[i] > tiny
            for e in near[i]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not hit:
            return [x >= 0 for x in level]
        turn = [0] * n
        for s in range(n):
            while level[s] == 0 and supply[s] > tiny:
                path, i = [], s
                while not demand[i] > tiny:
                    while turn[i] < len(near[i]) and not (room[near[i][turn[i]]] > tiny and level[to[near[i][turn[i]]]] == level[i] + 1):
                        turn[i] += 1
                    if turn[i] < len(near[i]):
                        path.append(near[i][turn[i]])
                        i = to[path[-1]]
                    elif path:
                        i = to[path.pop() ^ 1]
                        turn[i] += 1
                    else:
                        break
                else:
                    sent = min([supply[s], demand[i], *(room[e] for e in path)])
                    supply[s] -= sent
                    demand[i] -= sent
                    for e in path:
                        room[e] -= sent
                        room[e ^ 1] += sent
                    continue
                break


def own_cost(block: tuple[str, Node, int], weights=PRIOR) -> float:
    """Of the block alone: above zero for content, below for boilerplate."""
    return max(-OWN, min(OWN, sum(w * x for w, x in zip(weights, features(*block)))))


def label(found: list[tuple[str, Node, int]], weights=PRIOR) -> list[bool]:
    """Whether each block is content, by the cut."""
    elements: dict[int, tuple[int, Node]] = {}
    n = len(found)
    total = sum(len(text) for text, _, _ in found)
    for text, node, _ in found:
        while node:
            if id(node) not in elements:
                elements[id(node)] = (n + len(elements), node)
                node.blocks = node.chars = 0
            node.blocks += 1
            node.chars += len(text)
            node = node.parent
    costs, edges = [own_cost(b, weights) for b in found], []
    for at, node in elements.values():
        lean = node.lean * node.blocks
        costs.append(lean * LESS if node.by_class and node.chars > MOST * total else lean)
        if node.parent:
            kind = "part" if node.lean or node.tag in PART_TAGS else "text" if node.tag in TEXT_TAGS or node.tag in CELL_TAGS else "plain"
            edges.append((at, elements[id(node.parent)][0], EDGES[kind]))
    for i, (_, node, _) in enumerate(found):
        edges.append((i, elements[id(node)][0], EDGES["text"]))
        if i:
            edges.append((i - 1, i, NEXT / (1 + distance(found[i - 1][1], node))))
    return min_cut(costs, edges)[:n]


def main_text(page: str | None, weights=PRIOR) -> str:
    found = blocks(page or "")
    return " ".join(b[0] for b, keep in zip(found, label(found, weights)) if keep)


def told(node: Node) -> int | None:
    """A block's label for training, by what its elements say; None if they say nothing."""
    return 0 if node.bad else 1 if node.good else None


def fit(labels: np.ndarray, rows: np.ndarray, ridge: float = RIDGE) -> tuple[float, ...]:
    """Logistic regression by Newton's method; both labels weigh the same."""
    if not 0 < labels.sum() < len(labels):
        return PRIOR
    share = labels.mean()
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) / len(labels) * min(len(labels), 1000)
    w, keep = np.zeros(rows.shape[1]), ridge * np.append(0.0, np.ones(rows.shape[1] - 1)) + 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag(keep), rows.T @ (weight * (labels - p)) - keep * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = PAGES) -> tuple[float, ...]:
    """Weights of the classifier from the blocks of `sample` pages, in order of a hash of id and html."""
    rows = pages.select(F.col(html_col).cast("string").alias("html"), F.xxhash64(F.col(id_col), F.col(html_col)).alias("h")).where("html is not null")
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return PRIOR

    def run(batches):
        for batch in batches:
            for page in batch.column(0).to_pylist():
                out = [(y, features(*b)) for b in blocks(page) if (y := told(b[1])) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in out], pa.int32()), pa.array([x for _, x in out], pa.list_(pa.float64()))], ["label", "x"])

    # Rows that tie on the hash are copies, so it doesn't matter which of them the limit leaves.
    got = rows.where(F.col("h") <= last).limit(2 * sample).select("html").mapInArrow(run, "label int, x array<double>").collect()
    got.sort()  # sums of floats follow the order of rows, which is that of partitions
    return fit(np.array([r.label for r in got], float), np.array([r.x for r in got])) if got else PRIOR


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: tuple[float, ...] | None = None) -> DataFrame:
    """id_col, url_col, text, n_chars. weights: of learn(), which is run where they aren't given."""
    use = weights or learn(pages, id_col, html_col)

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                texts = [main_text(p, use) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
