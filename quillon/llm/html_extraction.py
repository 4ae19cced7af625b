"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a node with a hidden label, content or boilerplate. A node's own potential is
log-linear in features of its tag, its attribute words, its text and its links; a potential on each
edge ties a child's label to its parent's, by the kind of child. Sum-product messages go up from the leaves and
down from the root, which on a tree gives the exact marginals. The weights are fitted by
gradient ascent on the likelihood of labelled pages, whose gradient is the labels' features less
the marginals' (edges: less the pairwise marginals'). The text of every block whose
innermost element is content is kept, without that of inline elements with names of their own that aren't.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillon.llm.labelled_pages import PAGES

#: elements without end tags, and elements whose text is never shown
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg iframe object select option textarea button canvas audio video".split())
#: elements that may stand in a head; any other ends it, as its end tag may be left out
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: elements that begin a new line of their own
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: an opening element ends an open paragraph; these end their like within the nearest container
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: elements that only their own end tag ends, or that of the body
WALLS = frozenset("article main body table".split())
WORDS = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    names: tuple[str, ...] = ()
    parent: int = -1
    text: int = 0
    linked: int = 0
    stops: int = 0
    label: int | None = None
    hidden: bool = False
    #: whether it stands in a link, and the nearest block and named inline element that hold its text (-1: none)
    link: bool = False
    block: int = 0
    named: int = -1
    #: text before it and in no block inside it; siblings of its tag and names, where it has names; the most of such siblings among its children
    before: int = 0
    direct: int = 0
    alike: int = 0
    listed: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (node, text) of the stretches between block edges, in order
    blocks: list[tuple[int, str]] = field(default_factory=list)
    #: of blocks with named inline elements, by their place: the (element or -1, text) that they are made of
    pieces: dict[int, list[tuple[int, str]]] = field(default_factory=dict)


class _Builder(HTMLParser):
    """DOM of a page. Unclosed elements are closed as browsers do: a block ends an open paragraph, an end tag ends what is open inside its element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page([Node("#root")])
        self.open = [0]
        # depths of the open elements by tag, of those that begin a line, and of those that an end tag inside doesn't end
        self.depths: dict[str, list[int]] = {}
        self.lines: list[int] = [0]
        self.walls: list[int] = [0]
        self.run: list[tuple[int, str]] = []
        self.owner = 0
        self.blank = True  # nothing but white space in the run so far
        self.seen = 0

    def updatepos(self, i, j):
        return j  # line numbers aren't used

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # <![ with a word that no section has
            return self.parse_bogus_comment(i)

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(t for _, t in self.run).split())
            if text:
                if any(n >= 0 for n, _ in self.run):
                    self.page.pieces[len(self.page.blocks)] = self.run
                self.page.blocks.append((self.owner, text))
            self.run = []
            self.blank = True

    def close_to(self, depth: int) -> None:
        for at in reversed(self.open[depth:]):
            tag = self.page.nodes[at].tag
            self.depths[tag].pop()
            if tag in BLOCK:
                self.lines.pop()
                self.flush()
            if tag in WALLS:
                self.walls.pop()
        del self.open[depth:]

    def deepest(self, tags) -> int:
        """Depth of the innermost open element of these tags, 0 for none."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def end_head(self, within: bool = False) -> None:
        """Closes an open head that is the innermost element, or if `within` one that holds it."""
        head = self.deepest(("head",))
        if head and (within or head == len(self.open) - 1):
            self.close_to(head)

    def handle_starttag(self, tag, attrs):
        nodes = self.page.nodes
        if tag not in IN_HEAD:
            self.end_head(within=tag == "body")
        if tag in BLOCK:
            self.flush()
            if self.lines[-1] and nodes[self.open[self.lines[-1]]].tag == "p":
                self.close_to(self.lines[-1])
        if tag in CLOSES:
            ended, within = CLOSES[tag]
            wall = self.deepest(within)
            inside = [d[k] for t in ended if (d := self.depths.get(t)) and (k := bisect_right(d, wall)) < len(d)]
            if inside:
                self.close_to(min(inside))
        values, label = {k: v or "" for k, v in attrs}, None
        if "data-label" in values:
            label = int(values["data-label"] == "main")
        parent = self.open[-1]
        hidden = nodes[parent].hidden or tag in HIDDEN or re.search(r"display\s*:\s*none", values.get("style", "")) is not None
        names = tuple(dict.fromkeys(w for k in ("class", "id", "role", "itemprop", "aria-label") if k in values for w in WORDS.findall(values[k].lower())))
        # whether these are content is the model's to say
        names += ("@hidden",) * ("hidden" in values) + ("@aria-hidden",) * (values.get("aria-hidden") == "true")
        at, up = len(nodes), nodes[parent]
        block, named = (at, -1) if tag in BLOCK else (up.block, at if names else up.named)
        nodes.append(Node(tag, names, parent, label=label, hidden=hidden, link=up.link or tag == "a", block=block, named=named, before=self.seen))
        if tag in VOID:
            if tag == "br":
                self.run.append((-1, " "))
            if tag == "hr":
                self.flush()
        else:
            depth = len(self.open)
            self.open.append(len(nodes) - 1)
            self.depths.setdefault(tag, []).append(depth)
            if tag in BLOCK:
                self.lines.append(depth)
            if tag in WALLS:
                self.walls.append(depth)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        depth = self.deepest((tag,))
        if depth and (depth >= self.walls[-1] or tag in ("body", "html")):
            self.close_to(depth)

    def handle_data(self, data):
        if data.strip():
            self.end_head()
        at = self.page.nodes[self.open[-1]]
        if at.hidden:
            return
        size = len(data.strip())
        at.text += size
        self.page.nodes[at.block].direct += size
        self.seen += size
        at.linked += size * at.link
        at.stops += sum(map(data.count, ".!?")) if size else 0
        if self.blank:
            self.blank = not size
            self.owner = at.block
        self.run.append((at.named, data))


def parse(html: str | None) -> Page:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    builder.flush()
    # counts of whole subtrees: children stand after parents
    nodes = builder.page.nodes
    for n in reversed(nodes[1:]):
        up = nodes[n.parent]
        up.text += n.text
        up.linked += n.linked
        up.stops += n.stops
    groups = Counter((n.parent, n.tag, n.names) for n in nodes if n.names and n.tag in BLOCK)
    for n in nodes[1:]:
        if n.names and n.tag in BLOCK:
            n.alike = groups[n.parent, n.tag, n.names]
            nodes[n.parent].listed = max(nodes[n.parent].listed, n.alike)
    return builder.page


SIZES = (1, 4, 10, 40, 100, 400)


def node_key(node: Node, parent: Node | None, total: int) -> tuple:
    """All that the features of a node depend on; `total` is the page's text."""
    links = min(3, 4 * node.linked // node.text) if node.text else 0
    place = min(3, 4 * node.before // total) if total else 0
    return node.tag, node.names, bisect_right(SIZES, node.text), links, min(3, node.stops), parent.tag if parent is not None else "", place, min(3, node.alike), min(3, node.listed), min(3, 4 * node.text // total) if total else 0, min(2, 1 + 2 * node.direct // node.text) if node.direct else 0


def node_features(node: Node, parent: Node | None, total: int) -> list[str]:
    tag, names, size, links, stops, up, place, alike, listed, share, direct = node_key(node, parent, total)
    section = tag if tag in ("article", "main", "body", "#root") else "section" if edge_kind(node) in ("div", "section") else edge_kind(node)
    return ["bias", "tag=" + tag, f"size={size}", f"links={links}", f"stops={stops}", "up=" + up, f"place={section}{place}", f"alike={section}{alike}", f"listed={section}{listed}", f"share={section}{share}", f"direct={section}{direct}", *("name=" + n for n in names)]


def edge_kind(node: Node) -> str:
    """What the strength of a tie to the parent depends on: sections may differ from their parent, running text hardly does."""
    if node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "td", "tr", "tbody", "table", "dd", "dt", "dl", "figure", "figcaption", "summary", "details"):
        return "flow"
    if node.tag in ("article", "main", "div"):
        return node.tag
    return "section" if node.tag in BLOCK else "inline"


KINDS = ("flow", "article", "main", "div", "section", "inline")


@dataclass
class TreeModel:
    weights: dict[str, float]
    #: per kind of edge, log-potential [parent's label][child's label]
    edges: dict[str, np.ndarray]

    known: dict[tuple, float] = field(default_factory=dict)

    def potentials(self, page: Page) -> list[float]:
        """Log-potential of content, over boilerplate, of each node."""
        nodes, out, total = page.nodes, [], page.nodes[0].text
        for n in nodes:
            parent = nodes[n.parent] if n.parent >= 0 else None
            key = node_key(n, parent, total)
            x = self.known.get(key)
            if x is None:
                if len(self.known) > 100_000:
                    self.known.clear()
                x = self.known[key] = sum(self.weights.get(f, 0.0) for f in node_features(n, parent, total))
            out.append(x)
        return out

    def messages(self, page: Page, own) -> tuple[list, list, list]:
        """Per node the log of its potential with all messages from below, what it sends its parent, and the product with the message from above. Children stand after parents."""
        nodes, n = page.nodes, len(page.nodes)
        up = [[0.0, float(x)] for x in own]
        sent: list[tuple[float, float]] = [(0.0, 0.0)] * n
        table = {k: e.tolist() for k, e in self.edges.items()}
        for i in range(n - 1, 0, -1):
            (e00, e01), (e10, e11) = table[edge_kind(nodes[i])]
            a, b = up[i]
            sent[i] = s = _log_add(e00 + a, e01 + b), _log_add(e10 + a, e11 + b)
            p = up[nodes[i].parent]
            p[0] += s[0]
            p[1] += s[1]
        full: list = [up[0]] * n
        for i in range(1, n):
            (e00, e01), (e10, e11) = table[edge_kind(nodes[i])]
            q, s, u = full[nodes[i].parent], sent[i], up[i]
            a, b = q[0] - s[0], q[1] - s[1]  # the parent without this child
            full[i] = u[0] + _log_add(a + e00, b + e10), u[1] + _log_add(a + e01, b + e11)
        return up, sent, full

    def content(self, page: Page, own=None) -> list[float]:
        """P(content) of each node."""
        _, _, full = self.messages(page, self.potentials(page) if own is None else own)
        return [1 / (1 + math.exp(min(60.0, max(-60.0, a - b)))) for a, b in full]

    def joints(self, page: Page, own) -> np.ndarray:
        """P(parent's label, node's label) of each node but the root."""
        up, sent, full = (np.array(x, float).reshape(-1, 2) for x in self.messages(page, own))
        at = np.array([n.parent for n in page.nodes])
        ties = np.array([self.edges[edge_kind(n)] for n in page.nodes])
        j = (full[at] - sent)[:, :, None] + ties + up[:, None, :]
        j = np.exp(j - j.max(axis=(1, 2), keepdims=True))
        return j / j.sum(axis=(1, 2), keepdims=True)


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b - a > -40 else a


def labelled(page: Page) -> np.ndarray:
    """Labels of the nodes: an element's own, else that of its parent. The root is boilerplate, but content in a page without any label, which is main text as a whole."""
    out = np.zeros(len(page.nodes), int)
    out[0] = all(n.label is None for n in page.nodes)
    for i, n in enumerate(page.nodes[1:], 1):
        out[i] = n.label if n.label is not None else out[n.parent]
    return out


class _Forest:
    """The nodes of many pages in arrays, for messages in all pages at once, depth by depth."""

    def __init__(self, pages: list[Page]):
        nodes = [n for p in pages for n in p.nodes]
        first = np.repeat(np.cumsum([0, *(len(p.nodes) for p in pages)])[:-1], [len(p.nodes) for p in pages])
        own = np.array([n.parent for n in nodes])
        self.inner = np.flatnonzero(own >= 0)
        self.parent = np.where(own >= 0, own + first, 0)
        self.kind = np.array([KINDS.index(edge_kind(n)) for n in nodes])
        depth = np.zeros(len(nodes), int)
        for i in self.inner:
            depth[i] = depth[self.parent[i]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(1, depth.max(initial=0) + 1)]

    def marginals(self, own: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent's label, node's label) of each that has a parent."""
        ties, parent = edges[self.kind], self.parent
        up = np.stack([np.zeros(len(own)), own], 1)
        sent = np.zeros_like(up)
        for at in reversed(self.levels):
            sent[at] = np.logaddexp(ties[at, :, 0] + up[at, :1], ties[at, :, 1] + up[at, 1:])
            np.add.at(up, parent[at], sent[at])
        full = up.copy()
        for at in self.levels:
            rest = full[parent[at]] - sent[at]  # the parent without this child
            full[at] += np.logaddexp(rest[:, :1] + ties[at, 0], rest[:, 1:] + ties[at, 1])
        at = self.inner
        joint = (full[parent[at]] - sent[at])[:, :, None] + ties[at] + up[at][:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -60, 60))), joint / joint.sum(axis=(1, 2), keepdims=True)


#: names that begin so stand for any that the model doesn't know
UNKNOWN = "zz"


def fit(pages: tuple[str, ...] = PAGES, steps: int = 120, rate: float = 0.15, decay: float = 1e-4) -> TreeModel:
    """Fits node and edge weights to labelled pages, elements of which carry data-label="main" or "other"."""
    parsed = [parse(p) for p in pages]
    y = np.concatenate([labelled(p) for p in parsed])
    names = [[f for f in node_features(n, p.nodes[n.parent] if n.parent >= 0 else None, p.nodes[0].text) if not f.startswith("name=" + UNKNOWN)] for p in parsed for n in p.nodes]
    index = {f: i for i, f in enumerate(sorted({f for node in names for f in node}))}
    rows, cols = np.repeat(np.arange(len(names)), [len(x) for x in names]), np.array([index[f] for x in names for f in x])
    forest, k = _Forest(parsed), len(index)
    seen = np.zeros((len(KINDS), 2, 2))
    np.add.at(seen, (forest.kind[forest.inner], y[forest.parent[forest.inner]], y[forest.inner]), 1)
    w = np.zeros(k + seen.size)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p, joint = forest.marginals(np.bincount(rows, w[cols], len(y)), w[k:].reshape(seen.shape))
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.kind[forest.inner], joint)
        g = np.concatenate([np.bincount(cols, (y - p)[rows], k), (seen - expected).ravel()]) - decay * w * len(parsed)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return TreeModel({f: float(w[i]) for f, i in index.items()}, {kind: w[k + 4 * i :][:4].reshape(2, 2).copy() for i, kind in enumerate(KINDS)})


@lru_cache(maxsize=1)
def default_model() -> TreeModel:
    return fit()


def main_text(html: str | None, model: TreeModel) -> str:
    """The kept blocks, white space inside each turned into one space, joined by line breaks; empty for null or if no block is content."""
    page = parse(html)
    p = model.content(page)
    out = []
    for i, (at, text) in enumerate(page.blocks):
        if p[at] >= 0.5:
            if i in page.pieces:  # what stands in named inline elements is content if they are
                text = " ".join("".join(t if n < 0 or p[n] >= 0.5 else " " for n, t in page.pieces[i]).split())
            if text:
                out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """Adds to page_id and url: text and n_chars (its code points).

    Parsing and messages take time in proportion to the page, however deep its elements are nested. Null and empty html give an empty text. Repeated rows are extracted alike, long pages whole; other columns are ignored and an
    empty table gives an empty result. A page is handled on its own, so nothing is shuffled.
    """
    model = model or default_model()

    def texts(batches):
        for b in batches:
            out = [main_text(h, model) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": out, "n_chars": [len(t) for t in out]})

    return pages.select("page_id", "url", "html").mapInPandas(texts, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
