"""Main-text extraction with a tree-structured graphical model over the DOM.

Each element and each text block of a page is a node with a hidden state: boilerplate, mixed (holds both) or content.
Parent-child potentials P(child's state | parent's state, child's tag) tie them together and node potentials score tag, class and
id words, text length, link share and punctuation. Sum-product messages run up and then down the tree, which gives exact
marginals; a text block is content when its content marginal exceeds one half. All potentials are counted from labelled pages,
which html_pages.py writes (layouts with and without semantic tags); the pages to extract are never trained on.

A text block is what stands in a block element between block starts and ends; <br> and other inline elements are inside it.
Null and empty pages give empty text. Broken markup is read as browsers would: unclosed <p>, <li> and cells end where the
next starts, unmatched end tags are ignored. Nothing is capped: pages of any length and depth are read whole, without recursion.
Other columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_pages import MARK, labelled_pages

TRAINING_PAGES, SEED = 1000, 11
#: Most features of a text block say much the same, so each of those counts for a part.
LEAF_WEIGHT = {"in": 0.3, "words": 0.3, "end": 0.3, "mark": 0.3, "links": 1.0}

# Elements of HTML by their role in parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template svg math canvas object iframe audio video select option textarea button head".split())
#: A start tag ends an open element of these kinds, up to the given borders.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BORDERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
#: Block starts end an open paragraph.
P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split())

BOILER, MIXED, CONTENT = 0, 1, 2


class Node:
    __slots__ = ("tag", "names", "parent", "text", "linked", "leaf")

    def __init__(self, tag: str, names: tuple[str, ...], parent: int, leaf: bool = False) -> None:
        self.tag, self.names, self.parent, self.leaf = tag, names, parent, leaf
        self.text: list[str] = []
        self.linked = 0


@lru_cache(100_000)
def name_words(value: str) -> tuple[str, ...]:
    """Lower-case words of a class or id value, split at case changes and at all but letters, plurals cut."""
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return tuple(sorted({w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in words}))


class Tree(HTMLParser):
    """Nodes in page order; a parent stands before its children."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#page", (), -1)]
        self.stack: list[tuple[str, int]] = [("#page", 0)]
        self.blocks: list[int] = [0]  # for each open element the nearest block element
        self.open_leaf: int | None = None
        self.links = 0
        self.depth: dict[str, int] = {}

    def _pop(self) -> None:
        tag, _ = self.stack.pop()
        self.blocks.pop()
        self.depth[tag] -= 1
        if tag == "a":
            self.links -= 1
        if tag not in INLINE:
            self.open_leaf = None

    def _close(self, tags: tuple[str, ...], borders: tuple[str, ...]) -> None:
        if not any(self.depth.get(t) for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k][0]
            if tag in tags:
                while len(self.stack) > k:
                    self._pop()
                return
            if tag in borders:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS:
            self._close(ENDS[tag], BORDERS[tag])
        if tag in P_ENDERS:
            self._close(("p",), ("button", "table", "td", "th", "#page"))
        if tag == "br":
            if self.open_leaf is not None:
                self.nodes[self.open_leaf].text.append(" ")
            return
        if tag == "hr":
            self.open_leaf = None
        if tag in VOID:
            return
        inline = tag in INLINE
        at = self.blocks[-1]
        if not inline:
            self.open_leaf = None
            names = ()
            for k, v in attrs:
                if v and k in ("class", "id", "role"):
                    names += name_words(v)
            self.nodes.append(Node(tag, tuple(sorted(set(names))), at))
            at = len(self.nodes) - 1
        self.stack.append((tag, at))
        self.blocks.append(at)
        self.depth[tag] = self.depth.get(tag, 0) + 1
        if tag == "a":
            self.links += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):  # <div/> opens an element in HTML, inline ones are taken as closed
            if tag in INLINE:
                self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.depth.get(tag):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()
        elif tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p":
            self.open_leaf = None

    def handle_data(self, data: str) -> None:
        if self.open_leaf is None:
            if not data.strip():
                return
            self.nodes.append(Node("#text", (), self.blocks[-1], True))
            self.open_leaf = len(self.nodes) - 1
        leaf = self.nodes[self.open_leaf]
        leaf.text.append(data)
        if self.links:
            leaf.linked += len(data.strip())


def parse(html: str) -> list[Node]:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.nodes


def tag_class(tag: str) -> str:
    return "h" if re.fullmatch("h[1-6]", tag) else "silent" if tag in SILENT else tag


def features(node: Node, parent_tag: str) -> tuple[tuple[str, str], ...]:
    """(kind, value) pairs; a pair never seen in training says nothing."""
    if not node.leaf:
        return (("tag", tag_class(node.tag)), *(("name", n) for n in node.names))
    text = " ".join("".join(node.text).split())
    words = text.count(" ") + 1
    share = node.linked / max(1, len(text))
    return (
        ("in", parent_tag), ("words", str(min(8, words.bit_length()))), ("links", "0" if share == 0 else "1" if share < 0.4 else "2" if share < 0.85 else "3"),
        ("end", "stop" if text[-1:] in ".!?…:;\"”»。" else "no"), ("mark", "yes" if re.search("[©®|»›]", text) else "no"),
    )


class TreeModel:
    """Potentials counted from labelled pages, and exact marginals by sum-product."""

    def __init__(self) -> None:
        self.node: dict[tuple[str, str], np.ndarray] = {}
        self.edge: dict[str, np.ndarray] = {}
        self.ready: dict[tuple, tuple[float, float, float]] = {}

    def fit(self, pages: list[str]) -> TreeModel:
        edge_all = np.ones((3, 3))
        edge = {}
        states = np.ones(3)
        for html in pages:
            nodes = parse(html)
            has = np.zeros((len(nodes), 2), bool)  # content below, boilerplate below
            for i in range(len(nodes) - 1, 0, -1):
                n = nodes[i]
                if n.leaf:
                    text = "".join(n.text)
                    has[i] = (MARK in text, MARK not in text)
                    n.text = [text.replace(MARK, "")]
                has[n.parent] |= has[i]
            state = np.where(has[:, 0], np.where(has[:, 1], MIXED, CONTENT), BOILER)
            for i, n in enumerate(nodes[1:], 1):
                kind = tag_class(n.tag)
                edge.setdefault(kind, np.zeros((3, 3)))[state[n.parent], state[i]] += 1
                edge_all[state[n.parent], state[i]] += 1
                states[state[i]] += 1
                for f in features(n, tag_class(nodes[n.parent].tag)):
                    self.node.setdefault(f, np.zeros(3))[state[i]] += 1
        edge_all[BOILER, 1:] = edge_all[CONTENT, :2] = 0.05  # a part of boilerplate is boilerplate, a part of content is content
        base = edge_all / edge_all.sum(1, keepdims=True)
        for kind, e in {**edge, "#other": np.zeros((3, 3))}.items():
            p = (e + 2 * base) / (e.sum(1, keepdims=True) + 2)
            self.edge[kind] = p
        # Node potentials: how much likelier a feature is in a state than on the whole, so that the edges keep the prior.
        self.node = {f: np.log((c + 0.05) / (states * (c.sum() + 0.15) / states.sum())) for f, c in self.node.items()}
        return self

    def potential(self, node: Node, parent_tag: str) -> tuple[float, float, float]:
        f = features(node, parent_tag)
        got = self.ready.get(f)
        if got is None:
            v = sum((LEAF_WEIGHT.get(x[0], 1.0) * self.node[x] for x in f if x in self.node), np.zeros(3))
            if len(self.ready) > 200_000:
                self.ready.clear()
            got = self.ready[f] = tuple(np.exp(v - v.max()).tolist())
        return got

    def marginals(self, nodes: list[Node]) -> list[tuple[float, float, float]]:
        """P(state) of each node given the page: messages from the leaves up, then from the root down."""
        n = len(nodes)
        kinds = [tag_class(x.tag) for x in nodes]
        edges = [self.edge.get(k) for k in kinds]
        other = self.edge["#other"]
        edges = [(other if e is None else e).ravel().tolist() for e in edges]
        own = [(1.0, 1.0, 1.0)] + [self.potential(x, kinds[x.parent]) for x in nodes[1:]]
        belief = [list(x) for x in own]
        up: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            a, b, c = belief[i]
            s = a + b + c or 1.0
            a, b, c = a / s, b / s, c / s
            belief[i] = [a, b, c]
            e = edges[i]
            m = (e[0] * a + e[1] * b + e[2] * c, e[3] * a + e[4] * b + e[5] * c, e[6] * a + e[7] * b + e[8] * c)
            t = max(m) or 1.0
            up[i] = m = (m[0] / t + 1e-12, m[1] / t + 1e-12, m[2] / t + 1e-12)
            q = belief[nodes[i].parent]
            q[0] *= m[0]
            q[1] *= m[1]
            q[2] *= m[2]
            t = max(q)
            if t < 1e-100:
                q[0], q[1], q[2] = q[0] / t, q[1] / t, q[2] / t
        out: list[tuple[float, float, float]] = [(0.0, 0.0, 0.0)] * n
        root = belief[0]
        s = sum(root) or 1.0
        out[0] = (root[0] / s, root[1] / s, root[2] / s)
        for i in range(1, n):
            p, m, e, b = out[nodes[i].parent], up[i], edges[i], belief[i]
            x, y, z = p[0] / m[0], p[1] / m[1], p[2] / m[2]  # the parent's belief without this child
            d = ((x * e[0] + y * e[3] + z * e[6]) * b[0], (x * e[1] + y * e[4] + z * e[7]) * b[1], (x * e[2] + y * e[5] + z * e[8]) * b[2])
            s = sum(d) or 1.0
            out[i] = (d[0] / s, d[1] / s, d[2] / s)
        return out

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        nodes = parse(html)
        p = self.marginals(nodes)
        blocks = (" ".join("".join(x.text).split()) for x, m in zip(nodes, p, strict=True) if x.leaf and m[CONTENT] > 0.5)
        return "\n".join(b for b in blocks if b)


def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> TreeModel:
    """The model of a number of labelled pages, a bound that does not grow with the input."""
    return TreeModel().fit(labelled_pages(pages, seed))


def main_text(spark: object, html: str, model: TreeModel | None = None) -> Column:
    """A column with the main text of an HTML column."""
    sent = spark.sparkContext.broadcast(model or trained())  # a few thousand numbers

    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        m = sent.value
        return pa.array([m.extract(x) for x in column.to_pylist()], pa.string())

    return extract(html)


def digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    rows = pages.select("page_id", "url", main_text(pages.sparkSession, "html").alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def surprise(model: TreeModel, feature: tuple[str, str]) -> float:
    """Log-odds of content against boilerplate that a feature adds; 0 if it was never seen."""
    v = model.node.get(feature)
    return 0.0 if v is None else float(v[CONTENT] - v[BOILER]) / log(2)
