"""Main text of web pages by a tree-structured graphical model.

Every element and text of a page is a node with a hidden state, content or not. Parent-child potentials and a feature
likelihood per node are counted from labelled pages (`labelled_pages`); sum-product messages, upward and then
downward, give each text's exact marginal, and texts above one half are the main text.

Defined cases: a null or empty page gives the empty string; unclosed and stray tags are tolerated (a head ends at the
first tag or text that cannot stand in it; only a script or comment without its end, and a tag in which the page ends,
take the rest of the page); scripts, styles, comments and form controls are never text; pages are read one by one, so
repeats are equal; reading a page takes time in proportion to its length, whatever is in it.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.labelled_pages import labelled_pages

# HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas textarea select button datalist audio video math title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
#: What may stand in a head without ending it, besides the elements of RAW among them.
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: Without an end tag, only these elements' own text goes; of other elements of RAW just the tag.
LABELS = frozenset("title style textarea button select datalist".split())
OPTIONS = frozenset("option optgroup".split())
PARTS = frozenset("html main article section nav aside header footer form dialog menu address".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: What may follow a tag's name. Quotes count only where a value begins; no part is ever read twice.
ATTRIBUTES = r"(?:[^=>]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+"
#: A comment, other markup, or a tag: its slash, name, attributes and end, which is missing where the page ends in it.
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</[^a-zA-Z][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})(>|\Z)",
    re.S,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SCRIPT_END = re.compile(r"</script(?![^\s/>])[^>]*>", re.I)
SPLIT = re.compile(r"[^a-z]+")


def raw_ends(page: str, tag: str) -> dict[int, int]:
    """Where elements of RAW end, by where their start tags end; an end tag closes the nearest open start tag."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    for m in re.compile(f"<(/?){tag}(?![^\\s/>])({ATTRIBUTES})>", re.I).finditer(page):
        if not m[1]:
            if not closes_itself(m[2]):
                opened.append(m.end())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


def closes_itself(attributes: str) -> bool:
    """A slash before the end of a tag, unless it ends a value without quotes."""
    if not attributes.endswith("/"):
        return False
    _, equals, value = attributes.rsplit(None, 1)[-1].partition("=")
    return not equals or value[:1] in ("", '"', "'")


def unclosed_end(page: str, tag: str, at: int) -> int:
    """Where an element of RAW without an end tag ends: after its label, if it has one."""
    if tag not in LABELS:
        return at
    first = -1
    for m in TOKEN.finditer(page, at):
        if first < 0:
            first = m.start()
        name = (m[2] or "").lower()
        if tag in ("select", "datalist") and name in OPTIONS or tag == "button" and name in INLINE and name != "br":
            continue
        return m.start()
    return first if first >= 0 else len(page)


class Node:
    __slots__ = ("block", "children", "features", "label", "linked", "parent", "prior", "size", "state", "tag", "text", "up")

    def __init__(self, tag: str, parent: Node | None, names: tuple[str, ...] = (), text: str = ""):
        self.tag, self.parent, self.text, self.features = tag, parent, text, names
        #: The nearest element, itself included, that is not inline.
        self.block: Node = parent.block if parent is not None and (tag in INLINE or tag == "#") else self
        self.children: list[Node] = []
        self.size = self.linked = 0
        self.label = False
        if parent is not None:
            parent.children.append(self)


def parse(page: str) -> list[Node]:
    """All nodes in page order, parents before children; text nodes have the tag '#'.

    Time is linear in the page: tokens are read once, and an element is walked past only when it is closed.
    """
    root = Node("html", None)
    nodes, here, at, end = [root], root, 0, len(page)
    in_head = False
    closed: dict[str, dict[int, int]] = {}
    opened: Counter[str] = Counter()  # open elements by tag, without the root
    find = TOKEN.search

    def close(node: Node, last: Node) -> Node:
        """Close every open element from `node` up to `last`."""
        while True:
            opened[node.tag] -= 1
            if node is last:
                return node.parent
            node = node.parent

    while at < end:
        m = find(page, at)
        text = page[at : m.start() if m else end]
        if text and (text.strip() or here.tag not in ("html", "body")):
            nodes.append(Node("#", here, text=_html.unescape(text) if "&" in text else text))
            in_head = False
        if m is None:
            break
        at, tag = m.end(), m[2]
        if tag is None:
            continue
        if not m[4]:
            break  # the page ends inside this tag
        tag = tag.lower()
        if m[1]:
            in_head = in_head and tag not in ("head", "body", "html")
            if opened[tag] > 0:
                last = here
                while last.tag != tag:
                    last = last.parent
                here = close(here, last)
            continue
        if tag in ("html", "head", "body"):
            in_head = tag == "head"
            continue
        in_head = in_head and tag in HEAD
        own = m[3]
        alone = closes_itself(own)
        if tag in RAW:
            if tag == "script":
                if not alone:
                    stop = SCRIPT_END.search(page, at)
                    at = stop.end() if stop else end
            elif not alone:
                if tag not in closed:
                    closed[tag] = raw_ends(page, tag)
                at = closed[tag].get(at) or unclosed_end(page, tag, at)
            continue
        if in_head:
            continue
        shut = {"p"} if tag in CLOSES_P else SAME.get(tag)
        if shut:
            if here.block.tag in shut:
                here = close(here, here.block)
            elif here.tag in shut:
                here = close(here, here)
            if tag in SAME and here.tag in SAME[tag]:
                here = close(here, here)
        names = tuple(dict.fromkeys(w for g in NAMES.findall(own) for w in SPLIT.split("".join(g).lower()) if w)) if own else ()
        node = Node(tag, here, names)
        nodes.append(node)
        if tag not in VOID and not alone:
            here = node
            opened[tag] += 1
    for node in reversed(nodes):
        if node.tag == "#":
            node.size = len(node.text.strip())
        elif node.tag == "a":
            node.linked = node.size
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
    return nodes


def features(node: Node) -> tuple[str, ...]:
    """What the likelihood sees: tag, name tokens, length and share of linked text. Texts and plain inline elements
    would only repeat what their block shows, so they have no evidence of their own."""
    if kind(node) in "#i":
        return ()
    n = node.size
    size = "0" if n == 0 else "1" if n < 20 else "2" if n < 80 else "3" if n < 300 else "4"
    share = "0" if not node.linked else "1" if node.linked < 0.3 * n else "2" if node.linked < 0.7 * n else "3"
    return ("t:" + node.tag, "s:" + size, "l:" + share, *["n:" + w for w in node.features])


def kind(node: Node) -> str:
    """Potentials differ for texts, inline elements, plain blocks (they follow their parent) and parts of a page."""
    if node.tag == "#":
        return "#"
    if node.tag in INLINE and not node.features:
        return "i"
    return "b" if node.tag in PARTS or node.features else "p"


class Model:
    """Counts from labelled pages, smoothed: log likelihood ratios of features and parent-child transitions."""

    def __init__(self, pages: list[tuple[str, set[str]]], smooth: float = 0.5):
        seen = (Counter(), Counter())
        total = [0, 0]
        moves: dict[str, list[list[float]]] = {}
        for page, content in pages:
            nodes = parse(page)
            for node in reversed(nodes):
                if node.tag == "#":
                    node.label = node.text.strip() in content if node.text.strip() else node.parent.label
                elif node.children:
                    # an element is content if most of its text is
                    node.label = 2 * sum(c.size for c in node.children if c.label) > node.size
            for node in nodes:
                y = int(node.label)
                total[y] += 1
                seen[y].update(set(features(node)))
                if node.parent is not None:
                    moves.setdefault(kind(node), [[smooth, smooth], [smooth, smooth]])[int(node.parent.label)][y] += 1
        self.ratio = {f: log((seen[1][f] + smooth) / (total[1] + 2 * smooth)) - log((seen[0][f] + smooth) / (total[0] + 2 * smooth)) for f in set(seen[0]) | set(seen[1])}
        self.move = {k: tuple(tuple(x / sum(row) for x in row) for row in t) for k, t in moves.items()}
        self.known: dict[tuple[str, ...], float] = {}

    def own(self, node: Node) -> float:
        key = features(node)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[key] = sum(self.ratio.get(f, 0.0) for f in key)
        return got

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node, by messages from the leaves to the root and back, as log odds."""
        for node in nodes:
            node.prior = self.own(node)
        for node in reversed(nodes):  # upward: prior gathers the node's own evidence and its children's messages
            if node.parent is not None:
                (a, b), (c, d) = self.move[kind(node)]
                e = exp(min(node.prior, 700.0))
                node.up = log((c + d * e) / (a + b * e))
                node.parent.prior += node.up
        out = []
        for node in nodes:  # downward: what the parent believes without this child
            if node.parent is None:
                node.state = node.prior
            else:
                (a, b), (c, d) = self.move[kind(node)]
                e = exp(max(min(node.parent.state - node.up, 700.0), -700.0))
                node.state = node.prior + log((b + d * e) / (a + c * e))
            out.append(1 / (1 + exp(max(min(-node.state, 700.0), -700.0))))
        return out


@cache
def trained() -> Model:
    return Model(labelled_pages())


def main_text(page: str | None, model: Model | None = None) -> str:
    """Texts whose marginal is over one half: blocks in page order, white space folded, joined by one space."""
    if not page:
        return ""
    nodes = parse(page)
    marginals = (model or trained()).marginals(nodes)
    out: list[str] = []
    last: Node | None = None
    for node, p in zip(nodes, marginals, strict=True):
        if node.tag == "br":
            last = None
        elif node.tag == "#" and p > 0.5:
            block = node.block
            if block is not last:
                out.append(" ")
            out.append(node.text)
            last = block
        elif node.tag != "#" and node.tag not in INLINE:
            last = None
    return " ".join("".join(out).split())


def extracted(pages: DataFrame, id: str = "page_id", html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """(id, *carry, text, n_chars) for every row of pages."""
    carry = carry or []
    rows = pages.select(F.col(id).alias("_id"), F.col(html).alias("_html"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    names = ["_id", *[f"_c_{c}" for c in carry]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    out = rows.mapInArrow(run, schema + ", text string, n_chars long")
    return out.select(F.col("_id").alias(id), *[F.col(f"_c_{c}").alias(c) for c in carry], "text", "n_chars")
