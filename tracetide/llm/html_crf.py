"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks: stretches of text under the same
nearest block element, in page order. A block's features are the tags and the
class and id words of its ancestors and coarse measures of its text (length,
share of linked characters, punctuation). The field scores labels of blocks and
of neighbouring pairs; it is trained by gradient steps on the log-likelihood of
labelled pages (forward and backward sums) and decoded by Viterbi.

Character references are decoded, white space within a block becomes one space,
kept blocks are joined by one space. Null and empty pages give an empty text.
Time and memory are proportional to the page: blocks share the nodes of their
ancestors, and open tags are looked up by name.
Pages are read whole; ill-formed markup is repaired as browsers do in the plain
cases (unclosed paragraphs, items and cells, stray end tags).
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracetide.llm.common import require

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head noscript template textarea select button iframe svg object canvas audio video math".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br input".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FOREIGN = ("svg", "math")  # where a slash ends an element
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": {"td", "th", "table", "button", "li", "article", "div", "section"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """A chain of block elements from the root; chains with a common beginning share it."""

    __slots__ = ("parent", "tag", "depth", "held", "new", "own", "children", "owner", "inherited", "score")

    def __init__(self, parent: Node | None, tag: str, held: list[str], new: list[str], own: list[str]):
        self.parent, self.tag, self.depth = parent, tag, parent.depth + 1 if parent else 0
        self.held = held  # features that every block below has
        self.new = new  # of these, the ones that no ancestor gives
        self.own = own  # features of the blocks whose nearest element this is
        self.children: dict[tuple[str, str], Node] = {}
        self.owner = None  # the field that `inherited` and `score` belong to
        self.inherited = self.score = 0.0


class Paths:
    """The nodes of the pages read so far; begun anew when there are many."""

    def __init__(self, most: int = 100_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.root, self.count = Node(None, "", ["bias"], ["bias"], []), 0

    def below(self, parent: Node, tag: str, attributes: str, open_features: dict[str, int]) -> Node:
        node = parent.children.get((tag, attributes))
        if node is None:
            words = [w.lower() for w in WORD.findall(attributes)]
            held = [f"in:{tag}", *dict.fromkeys(f"word:{w}" for w in words)]
            own = [f"own:{tag}", *dict.fromkeys(f"near:{w}" for w in words), f"depth:{min(parent.depth + 1, 8)}"]
            if parent.parent is not None:
                own.append(f"pair:{parent.tag}>{tag}")
            node = parent.children[tag, attributes] = Node(parent, tag, held, [f for f in held if not open_features.get(f)], own)
            self.count += 1
        return node


PATHS = Paths()


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    linked: int  # characters inside links


def blocks(page: str, paths: Paths = PATHS) -> list[Block]:
    if paths.count > paths.most:
        paths.clear()
    out: list[Block] = []
    names: list[str] = []
    nodes: list[Node] = [paths.root]  # of the open block elements
    blocks_at: list[int] = []  # their places in names
    places: dict[str, list[int]] = {}  # of each open tag
    open_features: dict[str, int] = {}
    parts: list[str] = []
    linked = silent = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(nodes[-1], text, linked))
        parts.clear()
        linked = 0

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def pop_to(depth: int) -> None:
        nonlocal silent, links
        while len(names) > depth:
            tag = names.pop()
            places[tag].pop()
            silent -= tag in SILENT
            links -= tag == "a"
            if tag not in INLINE:
                blocks_at.pop()
                for f in nodes.pop().held:
                    open_features[f] -= 1

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not silent:
            parts.append(piece)
            if links:
                linked += len(piece)

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        slash, tag, rest = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag not in INLINE:
                flush()
            if places.get(tag):
                pop_to(last(tag))
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P and last("p") > last(*SCOPES["p"]):
                pop_to(last("p"))
            if tag in IMPLIED and last(*IMPLIED[tag]) > last(*SCOPES[tag]):
                pop_to(max(last(t) for t in IMPLIED[tag]))
        elif tag == "br":
            add(" ")
        elif tag == "a" and places.get("a") and last("a") > (blocks_at[-1] if blocks_at else -1):
            pop_to(last("a"))  # a link ends where the next begins
        foreign = tag in FOREIGN or last(*FOREIGN) >= 0
        if tag in VOID or (foreign and rest.endswith("/")):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            at = at or n
            continue
        places.setdefault(tag, []).append(len(names))
        if tag not in INLINE:
            attributes = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(rest)).strip() if rest else ""
            nodes.append(paths.below(nodes[-1], tag, attributes, open_features))
            blocks_at.append(len(names))
            for f in nodes[-1].held:
                open_features[f] = open_features.get(f, 0) + 1
        names.append(tag)
        silent += tag in SILENT
        links += tag == "a"
    flush()
    return out


def path_features(node: Node) -> list[str]:
    found = set(node.own)
    while node is not None:
        found.update(node.new)
        node = node.parent
    return sorted(found)


def text_key(block: Block) -> tuple[int, int, int]:
    n = len(block.text)
    marks = sum(map(block.text.count, ".,;:!?"))
    return (min(10, int(math.log2(n + 1))), min(4, block.linked * 4 // n if n else 0), min(4, marks * 40 // n))


def text_features(key: tuple[int, int, int]) -> list[str]:
    size, linked, marks = key
    return [f"size:{size}", f"linked:{linked}", f"marks:{marks}", f"size+linked:{size // 3}:{min(linked, 1)}"]


@dataclass
class Field:
    """weights: log-odds of content by feature; between[a][b]: score of label b after label a."""

    weights: dict[str, float]
    between: list[list[float]]
    begin: list[float]
    _texts: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_texts": {}}

    def emission(self, block: Block) -> float:
        node, above = block.node, []
        while node is not None and node.owner is not self:
            above.append(node)
            node = node.parent
        for x in reversed(above):
            x.inherited = (x.parent.inherited if x.parent else 0.0) + sum(self.weights.get(f, 0.0) for f in x.new)
            x.score, x.owner = x.inherited + sum(self.weights.get(f, 0.0) for f in x.own), self
        found = block.node.score
        key = text_key(block)
        own = self._texts.get(key)
        if own is None:
            own = self._texts[key] = sum(self.weights.get(f, 0.0) for f in text_features(key))
        return found + own

    def decode(self, page: list[Block]) -> list[bool]:
        """The best labelling, by Viterbi."""
        if not page:
            return []
        (b00, b01), (b10, b11) = self.between
        off, on = self.begin[0], self.begin[1] + self.emission(page[0])
        back: list[tuple[bool, bool]] = []
        for block in page[1:]:
            to_off, to_on = on + b10 > off + b00, on + b11 > off + b01
            back.append((to_off, to_on))
            off, on = max(off + b00, on + b10), max(off + b01, on + b11) + self.emission(block)
        label = on > off
        out = [label]
        for to_off, to_on in reversed(back):
            label = to_on if label else to_off
            out.append(label)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        found = blocks(page or "")
        return " ".join(b.text for b, keep in zip(found, self.decode(found), strict=True) if keep)


def train(pages: Iterable[tuple[list[Block], list[bool]]], rounds: int = 12, rate: float = 0.15, decay: float = 1e-4, seed: int = 0) -> Field:
    """A field from labelled pages (blocks, is content), by AdaGrad on the log-likelihood."""
    index: dict[str, int] = {}
    made = []
    for found, labels in pages:
        if found:
            rows = [np.array([index.setdefault(f, len(index)) for f in (*path_features(b.node), *text_features(text_key(b)))]) for b in found]
            made.append((rows, np.array(labels, int)))
    w, wg = np.zeros(len(index)), np.full(len(index), 1e-6)
    t, tg = np.zeros(6), np.full(6, 1e-6)  # four transitions, two beginnings
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in rng.permutation(len(made)):
            rows, y = made[k]
            n = len(rows)
            e = np.array([[0.0, w[r].sum()] for r in rows])
            a, b = np.zeros((n, 2)), np.zeros((n, 2))
            m = t[:4].reshape(2, 2)
            a[0] = t[4:] + e[0]
            for i in range(1, n):
                x = a[i - 1][:, None] + m
                a[i] = np.logaddexp(x[0], x[1]) + e[i]
            for i in range(n - 2, -1, -1):
                x = m + (e[i + 1] + b[i + 1])[None, :]
                b[i] = np.logaddexp(x[:, 0], x[:, 1])
            z = np.logaddexp(a[-1][0], a[-1][1])
            g = y - np.exp(a[:, 1] + b[:, 1] - z)
            gt = np.zeros(6)
            if n > 1:
                pair = np.exp(a[:-1, :, None] + m[None] + (e[1:] + b[1:])[:, None, :] - z).sum(axis=0).ravel()
                gt[:4] = np.bincount(y[:-1] * 2 + y[1:], minlength=4) - pair
            gt[4:] = np.eye(2)[y[0]] - np.exp(a[0] + b[0] - z)
            gw = np.zeros(len(w))
            for r, d in zip(rows, g, strict=True):
                gw[r] += d
            gw -= decay * w
            wg += gw * gw
            tg += gt * gt
            w += rate * gw / np.sqrt(wg)
            t += rate * gt / np.sqrt(tg)
    return Field({f: float(w[i]) for f, i in index.items()}, t[:4].reshape(2, 2).tolist(), t[4:].tolist())


def extract(pages: DataFrame, model: Field, text: str = "html", name: str = "text") -> DataFrame:
    """pages with the main text as one more column."""
    require(pages, text)
    if name in pages.columns:
        raise ValueError(f"pages already has a column {name}")

    @F.arrow_udf(pages.schema[text].dataType)
    def main_text(column: pa.Array) -> pa.Array:
        return pa.array([model.extract(p) for p in column.to_pylist()], pa.string())

    return pages.withColumn(name, main_text(text))


def labelled(marked: str, sign: str) -> tuple[list[Block], list[bool]]:
    """Blocks of a page whose content texts begin with a sign, and their labels."""
    found = blocks(marked)
    labels = [sign in b.text for b in found]
    for b in found:
        b.text = b.text.replace(sign, "")
    return found, labels


def training_set(pages: Iterator[str], sign: str) -> list[tuple[list[Block], list[bool]]]:
    return [labelled(p, sign) for p in pages]
