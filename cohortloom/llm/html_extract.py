"""Main text of web pages by a tree-structured graphical model over their elements and blocks."""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cohortloom.llm.batches import map_texts
from cohortloom.llm.html_pages import labelled_pages

# Elements of HTML by how they are read.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template title svg math iframe object canvas audio video select textarea button datalist noframes".split())
#: An opening tag (key) ends an open element of these, unless one of ``SCOPES`` was opened since.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset("ul ol dl table td th body html button menu".split())
TOKEN = re.compile("[A-Za-z][a-z]*")


@dataclass
class Page:
    """Nodes in page order, parents first: elements that hold blocks, and blocks of text as leaves."""

    parent: list[int] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    main: list[bool | None] = field(default_factory=list)


class Reader(HTMLParser):
    """Builds a ``Page`` from markup, however broken; ends that are left out are implied by what follows."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open: list[tuple[str, int, bool | None]] = []
        self.counts: dict[str, int] = {}
        self.run: list[str] = []
        self.linked = self.links = self.silent = 0
        self._node(-1, ["element", "tag:#root"], None, None)

    def _node(self, parent: int, features: list[str], text: str | None, main: bool | None) -> int:
        page = self.page
        page.parent.append(parent)
        page.features.append(features)
        page.text.append(text)
        page.main.append(main)
        return len(page.parent) - 1

    def _here(self) -> tuple[str, int, bool | None]:
        return self.open[-1] if self.open else ("#root", 0, None)

    def _flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                tag, node, main = next((x for x in reversed(self.open) if x[1]), ("#root", 0, None))
                words, share = text.count(" ") + 1, self.linked / len(text)
                size = "1" if words < 4 else "2" if words < 10 else "3" if words < 30 else "4"
                links = "none" if not self.linked else "some" if share < 0.5 else "most"
                found = ["leaf", f"in:{tag}", f"words:{size}", f"links:{links}"]
                found += ["stop"] * (text[-1] in ".!?:;…\"'»") + ["sign"] * ("©" in text)
                self._node(node, found, text, main)
        self.run, self.linked = [], 0

    def _push(self, tag: str, attrs: list) -> None:
        node, given = 0, dict(attrs)
        main = True if "main" in given else False if "rest" in given else self._here()[2]
        if tag in BLOCKS:
            found = ["element", f"tag:{tag}"]
            for name in ("class", "id", "role", "itemprop"):
                words = TOKEN.findall(given.get(name) or "")
                found += [f"{'role' if name == 'role' else 'name'}:{w.lower()}" for w in words]
            style = (given.get("style") or "").replace(" ", "").lower()
            if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style:
                found.append("hidden")
            holder = next((x[1] for x in reversed(self.open) if x[1]), 0)
            node = self._node(holder, sorted(set(found)), None, main)
        self.open.append((tag, node, main))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def _pop(self) -> None:
        tag, _, _ = self.open.pop()
        self.counts[tag] -= 1
        if tag == "a":
            self.links -= 1
        if tag in SILENT:
            self.silent -= 1

    def _end(self, tags: set[str]) -> None:
        """End the innermost open element of ``tags`` inside the present scope."""
        if not any(self.counts.get(t) for t in tags):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in SCOPES:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS and not self.silent:
            self._flush()
            if self.counts.get("p"):
                self._end({"p"})
        elif tag == "br":
            self.run.append(" ")
        if tag in VOID:
            return
        if tag in ENDS and not self.silent:
            self._end(ENDS[tag])
        self._push(tag, attrs)
        self.links += tag == "a"
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.counts.get(tag):
            return
        if tag in BLOCKS and not self.silent:
            self._flush()
        while self.open:
            last = self.open[-1][0]
            self._pop()
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.run.append(data)
            if self.links > 0:
                self.linked += len(data.strip())

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` with whatever follows is a comment up to the next ``>``, or to the end of the page."""
        end = self.rawdata.find(">", i)
        return len(self.rawdata) if end < 0 else end + 1

    def read(self, html: str) -> Page:
        self.feed(html)
        self.close()
        self._flush()
        return self.page


@dataclass(frozen=True)
class PageModel:
    """Log-odds of features, and of a child's state given its parent's: ``joint[kind][parent][child]``."""

    weights: dict[str, float]
    joint: dict[str, list[list[float]]]

    def odds(self, page: Page) -> list[float]:
        """Marginal log-odds that a node is content, by messages from the leaves to the root and back."""
        weights, n = self.weights, len(page.parent)
        own = [sum([weights.get(f, 0.0) for f in found]) for found in page.features]
        up = [0.0] * n
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = self.joint[page.features[i][0]]
            e = math.exp(max(-30.0, min(30.0, own[i])))
            up[i] = math.log((c + d * e) / (a + b * e))
            own[page.parent[i]] += up[i]
        for i in range(1, n):
            (a, b), (c, d) = self.joint[page.features[i][0]]
            e = math.exp(max(-30.0, min(30.0, own[page.parent[i]] - up[i])))
            own[i] += math.log((b + d * e) / (a + c * e))
        return own

    def text(self, html: str) -> str:
        """Blocks that are more likely content than not, in page order, a line each."""
        if not html:
            return ""
        page = Reader().read(html)
        return "\n".join(t for t, odds in zip(page.text, self.odds(page), strict=True) if t and odds > 0)


def states(page: Page) -> list[bool]:
    """Labels of all nodes: a block has its own, an element that of most of the text below it."""
    n = len(page.parent)
    size, content = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if page.text[i] is not None:
            size[i] = len(page.text[i])
            content[i] = size[i] if page.main[i] else 0
        if i:
            size[page.parent[i]] += size[i]
            content[page.parent[i]] += content[i]
    return [2 * c > s for c, s in zip(content, size, strict=True)]


def train(pages: list[str], steps: int = 250, penalty: float = 2e-3) -> PageModel:
    """Weights of features and pair potentials that make the labels most likely.

    Each step compares what the labels show with what sum-product expects, over all nodes and all pairs of parent and
    child; the trees of all pages are worked on together, one depth at a time.
    """
    read = [Reader().read(p) for p in pages]
    starts = np.cumsum([0, *[len(p.parent) for p in read]])
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(read, starts, strict=False)])
    y = np.array([s for p in read for s in states(p)], float)
    rows = [found for p in read for found in p.features]
    names = sorted({f for found in rows for f in found})
    at = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for r, found in enumerate(rows):
        x[r, [at[f] for f in found]] = 1.0
    kinds = ["element", "leaf"]
    kind = np.array([kinds.index(found[0]) for found in rows])
    depth = np.zeros(len(rows), int)
    for i in np.flatnonzero(parent >= 0):
        depth[i] = depth[parent[i]] + 1
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kind[child], y[parent[child]].astype(int), y[child].astype(int)), 1)

    theta, speed, size = np.zeros(len(names) + 8), np.zeros(len(names) + 8), np.zeros(len(names) + 8)
    for step in range(1, steps + 1):
        pair = np.exp(theta[len(names) :].reshape(2, 2, 2))
        own = (x @ theta[: len(names)]).astype(float)
        up, below = np.zeros(len(rows)), np.zeros(len(rows))
        for level in reversed(levels):
            t, below[level] = pair[kind[level]], own[level]
            e = np.exp(np.clip(own[level], -30, 30))
            up[level] = np.log((t[:, 1, 0] + t[:, 1, 1] * e) / (t[:, 0, 0] + t[:, 0, 1] * e))
            np.add.at(own, parent[level], up[level])
        for level in levels:
            t = pair[kind[level]]
            e = np.exp(np.clip(own[parent[level]] - up[level], -30, 30))
            own[level] += np.log((t[:, 0, 1] + t[:, 1, 1] * e) / (t[:, 0, 0] + t[:, 1, 0] * e))
        above = np.exp(np.clip(own[parent[child]] - up[child], -30, 30))
        joint = pair[kind[child]] * np.stack([np.ones(len(child)), above], 1)[:, :, None]
        joint = joint * np.stack([np.ones(len(child)), np.exp(np.clip(below[child], -30, 30))], 1)[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        expected = np.stack([joint[kind[child] == k].sum(axis=0) for k in range(2)])
        marginal = 1 / (1 + np.exp(-np.clip(own, -30, 30)))
        slope = np.concatenate([x.T @ (y - marginal), (seen - expected).ravel()]) / len(read) - penalty * theta
        speed, size = 0.9 * speed + 0.1 * slope, 0.99 * size + 0.01 * slope**2
        theta = theta + 0.1 * (speed / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-6)
    pair = np.exp(theta[len(names) :].reshape(2, 2, 2)).tolist()
    return PageModel(dict(zip(names, theta[: len(names)].tolist(), strict=True)), dict(zip(kinds, pair, strict=True)))


@functools.lru_cache(maxsize=1)
def default_model() -> PageModel:
    return train(labelled_pages())


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: PageModel | None = None) -> DataFrame:
    """Columns ``keep``, ``text`` (blocks of the article, a line each) and ``n_chars`` of every whole page; no shuffle.

    White space inside a block is one space, a line break of the markup included; blocks without text are left
    out, equal blocks are kept each. Null and empty pages, and pages whose blocks all look like something else, have an empty text. Broken
    markup is read as far as it goes. Other columns are ignored; an empty table stays empty.
    """
    found = model or default_model()
    out = StructType([StructField("text", StringType()), StructField("n_chars", LongType())])

    def make():
        def work(texts: list[str]) -> dict:
            made = [found.text(x) for x in texts]
            return {"text": made, "n_chars": [len(x) for x in made]}

        return work

    return map_texts(pages, make, out, html, list(keep))
