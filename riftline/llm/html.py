"""HTML extraction (operator 2) by a minimum cut: classifier costs against smoothness between neighbouring blocks.

A page is cut into blocks of text at block-level tags. A logistic model gives each block the odds of being content, from
its tags, the names of its ancestors' classes, its links, its length and its place; these odds become capacities to the
two terminals. Neighbours in page order are joined by an edge, blocks under the same container by a stronger one. The
minimum cut labels all blocks together, so a short paragraph inside an article stays, and a long advert outside goes.

The model is trained in numpy on pages generated from a rule, whose blocks have known labels: articles with menus,
headers, footers, sidebars, notices, adverts, forms and comments, under varying tags and class names.

Defined cases: a null page has no text; a page without markup is one block, and kept; scripts, styles, comments of the
markup, titles and forms are never text; unclosed and stray tags are taken as browsers do, as far as text blocks need it;
repeated rows give equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
BLANK = re.compile(r"\s+")

RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "xmp", "noembed", "noframes"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr", "img",
}
CONTAINERS = {"article", "main", "section", "div", "body", "td", "aside", "nav", "header", "footer", "form", "html"}
# A tag that begins closes these when they are open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEVER = {"form", "button", "select", "option", "textarea", "dialog"}
_BAD = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|sidebar|side|aside|footer|foot|header|masthead|"
    r"cookie\w*|consent|notice\w*|popup|modal|newsletter|subscribe\w*|signup|login|search|breadcrumbs?|pagination|pager|"
    r"related\w*|recommend\w*|share|social|widget|toolbar|comments?|replies|reply|disqus|respond|copyright|legal|skip)(?:$|[-_\s])", re.I
)
_GOOD = re.compile(r"(?:^|[-_\s])(?:article\w*|content|post|story|entry|main|body|text|blog)(?:$|[-_\s])", re.I)


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    bad: bool
    good: bool
    never: bool
    kinds: frozenset


@dataclass
class Blocks:
    text: list[str] = field(default_factory=list)
    node: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)


def parse(page: str) -> tuple[Blocks, list[Node]]:
    """Blocks of text in page order, and the elements they stand in."""
    nodes = [Node("#root", -1, 0, False, False, False, frozenset())]
    out, here, at = Blocks(), 0, 0
    parts: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = BLANK.sub(" ", "".join(parts)).strip()
            if text:
                out.text.append(text)
                out.node.append(block_of(here))
                out.tag.append(nodes[block_of(here)].tag)
                out.linked.append(min(linked, len(text)))
            parts.clear()
        linked = 0

    def block_of(place: int) -> int:
        while nodes[place].tag in INLINE:
            place = nodes[place].parent
        return place

    end = len(page)
    match = TOKEN.match
    while at < end:
        m = match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            piece = m.group(0)
            if piece[0] == "<" and len(piece) > 1:
                continue  # a comment or declaration
            if not nodes[here].never:
                decoded = entities.unescape(piece) if "&" in piece else piece
                parts.append(decoded)
                if in_link:
                    linked += len(decoded)
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in VOID:
                if tag == "br":
                    parts.append(" ")
                continue
            place = here
            while place > 0 and nodes[place].tag != tag:
                # an inline end does not close blocks
                if tag in INLINE and nodes[place].tag not in INLINE:
                    place = 0
                    break
                place = nodes[place].parent
            if place <= 0:
                if tag == "p":
                    flush()
                continue
            if tag not in INLINE:
                flush()
            while here != nodes[place].parent:
                in_link -= nodes[here].tag == "a" and in_link > 0
                here = nodes[here].parent
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag not in INLINE:
            flush()
            # a new block ends an open paragraph (and what is inline in it)
            place = block_of(here)
            if nodes[place].tag == "p" or nodes[place].tag in CLOSES.get(tag, ()):
                here = nodes[place].parent
                in_link = 0
            elif tag in CLOSES:
                while place > 0 and nodes[place].tag not in CLOSES[tag] and nodes[place].tag not in ("ul", "ol", "dl", "table", "select"):
                    place = nodes[place].parent
                if place > 0 and nodes[place].tag in CLOSES[tag]:
                    here = nodes[place].parent
        attributes = m.group(3)
        bad = good = hidden = False
        if attributes and attributes.strip():
            for a in ATTRIBUTE.finditer(attributes):
                name, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
                if name in ("class", "id", "role"):
                    bad, good = bad or bool(_BAD.search(value)), good or bool(_GOOD.search(value))
                    bad = bad or value.lower() in ("navigation", "banner", "contentinfo", "complementary", "dialog", "search")
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    hidden = True
        up = nodes[here]
        kinds = up.kinds if tag in INLINE else up.kinds | {tag}
        nodes.append(Node(tag, here, up.depth + 1, up.bad or bad, up.good or good, up.never or hidden or tag in NEVER, kinds))
        here = len(nodes) - 1
        in_link += tag == "a"
        if attributes and attributes.endswith("/") and tag not in INLINE:
            here = nodes[here].parent
    flush()
    return out, nodes


def features(out: Blocks, nodes: list[Node]) -> np.ndarray:
    n = len(out.text)
    rows = np.zeros((n, 15))
    longest = max((len(t) for t in out.text), default=1)
    for i, text in enumerate(out.text):
        node = nodes[out.node[i]]
        size = len(text)
        inside = node.kinds
        rows[i] = (
            1, np.log1p(size) / 8, out.linked[i] / max(size, 1), node.bad, node.good,
            bool(inside & {"nav", "header", "menu"}) and "article" not in inside, "footer" in inside, "aside" in inside,
            bool(inside & {"article", "main"}), node.tag == "p", node.tag in ("h1", "h2", "h3", "h4", "blockquote", "pre"),
            node.tag == "li", text[-1:] in ".!?…\"'”»:;", size / longest, "©" in text or "cookie" in text.lower(),
        )
    return rows


@dataclass
class BlockModel:
    weights: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


_NAMES = {
    "menu": ("nav", "menu", "navbar", "breadcrumb", "pagination"), "ad": ("ad", "ads", "advert", "sponsored", "promo", "banner"),
    "side": ("sidebar", "related", "widget", "recommended"), "foot": ("footer", "copyright", "legal"), "notice": ("cookie-notice", "consent", "notice", "popup"),
    "talk": ("comments", "comment", "replies"), "head": ("header", "masthead", "site-header"),
}


_LETTERS = "abcdefghilmnoprstu"


def generated_page(draw: np.random.Generator) -> tuple[str, list[int]]:
    """A page from a rule, and the label of each of its blocks in page order."""
    out, label = [], []

    def words(low: int, high: int) -> str:
        return " ".join("".join(map(_LETTERS.__getitem__, draw.integers(18, size=draw.integers(2, 9)))) for _ in range(draw.integers(low, high)))

    def boiler(kind: str, tag: str) -> None:
        name = str(draw.choice(_NAMES[kind]))
        bare = draw.random() < 0.3 and tag != "div"
        out.append(f"<{tag}>" if bare else f'<{tag} class="{name}">')
        if kind in ("menu", "head", "side"):
            links = int(draw.integers(2, 8))
            out.append("<ul>" + "".join(f'<li><a href="#">{words(1, 4)}</a></li>' for _ in range(links)) + "</ul>")
            label.extend([0] * links)
        if kind != "menu":
            text = {"foot": f"&copy; {words(2, 9)}", "notice": f"cookie {words(5, 20)}."}.get(kind, words(3, 40) + ".")
            out.append(f"<p>{text}</p>" if draw.random() < 0.5 else text)
            label.append(0)
        out.append(f"</{tag}>")

    for kind, tag in (("head", "header"), ("menu", "nav"), ("notice", "div"), ("ad", "div")):
        if draw.random() < 0.6:
            boiler(kind, tag if draw.random() < 0.6 else "div")
    shell = ("article", "main", 'div class="content"', 'div class="post"', "section")[int(draw.integers(5))]
    out.append(f"<{shell}><h1>{words(3, 10)}</h1>")
    label.append(1)
    for _ in range(int(draw.integers(1, 12))):
        kind = draw.random()
        if kind < 0.8:
            text = words(1, 90) + (". " if draw.random() < 0.8 else "")
            out.append(f"<p>{text}</p>")
            label.append(1)
        elif kind < 0.88:
            out.append(f"<h2>{words(2, 7)}</h2>")
            label.append(1)
        elif kind < 0.94:
            out.append(f"<ul><li>{words(3, 15)}</li><li>{words(3, 15)}</li></ul>")
            label.extend([1, 1])
        elif kind < 0.97:
            boiler("ad", "div")
        else:
            out.append(f"<blockquote>{words(5, 30)}</blockquote>")
            label.append(1)
    out.append(f"</{shell.split()[0]}>")
    for kind, tag in (("talk", "section"), ("side", "aside"), ("ad", "div"), ("foot", "footer")):
        if draw.random() < 0.6:
            boiler(kind, tag if draw.random() < 0.6 else "div")
    return "".join(out), label


@lru_cache(maxsize=4)
def fit_blocks(pages: int = 400, steps: int = 400, seed: int = 2) -> BlockModel:
    """Logistic regression by gradient steps on the blocks of ``pages`` generated pages."""
    draw = np.random.default_rng(seed)
    x, y = [], []
    for _ in range(pages):
        page, label = generated_page(draw)
        out, nodes = parse(page)
        if len(out.text) == len(label):
            x.append(features(out, nodes))
            y += label
    x, y = np.concatenate(x), np.array(y, dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + 1e-3 * np.eye(len(w))
        move = np.linalg.solve(curve, x.T @ (p - y) / len(x) + 1e-3 * w)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return BlockModel(w)


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay on the source side of a minimum cut (the largest such side), by shortest augmenting paths.

    What a node gets straight through from source to sink is taken off first, so a path runs from a node with source
    capacity left, along edges, to one with sink capacity left.
    """
    n = len(source)
    direct = [min(a, b) for a, b in zip(source, sink, strict=True)]
    supply = [a - d for a, d in zip(source, direct, strict=True)]
    demand = [b - d for b, d in zip(sink, direct, strict=True)]
    to, room, around = [], [], [[] for _ in range(n)]
    for a, b, c in edges:
        around[a].append(len(to))
        to.append(b)
        room.append(c)
        around[b].append(len(to))
        to.append(a)
        room.append(c)
    while True:
        via = [-2] * n
        queue = [i for i in range(n) if supply[i] > 0]
        for i in queue:
            via[i] = -1
        found = -1
        for i in queue:
            if demand[i] > 0:
                found = i
                break
            for e in around[i]:
                j = to[e]
                if room[e] > 0 and via[j] == -2:
                    via[j] = e
                    queue.append(j)
        if found < 0:
            break
        flow, i = demand[found], found
        while via[i] >= 0:
            flow = min(flow, room[via[i]])
            i = to[via[i] ^ 1]
        flow = min(flow, supply[i])
        supply[i] -= flow
        demand[found] -= flow
        i = found
        while via[i] >= 0:
            room[via[i]] -= flow
            room[via[i] ^ 1] += flow
            i = to[via[i] ^ 1]
    # Nodes that can still reach the sink are on its side; all others are content.
    lost = [d > 0 for d in demand]
    queue = [i for i in range(n) if lost[i]]
    for i in queue:
        for e in around[i]:
            j = to[e]
            if room[e ^ 1] > 0 and not lost[j]:
                lost[j] = True
                queue.append(j)
    return [not x for x in lost]


SCALE, ADJACENT, SAME_CONTAINER = 1000, 300, 900


def _container(place: int, nodes: list[Node]) -> int:
    while place > 0 and nodes[place].tag not in CONTAINERS:
        place = nodes[place].parent
    return place


def main_text(page: str | None, model: BlockModel) -> str:
    if not page:
        return ""
    out, nodes = parse(page)
    n = len(out.text)
    if not n:
        return ""
    p = np.clip(model.odds(features(out, nodes)), 1e-6, 1 - 1e-6)
    source = np.round(-np.log(1 - p) * SCALE).astype(int).tolist()
    sink = np.round(-np.log(p) * SCALE).astype(int).tolist()
    holder = [_container(place, nodes) for place in out.node]
    edges = []
    before: dict[int, int] = {}
    for i in range(n):
        if i:
            edges.append((i - 1, i, SAME_CONTAINER if holder[i] == holder[i - 1] else ADJACENT if _near(holder[i], holder[i - 1], nodes) else ADJACENT // 4))
        last = before.get(holder[i], -1)
        if 0 <= last < i - 1:  # the container's block before, past blocks nested between
            edges.append((last, i, SAME_CONTAINER))
        before[holder[i]] = i
    if all(a >= b for a, b in zip(source, sink, strict=True)):
        keep = [True] * n
    else:
        keep = minimum_cut(source, sink, edges)
    return " ".join(text for text, content in zip(out.text, keep, strict=True) if content)


def _near(a: int, b: int, nodes: list[Node]) -> bool:
    """Whether one container holds the other, or both have one parent that is not the page itself."""
    if nodes[a].parent == b or nodes[b].parent == a:
        return nodes[a].tag not in ("body", "html", "#root") and nodes[b].tag not in ("body", "html", "#root")
    return nodes[a].parent == nodes[b].parent and nodes[nodes[a].parent].tag not in ("body", "html", "#root")


def extract(pages: DataFrame, model: BlockModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    held = model or fit_blocks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("html")
            texts = [main_text(column[i].as_py(), held) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
