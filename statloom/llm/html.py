"""Main text of web pages by minimum cut.

A page becomes a row of text blocks, the nodes of a network. A classifier over a block's length, links and elements gives
it the cost of calling it content or boilerplate: the capacities of its edges to the two terminals. Edges between
neighbours in page order and between blocks of one parent make unlike labels cost something. The minimum cut parts
content from boilerplate with the least total cost.

What a page says about itself ties a block to a terminal for good: an article element, hidden blocks, menus and notices
by element or name. Such pages are also where the costs are learned, from text and links alone, so that they hold for
pages and blocks that say nothing: a logistic regression over patterns of features, and for each kind of edge the odds
that its ends agree. All pages count; Spark sums at most a few hundred counts.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a comment, a declaration or a tag starts, and a tag's attributes, in which quotes hide its end.
_START = re.compile(r"""<!--|<[!?]|<(/?)([a-zA-Z][^\s/>"'<]*+)""")
_QUOTED = re.compile(r"""((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_NAME_PART = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Elements whose content is not text of the page: up to the end tag whatever it holds, and, where an end tag follows at
#: all, elements like others.
RAW = frozenset(("script", "style", "template", "noscript", "iframe", "textarea", "title"))
EMBEDDED = frozenset(("svg", "object", "select", "canvas", "audio", "video"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "math", "mfrac", "mi", "mn", "mo", "mover", "mrow", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "semantics"))
#: Elements that the same element's start closes, up to the nearest of the second kind.
SELF_CLOSING = {"p": (), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: A paragraph ends where one of these starts.
ENDS_PARAGRAPH = frozenset(("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"))
BOILERPLATE_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "fieldset"))
CONTENT_TAGS = frozenset(("article", "main"))
#: Parts of class, id and role names.
BOILERPLATE_NAMES = frozenset(
    "ad ads adbox advert advertisement advertising adsbygoogle alert banner breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog discussion "
    "disqus footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar topbar widget".split()
)
CONTENT_NAMES = frozenset("article articlebody body content entry main maincontent post story text".split())

#: A block that the page itself labels is tied to its terminal by this much.
TIED = 1e6
#: Bins of length (doublings), of the share of links, and kinds of block; named or not is the fourth feature.
LENGTHS, LINK_SHARES, KINDS = 11, 4, 4
PATTERNS = LENGTHS * LINK_SHARES * KINDS * 2
#: Edges: neighbours in page order with unlike parents, the same with one parent, next but one with one parent.
NEXT, NEXT_SIBLING, SECOND_SIBLING = range(3)
#: The regression's penalty, a normal prior's precision on each coefficient but the intercept.
RIDGE = 1.0


@dataclass(frozen=True)
class Costs:
    """Evidence for content of each pattern of features (against it, if negative), and what parting an edge costs."""

    evidence: tuple[float, ...]
    edges: tuple[float, float, float]


class _Block:
    __slots__ = ("text", "links", "tag", "parent", "content", "named", "boilerplate")

    def __init__(self, tag: str, parent: int, content: bool, named: bool, boilerplate: bool):
        self.text: list[str] = []
        self.links = 0
        self.tag, self.parent = tag, parent
        self.content, self.named, self.boilerplate = content, named, boilerplate


def _roles(tag: str, attributes: str, inside_content: bool) -> tuple[bool, bool, bool]:
    """Whether an element marks content by its tag, content by its names, boilerplate."""
    boilerplate = tag in BOILERPLATE_TAGS or tag in EMBEDDED or tag == "header" and not inside_content
    content, named = tag in CONTENT_TAGS, False
    if attributes and not attributes.isspace():
        low = attributes.lower()
        parts: set[str] = set()
        for name, value in _ATTRIBUTE.findall(low):
            if name in ("class", "id", "role"):
                parts.update(_NAME_PART.findall(value))
            elif name == "style" and _HIDDEN.search(value) or name == "aria-hidden" and "true" in value:
                boilerplate = True
        bare = _ATTRIBUTE.sub(" ", low).split()
        if "hidden" in bare:
            boilerplate = True
        if tag not in ("body", "html"):
            if parts & BOILERPLATE_NAMES and not (tag in CONTENT_TAGS and parts & CONTENT_NAMES) and not (inside_content and parts <= {"header", "text", "content", "article", "entry", "post"}):
                boilerplate = True
            named = bool(parts & CONTENT_NAMES)
            content = content or "main" in parts and "role" in low
    return content and not boilerplate, named and not boilerplate, boilerplate


def blocks(page: str) -> list[_Block]:
    """Text blocks in page order. Block elements and line breaks part them; empty ones are left out."""
    found: list[_Block] = []
    # open elements: tag, content, named, boilerplate, number
    stack: list[tuple[str, bool, bool, bool, int]] = [("", False, False, False, 0)]
    # places in the stack of each tag, and of all that are not inline, so that no tag searches it
    places: dict[str, list[int]] = {}
    standing: list[int] = [0]
    number = 0
    current: _Block | None = None
    links = 0

    def add(piece: str) -> None:
        nonlocal current
        if "&" in piece:
            piece = entities.unescape(piece)
        if current is None:
            if not piece or piece.isspace():
                return
            k = standing[-1]
            tag, content, named, boilerplate, n = stack[-1]
            current = _Block(stack[k][0], stack[k - 1][4] if k else 0, content, named, boilerplate)
            found.append(current)
        current.text.append(piece)
        if links:
            current.links += len(piece)

    def cut(k: int) -> None:
        """Close the k-th open element and those inside it."""
        nonlocal links
        while len(stack) > k:
            open_tag = stack.pop()[0]
            places[open_tag].pop()
            links -= open_tag == "a"
            if open_tag not in INLINE:
                standing.pop()

    last_ends: dict[str, int] = {}  # where each embedded element's last end tag starts

    def ends_later(tag: str, place: int) -> bool:
        if tag not in last_ends:
            last_ends[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
        return last_ends[tag] >= place

    # quotes hide the end of a tag until some quote stays open to the end of the page; then they no longer do, so that
    # no more than one tag is read to the page's end in vain
    at, quotes = 0, True
    while m := _START.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        name = m[2]
        if name is None:
            close = "-->" if m[0] == "<!--" else ">"
            end = page.find(close, m.end())
            at = len(page) if end < 0 else end + len(close)
            continue
        told = _QUOTED.match(page, m.end()) if quotes else None
        if told:
            attributes, end = told[1], told.end()
        else:
            quotes, close = False, page.find(">", m.end())
            if close < 0:  # no tag ends any more: the rest is text, up to a comment
                add(re.split("<[!?]", page[m.start() :], maxsplit=1)[0])
                at = len(page)
                break
            attributes, end = page[m.end() : close], close + 1
        at = end
        tag = name.lower()
        if m[1]:
            if tag not in INLINE:
                current = None
            if places.get(tag):
                cut(places[tag][-1])
            continue
        if tag in RAW:
            end_tag = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            close = page.find(">", end_tag.end()) if end_tag else -1
            at = len(page) if close < 0 else close + 1
            continue
        if tag in EMBEDDED and (attributes.endswith("/") and tag == "svg" or not ends_later(tag, at)):
            continue
        if tag not in INLINE:
            current = None
        if tag in VOID:
            continue
        if tag == "body":
            cut(1)
        closes = tag if tag in SELF_CLOSING else ""
        if tag in ENDS_PARAGRAPH:
            closes = "p"
        if closes and places.get(closes):
            stops = SELF_CLOSING[closes]
            nearest = max((places[s][-1] for s in stops if places.get(s)), default=0) if stops else standing[-1]
            if places[closes][-1] >= nearest:
                cut(places[closes][-1])
        if attributes.endswith("/") and tag in INLINE:
            continue
        number += 1
        above = stack[-1]
        content, named, boilerplate = _roles(tag, attributes, above[1])
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            standing.append(len(stack))
        stack.append((tag, above[1] or content, above[2] or named, above[3] or boilerplate, number))
        links += tag == "a"
    if at < len(page):
        add(page[at:])
    return found


def pattern(block: _Block, length: int) -> int:
    """The number of a block's pattern of features."""
    size = min((length + 1).bit_length() - 1, LENGTHS - 1)
    share = 0 if not block.links else 1 + min(int(3 * block.links / max(length, block.links)), 2)
    kind = 1 if block.tag in ("p", "blockquote", "pre") else 2 if block.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 3 if block.tag in ("li", "td", "th", "dt", "dd") else 0
    return ((size * LINK_SHARES + share) * KINDS + kind) * 2 + block.named


def _design() -> np.ndarray:
    """A row of indicators for each pattern, the intercept first."""
    n = np.arange(PATTERNS)
    named, kind, share, size = n % 2, n // 2 % KINDS, n // (2 * KINDS) % LINK_SHARES, n // (2 * KINDS * LINK_SHARES)
    one_hot = [np.eye(width)[v] for v, width in ((size, LENGTHS), (share, LINK_SHARES), (kind, KINDS))]
    return np.column_stack([np.ones(PATTERNS), *one_hot, named])


def costs_from(blocks_seen: np.ndarray, content: np.ndarray, unlike: np.ndarray, alike: np.ndarray) -> Costs:
    """Costs from the number of blocks and of content blocks of each pattern, and of each kind of edge's ends."""
    x, beta = _design(), np.zeros(2 + LENGTHS + LINK_SHARES + KINDS)
    penalty = np.diag([1e-6, *[RIDGE] * (len(beta) - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ beta)))
        step = np.linalg.solve(x.T * (blocks_seen * p * (1 - p)) @ x + penalty, x.T @ (content - blocks_seen * p) - penalty @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.max(np.abs(step)) < 1e-8:
            break
    # a block has up to four edges whose evidence is much the same, so each counts a quarter
    edges = np.maximum(np.log((alike + 1) / (unlike + 1)), 0) / 4
    return Costs(tuple(float(v) for v in x @ beta), tuple(float(v) for v in edges))


def _prior() -> Costs:
    """Costs where no page labels itself: long blocks are content, links aren't."""
    n = np.arange(PATTERNS)
    named, kind, share, size = n % 2, n // 2 % KINDS, n // (2 * KINDS) % LINK_SHARES, n // (2 * KINDS * LINK_SHARES)
    z = -0.4 + np.minimum((2.0**size - 1) / 60, 3.0) - np.array([0, 1, 2.5, 4])[share] + 1.5 * named + np.array([0, 0.6, 0.3, 0])[kind]
    return Costs(tuple(float(v) for v in z), (0.5, 0.9, 0.3))


PRIOR = _prior()


def minimum_cut(weights: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) of least cost: |weight| of each node that is cut off, and each parted edge.

    Nodes that all their edges together can't turn keep their own label, and the others get the edges to them as part of
    their weight; only the rest needs a maximum flow.
    """
    n = len(weights)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
    weights = list(weights)
    label: list[bool | None] = [None] * n
    pull = [sum(c for _, c in x) for x in near]
    ready = [i for i in range(n) if abs(weights[i]) > pull[i]]
    while ready:
        i = ready.pop()
        if label[i] is not None:
            continue
        label[i] = weights[i] > 0
        for j, c in near[i]:
            if label[j] is None:
                weights[j] += c if label[i] else -c
                pull[j] -= c
                if abs(weights[j]) > pull[j]:
                    ready.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        on_source = _flow(rest, weights, near, label)
        for i in rest:
            label[i] = i in on_source
    return [bool(x) for x in label]


def _flow(nodes: list[int], weights: list[float], near: list, label: list) -> set[int]:
    """Nodes on the source's side of a minimum cut: blocking flows through levels of equal distance from the source."""
    place = {i: k for k, i in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    # edge 2k and its reverse 2k + 1
    ends: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(nodes) + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(ends))
        out[b].append(len(ends) + 1)
        ends.extend((b, a))
        room.extend((there, back))

    for i in nodes:
        if weights[i] > 0:
            join(source, place[i], weights[i], 0.0)
        elif weights[i] < 0:
            join(place[i], sink, -weights[i], 0.0)
        for j, c in near[i]:
            if label[j] is None and i < j:
                join(place[i], place[j], c, c)
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[ends[e]] < 0:
                    level[ends[e]] = level[a] + 1
                    queue.append(ends[e])
        if level[sink] < 0:
            return {i for i in nodes if level[place[i]] >= 0}
        tried = [0] * len(out)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                most = min(room[e] for e in path)
                cut = 0
                for k in reversed(range(len(path))):
                    room[path[k]] -= most
                    room[path[k] ^ 1] += most
                    if room[path[k]] <= 1e-9:
                        cut = k
                at = ends[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[at] < len(out[at]):
                e = out[at][tried[at]]
                if room[e] > 1e-9 and level[ends[e]] == level[at] + 1:
                    break
                tried[at] += 1
            if tried[at] < len(out[at]):
                path.append(e)
                at = ends[e]
            elif path:
                at = ends[path.pop() ^ 1]
                tried[at] += 1
            else:
                break


def _network(page: str) -> tuple[list[tuple[_Block, str]], list[tuple[int, int, int]], bool]:
    """Blocks with their texts, edges as (block, block, kind), and whether the page marks its content."""
    kept = [(b, t) for b in blocks(page) if (t := " ".join("".join(b.text).split()))]
    edges = []
    for i in range(1, len(kept)):
        edges.append((i - 1, i, NEXT_SIBLING if kept[i][0].parent == kept[i - 1][0].parent else NEXT))
        if i > 1 and kept[i][0].parent == kept[i - 2][0].parent:
            edges.append((i - 2, i, SECOND_SIBLING))
    return kept, edges, any(b.content and not b.boilerplate for b, _ in kept)


def labels(kept: list[tuple[_Block, str]], edges: list[tuple[int, int, int]], has_content: bool, costs: Costs) -> list[bool]:
    """Whether each block is content, by the minimum cut."""
    weights = []
    for b, t in kept:
        if b.boilerplate or has_content and not b.content:
            weights.append(-TIED)
        else:
            weights.append(TIED if has_content else costs.evidence[pattern(b, len(t))])
    return minimum_cut(weights, [(i, j, costs.edges[kind]) for i, j, kind in edges])


def main_text(page: str | None, costs: Costs = PRIOR) -> str:
    """Content blocks in page order, white space inside them as one space, joined by one space."""
    if not page:
        return ""
    kept, edges, has_content = _network(page)
    return " ".join(t for (_, t), keep in zip(kept, labels(kept, edges, has_content, costs), strict=True) if keep)


def _counts(page: str) -> np.ndarray:
    """Blocks and content blocks of each pattern, then unlike and like ends of each kind of edge, of a page that marks
    its content (zeros for another)."""
    out = np.zeros((2, PATTERNS + 3), dtype=np.int64)
    kept, edges, has_content = _network(page)
    if has_content:
        told = [b.content and not b.boilerplate for b, _ in kept]
        for (b, t), y in zip(kept, told, strict=True):
            k = pattern(b, len(t))
            out[0, k] += 1
            out[1, k] += y
        for i, j, kind in edges:
            out[int(told[i] == told[j]), PATTERNS + kind] += 1
    return out


def fit(pages: DataFrame) -> Costs:
    """Costs learned from all rows of pages whose html marks its content; PRIOR where there is none.

    Each task adds up counts by pattern; Spark adds up those, and no more than their sums (two for each of PATTERNS + 3)
    reach the driver. Null and empty html counts nothing; a page that is there twice counts twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, PATTERNS + 3), dtype=np.int64)
        for b in batches:
            for page in b.column("html").to_pylist():
                total += _counts(page)
        found = np.nonzero(total.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[0, found]), pa.array(total[1, found])], names=["k", "a", "b"])

    rows = pages.select(F.col("html").cast("string").alias("html")).where("html != ''").mapInArrow(run, "k int, a long, b long")
    total = np.zeros((2, PATTERNS + 3))
    for k, a, b in rows.groupBy("k").agg(F.sum("a"), F.sum("b")).collect():
        total[:, k] = a, b
    seen, content = total[:, :PATTERNS]
    if not 0 < content.sum() < seen.sum():
        return PRIOR
    return costs_from(seen, content, *total[:, PATTERNS:])


def extract(pages: DataFrame, id_column: str = "page_id", costs: Costs | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars. Costs are learned from the same pages if none are given.

    A null or empty html, and a page without content, has an empty text. Whole pages are read, however long and however
    badly nested; equal rows give equal results; an empty table gives an empty result; further columns are ignored.
    """
    known = costs or fit(pages)
    picked = pages.select(F.col(id_column).alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, known) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return picked.mapInArrow(run, f"page_id {picked.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
