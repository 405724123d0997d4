"""Main text of HTML pages by tag-path ratios.

A page is read into text nodes, each with the path of open elements from the
root to it.  A step of a path is an element's tag and class; paths are numbered,
so nesting of any depth costs one number an element.  Per path, text length,
punctuation and link text are summed and divided by the number of its nodes,
inline elements counting to the block they stand in.  The ratios are smoothed
over the nodes in page order and fused into one score with what the path itself
tells: a path through an article or main element scores higher, one through an
element whose class or id names a part that is no article far lower, and link
text counts against it.  Nodes of paths above a threshold are content.

What lies between content nodes, in an article or a heading has some support:
there a node's path needs less, so short lines and list items stay, while
adverts, reader comments and lists of links go by their scores.  Only elements
that HTML itself sets apart by tag, role or as hidden take no part at all.

Cases: null, empty and textless pages give the empty text.  Attributes are read
by whole name, so what a title or address says drops nothing.  Long pages and
deep nesting take time and memory in proportion.  Equal scores are treated
alike; rows that repeat count each, an empty table gives an empty one, and other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import portions

#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that continue the block they stand in.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template iframe object svg math head title select button textarea canvas audio video datalist".split())
#: Elements that are never part of an article; a header or footer inside one is dropped too if it is a footer.
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
#: Parts that are no article, where a class or id is or ends in their name; headers only outside articles.
PARTS = frozenset("ad ads advert adverts advertisement banner comment comments footer menu nav navigation notice notices sidebar".split())
HEADERS = frozenset(("header", "masthead"))
#: Roles of such parts.
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: A start tag of the key closes an open element of the values, if no scope element stands between.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPE = frozenset("html body table ul ol dl td th div article main section blockquote nav aside header footer form".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|textarea|title|svg|math|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?P<late>>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Weights of a node and its neighbours in smoothing.
WINDOW = (0.25, 0.5, 0.25)
#: How much higher paths through an article and how much lower those through other parts score.
ARTICLE_GAIN, PART_LOSS = 4.0, 0.05
#: The share of the mean score that content needs, and what a node has without it between content, in an article or a heading.
THRESHOLD, SUPPORT = 0.3, 0.5


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name, the first of a name; one without a value has the empty one."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), value[1:-1] if value[:1] in ("\"", "'") else value)
    return found


def _hidden(given: dict[str, str]) -> bool:
    if "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true":
        return True
    declared = (d.partition(":") for d in given.get("style", "").lower().split(";"))
    return any((prop.strip(), value.strip().partition(" ")[0]) in (("display", "none"), ("visibility", "hidden")) for prop, _, value in declared)


def _names_part(given: dict[str, str], tag: str, in_article: bool) -> bool:
    """Whether class or id name a part that is no article."""
    for name in (given.get("class", "") + " " + given.get("id", "")).split():
        words = WORD.findall(name)
        last = words[-1].lower() if words else ""
        if last in PARTS or last in HEADERS and not in_article and tag not in HEADINGS:
            return True
    return False


class _Element:
    """An open or closed element: first and stop bound the text nodes in it."""

    __slots__ = ("tag", "parent", "out", "depth", "path", "block", "link", "article", "heading", "part", "first", "stop")

    def __init__(self, tag: str, parent: _Element | None, out: bool, part: bool, path: int, first: int) -> None:
        self.tag, self.parent, self.path, self.first, self.stop = tag, parent, path, first, None
        above = parent is not None
        self.out = out or above and parent.out
        self.part = part or above and parent.part
        self.depth = parent.depth + 1 if above else 0
        #: the path of the block that the element is or stands in
        self.block = parent.block if above and tag in INLINE else path
        self.link = tag == "a" or above and parent.link
        self.article = tag in ("article", "main") or above and parent.article
        self.heading = tag in HEADINGS or above and parent.heading


Node = tuple[_Element, int, str]


class _Page:
    """The elements of a page, with the text nodes found so far and how many elements of each tag are open."""

    def __init__(self) -> None:
        self.paths: dict[tuple[int, str, str], int] = {}
        self.top = _Element("", None, False, False, 0, 0)
        self.nodes: list[Node] = []
        self.block = 0
        self.open: Counter = Counter()

    def text(self, text: str) -> None:
        self.nodes.append((self.top, self.block, text))

    def start(self, tag: str, out: bool, part: bool, label: str) -> None:
        path = self.paths.setdefault((self.top.path, tag, label), len(self.paths) + 1)
        self.top = _Element(tag, self.top, out, part, path, len(self.nodes))
        self.open[tag] += 1

    def close_to(self, parent: _Element) -> None:
        """Close open elements until ``parent`` is the innermost."""
        while self.top is not parent:
            self.top.stop = len(self.nodes)
            self.open[self.top.tag] -= 1
            self.top = self.top.parent

    def end(self, tag: str) -> None:
        """An end tag closes the innermost element of its name; </p> and </li> not beyond the next scope."""
        if not self.open[tag]:
            return
        e = self.top
        while e.tag != tag:
            if e.tag in SCOPE and tag in ("p", "li"):
                return
            e = e.parent
        self.close_to(e.parent)

    def close(self, tags: tuple[str, ...]) -> None:
        """A start tag closes an open element of ``tags`` in the same scope."""
        if not any(self.open[t] for t in tags):
            return
        e = self.top
        while e.parent is not None:
            if e.tag in tags:
                self.close_to(e.parent)
                return
            if e.tag in SCOPE:
                return
            e = e.parent


def text_nodes(html: str) -> list[Node]:
    """(element, block number, raw text) of each text node in page order; silent elements have none."""
    page, at = _Page(), 0
    root = page.top
    for m in TOKEN.finditer(html):
        if m.start() > at:
            page.text(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            page.block += m["late"] is not None
            continue
        if tag == "br":
            page.text(" ")
            continue
        if tag not in INLINE:
            page.block += 1
        if m["end"]:
            page.end(tag)
            continue
        if tag in ENDS_P:
            page.close(("p",))
        if tag in CLOSES:
            page.close(CLOSES[tag])
        if tag in VOID or m["attrs"].endswith("/") and tag in SILENT:
            continue
        given = attributes(m["attrs"]) if m["attrs"].strip() else {}
        out = tag in SILENT
        if tag not in ("html", "body", "article", "main"):
            header = tag == "header" and not page.top.article
            out = out or header or tag in OUTSIDE or given.get("role", "").strip().lower() in OUTSIDE_ROLES or _hidden(given)
            page.start(tag, out, _names_part(given, tag, page.top.article), given.get("class", "").rstrip("-_0123456789"))
        else:
            page.start(tag, out, False, "")
    if at < len(html):
        page.text(html[at:])
    page.close_to(root)
    root.stop = len(page.nodes)
    return page.nodes


def path_table(nodes: list[Node]) -> dict[int, tuple[int, int, int, int]]:
    """Per path: characters of text, punctuation, text nodes, characters of link text."""
    table: dict[int, tuple[int, int, int, int]] = {}
    for e, _, text in nodes:
        length, points, count, linked = table.get(e.path, (0, 0, 0, 0))
        n = len(text.strip())
        table[e.path] = length + n, points + len(PUNCTUATION.findall(text)), count + 1, linked + n * e.link
    return table


def path_scores(nodes: list[Node]) -> dict[int, float]:
    """Per path the mean of its block's fused, smoothed ratios, raised in articles and lowered in other parts and by links."""
    blocks: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    table = path_table(nodes)
    for path, block in {e.path: e.block for e, _, _ in nodes}.items():
        blocks[block] = [x + y for x, y in zip(blocks[block], table[path])]
    own = [blocks[e.block] for e, _, _ in nodes]
    reach = len(WINDOW) // 2

    def smooth(x: list[float]) -> np.ndarray:
        return np.convolve(np.pad(np.array(x, float), reach, mode="edge"), WINDOW, mode="valid")

    fused = smooth([length / count for length, _, count, _ in own]) * (1 + smooth([points / count for _, points, count, _ in own]))
    sums: dict[int, float] = defaultdict(float)
    for (e, _, _), (_, _, count, _), score in zip(nodes, own, fused):
        sums[e.block] += score / count
    worth = path_worth(nodes)
    return {e.path: sums[e.block] * worth[e.path] * (ARTICLE_GAIN if e.article else 1.0) for e, _, _ in nodes}


def path_worth(nodes: list[Node]) -> dict[int, float]:
    """Per path the share of its block's text that is no link, lowered in parts that are no article."""
    table = path_table(nodes)
    text: Counter = Counter()
    linked: Counter = Counter()
    for path, block in {e.path: e.block for e, _, _ in nodes}.items():
        text[block] += table[path][0]
        linked[block] += table[path][3]
    return {e.path: (1 - linked[e.block] / max(text[e.block], 1)) * (PART_LOSS if e.part else 1.0) for e, _, _ in nodes}


def _held_by(a: _Element, b: _Element) -> _Element:
    """The innermost element that holds both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def main_text(html: str) -> str:
    """The article's blocks, white space in each made single spaces, joined by blank lines; empty if there is none."""
    nodes = [(e, b, unescape(t)) for e, b, t in text_nodes(html)]
    inside = [i for i, (e, _, t) in enumerate(nodes) if not e.out and t and not t.isspace()]
    if not inside:
        return ""
    seen = [nodes[i] for i in inside]
    scores, worth = path_scores(seen), path_worth(seen)
    lengths = [len(t) for _, _, t in seen]
    mean = sum(n * scores[e.path] for (e, _, _), n in zip(seen, lengths)) / sum(lengths)
    content = [i for i in inside if scores[nodes[i][0].path] >= THRESHOLD * mean]
    first, last = content[0], content[-1]
    # in page order the innermost element of all content is that of its first and last node
    holder = _held_by(nodes[first][0], nodes[last][0])
    while holder.parent is not None and (holder.tag in INLINE or holder.tag == "p" or holder.parent.article):
        holder = holder.parent
    blocks: dict[int, list[str]] = {}
    ends = nodes[first][1], nodes[last][1]
    for i in range(holder.first, holder.stop):
        e, b, text = nodes[i]
        # white space between the nodes of a block has no path of its own
        if e.out or e.path not in scores:
            if not e.out and b in blocks:
                blocks[b].append(text)
            continue
        supported = ends[0] <= b <= ends[1] or holder.article or e.heading
        if scores[e.path] >= THRESHOLD * mean or supported and scores[e.path] + SUPPORT * worth[e.path] * mean >= THRESHOLD * mean:
            blocks.setdefault(b, []).append(text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n\n".join(x for x in lines if x)


def extracted(html: Column) -> Column:
    """The main text of a column of pages; null pages give the empty text."""

    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(h) if h else "" for (part,) in portions(batch) for h in part], pa.string())

    extract.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(extract, "string")(html)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row, in one pass without a shuffle."""
    return pages.select("page_id", "url", extracted(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
