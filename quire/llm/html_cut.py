"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks.  A linear classifier gives each block a score from its tag,
the elements around it and their class, id and role words, its length, its links and its
punctuation; a positive score is the cost of calling it boilerplate, a negative one that of
calling it content.  These costs are capacities to the two terminals.  Blocks that follow each
other, that have the same parent, or whose parents stand in the same section are joined by edges, and an
edge between differently labelled blocks costs its capacity.  Maximum flow finds the cheapest labelling: the
blocks that the source still reaches are content.

No cue decides alone: a word or tag of boilerplate weighs 4.0, the edges of a block up to 3.6.  Short items
between paragraphs are kept by their edges, unlabelled notices between labelled boilerplate go by
theirs.  An edge between a block with such a cue and one without counts a quarter, as the cue marks a border.

Text: character references are decoded, white space within a block becomes one space, blocks are
trimmed, empty ones left out, and content blocks joined by one newline in page order.  Not text at
all: the head, scripts, styles, templates, noscript, comments, svg, the choices and values of form fields,
what canvas, iframe, audio and video hold for browsers that can't show them, and elements with the attribute hidden.

Pages are read in one pass whose cost is linear in their length, whatever they hold: open elements carry
what a search through them would find.

Defined results: null or empty html, or a page without content blocks, gives the empty string;
unclosed, stray and unknown tags are read as browsers read them, as far as blocks go; a tag with an unpaired quote
ends at the next >, and a < without any > after it is text; rows are independent, so ties, repeated
rows and null ids change nothing; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pieces import slices

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_INSIDE = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"?|'[^']*'?")
_WORDS = re.compile(r"[a-z]+")
#: Fixed values of HTML: elements whose content is not text, that part blocks, that have no end tag.
NOT_TEXT = frozenset("script style template noscript svg head title iframe canvas audio video select option textarea datalist".split())
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first kind ends an open element of the second kind; every block ends an open p.
ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option", "p"), "body": ("head", "p")}
#: Elements past which an implied end tag doesn't reach.
FENCE = frozenset("ul ol dl table html body article section aside nav div main".split())
SECTION = frozenset("article main section aside nav header footer form body".split())
#: Words of the model: elements and class words around boilerplate, and around articles.
AWAY_TAGS = frozenset("nav footer aside form button menu dialog search label input".split())
AWAY_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert newsletter subscribe subscription signup login signin share sharing social sidebar side aside related recommended popular trending widget comment comments commentlist reply replies respond disqus discussion nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead toolbar popup modal overlay copyright legal disclaimer complementary contentinfo search skip tags".split())
HOME_TAGS = frozenset("article main".split())
HOME_WORDS = frozenset("article content entry post story main body text".split())

#: The classifier's weights, and the edges' capacities.
CUE, HOME, ELSEWHERE, UNKNOWN, LINKED, SHORT, ENDED = -4.0, 1.5, -1.0, 0.3, -3.0, -1.0, 0.5
KIND = {"p": 1.0, "blockquote": 0.8, "pre": 0.8, "li": -0.2, "td": -0.2} | {f"h{i}": 0.6 for i in range(1, 7)}
ADJACENT, SIBLING, TOGETHER, BORDER = 0.3, 1.0, 0.5, 0.25


class Open(NamedTuple):
    """An open element, with what blocks in it must know of all elements around."""

    tag: str
    number: int
    parent: int
    block: int  # place in the stack of the nearest element that parts blocks
    section: int  # number of the nearest section
    home: bool
    away: bool  # an away tag around it
    worded: int  # number of the nearest element with an away word; 0: none
    marked: bool  # an away word since the last article or main
    past: int  # the nearest element with an away word outside the last article or main
    off: bool
    within_home: bool  # article or main around it


class Block:
    __slots__ = ("away", "home", "linked", "parent", "parts", "past", "section", "tag")

    def __init__(self, tag, parent, section):
        self.tag, self.parent, self.section = tag, parent, section
        self.parts, self.linked, self.past, self.home, self.away = [], 0, [], False, False


class Reader:
    """One pass over a page's html."""

    def __init__(self, html: str):
        self.html, self.found, self.block, self.links, self.number = html, [], None, 0, 0
        self.stack = [Open("", 0, 0, 0, 0, False, False, 0, False, 0, False, False)]
        self.sections: list[int] = [0]  # by number of element: its section
        self.opened: Counter = Counter()  # open elements by tag
        self.inline: list[Counter] = [Counter()]  # since each open element that parts blocks
        self.fenced: list[Counter] = [Counter()]  # since each open fence
        self.chars: dict[int, int] = {0: 0}  # characters straight in elements with an away word; 0: outside all
        self.around: dict[int, int] = {}  # the next such element around each
        self.failed = 0

    def text(self, a: int, b: int) -> None:
        top = self.stack[-1]
        if a >= b or top.off:
            return
        t = self.html[a:b]
        if self.block is None:
            if t.isspace():
                return
            own = self.stack[top.block]
            self.block = Block(own.tag, own.parent, self.sections[own.parent])
            self.found.append(self.block)
        t, block = unescape(t) if "&" in t else t, self.block
        block.parts.append(t)
        block.home |= top.home and not top.marked
        block.away |= top.away or top.marked
        if top.past:
            block.past.append(top.past)
        self.chars[top.worded] = self.chars.get(top.worded, 0) + len(t)
        if self.links:
            block.linked += len(t)

    def close(self, k: int) -> None:
        """Take the elements from place k on off the stack."""
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.opened[tag] -= 1
            self.links -= tag == "a"
            if tag in FENCE:
                self.fenced.pop()
            else:
                self.fenced[-1][tag] -= 1
            if tag in BLOCK:
                self.inline.pop()
                self.block = None
            else:
                self.inline[-1][tag] -= 1

    def place(self, tags: tuple) -> int:
        k = len(self.stack) - 1
        while self.stack[k].tag not in tags:
            k -= 1
        return k

    def end(self, name: str) -> None:
        if name == "p" and not self.opened["p"]:
            self.block = None
        if self.opened[name] and (name in BLOCK or self.inline[-1][name]):
            self.close(self.place((name,)))

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            if self.block is not None:
                self.block.parts.append(" ")
            return
        if name in BLOCK:
            self.block = None
        ends = ENDS.get(name, ("p",)) if name in BLOCK or name == "option" else ()
        # A tr ends a cell and the row around it, others one element.
        for _ in range(3 if name == "tr" else 1):
            if any(self.fenced[-1][e] for e in ends):
                self.close(self.place(ends))
        if name in VOID:
            return
        self.number += 1
        o, n = self.stack[-1], self.number
        section, home, away, worded, marked, past, off, within = o.section, o.home, o.away, o.worded, o.marked, o.past, o.off, o.within_home
        if name in HOME_TAGS:
            past, marked, home, within = worded, False, True, True
        away = away or name in AWAY_TAGS or (name == "header" and not within)
        if attributes and not attributes.isspace():
            for key, x, y, z in _ATTRIBUTE.findall(attributes):
                key = key.lower()
                if key == "hidden":
                    off = True
                elif key in ("class", "id", "role") and name not in ("body", "html"):
                    words = _WORDS.findall((x or y or z).lower())
                    if not AWAY_WORDS.isdisjoint(words):
                        if worded != n:
                            self.around[n], worded = worded, n
                        marked = True
                    elif not HOME_WORDS.isdisjoint(words):
                        home = True
        if name in SECTION:
            section = n
        self.sections.append(section)
        self.stack.append(Open(name, n, o.number, len(self.stack) if name in BLOCK else o.block, section, home, away, worded, marked, past, off or name in NOT_TEXT, within))
        self.opened[name] += 1
        self.links += name == "a"
        if name in FENCE:
            self.fenced.append(Counter())
        else:
            self.fenced[-1][name] += 1
        if name in BLOCK:
            self.inline.append(Counter())
        else:
            self.inline[-1][name] += 1

    def tag_end(self, at: int) -> int:
        """Where the > of a tag is, -1 if there is none.  After a few tags with unpaired quotes, each of which may
        cost a look at all the rest, quotes no longer count."""
        if self.failed < 16:
            end = _INSIDE.match(self.html, at).end()
            if self.html[end : end + 1] == ">":
                return end
            self.failed += 1
        return self.html.find(">", at)

    def blocks(self) -> list[tuple[Block, str]]:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            start = html.find("<", at)
            if start < 0:
                self.text(at, n)
                break
            if html[start + 1 : start + 2] in ("!", "?"):
                self.text(at, start)
                at = _COMMENT.match(html, start).end()
                continue
            m = _NAME.match(html, start)
            if m is None:
                self.text(at, start + 1)
                at = start + 1
                continue
            end = self.tag_end(m.end())
            if end < 0:
                self.text(at, n)
                break
            self.text(at, start)
            at, name = end + 1, m[2].lower()
            if m[1]:
                self.end(name)
                continue
            if name in RAW:
                close = re.compile(rf"</{name}\b", re.I).search(html, at)
                at = html.find(">", close.end()) + 1 or n if close else n
                continue
            self.start(name, html[m.end() : end])
        return self._finished()

    def _finished(self) -> list[tuple[Block, str]]:
        for k in sorted(self.around, reverse=True):  # the outer elements have the smaller numbers
            outer = self.around[k]
            self.chars[outer] = self.chars.get(outer, 0) + self.chars.get(k, 0)
        out = []
        for b in self.found:
            # A word on what holds most of the page is about the layout, and says nothing of an article in it.
            if any(2 * self.chars.get(k, 0) <= self.chars[0] for k in b.past):
                b.away, b.home = True, False
            t = " ".join("".join(b.parts).split())
            if t:
                out.append((b, t))
        return out


def blocks_of(html: str) -> list[tuple[Block, str]]:
    """Text blocks in page order."""
    return Reader(html).blocks()


def score(block: Block, text: str, any_home: bool) -> float:
    """The classifier; positive for content."""
    s = SHORT + min(2.5, 0.5 * math.log2(2 + text.count(" "))) + LINKED * min(1.0, block.linked / len(text))
    s += KIND.get(block.tag, 0.0) + (CUE if block.away else 0.0) + (ENDED if text[-1] in ".!?…:;\"”»" else 0.0)
    return s + ((HOME if block.home else ELSEWHERE) if any_home else UNKNOWN)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges, child, inside = [], {}, {}
    for i, b in enumerate(blocks):
        near = [(i - 1, ADJACENT)] if i else []
        near += [(last[key], weight) for last, key, weight in ((child, b.parent, SIBLING), (inside, b.section, TOGETHER)) if key in last]
        edges += [(j, i, weight * (1.0 if blocks[j].away == b.away else BORDER)) for j, weight in near]
        child[b.parent] = inside[b.section] = i
    return edges


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's side of a minimum cut.

    scores > 0: capacity from the source; < 0: to the sink; edges have their capacity both ways.  Maximum
    flow by blocking flows: a search from all nodes with excess gives levels, then flow goes along rising
    levels until none is left.  Capacities are whole thousandths; what is left of those to the
    terminals is in ``excess``."""
    n = len(scores)
    together: dict[tuple[int, int], int] = {}
    for a, b, c in edges:
        key = (a, b) if a < b else (b, a)
        together[key] = together.get(key, 0) + round(1000 * c)
    near: list[list[int]] = [[] for _ in range(n)]  # arcs; arc e and e ^ 1 are the two ways of one edge
    to, left, excess = [], [], [round(1000 * s) for s in scores]
    for (a, b), c in together.items():
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += (b, a)
        left += (c, c)
    while True:
        level, queue, ends = [-1] * n, deque(), False
        for i in range(n):
            if excess[i] > 0:
                level[i] = 0
                queue.append(i)
        sources = list(queue)
        while queue:
            a = queue.popleft()
            for e in near[a]:
                b = to[e]
                if left[e] and level[b] < 0:
                    level[b] = level[a] + 1
                    if excess[b] < 0:
                        ends = True
                    queue.append(b)
        if not ends:
            return [x >= 0 for x in level]
        following = [0] * n
        for source in sources:
            path, a = [], source
            while excess[source] > 0:
                if excess[a] < 0:
                    flow = min(excess[source], -excess[a], min(left[e] for e in path))
                    excess[source] -= flow
                    excess[a] += flow
                    back = len(path)
                    for i in range(len(path) - 1, -1, -1):
                        e = path[i]
                        left[e] -= flow
                        left[e ^ 1] += flow
                        if not left[e]:
                            back = i
                    if back < len(path):
                        a = to[path[back] ^ 1]
                        del path[back:]
                    continue
                arcs, i = near[a], following[a]
                while i < len(arcs) and not (left[arcs[i]] and level[to[arcs[i]]] == level[a] + 1):
                    i += 1
                following[a] = i
                if i < len(arcs):
                    path.append(arcs[i])
                    a = to[arcs[i]]
                elif path:
                    level[a] = -2  # nothing goes on from here
                    a = to[path.pop() ^ 1]
                else:
                    break


def labelled(html: str) -> list[tuple[str, float, bool]]:
    """(text, score, content) of each block."""
    blocks = blocks_of(html)
    any_home = any(b.home for b, _ in blocks)
    scores = [score(b, t, any_home) for b, t in blocks]
    content = min_cut(scores, edges_of([b for b, _ in blocks]))
    return [(t, s, c) for (_, t), s, c in zip(blocks, scores, content, strict=True)]


def main_text(html: str) -> str:
    return "\n".join([t for t, _, content in labelled(html) if content])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in slices(len(batch)):
            part = batch.slice(i, j - i)
            texts = [main_text(h or "") for h in part["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
