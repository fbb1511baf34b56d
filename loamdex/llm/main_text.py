"""Main text of HTML pages by minimum-cut labelling.

A page is read into blocks: text between the borders of block elements, with its place in the document tree.  A
classifier gives each block the log odds that it is content, from the elements and names around it and from its text.
These become terminal capacities; neighbours in page order and blocks close in the tree are tied by smoothness edges.
The minimum cut (Dinic's maximum flow) labels all blocks of a page at once: strong evidence against a block (it stands
in a menu or an advert outside of an article) can't be outvoted, weak evidence follows the surroundings.  Names weigh by
what they say: an advert's or a comment list's much, a word such as ``legal`` or ``form`` less inside an article, and
little where it is one of several words of a name.  An inline element that is an advert, a button or hidden is a block
of its own, and the paragraph around it stays one.

Markup is scanned once from left to right, in time that grows with the page, whatever it holds.

The text is that of the content blocks, in page order: character references decoded, white space inside a block one
space, blocks joined by one space.

Nulls and odd cases: null, empty and blank html and pages without content give an empty text.  Broken markup (unclosed
or stray tags, open comments) is read as far as it goes, as browsers do.  Whole pages are read, however long.  Repeated
rows give equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm.words import slices

# what ends a tag or begins a quoted value in it
_STOP = re.compile(r"""=\s*+(["'])|>""")
_TAG = re.compile(r"[a-zA-Z][^\s/>]*+")
#: Elements whose content is no text: to their end tag, or to the page's end.
_RAW = frozenset("script style textarea title iframe noembed noframes".split())
#: The same, but an end tag that is missing hides nothing.
_EMBEDDED = frozenset("template svg object canvas audio video".split())
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in (*_RAW, *_EMBEDDED)}
#: Elements deeper than this stand beside the last one that is not, as in browsers.
DEPTH = 128
_NAMES = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|\b(hidden)\b(?!\s*=\s*["']?false)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article main".split())
#: Elements that hold no part of an article.
FRAME = frozenset("head nav aside footer form menu dialog button select option fieldset label legend search".split())
#: Words in classes, ids and roles that say the same,
FRAME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promoted promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer masthead topbar toolbar sidebar contentinfo cookie cookies consent gdpr popup modal overlay comment comments commentlist replies disqus share sharing "
    "related recommended recommendations newsletter subscribe subscription signup login pagination pager hidden".split()
)
#: words that say it unless they are one of several in a name,
VAGUE_WORDS = frozenset("header side aside complementary notice notices notification alert dialog reply discussion feedback social search form widget widgets copyright legal disclaimer skip".split())
#: words that add nothing to a name, and words that say it of an inline element.
EMPTY_WORDS = frozenset("box bar block area section container wrapper wrap inner outer list item items links link buttons button icons panel holder group row col column main page site top bottom left right div js is has".split())
INLINE_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promoted promotion share sharing newsletter subscribe hidden".split())
CONTENT_WORDS = frozenset("article content post entry story body text main prose".split())

# log odds of the classifier
BASE, IN_CONTENT, NAMED_CONTENT, IN_FRAME, OWN_HEADER = -0.6, 3.0, 1.5, -30.0, -1.0
# inside an article: what a name or element says, a vague name, and a vague word among others; outside, that word
FRAME_INSIDE, VAGUE_INSIDE, PASSING_INSIDE, PASSING = -12.0, -7.0, -1.0, -3.0
BY_TAG = {"p": 1.0, "h1": 1.0, "h2": 0.6, "h3": 0.6, "h4": 0.4, "h5": 0.4, "h6": 0.4, "blockquote": 0.8, "pre": 0.8, "li": -0.2, "td": 0.0, "th": 0.0}
PER_LOG_WORD, SENTENCE, LINKED = 0.45, 0.4, -4.0
# smoothness
ADJACENT, SIBLING = 1.0, 0.6
#: What is left of a tie between a block inside and one outside of a menu, advert or the like.
BORDER = 0.1


@dataclass(slots=True)
class Element:
    """What of an open element matters below it."""

    tag: str
    depth: int
    up: Element | None
    content: bool = False
    frame: bool = False
    header: bool = False
    named: bool = False
    weight: float = 0.0


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    at: Element


def _opened(tag: str, rest: str, up: Element | None) -> Element:
    e = Element(tag, up.depth + 1 if up else 0, up)
    if up:
        e.content, e.frame, e.header, e.named, e.weight = up.content, up.frame, up.header, up.named, up.weight
    inline = tag not in BLOCKS
    framed = vague = passing = False
    if tag in CONTENT:
        e.content = True
    elif tag in FRAME:
        framed = True
    elif tag == "header":
        framed, e.header = not e.content, True
    if rest and tag not in ("html", "body"):
        for m in _NAMES.finditer(rest):
            kind, value = (m[1] or "hidden").lower(), m[2] or m[3] or m[4] or ""
            if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
                e.frame = True
            elif kind == "style":
                e.frame = e.frame or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif kind != "aria-hidden":
                words = {w.lower() for w in _PART.findall(value)}
                if inline:
                    framed = framed or bool(words & INLINE_WORDS)
                    continue
                if tag not in CONTENT and not (tag in HEADINGS and words & CONTENT_WORDS):
                    framed = framed or bool(words & FRAME_WORDS)
                    if words & VAGUE_WORDS:
                        if e.content and words & VAGUE_WORDS == {"header"}:
                            e.header = True
                        elif words - VAGUE_WORDS - EMPTY_WORDS:
                            passing = True
                        else:
                            vague = True
                if words & CONTENT_WORDS and not words & (FRAME_WORDS | VAGUE_WORDS):
                    e.named = True
    if e.content:
        e.weight = min(e.weight, FRAME_INSIDE if framed else VAGUE_INSIDE if vague else PASSING_INSIDE if passing else 0.0)
    else:
        e.frame = e.frame or framed or vague
        e.weight = min(e.weight, PASSING if passing else 0.0)
    return e


def _apart(e: Element) -> bool:
    """Whether what an element holds is likely no part of an article."""
    return e.frame or e.weight <= FRAME_INSIDE


def scanned(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """Markup in page order: (text before it, tag or nothing, whether it ends an element, attributes); at last the text behind all."""
    at, n, gone = 0, len(page), dict.fromkeys(('"', "'", *_END), False)  # gone: no such quote or end tag is left
    parts: list[str] = []
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= n:
            break
        first = page[lt + 1]
        if first in "!?":
            close = page.find("-->", lt + 4 if not page.startswith("<!-->", lt) else lt + 2) if page.startswith("<!--", lt) else page.find(">", lt)
            parts.append(page[at:lt])
            at = n if close < 0 else close + (3 if page.startswith("<!--", lt) else 1)
            continue
        end = first == "/"
        name = _TAG.match(page, lt + 1 + end)
        if not name:
            if end:  # a bogus comment
                close = page.find(">", lt)
                parts.append(page[at:lt])
                at = n if close < 0 else close + 1
            else:
                parts.append(page[at : lt + 1])
                at = lt + 1
            continue
        parts.append(page[at:lt])
        place = name.end()
        while True:
            stop = _STOP.search(page, place)
            if not stop:  # the page ends within a tag
                yield "".join(parts), "", False, ""
                return
            if not stop[1]:
                break
            close = -1 if gone[stop[1]] else page.find(stop[1], stop.end())
            gone[stop[1]] = close < 0
            place = stop.end() if close < 0 else close + 1
        tag, rest, at = name[0].lower(), page[name.end() : stop.start()], stop.end()
        if not end and tag in _END and not rest.endswith("/"):
            close = None if gone[tag] else _END[tag].search(page, at)
            gone[tag] = close is None
            if close:
                close_end = page.find(">", close.end())
                at = n if close_end < 0 else close_end + 1
            elif tag in _RAW:
                at = n
            continue
        if tag in _END:
            continue
        yield "".join(parts), tag, end, rest
        parts = []
    parts.append(page[at:])
    yield "".join(parts), "", False, ""


# elements that end where one of the same kind starts, and how far out they are looked for
_SHUT = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page, in order."""
    out: list[Block] = []
    now, parts, linked, links = Element("html", 0, None), [], 0, 0
    around: list[tuple[Element, list[str], int]] = []  # paragraphs around inline elements that stand apart
    opened: Counter[str] = Counter()

    def leave(e: Element) -> None:
        """An element ends, and all in it."""
        nonlocal now
        while now is not e.up:
            opened[now.tag] -= 1
            now = now.up

    def put(parts: list[str], linked: int, at: Element) -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, at))

    def holder(e: Element) -> Element:
        while e.up and e.tag not in BLOCKS:
            e = e.up
        return e

    def close() -> None:
        """A block ends, and with it all inline elements apart in it."""
        nonlocal parts, linked
        while around:
            e, outer, n = around.pop()
            put(parts, linked, e)
            parts, linked = outer, n
        put(parts, linked, holder(now))
        parts, linked = [], 0

    for raw, tag, end, rest in scanned(page):
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)
        if not tag:
            continue
        block = tag in BLOCKS
        if block:
            if parts and tag == "br":
                parts.append(" ")
            elif tag != "br":
                close()
        if end:
            if not opened[tag]:
                continue
            e, inner = now, 0
            # an inline end tag doesn't reach beyond the block it stands in
            while e.up and e.tag != tag and (block or e.tag not in BLOCKS):
                inner += e.tag == "a"
                e = e.up
            if e.tag == tag and e.up:
                while around and around[-1][0].depth >= e.depth:
                    apart, outer, n = around.pop()
                    put(parts, linked, apart)
                    parts, linked = outer, n
                leave(e)
                links = max(0, links - inner - (tag == "a"))
        elif tag not in VOID:
            if block:
                # a paragraph ends where another block starts; items, cells and rows end where the next one starts
                shut, stop = _SHUT.get(tag, ()), _WITHIN.get(tag, ())
                e = now
                while e.up and e.tag not in stop:
                    if e.tag == "p" or e.tag in shut:
                        leave(e)
                        links = 0
                        break
                    if e.tag in BLOCKS and not shut:
                        break
                    e = e.up
            if now.depth >= DEPTH:
                leave(now)
            e = _opened(tag, rest, now)
            opened[tag] += 1
            if not block and _apart(e) and not _apart(now):
                around.append((e, parts, linked))
                parts, linked = [], 0
            now = e
            links += tag == "a"
    close()
    return out


def log_odds(b: Block) -> float:
    """The classifier: the log odds that a block is content."""
    e = b.at
    words = b.text.count(" ") + 1
    score = BASE + BY_TAG.get(e.tag, 0.0) + PER_LOG_WORD * math.log1p(words) + LINKED * b.linked / len(b.text)
    if b.text[-1] in ".!?…:;\"'”»":
        score += SENTENCE
    if e.content:
        score += IN_CONTENT
    if e.named:
        score += NAMED_CONTENT
    if e.header and e.tag not in HEADINGS:
        score += OWN_HEADER
    return IN_FRAME if e.frame else score + e.weight


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth and a.up:
            a = a.up
        elif b.up:
            b = b.up
        else:
            break
        n += 1
    return n


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, weaker with distance in the tree; and blocks of one parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            border = 1.0 if _apart(found[i - 1].at) == _apart(b.at) else BORDER
            out.append((i - 1, i, border * ADJACENT * math.exp(-_distance(found[i - 1].at, b.at) / 4)))
        parent = id(b.at.up or b.at)
        if parent in last and last[parent] != i - 1 and _apart(found[last[parent]].at) == _apart(b.at):
            out.append((last[parent], i, SIBLING))
        last[parent] = i
    return out


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's (content's) side of the minimum cut; Dinic's algorithm.

    Positive log odds are a node's capacity from the source, negative ones to the sink.
    """
    n = len(odds)
    supply, demand = [max(0.0, x) for x in odds], [max(0.0, -x) for x in odds]
    if not edges or not any(supply) or not any(demand):
        return [x > 0 for x in odds]
    to: list[list[int]] = [[] for _ in range(n)]
    head, room = [], []
    for i, j, w in edges:
        to[i].append(len(head))
        to[j].append(len(head) + 1)
        head += [j, i]
        room += [w, w]
    tiny = 1e-12
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if supply[i] > tiny)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or demand[i] > tiny
            for e in to[i]:
                if room[e] > tiny and level[head[e]] < 0:
                    level[head[e]] = level[i] + 1
                    queue.append(head[e])
        if not reached:
            return [x >= 0 for x in level]
        next_ = [0] * n
        for start in range(n):
            while supply[start] > tiny:
                way, i = [], start  # depth first, without recursion
                while demand[i] <= tiny:
                    while next_[i] < len(to[i]):
                        e = to[i][next_[i]]
                        if room[e] > tiny and level[head[e]] == level[i] + 1:
                            break
                        next_[i] += 1
                    if next_[i] < len(to[i]):
                        way.append(to[i][next_[i]])
                        i = head[way[-1]]
                    elif way:
                        i = head[way.pop() ^ 1]
                        next_[i] += 1
                    else:
                        break
                if demand[i] <= tiny:
                    break
                push = min([supply[start], demand[i], *(room[e] for e in way)])
                supply[start] -= push
                demand[i] -= push
                for e in way:
                    room[e] -= push
                    room[e ^ 1] += push


def main_text(page: str | None) -> str:
    """The main text of one page."""
    found = blocks(page) if page else []
    keep = minimum_cut([log_odds(b) for b in found], ties(found))
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 2):
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            made = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[3:]], names=["page_id", "url", "text", "n_chars", *batch.schema.names[3:]])


def main_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **keep: Column) -> DataFrame:
    """One row per input row: id, url, text, n_chars (code points), and what else is asked for by name, as strings."""
    more = [c.cast("string").alias(f"kept_{name}") for name, c in keep.items()]
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), *more)
    schema = "page_id long, url string, text string, n_chars long" + "".join(f", kept_{name} string" for name in keep)
    return rows.mapInArrow(_extract, schema).withColumnsRenamed({"page_id": id_col, "url": url_col} | {f"kept_{name}": name for name in keep})
