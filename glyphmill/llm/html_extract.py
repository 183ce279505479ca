"""Main text of web pages by tag-path ratios.

A page's blocks of text are keyed by their root-to-leaf tag path (tags with their class names).
Per path, text length, punctuation and linked text are summed over the page and divided by its
nodes; the ratios are fused, smoothed along the page, averaged per path again and thresholded:
that decides which paths are content. A block of another path (a heading, a one-word
paragraph, a list item) belongs to the article where content lies beside it: in the element
that holds it directly, in a named article, or right after a heading; link lists never do.
What the markup declares to be something else (forms, asides, comments, ...) is vetoed, in
content paths as well; the declarations choose nothing. Paths are numbers interned by parent
and tag, and no step looks up a chain of elements twice, so a page costs time in proportion to
its length. Pages are independent: nothing is shuffled.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only

#: Fixed word lists of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object title select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("head aside footer form button dialog menu fieldset canvas audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Elements that hold others; only these can be vetoed by the words of OFTEN.
HOLDERS = frozenset("div section ul ol dl table nav center details".split())
#: Class and id words that say of any block that it is no part of an article.
NEVER = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adslot sponsored cookie cookies gdpr newsletter disqus commentlist comments sidebar sidenav
    breadcrumb breadcrumbs navbar topbar toolbar masthead pagination""".split()
)
#: Words that say so of an element that holds others, if its name has no words but these, those of NEVER and NEUTRAL.
OFTEN = frozenset(
    """sponsor promo promotion banner consent notice notices notification alert popup modal overlay subscribe subscription signup login rail widget widgets
    related recommended recommendations trending share sharing social menu nav navigation footer comment respond replies reply pager copyright disclaimer skip
    header""".split()
)
NEUTRAL = frozenset("box bar block list item items area container wrap wrapper inner outer section main site page global top bottom left right links link content text js id has is the and".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？、]")
#: An element of the key is closed by a start tag of the value's elements.
_CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_P_CLOSERS = frozenset("p div ul ol dl table section article aside nav header footer form h1 h2 h3 h4 h5 h6 pre blockquote figure main hr address".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of the length-weighted mean score that a path needs; from this share of linked text on a path is a list of links.
THRESHOLD, LINKED = 0.5, 0.8


@dataclass(slots=True)
class Element:
    tag: str
    path: int
    parent: Element | None
    dropped: bool
    holder: Element | None = None  # itself, or what holds it if it is inline
    has_content: bool = False  # some content block lies in it
    direct: bool = False  # some content block is its child
    above: Element | None = None  # a step towards the next ancestor with content


@dataclass(slots=True)
class Block:
    """A text node or a run of them within one block element."""

    owner: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join(html_lib.unescape("".join(self.parts)).split())


def _named(attributes: str) -> tuple[frozenset[str], bool]:
    """Words of class and id, and whether hidden or given a role outside of articles."""
    if "=" not in attributes and "hidden" not in attributes:
        return frozenset(), False
    words: set[str] = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in ROLES - {"navigation"}):
            return frozenset(), True
        if name in ("class", "id"):
            words |= {w.lower() for w in _PARTS.findall(value)}
    return frozenset(w for w in words if not w.isdigit()), False


def _vetoed(tag: str, words: frozenset[str], inside_article: bool) -> bool:
    """Whether the markup says that the element is no part of an article."""
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True
    if tag in ("html", "body", "article", "main") or not words:
        return False
    if words & NEVER and tag not in INLINE:
        return True
    often = words & OFTEN
    return bool(often) and tag in HOLDERS and words <= OFTEN | NEVER | NEUTRAL and not (inside_article and often <= {"header"})


def _blocks(page: str) -> list[Block]:
    """Text of block elements in page order, vetoed ones left out."""
    root = Element("", 0, None, False)
    root.holder = root
    stack, blocks, open_block, at = [root], [], None, 0
    numbers: dict[tuple[int, str, frozenset[str]], int] = {}
    opened: Counter[str] = Counter()
    endless: set[str] = set()  # raw elements without an end tag from here on

    def add(text: str) -> None:
        nonlocal open_block
        top = stack[-1]
        if top.dropped or not text or (open_block is None and text.isspace()):
            return
        if open_block is None:
            blocks.append(open_block := Block(top.holder))
        open_block.parts.append(text)
        if opened["a"]:
            open_block.linked += len(text)

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    while (m := _TAG.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            add(m[1])
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag not in INLINE:
            open_block = None
        if m[2]:
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag == "br":
            add(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            if m[4].rstrip().endswith("/>"):
                continue
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in ("title", "select", "svg", "math", "object"):
                endless.add(tag)
            else:
                at = len(page)
            continue
        shut = _CLOSES.get(tag, frozenset()) | (frozenset(["p"]) if tag in _P_CLOSERS else frozenset())
        if any(opened[x] for x in shut):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in shut:
                    close(i)
                    break
                if stack[i].tag not in INLINE and stack[i].tag not in ("p", "td", "th"):
                    break
        top = stack[-1]
        words, hidden = _named(m[4])
        path = numbers.setdefault((top.path, tag, words), len(numbers) + 1)
        e = Element(tag, path, top, top.dropped or hidden or _vetoed(tag, words, opened["article"] + opened["main"] > 0))
        e.holder = top.holder if tag in INLINE else e
        stack.append(e)
        opened[tag] += 1
    add(page[at:])
    return blocks


def path_scores(paths: list[int], texts: list[str], linked: list[float]) -> np.ndarray:
    """The fused and smoothed tag-path ratio of each node's path.

    Per path: characters per node and punctuation marks per node, as logarithms, multiplied,
    less the share of linked text; along the page each node takes an eighth of each
    neighbour's score; a path has the mean of its nodes.
    """
    _, at = np.unique(paths, return_inverse=True)
    length = np.array([len(t) for t in texts], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in texts], float)
    nodes, characters = np.bincount(at), np.bincount(at, length)
    free = 1 - np.minimum(1, np.bincount(at, np.minimum(linked, length)) / characters)
    fused = free * np.log1p(characters / nodes) * (0.2 + np.log1p(np.bincount(at, marks) / nodes))
    own = np.pad(fused[at], 1, mode="edge")
    smooth = 0.125 * own[:-2] + 0.75 * own[1:-1] + 0.125 * own[2:]
    return (np.bincount(at, smooth) / nodes)[at]


def _nearest(e: Element) -> Element | None:
    """The lowest ancestor (itself included) with content; steps taken are shortened for the next block."""
    way = []
    while e is not None and not e.has_content:
        way.append(e)
        e = e.above or e.parent
    for x in way:
        x.above = e
    return e


def extract_text(page: str | None) -> str:
    """The main text: blocks joined by two line ends; '' for a null or empty page."""
    told = [(b, t) for b in _blocks(page or "") if (t := b.text())]
    if not told:
        return ""
    blocks, texts = [b for b, _ in told], [t for _, t in told]
    length = np.array([len(t) for t in texts], float)
    scores = path_scores([b.owner.path for b in blocks], texts, [float(b.linked) for b in blocks])
    content = scores >= THRESHOLD * (scores @ length) / length.sum()
    for b, c in zip(blocks, content.tolist(), strict=True):
        if c:
            if b.owner.parent is not None:
                b.owner.parent.direct = True
            e = b.owner
            while e is not None and not e.has_content:
                e.has_content, e = True, e.parent
    kept, after = [], False
    for b, t, c in zip(blocks[::-1], texts[::-1], content[::-1].tolist(), strict=True):
        if not c and b.linked < LINKED * len(t):
            e = _nearest(b.owner)
            c = e is not None and (e.direct or e is b.owner or e.tag in ("article", "main") or (after and b.owner.tag in _HEADINGS))
        after = c
        if c:
            kept.append(t)
    return "\n\n".join(kept[::-1])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            texts = [extract_text(x.as_py()) for x in part.column(2)]
            columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty page gives an empty text; a page cut off within a tag, comment or script
    gives what stands before. Very long or deeply nested pages cost time in proportion to their
    length. Paths of equal scores are all content or none. Null ids and urls stay null, repeated
    rows give their rows, an empty table none. Other columns, of any name, are not read.
    """
    d = only(pages, page_id=id_col, url=url_col, html=html_col)
    return d.mapInArrow(_extract, f"page_id {dict(d.dtypes)['page_id']}, url string, text string, n_chars long")


def report(pages: DataFrame) -> DataFrame:
    return extract(pages)
