"""HTML extraction: flat text blocks, classified by a decision tree over their own and their neighbours' features.

A page becomes a flat list of blocks, cut at block-level tags. Each has a word count and a link density, those of the
blocks before and after it, and hints of what surrounds it: how surely a main container holds it (2 by tag or role, 1 by
a word of its class or id), the surest such container of the page, how surely page furniture holds it (3 by tag or role,
2 where all words of a class are of that kind, 1 where some are), and whether it is a heading. A decision tree, grown on
the labelled table below, keeps or drops each block: hints weigh for and against, but a link list inside an article goes
and prose under an odd class name stays.

Defined results: a null or empty page, or one without kept blocks, gives the empty text; character references are
decoded, white space within a block becomes one blank, and blocks are joined in page order by one line break; a line
break tag is white space. Unclosed tags end with what holds them; unclosed comments, scripts and tags without a closing
bracket end with the page. A leaf of the tree with as many rows of either label keeps. Repeated rows are extracted each;
an empty table gives an empty one; extra columns are ignored. Pages are read whole, in time proportional to their length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborflow.llm.common import small_batches

#: Tags that start or end a block, tags whose content is no text, and words that mark page furniture.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW_TAGS = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
SKIP_TAGS = frozenset("head template svg math object canvas select button audio video".split())
MAIN_TAGS = frozenset("article main".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog search fieldset".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold a text rather than a part of a page: of their class names only whole ones say what they are.
TEXT_TAGS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split())
#: Tags that end with the next of their kind, and a paragraph with any block.
CLOSED_BY_NEXT = frozenset("p li dt dd tr td th option".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
FURNITURE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer form header login masthead menu modal nav navbar navigation newsletter notice "
    "notification pagination pager popup promo promotion promoted recommended related replies reply respond responses share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split()
)
COMMENT_WORDS = frozenset("comment comments discussion disqus replies reply respond responses shoutbox".split())
#: Words that say nothing about what holds the text.
NEUTRAL_WORDS = frozenset("area bar bottom box container global group holder inner item items left link links list outer page panel primary right secondary section site slot top unit wrap wrapper".split())
MAIN_WORDS = frozenset("article articlebody content entry main maincontent post story".split())
_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>?))", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HEADING = re.compile(r"h[1-6]\Z")
_ZEROS = re.compile(r"&#([xX]?)0{2,}+(?=[0-9a-fA-F])")
_NUMBER = re.compile(r"&#(?:[xX][0-9a-fA-F]{7,}|[0-9]{8,});?")
FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "main", "page's main", "furniture", "heading")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    main: int
    furniture: int
    heading: bool


@dataclass
class Place:
    """What surrounds a text: its element, the hints, and whether the furniture is a form, which may hold a whole page."""

    tag: str = ""
    main: int = 0
    furniture: int = 0
    form: bool = False
    hidden: bool = False
    heading: bool = False


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond all code points become the replacement character."""
    return html.unescape(_NUMBER.sub("\ufffd", _ZEROS.sub(r"&#\1", text) if "&#" in text else text)) if "&" in text else text


def _class_hint(value: str, text: bool = False) -> tuple[int, int]:
    """(main, furniture) of a class or id; in the name of a ``text`` element a word among others is a faint hint only."""
    main = furniture = 0
    for token in value.split():
        parts = {token.lower()} if token.lower() in FURNITURE_WORDS | MAIN_WORDS else {w.lower() for w in _WORD.findall(token)}
        if hit := parts & FURNITURE_WORDS:
            furniture = max(furniture, 2 if parts <= FURNITURE_WORDS | NEUTRAL_WORDS or hit & COMMENT_WORDS and not text else 1)
        main = max(main, int(not parts.isdisjoint(MAIN_WORDS)))
    return main, furniture


def _enter(tag: str, attrs: str, outer: Place) -> Place:
    """The place inside an opening tag."""
    main, furniture, form = 2 * (tag in MAIN_TAGS), 3 * (tag in FURNITURE_TAGS and tag != "form"), tag == "form"
    hidden = tag in SKIP_TAGS
    if attrs.strip(" /"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "role":
                main, furniture = max(main, 2 * (value.lower() in ("main", "article"))), max(furniture, 3 * (value.lower() in FURNITURE_ROLES))
            elif name in ("class", "id") and tag != "body":
                m, f = _class_hint(value, tag in TEXT_TAGS)
                main, furniture = max(main, m), max(furniture, f)
            elif name == "style":
                hidden = hidden or bool(_HIDDEN.search(value))
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                hidden = True
    inherited = 0 if main == 2 and (outer.furniture <= 1 or outer.form) else outer.furniture  # a main container outweighs faint hints around it
    own = max(furniture, 2 * form)
    return Place(tag, max(main, outer.main), max(own, inherited), (form and furniture < 3) if own >= inherited else outer.form, hidden or outer.hidden, outer.heading or bool(_HEADING.match(tag)))


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[Place] = []  # open elements that may change what surrounds a text
    open_: Counter = Counter()
    text: list[str] = []
    links: list[str] = []
    in_link, here, nowhere = False, Place(), Place()

    def flush() -> None:
        if text:
            words = " ".join(decoded("".join(text)).split())
            if words and not here.hidden:
                out.append(Block(words, words.count(" ") + 1, len(decoded(" ".join(links)).split()), here.main, here.furniture, here.heading))
            text.clear()
            links.clear()

    def leave(upto: int) -> None:
        nonlocal here
        while len(stack) > upto:
            open_[stack.pop().tag] -= 1
        here = stack[-1] if stack else nowhere

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else size]
        if piece:
            text.append(piece)
            if in_link:
                links.append(piece)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:  # a tag without its closing bracket holds the rest of the page
            break
        tag = m[2].lower()
        if tag == "br":
            text.append(" ")
        elif not m[1]:
            if tag in RAW_TAGS:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                close = page.find(">", end.start()) if end else -1
                at = close + 1 if close >= 0 else size
                continue
            if tag == "a":
                in_link = True
                continue
            block = tag in BLOCK_TAGS or tag in SKIP_TAGS
            if block:
                flush()
                if stack and (stack[-1].tag == "p" or tag in CLOSED_BY_NEXT and stack[-1].tag == tag):
                    leave(len(stack) - 1)
            if tag == "body":
                leave(0)
            if not (block or m[3]) or tag in VOID_TAGS or m[3].endswith("/") and not block:
                continue
            inner = _enter(tag, m[3], here)
            changed = (inner.main, inner.furniture, inner.hidden, inner.heading) != (here.main, here.furniture, here.hidden, here.heading)
            if changed and not block:
                flush()
            if changed or block and tag not in CLOSED_BY_NEXT:
                stack.append(inner)
                open_[tag] += 1
                here = inner
        elif tag == "a":
            in_link = False
        else:
            if tag in BLOCK_TAGS:
                flush()
                in_link = in_link and tag in ("div", "figure", "h1", "h2", "h3", "h4", "h5", "h6")
            if open_[tag]:
                flush()
                n = len(stack) - 1
                while stack[n].tag != tag:
                    n -= 1
                leave(n)
    flush()
    return out


def features(page: list[Block]) -> np.ndarray:
    """A row of FEATURES per block."""
    n = len(page)
    words = np.array([0, *(b.words for b in page), 0], np.float64)
    density = np.array([0, *(min(1.0, b.linked / b.words) for b in page), 0], np.float64)
    best = max((b.main for b in page if b.furniture < 2), default=0)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], [b.main for b in page], [best] * n, [b.furniture for b in page], [b.heading for b in page]]).astype(np.float64)


#: The labelled table: words; link density; words:density of the block before; of the block after; main; the page's main;
#: furniture; heading; and 1 for main text or 0 for the rest. Values of one field stand side by side; a row stands for
#: all their combinations.
TABLE = """
1 4 12 40 150; 0 .2; 0:0 3:1 9:0 80:0; 0:0 3:1 9:0 80:0; 2; 2; 0; 0 1; 1
1 4 12 40; 0 .2; 0:0 3:1 80:0; 0:0 3:1 80:0; 1; 1; 0; 0 1; 1
1 4 12 40; .5 1; 0:0 3:1 80:0; 0:0 3:1 80:0; 1 2; 2; 0; 1; 1
4 12; .5; 0:0 9:0 80:0; 0:0 9:0 80:0; 1 2; 2; 0; 0; 1
4 12; .5; 3:1 8:.8; 3:1 8:.8; 2; 2; 0; 0; 0
4 12; .5; 3:1 8:.8; 3:1 8:.8; 1; 1; 0; 0; 0
1 4 12; .8 1; 0:0 3:1 9:0 80:0; 0:0 3:1 9:0 80:0; 2; 2; 0; 0; 0
1 4 12; .8 1; 0:0 3:1 9:0 80:0; 0:0 3:1 9:0 80:0; 1; 1; 0; 0; 0
20 40 150; .5 1; 0:0 9:0 80:0; 0:0 9:0 80:0; 2; 2; 0; 0; 1
20 40 150; .5 1; 3:1 25:1; 0:0 9:0 80:0 3:1 25:1; 1 2; 2; 0; 0; 0
20 40 150; .5 1; 0:0 9:0 80:0; 3:1 25:1; 1 2; 2; 0; 0; 0
10 40 150; 0 .2; 0:0 3:1 80:0; 0:0 3:1 80:0; 1 2; 2; 1; 0 1; 1
10 40 150; 0 .2; 0:0 3:1 80:0; 0:0 3:1 80:0; 1; 1; 1; 0 1; 1
1 4; 0 .2; 0:0 3:1 80:0; 0:0 3:1 80:0; 1 2; 1 2; 1; 0; 0
1 4; 0 .2; 0:0 80:0; 0:0 80:0; 2; 2; 1; 1; 1
1 4 12; .5 1; 0:0 3:1 80:0; 0:0 3:1 80:0; 1 2; 2; 1; 0 1; 0
1 4 12 40 150; 0 .2 .5 1; 0:0 3:1 80:0; 0:0 3:1 80:0; 0 1 2; 0 1 2; 2 3; 0 1; 0
1 4 12 40 150; 0 .2 .5 1; 0:0 3:1 80:0; 0:0 3:1 80:0; 0; 1 2; 0 1; 0 1; 0
25 40 150; 0 .2; 0:0 3:1 9:0 80:0; 0:0 3:1 9:0 80:0; 0; 0; 0; 0 1; 1
12; 0 .2; 0:0 3:1 9:0 80:0; 9:0 80:0; 0; 0; 0; 0; 1
12; 0 .2; 9:0 80:0; 0:0 3:1 9:0 80:0; 0; 0; 0; 0; 1
12; 0 .2; 3:1 8:.8; 3:1 8:.8; 0; 0; 0; 0; 0
1 4 12; 0; 0:0; 0:0; 0; 0; 0; 0 1; 1
1 4; 0; 0:0 9:0 80:0; 9:0 80:0; 0; 0; 0; 0; 1
1 4; 0; 4:0 80:0; 0:0; 0; 0; 0; 0; 1
1 4 12; 0; 0:0 3:1 9:0 80:0; 0:0 1:0 9:0 80:0; 0; 0; 0; 1; 1
1 4 12; 0 .2; 0:0 3:1 9:0 80:0; 2:1 8:.8; 0; 0; 0; 1; 0
1 4; 0; 3:1 8:.8; 0:0 3:1 8:.8; 0; 0; 0; 0; 0
1 4 12; .5 1; 0:0 3:1 9:0 80:0; 0:0 3:1 9:0 80:0; 0; 0; 0; 0 1; 0
25 40; .5 1; 3:1 25:1; 3:1 25:1; 0; 0; 0; 0; 0
25 40 150; .5; 9:0 80:0; 9:0 80:0; 0; 0; 0; 0; 1
10 40 150; 0 .2; 0:0 3:1 80:0; 0:0 3:1 80:0; 0; 0; 1; 0; 1
1 4 12; .5 1; 0:0 3:1 80:0; 0:0 3:1 80:0; 0; 0; 1; 0 1; 0
1 4; 0; 3:1 8:.8; 0:0 3:1 8:.8; 0; 0; 1; 0; 0
"""


def table() -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels of the table."""
    rows = []
    for line in TABLE.strip().splitlines():
        fields = [[tuple(map(float, v.split(":"))) for v in f.split()] for f in line.split(";")]
        rows += [sum(r, ()) for r in product(*fields)]
    out = np.unique(np.array(rows), axis=0)
    return out[:, :-1], out[:, -1]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 24, least: int = 1):
    """A tree by Gini impurity: (feature, threshold, low branch, high branch), or the share of label 1 at a leaf. Of
    equally good cuts the first feature's widest gap wins."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for lo, hi in zip(values[:-1], values[1:], strict=True):
            low = x[:, f] <= (lo + hi) / 2
            if min(low.sum(), (~low).sum()) < least:
                continue
            impurity = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
            if best is None or (impurity, -(hi - lo)) < best[:2]:
                best = (impurity, -(hi - lo), f, (lo + hi) / 2, low)
    if best is None:
        return float(y.mean())
    _, _, f, cut, low = best
    return f, cut, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    f, cut, low, high = tree
    side = x[:, f] <= cut
    out = np.zeros(len(x), bool)
    if side.any():
        out[side] = classify(low, x[side])
    if not side.all():
        out[~side] = classify(high, x[~side])
    return out


def extract(page: str | None, tree) -> str:
    found = blocks(page) if page else []
    keep = classify(tree, features(found)) if found else []
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tree = grow(*table())
    small_batches(pages.sparkSession)

    def run(batches):
        for pdf in filter(len, batches):
            texts = [extract(h, tree) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
