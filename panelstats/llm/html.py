"""Main text of web pages by two passes of block rules.

A page is cut at block elements.  The first pass labels each block by itself: blocks of menus, footers,
sidebars, notices, adverts, forms or reader comments and blocks that are mostly links are bad; long blocks
rich in stop words are good; short blocks and blocks with fewer stop words are ambiguous.  The second pass
lets every ambiguous block inherit the label of the nearest decided block, counted in blocks.

A name (class or id) condemns what is in its element, but not an element that the page's article is in: one that is
or holds all outermost articles or mains, or, where every one of them is condemned or there is none, one that
holds most of the good text.  There the block rules decide.  Names of comments condemn always.

Where a page says which element is its article, ambiguous blocks of the article ask decided blocks of the
article only (there being none, they are good), blocks without stop words are ambiguous there instead of
bad, and blocks outside are bad once the article has a good one.

Defined results: null and empty pages, and pages without any text, give an empty text; markup that is never
closed ends with the page; character references that HTML doesn't know stay as they are; white space is
what ``str.split`` takes for it; repeated rows are extracted alike; null ids and urls are kept; an empty
table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their role here.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED_TAGS = frozenset("script style title textarea iframe noscript template svg math object xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog select button".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words in a class or id that tell what an element is not.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer login masthead menu modal nav navbar navigation newsletter notice pagination popup promo related "
    "reply replies share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split()
)
COMMENT_NAMES = frozenset("comment comments disqus reply replies".split())
STOP_WORDS = frozenset(
    # English
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or our she that the their they "
    "this to was we were which who will with you "
    # German
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist "
    "mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war wie wir zu zum zur "
    # French
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me même nous on ou par pas pour "
    "que qui sa se ses son sont sur un une vous y "
    # Spanish
    "al con como cual del desde el ella ellos era es esta este ha hay la las lo los más muy no nos o para pero por porque que se si "
    "sin sobre son su sus también un una uno ya".split()
)
SHORT, LONG = 70, 200
LINKS, STOPS_LOW, STOPS_HIGH = 0.5, 0.2, 0.3
GOOD, BAD, UNDECIDED = 1, -1, 0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_EDGES = ".,;:!?()[]{}\"'«»„“”‚‘’…*#$%&|<>+-_/"


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    in_article: bool
    in_bad: bool
    named: tuple[int, ...] = ()
    label: int = UNDECIDED


@dataclass
class Named:
    """An element that its names condemn, and how many outermost articles and mains it holds or is."""

    comments: bool
    articles: int = 0
    mains: int = 0


@dataclass
class Page:
    """Blocks, condemned elements, outermost articles and mains, and how many of both no name condemns."""

    blocks: list[Block]
    named: list[Named]
    articles: int = 0
    mains: int = 0
    free: int = 0


def _judged(tag: str, attributes: str, in_article: bool) -> tuple[bool, set[str]]:
    """Whether an element is bad by its kind or role, and the bad words of its names."""
    bad, words = tag in BAD_TAGS or tag == "header" and not in_article, set()
    if tag not in ("html", "body"):
        for name, value in _NAMES.findall(attributes):
            found = {w.lower() for w in _WORD.findall(value)}
            if name.lower() == "role":
                bad = bad or bool(found & BAD_ROLES)
            else:
                words |= found & BAD_NAMES
    return bad, words


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order, judged by their elements and these elements' names."""
    read = read_page(page)
    if read.named:
        spared = _spared(read)
        for b in read.blocks:
            b.in_bad = b.in_bad or not spared.issuperset(b.named)
    return read.blocks


def _spared(page: Page) -> set[int]:
    """The condemned elements that hold the page's article."""
    some = {i: n for i, n in enumerate(page.named) if not n.comments}
    spared = {i for i, n in some.items() if n.articles and n.articles == page.articles or n.mains and n.mains == page.mains}
    if some and not page.free:
        good = [b for b in page.blocks if label_alone(b) == GOOD]
        total = sum(len(b.text) for b in good)
        spared |= {i for i in some if 2 * sum(len(b.text) for b in good if i in b.named) > total}
    return spared


def read_page(page: str) -> Page:
    """Blocks with text, in page order, and what the page's elements say."""
    read = Page([], [])
    found = read.blocks
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # element, within an article, within something bad, condemned ones around
    links = link_chars = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal link_chars
        raw = "".join(parts)
        text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
        if text:
            tag, in_article, in_bad, named = stack[-1] if stack else ("", False, False, ())
            found.append(Block(text, link_chars, tag in HEADINGS, in_article, in_bad, named))
        parts.clear()
        link_chars = 0

    def say(text: str) -> None:
        nonlocal link_chars
        if text:
            parts.append(text)
            if links:
                link_chars += len(text)

    while at < end:
        token = _TOKEN.search(page, at)
        if not token:
            say(page[at:])
            break
        say(page[at : token.start()])
        at = token.end()
        closing, tag, attributes = token.group(1, 2, 3) if token[2] else token.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag in SKIPPED_TAGS:
            if not closing and not attributes.endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                at = over.end() if over else end
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
            continue
        if tag not in BLOCK_TAGS and tag != "button" and tag != "select":
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        links = 0
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
            continue
        if tag in VOID_TAGS:
            continue
        if stack and (stack[-1][0] == "p" or stack[-1][0] in HEADINGS or tag == "li" == stack[-1][0]):
            stack.pop()
        _, in_article, in_bad, named = stack[-1] if stack else ("", False, False, ())
        bad, words = _judged(tag, attributes, in_article)
        if words:
            named = (*named, len(read.named))
            read.named.append(Named(not words.isdisjoint(COMMENT_NAMES)))
        if tag in CONTENT_TAGS and words.isdisjoint(COMMENT_NAMES) and not (bad or in_bad) and not any(s[0] == tag for s in stack):
            main = tag == "main"
            read.articles, read.mains, read.free = read.articles + (not main), read.mains + main, read.free + (not named)
            for i in named:
                read.named[i].articles += not main
                read.named[i].mains += main
        stack.append((tag, in_article or tag in CONTENT_TAGS, in_bad or bad, named))
    flush()
    return read


def label_alone(block: Block) -> int:
    """First pass: what a block says of itself."""
    n = len(block.text)
    density = block.link_chars / n
    if block.in_bad or density > LINKS and not block.heading:
        return BAD
    if n < SHORT:
        return BAD if density and not (block.heading or block.in_article) else UNDECIDED
    words = block.text.lower().split()
    stops = sum(w.strip(_EDGES) in STOP_WORDS for w in words) / len(words)
    if stops >= STOPS_HIGH:
        return GOOD if n > LONG else UNDECIDED
    return UNDECIDED if stops >= STOPS_LOW or block.in_article else BAD


def inherit(blocks: list[Block]) -> None:
    """Second pass: undecided blocks take the label of the nearest decided block, good before bad."""
    first = [b.label for b in blocks]
    near: list[list[tuple[int, int]]] = [[] for _ in blocks]
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last = None
        for i in order:
            if first[i] != UNDECIDED:
                last = i
            elif last is not None:
                near[i].append((abs(i - last), -first[last]))
    for block, found in zip(blocks, near, strict=True):
        if block.label == UNDECIDED:
            block.label = -min(found)[1] if found else GOOD if block.in_article else BAD


def main_blocks(page: str | None) -> list[str]:
    """Texts of the blocks that are main text."""
    blocks = blocks_of(page) if page else []
    for b in blocks:
        b.label = label_alone(b)
    article = [b for b in blocks if b.in_article and not b.in_bad]
    rest = [b for b in blocks if not b.in_article or b.in_bad]
    inherit(article)
    if any(b.label == GOOD for b in article):
        return [b.text for b in article if b.label == GOOD]
    inherit(rest)
    return [b.text for b in rest if b.label == GOOD]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points), n_blocks (that the text is made of)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            kept = [main_blocks(page) for page in given.column(2).to_pylist()]
            texts = [" ".join(k) for k in kept]
            columns = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, kept), pa.int32())]
            names = ["page_id", "url", "text", "n_chars", "n_blocks"]
            yield pa.RecordBatch.from_arrays([given.column(0), given.column(1), *columns], names=names)

    kinds = f"page_id {rows.dtypes[0][1]}, url {rows.dtypes[1][1]}, text string, n_chars long, n_blocks int"
    return rows.mapInArrow(read, kinds)
