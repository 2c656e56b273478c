"""Main text of web pages by two passes over their text blocks.

The first pass judges every block by its text: link density, length and share of stop words decide
some, short blocks and those with few stop words stay undecided. Where a block stands is one more
feature: menus, forms, comments and the like are never text, and the region with more decided text,
inside articles or outside, is the page's text. In the second pass an undecided block of that region takes the label of
its nearest decided neighbours; where none is text for sure, all undecided ones are.
Each page is worked on alone, inside one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowwarden.llm.base import filled, query, slices, table

MAX_LINKS = 0.5  # share of a block's characters inside links
SURE_WORDS = 10  # words from which a block with stop words is text by itself
SURE_STOPS = 0.2  # share of stop words among them
GOOD, BAD, UNSURE = 1, -1, 0

# Elements whose content is no text.
HIDDEN = frozenset("script style noscript template svg math iframe object textarea select title canvas audio video".split())
# Elements that end a block. Those in PLACES are also remembered until they close.
PLACES = frozenset(
    "html body div section article main nav header footer aside form menu dialog ul ol dl table figure fieldset details blockquote".split())
BLOCKS = PLACES | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody caption figcaption pre hr address summary legend".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
TEXT = frozenset("article main".split())
# Names in class, id or role, or last parts of them, that mark a place as boilerplate.
MARKS = frozenset((
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer cookie cookies consent notice notices notification alert popup modal overlay comment comments reply replies "
    "disqus share sharing social related recommended newsletter subscribe signup login form search widget pagination pager "
    "copyright disclaimer complementary contentinfo").split())
# What may stand before a mark to say that something has it or lacks it, and after it without a meaning of its own.
STATES = frozenset("has have no not with without hide show".split())
FRAMES = frozenset("area box list".split())
UNMARKED = frozenset("html body main".split())  # the whole page or its text, whatever its class says
HEADER_MARKS = frozenset("header masthead topbar".split())  # boilerplate outside an article only
# Frequent words of English, German, French and Spanish.
STOPS = frozenset((
    "the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all were when "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des et un une du en à il que est pour qui dans ce par sur se pas plus au avec son ne "
    "el los las y del con no por su para como más pero sus lo este entre cuando muy sin sobre también me ya").split())

# A quoted attribute may hold ">" and be of any length; one that never ends, ends with the tag at the next ">".
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)"
    r"((?:[^'\">]|\"[^\"]*\"|'[^']*')*+|[^<>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
MARKED = frozenset("class id role".split())
INVISIBLE = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PARTING = re.compile(r"[\W\d_]+")


def marks_of(attributes: str) -> set[str]:
    """Last part of every name in class, id and role: "footer" of "site-footer", "comment" of "comment-7".

    Numbers and ``FRAMES`` at the end do not count; a name like "no-sidebar" marks nothing."""
    marks = set()
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() in MARKED:
            for token in value.strip("\"'").lower().split():
                parts = [part for part in PARTING.split(token) if part]
                while len(parts) > 1 and parts[-1] in FRAMES:
                    parts.pop()
                if parts and not (len(parts) > 1 and parts[0] in STATES):
                    marks.add(parts[-1])
    return marks


def place_of(tag: str, attributes: str, inside: int, in_article: bool = False) -> int:
    """What an element says about the blocks in it: GOOD, BAD or, like its parent, ``inside``.

    Marks say nothing of html, body, main and article. Only an article in another one, or in a place
    of boilerplate, is a comment or a teaser if it is marked."""
    if tag in BOILERPLATE:
        return BAD
    marks = set()
    if attributes:
        if INVISIBLE.search(attributes):
            return BAD
        if tag not in UNMARKED and (tag != "article" or in_article or inside == BAD):
            marks = marks_of(attributes)
    if marks & MARKS or inside != GOOD and (tag == "header" or marks & HEADER_MARKS):
        return BAD
    return GOOD if tag in TEXT else inside


def blocks(html: str) -> list[tuple[str, int, int]]:
    """(text, characters inside links, place) of every block with text, in page order."""
    found: list[tuple[str, int, int]] = []
    pieces: list[str] = []
    linked, breaks, link = 0, 0, False
    places: list[tuple[str, int, bool]] = [("", UNSURE, False)]  # element, what it says, whether in an article
    at = 0

    def flush():
        nonlocal linked, breaks
        text = " ".join("".join(pieces).split())
        if text:
            found.append((text, linked, places[-1][1]))
        pieces.clear()
        linked = breaks = 0

    def add(raw: str):
        nonlocal linked, breaks
        if raw:
            text = unescape(raw)
            if not text.isspace():
                breaks = 0
                linked += len(text.strip()) if link else 0
            pieces.append(text)

    while True:
        match = TAG.search(html, at) if html.find(">", at) >= 0 or html.find("<!--", at) >= 0 else None
        if match is None:
            add(html[at:])
            break
        add(html[at:match.start()])
        at = match.end()
        closing, tag = match[1], (match[2] or "").lower()
        if tag in HIDDEN and not closing:
            if not match[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
        elif tag == "a":
            link = not closing
        elif tag == "br":
            breaks += 1
            pieces.append(" ")
            if breaks > 1:  # two line breaks are a paragraph
                flush()
        elif tag in BLOCKS:
            flush()
            link = False
            if tag in PLACES:
                if not closing:
                    _, inside, in_article = places[-1]
                    places.append((tag, place_of(tag, match[3], inside, in_article), in_article or tag == "article"))
                elif any(tag == name for name, _, _ in places):
                    while places.pop()[0] != tag:
                        pass
    flush()
    return found


def decided(block: tuple[str, int, int]) -> int:
    """First pass: GOOD, BAD or UNSURE."""
    text, linked, place = block
    if place == BAD or linked > MAX_LINKS * len(text):
        return BAD
    words = text.lower().split()
    stops = sum(word.strip(".,;:!?()\"'«»") in STOPS for word in words)
    return GOOD if len(words) >= SURE_WORDS and stops >= SURE_STOPS * len(words) else UNSURE


def inherited(labels: list[int], article: bool) -> list[int]:
    """Second pass: undecided labels become that of the nearest decided one, at equal distance of the one before.
    Inside articles only those enclosed by boilerplate on both sides are boilerplate. Without any decided label they
    stay undecided."""
    before, after = [], []
    for out, order in ((before, labels), (after, reversed(labels))):
        seen, steps = UNSURE, 0
        for label in order:
            out.append((steps, seen))
            seen, steps = (label, 1) if label != UNSURE else (seen, steps + 1)
    final = []
    for label, (near, one), (far, other) in zip(labels, before, reversed(after), strict=True):
        if label == UNSURE and (one or other):
            if article:
                label = BAD if one == other == BAD else GOOD
            elif not one or not other:
                label = one or other
            else:
                label = one if near <= far else other
        final.append(label)
    return final


def main_text(html: str) -> str:
    """The page's text blocks, one line each.

    Blocks in menus and other places of boilerplate go, and say nothing about their neighbours. Of the others,
    those inside articles are the page's text unless those outside have more text that is text for sure, as beside
    teasers. Of the chosen blocks, undecided ones take the label of the nearest that its own text decided; inside articles
    they go only where decided blocks on both sides are boilerplate. Where no block is text for sure, as
    in a language without stop words here or on a page of short lines, all undecided blocks are text."""
    page = [(block, decided(block)) for block in blocks(html) if block[2] != BAD]
    sure = {place: sum(len(block[0]) for block, label in page if label == GOOD and block[2] == place) for place in (GOOD, UNSURE)}
    article = any(block[2] == GOOD for block, _ in page) and sure[GOOD] >= sure[UNSURE]
    if article:
        page = [(block, label) for block, label in page if block[2] == GOOD]
    labels = [label for _, label in page]
    if GOOD in labels:
        labels = inherited(labels, article)
    return "\n".join(block[0] for (block, _), label in zip(page, labels, strict=True) if label != BAD)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(html) for html in filled(batch, "html").to_pylist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes)],
            ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Null and empty html, and pages without text, give an empty text. Broken markup is read as far as
    it goes. Null ids and urls stay null; repeated rows are extracted alike; other columns are not
    read; an empty table gives no rows."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


@query("op8_html_extraction")
def op8(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
