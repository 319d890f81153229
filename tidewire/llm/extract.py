"""Main text of web pages by block rules in two passes.

The first pass labels each block of text by itself: by density of links, by length and by
density of stop words it is good, bad, nearly good, or too short to tell; what lies in
menus, headers, footers, sidebars, notices, adverts, forms and comments by its elements,
roles or names is bad. The second pass gives ambiguous blocks the label of their nearest
decided neighbours, and headings that of what they head.

Where a page marks its article (``article``, else ``main``, else a container named so),
only that is read, and its blocks count as good unless they are mostly links. Elsewhere
the densities decide alone; where a page's long blocks hold next to no known stop words
(another language), length and links do.

Defined results: a null or empty page and one without text give the empty string; tags
that are never closed or cut off end with the page; each row is treated by itself; columns
that are not asked for are left out; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.markup import Page, plain, read_page
from tidewire.llm import bytes_np as B
from tidewire.llm.shared import mapped

#: frequent words of the languages that are read; a parameter of the extractor
STOP_WORDS = frozenset("""
    the of and to in is that it for was on are as with be at by this from or an have not they but his her you we their been has were will would can all there which
    der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es werden aus er hat dass sie nach wird bei einer um am sind noch wie über so
    de la le et les un du une que est pour qui dans par plus pas au sur ne se ce il sont avec mais ou son cette aux ont été nous vous tout
    el los del las con para al lo como más o pero sus sin este ya entre cuando todo esta ser son también fue había muy hasta desde
""".split())  # fmt: skip

SHORT, LONG = 70, 200
LOW_DENSITY, HIGH_DENSITY = 0.12, 0.18
#: share of a block's characters in links
MOST_LINKS, MOST_LINKS_OF_ARTICLE = 0.2, 0.5
HEADING_REACH = 200

GOOD, NEAR, SMALL, BAD = "good", "near", "short", "bad"

_JUNK_TAGS = frozenset("head script style noscript template nav footer aside form select textarea button iframe object svg math dialog menu fieldset datalist audio video canvas map".split())
_JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist form status".split())
_JUNK_NAMES = frozenset("""
    nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets cookie cookies consent gdpr notice notices notification
    alert alerts banner banners popup modal overlay toast newsletter subscribe subscription signup login signin register ad ads adv adsense adslot adbox related
    share sharing social follow disqus reply replies respond responses discussion pagination pager search toolbar skip copyright legal disclaimer outbrain taboola trending popular tags form
""".split())  # fmt: skip
_JUNK_BEGINNINGS = ("advert", "sponsor", "promo", "comment", "recommend", "breadcrumb")
_COMMENTS = frozenset("disqus reply replies respond responses discussion".split())
_ASIDE = frozenset("has with no without hide show".split())  # "has-sidebar" is not a sidebar
_ARTICLE_NAME = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|news|page|main|blog)[_-]?(?:body|content|text|copy)(?:$|[\s_-])", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMENT_HEADING = re.compile(r"\W*(?:\d+\s+)?(?:(?:reader|user|leser)s?\W?\s*)?(?:comments?|kommentare?|commentaires?|comentarios?|leave a (?:comment|reply))\b.{0,30}", re.I)
_COPYRIGHT = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Block:
    """A block of text: its element, text, and share of characters in links."""

    __slots__ = ("node", "text", "links", "label", "heading", "fixed")

    def __init__(self, node: int, text: str, links: float, heading: int) -> None:
        self.node, self.text, self.links, self.heading = node, text, links, heading
        self.label, self.fixed = "", False


def _names(page: Page, node: int) -> list[str]:
    if not page.raw[node]:
        return []
    found = page.attributes(node)
    parts = [p.lower() for p in _NAME_PARTS.findall(f"{found.get('class', '')} {found.get('id', '')}")]
    return [p for i, p in enumerate(parts) if not (i and parts[i - 1] in _ASIDE)]


def _hidden(page: Page, node: int) -> bool:
    found = page.attributes(node)
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) is not None


def junk_elements(page: Page) -> list[bool]:
    """Whether each element is, or lies in, what is not the article.

    A name alone does not condemn what holds an article, main or page title; names of comments do.
    """
    holds = [False] * len(page.tags)
    own: list[str] = []
    for node, tag in enumerate(page.tags):
        names = _names(page, node)
        role = page.attributes(node).get("role", "").lower() if page.raw[node] else ""
        comment = any(n in _COMMENTS or n.startswith("comment") for n in names)
        kind = ""
        if tag in ("html", "body"):
            pass
        elif comment:
            kind = "comments"
        elif tag in _JUNK_TAGS or role in _JUNK_ROLES or (page.raw[node] and _hidden(page, node)):
            kind = "form" if tag == "form" else "element"
        elif tag == "header":
            kind = "header"
        elif tag not in ("article", "main", *_HEADINGS) and any(n in _JUNK_NAMES or n.startswith(_JUNK_BEGINNINGS) for n in names):
            kind = "header" if all(n in ("header", "banner") for n in names if n in _JUNK_NAMES) else "name"
        own.append(kind)
        if tag in ("article", "main", "h1") and not comment:
            for outer in page.holders(page.parents[node]):
                if holds[outer] or own[outer] == "comments":
                    break
                # a header that holds the title alone is still a header of the page
                holds[outer] = tag != "h1" or own[outer] == "form"
    junk: list[bool] = []
    article: list[bool] = []
    for node, tag in enumerate(page.tags):
        parent = page.parents[node]
        inside = parent >= 0 and article[parent]
        article.append(inside or tag in ("article", "main"))
        kind = own[node]
        bad = kind in ("element", "comments") or (kind in ("form", "name") and not holds[node]) or (kind == "header" and not inside and not holds[node])
        junk.append(bad or (parent >= 0 and junk[parent]))
    return junk


def _regions(page: Page, junk: list[bool], blocks: Sequence[Block]) -> list[bool]:
    """Whether each element lies in what the page marks as its article; all false where it marks none with text."""
    marks = [
        lambda n: page.tags[n] == "article" or page.attributes(n).get("role", "").lower() == "article",
        lambda n: page.tags[n] == "main" or page.attributes(n).get("role", "").lower() == "main",
        lambda n: page.attributes(n).get("itemprop", "").lower() == "articlebody" or bool(_ARTICLE_NAME.search(f"{page.attributes(n).get('class', '')} {page.attributes(n).get('id', '')}")),
    ]
    for mark in marks:
        inside: list[bool] = []
        for node, parent in enumerate(page.parents):
            inside.append((parent >= 0 and inside[parent]) or (not junk[node] and mark(node)))
        if any(b.node >= 0 and inside[b.node] and not junk[b.node] for b in blocks):
            return inside
    return [False] * len(page.tags)


def page_blocks(page: Page) -> list[Block]:
    """Blocks of the page that hold text, in order."""
    blocks: list[Block] = []
    at = 0
    while at < len(page.pieces):
        first = at
        while at < len(page.pieces) and page.pieces[at].block == page.pieces[first].block:
            at += 1
        pieces = page.pieces[first:at]
        text = plain("".join(p.text for p in pieces))
        if not text:
            continue
        # the block-level element that holds it
        node = next((n for p in pieces if p.text.strip() for n in page.holders(p.node) if page.tags[n] not in ("a", "b", "i", "em", "strong", "span")), -1)
        held = max(1, sum(len(p.text.strip()) for p in pieces))
        links = sum(len(p.text.strip()) for p in pieces if p.linked) / held
        blocks.append(Block(node, text, links, next((int(page.tags[n][1]) for n in page.holders(node) if page.tags[n] in _HEADINGS), 0)))
    return blocks


def _density(text: str, stop_words: frozenset[str]) -> tuple[int, int]:
    """(words with letters, how many of them are stop words)."""
    words = [w for w in ("".join(filter(str.isalpha, w)) for w in text.lower().split()) if w]
    return len(words), sum(w in stop_words for w in words)


def _by_itself(block: Block, density: float | None) -> str:
    """The first pass, outside a marked article; without a density, stop words are not asked."""
    size = len(block.text)
    if block.links > MOST_LINKS or (size < LONG and _COPYRIGHT.search(block.text)):
        return BAD
    if size < SHORT:
        return BAD if block.links else SMALL
    if density is None or density >= HIGH_DENSITY:
        return GOOD if size >= LONG else NEAR
    return NEAR if density >= LOW_DENSITY else BAD


def _comment_sections(page: Page, blocks: Sequence[Block]) -> None:
    """What follows a heading of comments, within what holds it, is bad."""
    end = -1
    for block in blocks:
        if block.node <= end and block.node >= 0:
            block.label, block.fixed = BAD, True
        elif len(block.text) < 60 and (block.heading > 1 or block.node < 0) and _COMMENT_HEADING.fullmatch(block.text):
            block.label, block.fixed = BAD, True
            holder = next((n for n in page.holders(block.node) if page.tags[n] not in _HEADINGS), 0) if block.node >= 0 else 0
            end = page.last[holder] if page.tags else -1


def label_blocks(page: Page, stop_words: frozenset[str] = STOP_WORDS) -> list[Block]:
    """The blocks of a page, each good or bad."""
    blocks = page_blocks(page)
    junk = junk_elements(page)
    region = _regions(page, junk, blocks)
    marked = any(region)
    _comment_sections(page, blocks)
    for block in blocks:
        inside = block.node >= 0 and region[block.node]
        if not block.fixed and ((block.node >= 0 and junk[block.node]) or (marked and not inside and block.heading != 1)):
            block.label, block.fixed = BAD, True
    free = [b for b in blocks if not b.fixed]
    counts = {id(b): _density(b.text, stop_words) for b in free if len(b.text) >= SHORT}
    words, stops = (sum(c[i] for c in counts.values()) for i in (0, 1))
    foreign = stops < words * LOW_DENSITY / 4
    for block in free:
        inside = block.node >= 0 and region[block.node]
        if inside:
            block.label = BAD if block.links > MOST_LINKS_OF_ARTICLE else GOOD if len(block.text) >= SHORT else SMALL
        else:
            n, stop = counts.get(id(block), (0, 0))
            block.label = _by_itself(block, None if foreign else stop / max(1, n))
    _second_pass(blocks, free, marked)
    return blocks


def _nearest(blocks: Sequence[Block], decided: tuple[str, ...]) -> list[str | None]:
    """For each block, the label of the nearest earlier one that is decided."""
    found, last = [], None
    for block in blocks:
        found.append(last)
        if block.label in decided:
            last = block.label
    return found


def _second_pass(blocks: Sequence[Block], free: list[Block], marked: bool) -> None:
    """Ambiguous blocks take the label of decided neighbours; at the edges of an article that is marked these count as good, else as bad."""
    edge = GOOD if marked else BAD
    # within a marked article, what is cut out of it does not speak for its neighbours
    row = free if marked else list(blocks)
    headed = _headed(row)
    for ambiguous, decided in ((NEAR, (GOOD, BAD)), (SMALL, (GOOD, BAD))):
        before = _nearest(row, decided)
        after = _nearest(row[::-1], decided)[::-1]
        labels = []
        for i, block in enumerate(row):
            if block.label != ambiguous:
                labels.append(block.label)
                continue
            sides = [before[i] or edge, after[i] or edge]
            if ambiguous == NEAR:
                labels.append(GOOD if GOOD in sides else BAD)
            elif block.heading and headed[i] is not None:
                labels.append(GOOD if headed[i] else BAD)
            else:
                labels.append(GOOD if sides == [GOOD, GOOD] or (marked and GOOD in sides) else BAD)
        for block, label in zip(row, labels, strict=True):
            block.label = label
    if marked and not any(b.label == GOOD for b in free):
        for block in free:
            block.label = GOOD


def _headed(row: Sequence[Block]) -> list[bool | None]:
    """For each heading, whether something good follows it before the next heading of its rank (close by, below the first); None if it heads nothing."""
    out: list[bool | None] = [None] * len(row)
    for i, block in enumerate(row):
        if not block.heading:
            continue
        seen, size = None, 0
        for at in range(i + 1, len(row)):
            later = row[at]
            if later.heading and later.heading <= block.heading:
                break
            if later.heading:
                continue
            seen = bool(seen) or later.label in (GOOD, NEAR) or (later.label == SMALL and not later.links)
            size += len(later.text)
            if seen or size > HEADING_REACH:
                break
        out[i] = seen
    return out


def main_text(content: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The good blocks of a page, one a line."""
    return "\n".join(b.text for b in label_blocks(read_page(content), stop_words) if b.label == GOOD)


def extract_text(pages: DataFrame, *, keep: Sequence[str] = ("page_id", "url"), html_column: str = "html", output: str = "text", stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """The columns ``keep`` and the main text of every page. No shuffle; a task holds one page at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, html_column):
            texts = pa.array([main_text(t, stop_words) for t in batch.column(html_column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], names=[*keep, output])

    rows = pages.select(*keep, html_column)
    return mapped(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]) + f", `{output}` string")


def op13_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
