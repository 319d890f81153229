"""Articles and links out of web pages and feeds."""

from __future__ import annotations

import html
import json
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.markup import Page, closed_references, plain, read_page
from tidewire.functions.rules import find_date, is_future, post_title
from tidewire.functions.selectors import select
from tidewire.functions.text import clean_html, clean_query
from tidewire.operators.tables import bounded_batches

# Elements whose content is no text of an article, names of such and of others, and where a picture is named.
_SKIPPED = frozenset("script style noscript svg iframe nav footer header aside form".split())
_BAD_NAME = re.compile("nav|menu|footer|header|cookie|banner|share|social|subscribe|newsletter|advert|promo|related|sidebar|breadcrumb|comment", re.I)
_GOOD_NAME = re.compile("article|content|story|post|entry|body|main|text", re.I)
_HOLDER_NAME = re.compile("article|content|story", re.I)
_HOLDER_ID = re.compile("article|content", re.I)
_IMAGES = [("property", "og:image"), ("property", "og:image:url"), ("property", "og:image:secure_url"), ("name", "og:image"), ("name", "twitter:image"), ("name", "twitter:image:src")]
_ITEMS = frozenset(["p", "li", "h2", "h3", "blockquote"])


def _skipped(page: Page) -> list[bool]:
    out: list[bool] = []
    for node, parent in enumerate(page.parents):
        out.append(page.tags[node] in _SKIPPED or (parent >= 0 and out[parent]))
    return out


def _whole_text(page: Page, skipped: list[bool]) -> str:
    """All text of a page but that of its head."""
    kept, block = [], None
    for p in page.pieces:
        if p.node >= 0 and (skipped[p.node] or page.tags[p.node] in ("title", "head")):
            continue
        if p.block != block:
            kept.append(" ")
        kept.append(p.text)
        block = p.block
    return plain("".join(kept))


def _json_bodies(value) -> list[str]:
    if isinstance(value, list):
        return [b for v in value for b in _json_bodies(v)]
    if not isinstance(value, dict):
        return []
    own = [v for v in (value.get("articleBody"), value.get("text")) if isinstance(v, str) and len(v.strip()) >= 120]
    return own + _json_bodies(value.get("@graph"))


def _told_text(page: Page) -> str:
    """The longest body that linked data of the page tell."""
    found = []
    for node, tag in enumerate(page.tags):
        if tag == "script" and "ld+json" in page.attributes(node).get("type", "").lower():
            try:
                found += _json_bodies(json.loads("".join(p.text for p in page.pieces[page.begins[node] : page.ends[node]])))
            except (ValueError, RecursionError):
                continue
    return max((plain(html.unescape(re.sub("<[^>]*>", " ", b))) for b in found), key=len, default="")


def best_text(page: Page, skipped: list[bool], least: int = 120) -> str:
    """The text of the best element: long, in paragraphs, named like an article, and not made of links; linked data come first."""
    best = _told_text(page)
    score = len(best) + 300 if len(best) >= least else -1.0
    name = lambda n: " ".join(filter(None, (page.attributes(n).get("class"), page.attributes(n).get("id")))) if page.raw[n] else ""

    def holds(node: int) -> bool:
        if page.tags[node] in ("article", "main"):
            return True
        found = page.attributes(node) if page.tags[node] in ("div", "section") and page.raw[node] else {}
        return bool(_HOLDER_NAME.search(found.get("class", "")) or _HOLDER_ID.search(found.get("id", "")))

    items = [(n, t) for n, tag in enumerate(page.tags) if tag in _ITEMS and not skipped[n] and not _BAD_NAME.search(name(n)) and len(t := page.text(n, skipped)) >= 30]
    links = [(n, len(page.text(n, skipped)) + 1) for n, tag in enumerate(page.tags) if tag == "a" and not skipped[n]]
    holders = [n for n in range(len(page.tags)) if not skipped[n] and holds(n)]
    for node in holders or [-1]:
        last = page.last[node] if node >= 0 else len(page.tags)
        text = "\n\n".join(dict.fromkeys(t for n, t in items if node < n <= last))
        if len(text) < 200:
            whole = page.text(node, skipped) if node >= 0 else _whole_text(page, skipped)
            text = whole if len(whole) > len(text) else text
        if len(text) < least:
            continue
        own = name(node) if node >= 0 else ""
        linked = max(0, sum(size for n, size in links if node < n <= last) - 1)
        value = len(text) + 30 * (text.count("\n\n") + 1) + (250 if _GOOD_NAME.search(own) else 0) - (500 if _BAD_NAME.search(own) else 0) - min(400, linked * 0.4)
        if value > score:
            best, score = text, value
    return best


def article_of(content: str | None, least: int = 120) -> dict:
    """Title, text, picture and date texts of the article on a page."""
    page = read_page(content, closed_references)
    skipped = _skipped(page)
    metas: dict[tuple[str, str], str] = {}
    for node, tag in enumerate(page.tags):
        if tag == "meta":
            found = page.attributes(node)
            for kind in ("property", "name"):
                if kind in found:
                    metas.setdefault((kind, found[kind].lower()), found.get("content", ""))
    first = lambda tag: next((n for n, t in enumerate(page.tags) if t == tag), None)
    heading, title, time = first("h1"), first("title"), first("time")
    titles = [metas.get(("property", "og:title"), ""), metas.get(("name", "twitter:title"), ""), page.text(heading, None, " ") if heading is not None else "", page.text(title) if title is not None else ""]
    pictures = [metas.get(k, "") for k in _IMAGES] + [page.attributes(n).get("href", "") for n, t in enumerate(page.tags) if t == "link" and page.attributes(n).get("rel", "").lower() == "image_src"]
    shown = page.text(time) if time is not None else ""
    dates = [metas.get(("property", "article:published_time"), ""), metas.get(("name", "pubdate"), ""), page.attributes(time).get("datetime", "") if time is not None else "", "".join(re.findall(_DATES, shown)[:1])]
    text = best_text(page, skipped, least)
    return {
        "title": next((t[:500] for t in map(plain, titles) if t), None), "text": text if len(text) >= least else _whole_text(page, skipped),
        "image": next((p.strip() for p in pictures if p.strip().startswith("http")), None), "dates": dates,
    }


def parse_page(content: str | None) -> dict:
    """Title, main text, picture and links of a page."""
    found, page = article_of(content), read_page(content, closed_references)
    links = [{"href": page.attributes(n)["href"].strip(), "text": page.text(n)} for n, t in enumerate(page.tags) if t == "a" and page.attributes(n).get("href")]
    return {"title": found["title"], "body": found["text"], "image": found["image"], "links": links}


def _pages(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(c) for c in content], columns=["title", "body", "image", "links"])


def parse_pages(pages: DataFrame, content: str = "html") -> DataFrame:
    """Pages with ``title``, ``body``, ``image`` and ``links``."""
    bounded_batches(pages.sparkSession)
    return pages.withColumn("_p", F.pandas_udf(_pages, "title string, body string, image string, links array<struct<href string, text string>>")(F.col(content))).select(*pages.columns, "_p.*")


def page_nodes(pages: DataFrame, *, key: str, content: str = "html") -> DataFrame:
    """One row an element of every page: (key, node, parent, last, depth, tag, attributes, text); ``text`` is what stands in it alone."""
    bounded_batches(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def run(frames):
        for frame in frames:
            for of, page in zip(frame[key], (read_page(c, closed_references) for c in frame[content]), strict=True):
                depths: list[int] = []
                own: dict[int, list[str]] = {}
                for p in page.pieces:
                    own.setdefault(p.node, []).append(p.text)
                for parent in page.parents:
                    depths.append(depths[parent] + 1 if parent >= 0 else 0)
                n = len(page.tags)
                for i in range(0, n, 10_000):
                    nodes = range(i, min(n, i + 10_000))
                    yield pd.DataFrame({
                        key: [of] * len(nodes), "node": nodes, "parent": [page.parents[x] for x in nodes], "last": [page.last[x] for x in nodes], "depth": [depths[x] for x in nodes],
                        "tag": [page.tags[x] for x in nodes], "attributes": [page.attributes(x) for x in nodes], "text": [plain("".join(own.get(x, ()))) for x in nodes],
                    })

    return pages.select(key, content).mapInPandas(run, f"`{key}` {kind}, node int, parent int, last int, depth int, tag string, attributes map<string,string>, text string")


def _anchors(content: str | None, listing: str | None, link: str | None, date: str | None) -> list[dict]:
    """Links of a page with title and date text: those that the selectors pick first, then all."""
    page = read_page(content)
    found: list[dict] = []

    def add(node: int, stamps: list[str], picked: bool) -> None:
        href = page.attributes(node).get("href", "").strip()
        if href:
            own = [page.attributes(node).get(name, "") for name in ("datetime", "content", "data-date")]
            found.append({"href": href, "title": page.text(node), "stamps": [s for s in (*stamps, *own, near(page.parents[node])) if s], "picked": picked})

    known: dict[int, str] = {}

    def near(parent: int) -> str:
        if parent not in known:
            known[parent] = "".join(re.findall(_DATES, page.text(parent))[:1]) if parent >= 0 else ""
        return known[parent]

    if any((s or "").strip() for s in (listing, link, date)):
        for node in select(page, listing) or [None]:
            last = page.last[node] if node is not None else len(page.tags) - 1
            picked = select(page, link, node) if (link or "").strip() else [n for n in range(node or 0, last + 1) if page.tags[n] == "a"]
            shown = next((t for t in (page.text(n) for n in select(page, date, node)) if t), "") if picked and (date or "").strip() else ""
            for n in picked:
                add(n, [shown] if shown else [], True)
    for node, tag in enumerate(page.tags):
        if tag == "a":
            add(node, [], False)
    return found


# Words of addresses of articles and of others, and endings of media files.
ARTICLE_HINTS = "news|press|media|article|articles|blog|post|posts|story|stories|insight|insights|publication|publications|release|releases|updates?"
BAD_LINKS = "contact|about|privacy|terms|career|job|vacan|event|webinar|podcast|subscribe|signin|login|register|mailto:|javascript:|#"
MEDIA_FILES = "avif|gif|jpe?g|png|svg|webp|bmp|ico|pdf|zip|rar|7z|mp4|mov|webm|mp3|wav"
_DATES = r"\b20[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}\b"


def link_score(path: Column, title: Column) -> Column:
    """How much a link looks like one to an article."""
    low = F.lower(path)
    slashes = F.length(low) - F.length(F.replace(low, F.lit("/"), F.lit("")))
    points = [(low.rlike(ARTICLE_HINTS), 4), (low.rlike("/20[0-9]{2}/[0-9]{1,2}/[0-9]{1,2}/"), 3), (slashes >= 2, 1), (F.length(title) >= 40, 2), (F.length(title) >= 80, 1), (low.rlike(BAD_LINKS), -5)]
    return sum((F.when(test, n).otherwise(0) for test, n in points), F.lit(0))


def listing_candidates(pages: DataFrame, *, key: str, url: str = "url", content: str = "html", selectors: tuple[str, str, str] | None = None, as_of: Column | None = None, limit: int = 12, least_title: int = 18) -> DataFrame:
    """(key, rank, url, title, score, published_at): of each listing page the best links to articles of its own host.

    ``selectors`` names the columns of a page's selectors of lists, links and dates (CSS or XPath, null: none); where they pick
    any good link, only such count, each with two points more. Else all links do. Links to other hosts, media files, the front
    page, and of a short title go; of equal addresses the first stays; a link with a date has two points more.
    """
    bounded_batches(pages.sparkSession)
    picked = [F.col(c) for c in selectors] if selectors else [F.lit(None).cast("string")] * 3
    found = F.pandas_udf(lambda *columns: pd.Series([_anchors(*row) for row in zip(*columns, strict=True)]), "array<struct<href string, title string, stamps array<string>, picked boolean>>")
    rows = pages.select(F.col(key), F.col(url).alias("_home"), F.posexplode(found(F.col(content), *picked)).alias("_at", "_a"))
    rows = rows.select(key, "_home", "_at", F.col("_a.href").alias("_href"), "_a.title", "_a.stamps", "_a.picked").where(~F.col("_href").rlike(f"(?i){BAD_LINKS}"))
    base = F.regexp_extract("_home", "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract("_home", "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^?#]*/)?)", 1)
    h = F.col("_href")
    joined = (
        F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.substring_index("_home", "//", 1), h)).when(h.startswith("/"), F.concat(base, h))
        .when(h.startswith("?"), F.concat(F.regexp_replace("_home", "[?#].*$", ""), h)).otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), h))
    )
    rows = rows.withColumn("_u", joined).where(F.col("_u").rlike("^https?://") & (F.lower(F.regexp_extract("_u", "://([^/?#]*)", 1)) == F.lower(F.regexp_extract("_home", "://([^/?#]*)", 1))))
    path, query = F.regexp_extract("_u", "://[^/?#]*([^?#]*)", 1), clean_query(F.regexp_extract("_u", r"\?([^#]*)", 1))
    rows = rows.withColumns({"_path": path, "_query": query}).where(~F.col("_path").rlike(rf"(?i)\.(?:{MEDIA_FILES})$"))
    rows = rows.where(((F.regexp_replace("_path", "/+$", "") != "") | (F.col("_query") != "")) & (F.length("title") >= least_title))
    site, where = F.regexp_extract("_u", "^(https?://[^/?#]*)", 1), F.when(F.col("_path") == "/", "").otherwise(F.col("_path"))
    rows = rows.withColumn("_clean", F.concat(site, where, F.when(F.col("_query") != "", F.concat(F.lit("?"), "_query")).otherwise("")))
    dates = F.transform("stamps", find_date)
    rows = rows.withColumn("published_at", F.get(F.filter(dates, lambda d: d.isNotNull() if as_of is None else d.isNotNull() & ~is_future(d, as_of)), F.lit(0)))
    points = link_score(F.col("_path"), F.col("title")) + F.when(F.col("published_at").isNotNull(), 2).otherwise(0)
    scored = rows.withColumn("score", points).where("score > 0").withColumn("score", F.col("score") + F.when(F.col("picked"), 2).otherwise(0))
    scored = scored.withColumn("_any", F.max("picked").over(Window.partitionBy(key))).where("picked = _any")
    first = scored.groupBy(key, F.col("_clean").alias("url")).agg(F.min_by(F.struct(F.substring("title", 1, 500).alias("title"), "score", "published_at", "picked"), "_at").alias("b"))
    dated = F.when(~F.col("b.picked"), F.coalesce("b.published_at", F.lit("9999-01-01").cast("timestamp")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("b.score"), dated, "url"))
    return first.withColumn("rank", rank).where(F.col("rank") <= limit).select(key, "rank", "url", "b.title", "b.score", "b.published_at")


def _articles(content: pd.Series, least: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([article_of(c, n) for c, n in zip(content, least, strict=True)], columns=["title", "text", "image", "dates"])


def page_articles(pages: DataFrame, *, as_of: Column, content: str = "html", least_text: int = 120) -> DataFrame:
    """Pages with ``title``, ``text``, ``image`` and ``published_at`` of the article on them.

    The title is that of og, twitter, the first heading or the page. The text is that of the best element by length,
    paragraphs, names and links, or linked data's where these are better; of a page without an element of ``least_text``
    characters all text. Dates after ``as_of`` do not count.
    """
    bounded_batches(pages.sparkSession)
    found = F.pandas_udf(_articles, "title string, text string, image string, dates array<string>")(F.col(content), F.lit(least_text))
    rows = pages.withColumn("_found", found)
    dates = F.filter(F.transform("_found.dates", find_date), lambda d: d.isNotNull() & ~is_future(d, as_of))
    return rows.withColumns({"title": F.col("_found.title"), "text": F.col("_found.text"), "image": F.col("_found.image"), "published_at": F.get(dates, F.lit(0))}).drop("_found")


def _posts(content: str | None) -> list[dict]:
    """Posts of a channel preview in order of the page: name, text, and date text."""
    page, found = read_page(content), []
    for node, tag in enumerate(page.tags):
        if tag == "div" and page.raw[node] and re.fullmatch(r"[A-Za-z0-9_]+/[0-9]+", page.attributes(node).get("data-post", "")):
            inside = range(node, page.last[node] + 1)
            text = next((n for n in inside if page.raw[n] and "tgme_widget_message_text" in page.attributes(n).get("class", "").split()), None)
            time = next((n for n in inside if page.tags[n] == "time" and page.attributes(n).get("datetime")), None)
            found.append({"name": page.attributes(node)["data-post"], "text": page.text(text) if text is not None else "", "at": page.attributes(time)["datetime"] if time is not None else None})
    return found


def channel_previews(pages: DataFrame, *, content: str = "html", limit: int = 20) -> DataFrame:
    """Previews of channels with ``posts`` (url, title, text, published_at) in place of the page, the newest first; posts without text go."""
    bounded_batches(pages.sparkSession)
    found = F.pandas_udf(lambda c: c.map(_posts), "array<struct<name string, text string, at string>>")(F.col(content))

    def post(p: Column) -> Column:
        at = F.try_to_timestamp(F.substring(p["at"], 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
        return F.struct((-F.coalesce(F.unix_timestamp(at), F.lit(0))).alias("turn"), F.concat(F.lit("https://t.me/"), p["name"]).alias("url"), p["text"].alias("text"), at.alias("published_at"))

    posts = F.slice(F.array_sort(F.transform(F.filter(found, lambda p: p["text"] != ""), post)), 1, limit)
    told = F.transform(posts, lambda p: F.struct(p["url"].alias("url"), post_title(p["text"]).alias("title"), p["text"].alias("text"), p["published_at"].alias("published_at")))
    return pages.withColumn("posts", told).drop(content)


def channel_posts(pages: DataFrame, *, content: str = "html", limit: int = 20) -> DataFrame:
    """(url, title, text, published_at) of the posts of channel previews, the newest first in each page; posts without text go."""
    kept = [c for c in pages.columns if c != content]
    return channel_previews(pages, content=content, limit=limit).select(*kept, F.explode("posts").alias("_p")).select(*kept, "_p.*")


def parse_feed(content: str | None) -> list[dict]:
    """Items of an RSS or Atom document that have a title and a link; titles are cut at 500 characters."""
    try:
        root = ElementTree.fromstring(content or "")
    except ElementTree.ParseError:
        return []
    out = []
    for node in root.iter():
        if node.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        values: dict[str, str] = {}
        for child in node:
            name = child.tag.rpartition("}")[2]
            values.setdefault(name, child.get("href") or (child.text or "").strip())
        title = plain(re.sub("<[^>]+>", " ", html.unescape(values.get("title", ""))))[:500]
        if title and values.get("link"):
            out.append({"title": title, "url": values["link"], "published": values.get("pubDate") or values.get("published") or values.get("updated"), "summary": values.get("description") or values.get("summary")})
    return out


def _feeds(content: pd.Series) -> pd.Series:
    return content.map(parse_feed)


def parse_feeds(feeds: DataFrame, content: str = "content") -> DataFrame:
    """One row for each item of each feed."""
    others = [c for c in feeds.columns if c != content]
    items = F.pandas_udf(_feeds, "array<struct<title string, url string, published string, summary string>>")(F.col(content))
    return feeds.select(*others, F.explode(items).alias("_i")).select(*others, "_i.*")
