"""The page reader on real-life faults and on hostile pages."""

import time

import pytest

from tidewire.functions.markup import plain, read_page
from tidewire.functions.rules import find_date
from tidewire.functions.selectors import select
from tidewire.sources import pages as sources


def outline(content):
    page = read_page(content)
    path = lambda n: "/".join(page.tags[x] for x in reversed(list(page.holders(n)))) if n >= 0 else ""
    return [(path(p.node), plain(p.text)) for p in page.pieces if p.text.strip()]


def test_nesting_that_is_implied():
    assert outline("<head><title>a &amp; b</title><p>x<p>y<ul><li>1<li>2</ul>z") == [("head/title", "a & b"), ("p", "x"), ("p", "y"), ("ul/li", "1"), ("ul/li", "2"), ("", "z")]
    assert outline("<table><tr><td>1<td>2<tr><th>3</table><dl><dt>k<dd>v</dl>") == [("table/tr/td", "1"), ("table/tr/td", "2"), ("table/tr/th", "3"), ("dl/dt", "k"), ("dl/dd", "v")]
    assert outline("<div><p><b>one</div>two</b>") == [("div/p/b", "one"), ("", "two")]


def test_what_is_no_text():
    assert outline("a<!-- <p>b</p> -->c<script>if (a < b) '</p>'</script><style>p{}</style><?php x ?><!DOCTYPE html>") == [("", "a"), ("", "c"), ("script", "if (a < b) '</p>'"), ("style", "p{}")]
    assert outline("1 < 2 </ > 3 <x") == [("", "1 <"), ("", "2"), ("", "3")]
    assert outline(None) == outline("") == []


def test_attributes():
    page = read_page("<a HREF='/x?a=1&amp;b=2' title=\"1 > 0\" data-x=y hidden class=c class=d>t</a>")
    assert page.attributes(0) == {"href": "/x?a=1&b=2", "title": "1 > 0", "data-x": "y", "hidden": "", "class": "c"}
    assert page.pieces[0].linked


def test_blocks_and_subtrees():
    page = read_page("<div>a <b>b</b><br>c<br><br>d<p>e</p>f</div>")
    blocks = {}
    for p in page.pieces:
        blocks.setdefault(p.block, []).append(p.text)
    assert [plain("".join(b)) for b in blocks.values() if plain("".join(b))] == ["a b c", "d", "e", "f"]
    assert page.last[0] == len(page.tags) - 1 and page.last[1] == 1


@pytest.mark.parametrize("piece", ['<a href="x" ', "<script ", '<a href="x">', "<p ", "<b>", "<div>", "</p>", "<", "<!--", "<!", "<li>", "<ul><li>", "<table><tr><td>", "<a b='\">", "</é>", "&"])
def test_a_megabyte_is_read_in_seconds(piece):
    content = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    page = read_page(content)
    for node in range(len(page.tags)):
        page.attributes(node)
    assert time.perf_counter() - began < 10


def picked(content, selector, within=None):
    page = read_page(content)
    return [page.attributes(n).get("id", page.tags[n]) for n in select(page, selector, within)]


TREE = "<div class='list main' id=a><ul id=b><li id=c class=item><a id=d href=/news/1>x</a><li id=e class='item hot'><p id=f><a id=g href=/about lang=en-GB></a></p></ul></div><a id=h data-x='1 2'></a>"


@pytest.mark.parametrize("selector,want", [
    ("a", "dgh"), ("li a", "dg"), ("li > a", "d"), (".item", "ce"), ("li.item.hot", "e"), ("#b li", "ce"), ("div.list li > p a", "g"), ("a[href]", "dg"), ("a[href^='/news']", "d"), ('a[href*="bout"]', "g"), ("a[href$='1']", "d"),
    ("a[data-x~=2]", "h"), ("[lang|=en]", "g"), ("p, a[data-x]", "fh"), ("*", "abcdefgh"), ("//li", "ce"), ("//li/a", "d"), ("//div[@class='list main']//a[@href]", "dg"), ("//li[contains(@class, 'hot')]//a", "g"), ("/div/ul", "b"), ("/ul", ""), (".//a[starts-with(@href,'/n')]", "d"),
    ("//a[@href and @lang]", "g"), ("a:hover", ""), ("li >", ""), ("//a[1]", ""), ("", ""), (None, ""), ("div div", ""),
])
def test_selectors(selector, want):
    assert "".join(picked(TREE, selector)) == want


def test_selectors_within_an_element():
    page = read_page(TREE)
    item = select(page, "li.hot")[0]
    names = lambda s: "".join(page.attributes(n)["id"] for n in select(page, s, item))
    assert names("a") == "g" and names("li > p") == "f" and names("ul a") == "" and names(".//a") == "g" and names("//a") == "dgh"


def test_dates(spark):
    texts = ["2024-05-06T07:08:09+00:00", "2024-05-06 07:08", " 2024-05-06", "on 2024/5/6.", "06.05.2024", "6 May 2024", "by x, May 6, 2024 at y", "6 MAY 2024", "Sept 2024", "soon", "", None, "99 May 2024"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = [str(r.d) if r.d else None for r in frame.orderBy("id").select(find_date(frame.t).alias("d")).collect()]
    assert got == ["2024-05-06 07:08:09", "2024-05-06 07:08:00", *["2024-05-06 00:00:00"] * 6, *[None] * 5]


def test_best_element(spark):
    long, other = "A sentence of an article that goes on. " * 9, "Something else that is told at some length here. " * 9
    page = lambda body: sources.article_of(f"<html><body>{body}</body></html>")["text"]
    assert page(f"<nav><p>{other}</p></nav><div class=content><p>{long}</p><p>short</p></div><div class=sidebar-content><p>{other}</p></div>") == long.strip()
    assert page(f"<div class=story><a href=x>{other}</a></div><article class=post><p>{long}</p><p>{long}</p></article>") == long.strip()
    assert page("<div>" + other + "</div>") == other.strip() and page("<p>tiny</p>") == "tiny"
    told = '<script type="application/ld+json">{"@graph": [{"articleBody": "' + long * 3 + '"}, {"text": "' + other + '"}]}</script>'
    assert page(told + f"<article><p>{other}</p></article>") == (long * 3).strip()
    assert page('<script type="application/ld+json">{bad</script>' + f"<p>{other}</p>") == other.strip()
    assert sources.article_of("<h1>Head<br><span>lead</span></h1><time>on 2024/5/6</time><link rel=image_src href='https://x/y.png'>") | {"text": ""} == {"title": "Head lead", "text": "", "image": "https://x/y.png", "dates": ["", "", "", "2024/5/6"]}


@pytest.mark.parametrize("piece", ['<a href="x" ', '<a href="/news/1">title of it', "<script ", "<div class=content>", "<p>text of some length that is enough", "<div class=content><p>text of some length that is enough", "<h2>x"])
def test_hostile_articles_and_listings(piece):
    content = piece * (300_000 // len(piece))
    began = time.perf_counter()
    sources.article_of(content)
    sources._anchors(content, "div.content", "a[href]", "time")
    assert time.perf_counter() - began < 20
