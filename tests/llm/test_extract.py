"""Main text of made pages of several layouts, and of the given pages by their template."""

import html
import random
import re
import time

import pytest

from tidewire.llm import extract

LONG = "The report says that the price of oil was higher than in the year before, and that most of the fields in the north will be open by the end of it. " * 2
MIDDLE = "It was not clear to them which of the two plans would be used, or by whom."
MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "About us", "Contact"))
NOTICE = "We use cookies on this site to give you the best of it, and by the use of it you say that you are fine with that. " * 2
COMMENT = "I have been to this place and it is not as good as they say that it is, so do not go to it if you can help it. " * 2


def body(*paragraphs):
    return "".join(f"<p>{p}</p>" for p in paragraphs)


TEXT = [LONG, MIDDLE, "Short one.", LONG + "again"]
PAGES = {
    "elements": (f"<header>Site of the day</header><nav><ul>{MENU}</ul></nav><aside>{LONG}</aside><article><h1>Title</h1>{body(*TEXT)}</article><footer>{LONG}</footer>", ["Title", *TEXT]),
    "names": (
        f"<div id=header><p>{LONG}</p></div><div class='main-menu'>{MENU}</div><div class='cookie-notice'>{NOTICE}</div><div class=content><h1>Title</h1>{body(*TEXT)}</div>"
        f"<div class=sidebar>{body(LONG, 'x')}</div><div class='ad'>{LONG}</div><section id='comments'><h2>2 comments</h2><div><p>{COMMENT}</p></div></section><div class=footer>{LONG}</div>",
        ["Title", *TEXT],
    ),
    "densities": (
        f"<div><table><tr><td><ul>{MENU}</ul></td><td><h1>Title of it</h1>{body(*TEXT)}</td></tr></table></div><div><a href=x>{LONG}</a></div><div>© 2020 All rights reserved.</div><div>Zurich Basel</div>",
        ["Title of it", *TEXT],
    ),
    "article with parts": (
        f"<article><header><h1>Title</h1></header>{body(LONG)}<div class='ad-slot'>{LONG}</div><aside>{LONG}</aside>{body('End.')}<h2>Part</h2>{body('a', 'b')}<h3>Related</h3><ul>{MENU}</ul>"
        f"<form><input><p>{LONG}</p></form><div class='share-buttons'>Tweet this</div><footer>Tags</footer></article>",
        ["Title", LONG, "End.", "Part", "a", "b"],
    ),
    "short article": ("<nav>Home</nav><article><h1>Hi</h1><p>One line.</article><div>other</div>", ["Hi", "One line."]),
    "comments by heading": (f"<main><h1>Title</h1>{body(LONG, MIDDLE)}<div><h3>Reader comments (3)</h3><p>{COMMENT}</p><div><p>{COMMENT}</p></div></div></main>", ["Title", LONG, MIDDLE]),
    "nested comments": (f"<div class=comments><article class=comment><p>{COMMENT}</p></article></div><article><p>{LONG}</p><p>{MIDDLE}</p></article>", [LONG, MIDDLE]),
    "wrapping form and names": (f"<body class='has-sidebar no-comments'><form id=aspnet><div class='page banner-layout'><article>{body(*TEXT)}</article></div></form></body>", TEXT),
    "references and spaces": ("<article><p>a&nbsp;&amp;amp; &lt;b&gt; &#8364;&#x41; &copy &unknown;\n\t x</p><p>y<br>z<br><br>w</p></article>", ["a &amp; <b> €A © &unknown; x", "y z", "w"]),
    "unclosed": (f"<title>t</title><article><p><b>{LONG}<p><i>One<br><p>Two <a href='x'>three</a> four</b><!-- <p>no</p> --><script>var a = '</p>' < 1;</script>", [LONG, "One", "Two three four"]),
    "hidden": (f"<article><p>{LONG}</p><p hidden>{LONG}</p><div style='display: none'>{LONG}</div><div aria-hidden=true>x</div></article>", [LONG]),
    "other language": ("<div><ul>" + MENU + "</ul></div><div><p>" + "Ala ma kota i psa oraz wiele innych zwierząt. " * 6 + "</p></div>", ["Ala ma kota i psa oraz wiele innych zwierząt. " * 6]),
    "no tags": (LONG, [LONG]),
    "only menus": (f"<nav>{MENU}</nav><footer>x</footer>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    page, want = PAGES[name]
    assert extract.main_text(page).split("\n") == ([extract.plain(w) for w in want] or [""])


def test_given_pages(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = {r.page_id: r for r in extract.op13_html_text(spark, folder).collect()}
    assert len(got) == len(rows)
    for r in rows:
        blocks = re.split("</?(?:p|h1)>", re.search(r"(?s)<article>(.*?)</article>", r.html)[1])
        want = "\n".join(b for b in (extract.plain(html.unescape(re.sub("<[^>]+>", " ", b))) for b in blocks) if b)
        assert tuple(got[r.page_id]) == (r.page_id, r.url, want, len(want))


def test_frames(spark, tmp_path):
    rows = [(1, "u", None, "x", 2), (1, "u", "", "x", 2), (None, None, "<article>a<b>𝒳</b></article>", None, None), (3, "v", "<article>" + "<p>word</p>" * 50_000, "x", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    got = extract.op13_html_text(spark, str(tmp_path)).collect()
    assert got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, "u", "", 0), (1, "u", "", 0), (None, None, "a𝒳", 2), (3, "v", "\n".join(["word"] * 50_000), 249_999)]))
    assert extract.extract_text(frame.where("false"), keep=["url"], output="main").columns == ["url", "main"]


@pytest.mark.parametrize("piece", ['<a href="x" ', "<script ", '<a href="x">', "<b>", "<div class=ad>", "</p>", "<", "<!--", "<h2>x", "<li>x", "<table><tr><td>", "<article>", "&lt"])
def test_hostile_pages(piece):
    began = time.perf_counter()
    extract.main_text(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 20


def test_any_mixture_of_tags():
    r = random.Random(4)
    parts = ["<p>", "</p>", "<b>", "</b>", "<article>", "</article>", "<ul>", "<li>", "</ul>", "text ", "<a href=x>", "</a>", "<br>", "<table>", "<td>", "</table>", "&amp;", "<", "<h2>", "<div class=comment>", "</div>", "<!--", "-->", "<script>", "</script>", '"', "'"]
    for _ in range(500):
        extract.main_text("".join(r.choice(parts) for _ in range(r.randrange(60))))
