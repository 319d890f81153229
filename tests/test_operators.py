"""Operators on hand-made rows, with null and empty inputs."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as fn
from tidewire.operators import documents, jobs, merge, similarity
from tidewire.plans import derived, reports
from tidewire.sources import pages
from tidewire.sources.newsroom import Newsroom
from tidewire.streaming import ingest


def one(spark, expression, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expression).first()[0]


def test_title_matches_body(spark):
    match = fn.title_matches_body(F.col("t"), F.col("b"))
    assert one(spark, match, t="Роснефть запустила новую скважину сегодня", b="Компания Роснефть сообщила, что новую скважину запустили")
    assert not one(spark, match, t="Роснефть запустила новую скважину сегодня", b="Чемпионат закончился победой хозяев поля вчера вечером")
    assert one(spark, match, t="May 2026", b="anything else at all")
    assert one(spark, match, t=None, b=None)


def test_emoji_and_keys(spark):
    assert one(spark, fn.strip_emoji(F.col("t")), t="🔥 Рост ↓ 5° ™ ✓ 👍🏽") == "Рост ↓ 5° ™ ✓"
    assert one(spark, fn.url_key(F.col("t")), t="HTTPS://www.Site.com/A/b/?q=1#x") == "site.com/a/b"
    assert one(spark, fn.url_key(F.col("t")), t="  ") is None
    assert one(spark, fn.body_hash(F.col("t")), t=" \n ") is None
    assert one(spark, fn.clean_query(F.col("t")), t="a=1&utm_source=x&b=2&FBCLID=3") == "a=1&b=2"


def test_prefilter_keeps_short_words_whole(spark):
    keep = fn.should_keep(F.col("t"), F.col("s"), ["ai"], ["match"])
    assert not one(spark, keep, t="The match in Spain", s=None)
    assert one(spark, keep, t="The match of AI", s="")
    assert one(spark, keep, t=None, s=None)


def test_numbers(spark):
    cases = {
        "1 234 567": "1234567", "1.234.567": "1234567", "1 234 567": "1234567", "1’234": "1234", "1.234,50": "1234.5", "1,5": "1.5", "1,500": "1500", "–5": "5", "+007,10": "7.1", "0,0": "0",
        "1,234.567.8": None, "": None, None: None, "x5": None, "..": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", documents.normalized_number(F.col("raw")).alias("n")).collect()
    assert {r.raw: r.n for r in rows} == cases


def test_verified_values(spark):
    cases = [
        ("1,5", "млн тонн", "добыто 1 500 000 тонн нефти", True), ("1,5", "млн", "выделено 1,5 млрд", False), ("15", "", "в 2015 году", False), ("высокий", None, "Риск  Высокий", True),
        ("5", "м2", "площадь 5 кв.м", True), ("5", "этажей", "дом 5 этаж", True), ("1,2", "тыс. барр/сут", "дебит 1,2 тыс. барр/сут в среднем", True), ("1200", "барр/сут", "дебит 1,2 тыс. барр/сут", True),
        ("1200", "т/сут", "дебит 1,2 тыс. барр/сут", False), ("более 10", "скважин", "пробурено 10 скважин", True), ("Итого: 7", None, "всего 7 штук", True), ("100", "usd", "цена $ 100.", True),
        ("100", "руб", "цена $ 100.", False), ("10", "кВ", "линия 10 кВ", True), ("3", "мес", "срок 3 месяца", True), ("", "т", "1 т", False), (None, None, None, False), ("4", None, "", False), ("5", "т", None, False),
    ]
    frame = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, v string, u string, a string")
    got = {r.i: r.ok for r in frame.select("i", documents.value_verified(F.col("v"), F.col("u"), F.col("a")).alias("ok")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


@pytest.mark.parametrize(("limit", "overlap"), [(120, 20), (120, 0), (60, 59)])
def test_chunks(spark, limit, overlap):
    r = random.Random(7)
    anchors = [(1, "a" * 30), (2, " \n"), (3, "".join(f"{i:04d}" for i in range(75))), (4, "c" * 20), (5, None)] + [(6 + i, "".join(r.choices("defghijk", k=r.randrange(1, 90)))) for i in range(40)]
    frame = spark.createDataFrame([(1, anchors), (2, []), (3, None), (4, [(9, "one")])], "doc_id int, anchors array<struct<number:int,text:string>>")
    found = documents.chunk_documents(frame, max_chars=limit, overlap=overlap).orderBy("doc_id", "chunk").collect()
    assert [tuple(x) for x in found if x.doc_id != 1] == [(4, 0, "one", 9, 9)]
    chunks = [x for x in found if x.doc_id == 1]
    lines = [(n, t) for n, t in anchors if t and t.strip()]
    stream, places, at = "\n".join(t for _, t in lines), {}, 0
    for n, t in lines:
        places[n] = (at, at + len(t))
        at += len(t) + 1
    lead, done, whole = max(overlap, 1), 0, []
    for x in chunks:
        assert len(x.text) <= limit and x.chunk == len(whole)
        begin = stream.find(x.text, max(0, done - limit))
        end = begin + len(x.text)
        assert 0 <= begin <= done <= end  # nothing is left out
        long = [n for n, (b, e) in places.items() if e - b > limit - min(lead, b) and n == x.anchor_from == x.anchor_to]
        if not long:
            inside = [n for n, (b, e) in places.items() if e > begin and b < end]
            assert (inside[0], inside[-1]) == (x.anchor_from, x.anchor_to) and end == places[x.anchor_to][1]
            after = [e for b, e in places.values() if b >= end]
            content = begin + min(lead, done + 1) if begin else 0
            assert not after or after[0] - content > limit - lead  # the next anchor would not fit
        done, whole = end, [*whole, x]
    assert done == len(stream)
    with pytest.raises(ValueError, match="overlap"):
        documents.chunk_documents(frame, max_chars=10, overlap=10)


def test_long_anchor_pieces_keep_its_number(spark):
    frame = spark.createDataFrame([(1, [(1, "a" * 30), (2, "b" * 300), (3, "c" * 20)])], "doc_id int, anchors array<struct<number:int,text:string>>")
    found = documents.chunk_documents(frame, max_chars=120, overlap=20).orderBy("chunk").collect()
    assert [(x.anchor_from, x.anchor_to, len(x.text)) for x in found] == [(1, 1, 30), (2, 2, 120), (2, 2, 120), (2, 2, 120), (2, 3, 40)]


def test_marked_chunks(spark):
    frame = spark.createDataFrame([(1, [(1, " aa "), (2, None), (3, "b" * 50), (4, "c")]), (2, None)], "doc_id int, anchors array<struct<number:int,text:string>>")
    found = documents.marked_chunks(frame, max_chars=40).orderBy("chunk").collect()
    assert [tuple(x)[1:] for x in found] == [(0, "[[unit 1]]\naa", 1, 1), (1, "[[unit 3]]\n" + "b" * 40, 3, 3), (2, "[[unit 3]]\n" + "b" * 10 + "\n[[unit 4]]\nc", 3, 4)]


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a", "x", 1), (2, "b", None, 2)], "id int, o string, k string, p int")
    new = spark.createDataFrame([(1, "A", None, 9), (3, "C", "z", 7)], "id int, o string, k string, p int")
    rows = {r.id: tuple(r)[1:] for r in merge.upsert(old, new, ["id"], {"k": merge.KEEP_IF_NULL, "p": merge.PRESERVE}).collect()}
    assert rows == {1: ("A", "x", 1), 2: ("b", None, 2), 3: ("C", "z", 7)}
    assert merge.insert_new(old, new.union(new), ["id"], "p").count() == 1
    assert merge.delete(old, new, ["id"]).count() == 1


def test_heartbeat_and_claim(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "q", "queued", 0, 3, t, None, None, None), (2, "q", "queued", 0, 3, t, None, None, t + dt.timedelta(hours=1)), (3, "q", "running", 3, 3, t, "tok", t - dt.timedelta(hours=1), None)]
    queue = spark.createDataFrame(rows, "id int, queue_name string, status string, attempts int, max_attempts int, created_at timestamp_ntz, lease_token string, lease_expires_at timestamp_ntz, run_after timestamp_ntz")
    assert {r.id: r.status for r in jobs.claim(queue, now, per_queue=5).collect()} == {1: "running", 2: "queued", 3: "running"}
    assert {r.id: r.status for r in jobs.sweep(queue, now).collect()}[3] == "failed"
    beats = spark.createDataFrame([(3, "tok")], "id int, lease_token string")
    assert jobs.heartbeat(queue, beats, now).where("id = 3").first().lease_expires_at == t - dt.timedelta(hours=1)


def test_star_not_chain(spark):
    nodes = spark.createDataFrame([(1, 1, 3, 9.0, 1), (1, 2, 3, 8.0, 1), (1, 3, 3, 7.0, 1), (1, 4, 0, 1.0, 1)], "component long, id long, tier int, score double, evidence int")
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 4)], "component long, a long, b long")
    assert {(r.id, r.duplicate_of) for r in similarity.assign_stars(nodes, edges).collect()} == {(1, 4), (3, 2)}


def test_signals_for_dedup_keeps_reviewed_cards_and_ten_urls(spark):
    room = Newsroom(spark, "/root/testdata/sf0.001")
    evidence, reviewed = {}, {r.signal_id for r in room.table("signal_feedback").where("verdict <> '' or event_type = 'comment_added'").collect()}
    for r in sorted(room.table("signal_evidence").collect(), key=lambda r: (-r.strength, r.id)):
        evidence.setdefault(r.signal_id, []).append(r)
    oldest = dt.datetime.fromisoformat(reports.AS_OF) - dt.timedelta(days=30)
    wanted = []
    for s in room.table("signals").where("merged_into_signal_id is null").collect():
        last = max((e.published_at for e in evidence.get(s.id, []) if e.published_at), default=None)
        if s.id in reviewed or (last and last >= oldest):
            wanted.append((s.id not in reviewed, -last.timestamp() if last else math.inf, -s.id))
    rows = room.sql(reports.signals_for_dedup()).collect()
    assert [r.id for r in rows] == [-x[2] for x in sorted(wanted)[:300]]
    assert all(r.urls.split() == [e.source_url for e in evidence.get(r.id, [])[:10]] for r in rows)
    assert any(len(r.urls.split()) == 10 for r in rows)


def greedy_stars(nodes, edges):
    """nodes: (id, tier, score, evidence); edges: pairs of ids."""
    near = {n[0]: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    order = sorted(nodes, key=lambda n: (n[1], -n[2], -n[3], n[0]))
    place, tier, into = {n[0]: k for k, n in enumerate(order)}, {n[0]: n[1] for n in nodes}, {}
    for node, *_ in order:
        if node not in into:
            into |= {o: node for o in near[node] if o not in into and place[o] > place[node] and tier[o] >= 2}
    return into


@pytest.mark.parametrize("seed", [0, 1])
def test_stars_match_greedy(spark, seed):
    r = random.Random(seed)
    nodes = [(i, r.randrange(4), float(r.randrange(3)), r.randrange(2)) for i in range(40)]
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(70)]
    edges = [e for e in edges if e[0] != e[1]]
    chain = [(100 + i, 3, float(-i), 1) for i in range(7)]
    # 203 is taken by 202 in the first round; 200 ranks higher and is found a centre only later
    late = [(199, 2, 9.0, 1), (198, 2, 8.0, 1), (200, 2, 7.0, 1), (202, 2, 6.0, 1), (203, 2, 5.0, 1)]
    nodes, edges = nodes + chain + late, edges + [(100 + i, 101 + i) for i in range(6)] + [(199, 198), (198, 200), (200, 203), (202, 203)]
    found = similarity.assign_stars(spark.createDataFrame(nodes, "id long, tier int, score double, evidence int"), spark.createDataFrame(edges, "a long, b long"))
    got = {x.id: x.duplicate_of for x in found.collect()}
    assert got == greedy_stars(nodes, edges) and got[203] == 200 and got[103] == 102


@pytest.mark.parametrize("threshold", [0.25, 0.6])
@pytest.mark.parametrize("heads,block,few", [(4096, 8192, 200_000), (5, 16, 200_000), (3, 16, 0)])
def test_similar_stars_list_no_pairs(spark, monkeypatch, threshold, heads, block, few):
    monkeypatch.setattr(similarity, "similar_pairs", lambda *_, **__: pytest.fail("pairs are listed"))
    for name, value in (("HEADS", heads), ("BLOCK", block), ("CELLS", 64), ("FEW_EDGES", few)):
        monkeypatch.setattr(similarity, name, value)
    r = random.Random(heads)
    rows = [(i, t, r.randrange(5), float(r.randrange(3)), r.randrange(2)) for i, t in enumerate(made_titles(), 1)]
    stems = {i: stem_set(t) for i, t, *_ in rows}
    edges = [(i, j) for i in stems for j in stems if i < j and stems[i] and stems[j] and len(stems[i] & stems[j]) / len(stems[i] | stems[j]) >= threshold]
    frame = spark.createDataFrame(rows, "id long, title string, tier int, score double, evidence int")
    found = similarity.similar_stars(frame.join(similarity.title_sets(frame), "id"), threshold=threshold)
    assert {x.id: x.duplicate_of for x in found.collect()} == greedy_stars([(i, *n) for i, _, *n in rows], edges)


def test_star_assignment_takes_all_articles(spark):
    room = Newsroom(spark, "/root/testdata/sf0.001")
    nodes = [(r.id, r.id % 3 + 1, float(r.id % 100), 1) for r in room.table("articles").select("id").collect()]
    stems = {r.id: stem_set(r.title) for r in room.table("articles").select("id", "title").collect()}
    edges = [(i, j) for i in stems for j in stems if i < j and stems[i] and stems[j] and len(stems[i] & stems[j]) / len(stems[i] | stems[j]) >= 0.25]
    assert {x.id: x.duplicate_of for x in derived.star_assignment(spark, room.folder).collect()} == greedy_stars(nodes, edges)


def made_titles():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeжё1") for _ in range(r.randrange(3, 7))) for _ in range(40)]
    titles = [None, "", "the and for", *(" ".join(r.choice(words) for _ in range(r.randrange(1, 9))) for _ in range(80))]
    return titles + titles[-12:] + [titles[-1]] * 8


def stem_set(title):
    return {w[:4] for w in re.findall("[a-zа-яё0-9]{4,}", (title or "").lower()) if w not in similarity.STOP_STEMS and not w.isdigit()}


@pytest.mark.parametrize("threshold", [0.25, 0.5, 1.0])
@pytest.mark.parametrize("spread", [1000, 3])
def test_similar_pairs_match_all_pairs(spark, monkeypatch, threshold, spread):
    monkeypatch.setattr(similarity, "SPREAD", spread)
    rows = list(enumerate(made_titles(), 1))
    found = similarity.similar_pairs(spark.createDataFrame(rows, "id long, title string"), threshold=threshold).collect()
    stems = {i: stem_set(t) for i, t in rows}
    want = {(i, j): len(stems[i] & stems[j]) / len(stems[i] | stems[j]) for i in stems for j in stems if i < j and stems[i] and stems[j]}
    assert sorted((r.id_a, r.id_b, r.overlap) for r in found) == sorted((*k, v) for k, v in want.items() if v >= threshold)


def test_jaccard_pairs_reads_all_articles(spark):
    room = Newsroom(spark, "/root/testdata/sf0.001")
    stems = {r.id: stem_set(r.title) for r in room.table("articles").select("id", "title").collect()}
    like = lambda i, j: len(stems[i] & stems[j]) / len(stems[i] | stems[j]) >= 0.25
    want = {(i, min((j for j in stems if s and stems[j] == s), default=i), sum(j != i and bool(s and stems[j]) and like(i, j) for j in stems)) for i, s in stems.items()}
    assert {(r.id, r.of, r.links) for r in derived.jaccard_pairs(spark, room.folder).collect()} == want


@pytest.mark.parametrize("threshold", [0.25, 0.5, 1.0])
def test_links_are_counted_and_not_listed(spark, monkeypatch, threshold):
    monkeypatch.setattr(similarity, "BLOCK", 20)
    monkeypatch.setattr(similarity, "CELLS", 64)
    rows = list(enumerate(made_titles(), 1))
    members, classes = similarity.similar_counts(similarity.title_sets(spark.createDataFrame(rows, "id long, title string")), threshold=threshold)
    stems = {i: frozenset(stem_set(t)) for i, t in rows if stem_set(t)}
    of = {s: min(i for i in stems if stems[i] == s) for s in stems.values()}
    like = {s: [(o, len(s & o) / len(s | o)) for o in of if o != s and len(s & o) / len(s | o) >= threshold] for s in of}
    copies = {s: sum(o == s for o in stems.values()) for s in of}
    assert {(r.id, r.of) for r in members.collect()} == {(i, of[s]) for i, s in stems.items()}
    assert {(r.of, r.copies, r.links, r.linked, r.best) for r in classes.collect()} == {(of[s], copies[s], len(x), sum(copies[o] for o, _ in x), max((v for _, v in x), default=None)) for s, x in like.items()}


def test_pages_and_feeds(spark):
    page = pages.parse_page('<html><head><title>T</title><meta property="og:title" content="OG"></head><body><nav>menu</nav><p>Hello <a href="/n/1">link</a></p></body></html>')
    assert page["title"] == "OG" and page["links"] == [{"href": "/n/1", "text": "link"}] and "menu" not in page["body"]
    assert pages.parse_page(None)["title"] is None
    feed = "<rss><channel><item><title>A &amp; B</title><link>http://x/1</link></item><item><title>no link</title></item></channel></rss>"
    rows = pages.parse_feeds(spark.createDataFrame([(1, feed), (2, None), (3, "<bad")], "id int, content string")).collect()
    assert [(r.id, r.title, r.url) for r in rows] == [(1, "A & B", "http://x/1")]


def test_stream_matches_batch(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    got = {(r.start, r.event_type): r.n for r in ingest.events_by_day(spark, folder, str(tmp_path / "c")).collect()}
    batch = spark.read.parquet(f"{folder}/events.parquet").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").count()
    assert got == {(r["start"], r["event_type"]): r["count"] for r in batch.collect()}


def test_ingest_is_idempotent(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    rows.write.parquet(source)
    for k in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(source)
        ingest.ingest_new(stream, target, str(tmp_path / f"c{k}"), keys=["id"], order="v").awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_lease_states(spark, tmp_path):
    source = str(tmp_path / "ev")
    rows = spark.createDataFrame([(1, 1.0, "running"), (1, 2.0, "ok"), (2, 1.0, "queued")], "job_id long, at double, status string")
    rows.write.parquet(source)
    out = ingest.lease_states(spark.readStream.schema(rows.schema).parquet(source))
    out.writeStream.outputMode("update").format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.job_id, r.status, r.attempts) for r in spark.table("leases").collect()} == {(1, "ok", 1), (2, "queued", 0)}


def test_listing_candidates(spark):
    html = """<a href='/news/2024/05/06/one'>A long enough title of one article</a><a href="/news/2024/05/06/one#x">bad fragment of an article</a>
    <A class=x HREF="two/story-two?utm_source=q&amp;id=3">Second story with its &amp; title <b>in bold</b></A><a href="/about/us">About the company and its people</a>
    <a href="https://else.org/news/1">A title that is long enough too</a><a href="/a.jpg">A picture that is shown in full size</a><a href="/">The front page of this very site</a><a href="/news/3">short</a>
    <a href="//my.org/press/4">Protocol-relative press release four</a><a href="?p=5">A page that only differs by its query</a><a href="/news/2024/05/06/one">A later title of the same address</a><a>no address at all in this one</a>"""
    rows = spark.createDataFrame([(1, "https://my.org/list/all.html?x=1", html), (2, "https://my.org", None), (3, None, html)], "id int, url string, html string")
    found = [tuple(r) for r in pages.listing_candidates(rows, key="id").drop("published_at").orderBy("id", "rank").collect()]
    assert found == [
        (1, 1, "https://my.org/news/2024/05/06/one", "A long enough title of one article", 8),
        (1, 2, "https://my.org/list/two/story-two?id=3", "Second story with its & title in bold", 5),
        (1, 3, "https://my.org/press/4", "Protocol-relative press release four", 5),
        (1, 4, "https://my.org/list/all.html?p=5", "A page that only differs by its query", 1),
    ]


def test_page_articles(spark):
    long = "A sentence of an article that goes on. " * 6
    rows = spark.createDataFrame([
        (1, f'<meta property="og:title" content="The &amp; title"><script type="application/ld+json">{{"articleBody": "{long}\\"x\\""}}</script><h1>Head</h1><meta name="pubdate" content="2001-02-03T04:05:06Z">'),
        (2, f"<title>Page</title><h1>A <b>head</b></h1><nav><p>menu</p></nav><p>{long}</p><p>{long}</p><time datetime='2999-01-01'>on 2000/5/6</time>"),
        (3, "<title>Only</title><p>short</p>"), (4, None), (5, '"text": "' + "a" * 300_000),
    ], "id int, html string")
    found = {r.id: r for r in pages.page_articles(rows, as_of=F.lit("2001-08-02").cast("timestamp")).collect()}
    assert found[1].title == "The & title" and found[1].text.startswith("A sentence") and found[1].published_at.year == 2001
    assert found[2].title == "A head" and found[2].text == long.strip() and str(found[2].published_at)[:10] == "2000-05-06"
    assert found[3].title == "Only" and found[3].text == "short" and found[4].title is None and found[4].text == "" and found[5].title is None


def test_channel_posts(spark):
    post = lambda n, text, at: f'<div class="tgme_widget_message" data-post="chan/{n}"><div class="tgme_widget_message_text js">{text}</div><time datetime="{at}"></time></div>'
    html = post(1, "First post. It has two sentences, and more.", "2024-01-01T10:00:00+00:00") + post(2, "", "2024-01-03T10:00:00+00:00") + post(3, "A sentence that is long enough. Then more", "2024-01-02T10:00:00+00:00") + post("x", "no number", "")
    rows = spark.createDataFrame([("s", html), ("t", None), ("u", "<p>none</p>")], "source string, html string")
    found = [tuple(r)[:4] for r in pages.channel_posts(rows).collect()]
    assert found == [("s", "https://t.me/chan/3", "A sentence that is long enough.", "A sentence that is long enough. Then more"), ("s", "https://t.me/chan/1", "First post. It has two sentences, and more.", "First post. It has two sentences, and more.")]
