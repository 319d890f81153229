"""Toxicity, language, search and contamination against plain versions or held-out labels."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, language, topk, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    scored = toxicity.op4_toxicity(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = ([r.score for r in scored if r.toxic == y] for y in (1, 0))
    assert np.mean(np.array(bad)[:, None] > np.array(good)) > 0.95
    assert np.mean([r.predicted == r.toxic for r in scored]) > 0.93


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    for rows, known in ((odd, labels), (odd, labels.where("false")), (empty, labels), (odd, labels.where("toxic = 1"))):
        found = toxicity.score(rows, toxicity.learn(rows, known), out="tox").collect()
        assert len(found) == rows.count() and all(0 <= r.tox <= 1 for r in found)


def test_toxicity_replaces_a_column_and_repeats_scores(spark):
    rows = spark.createDataFrame([(i, "you idiot " * (i % 2) + "fine words here", 9.0) for i in range(40)] + [(41, "idiot " * 50_000, 9.0), (42, None, 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.learn(rows, labels)
    found = toxicity.score(rows, model, out="score")
    assert found.columns == ["doc_id", "text", "score"]
    scores = {r.doc_id: r.score for r in found.collect()}
    assert len({scores[i] for i in range(0, 40, 2)}) == len({scores[i] for i in range(1, 40, 2)}) == 1
    assert scores[41] > 0.5 > scores[0] >= scores[42] - 1e-9


def test_label_model_finds_reliable_voters():
    r = np.random.default_rng(1)
    y = (r.random(3000) < 0.2).astype(int)
    good, noise = (r.random((3000, 3)) < np.where(y[:, None] == 1, 0.7, 0.02)), (r.random((3000, 2)) < 0.2)
    fires = np.hstack([good, good[:, :1], noise]).astype(np.float32)
    post, _, rates, discount = toxicity.label_model(fires, y)
    assert np.mean((post > 0.5) == y) > 0.97 and (rates[1, :3] > 0.5).all() and discount[0] < discount[1]


def test_language_held_out(spark):
    found = language.op10_language(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97


def test_language_odd(spark, odd, empty):
    prototypes = language.learn_prototypes(odd)
    found = {r.doc_id: r for r in language.identify(odd, prototypes).collect()}
    assert found[0].lang_pred == found[2].lang_pred == "und" and found[0].score == 0 and found[5].lang_pred == "en"
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.learn_prototypes(empty) == {} and language.identify(empty, prototypes).count() == 0


def test_top_k_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    want = con.execute(topk.OP8_SQL).df().sort_values(["query_id", "rank"])[["query_id", "rank", "vec_id", "score"]].values.tolist()
    assert sorted(map(list, topk.op8_topk(spark, FOLDER).collect())) == want


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k_odd(spark, block):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [inf, 1.0]), (6, [nan, 1.0]), (None, [1.0, 1.0]), (7, [-3.0, 0.5]), (8, [1.0]), (9, []), (10, [0.5, 0.5]), (50, [9e6, 9e6])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    found = topk.top_k(frame, F.col("vec_id") % 50 == 0, k=3, block=block, query_block=1).collect()
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and len(v) == 2 and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in kept:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in kept if i != q)[:3]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, found)) == sorted(want)
    assert topk.top_k(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_copies_no_queries(spark):
    """Query blocks are read by every lane: neither copied to each lane nor broadcast, as both grow with queries times lanes."""
    frame = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 7 - 3.0, F.col("id") % 11 / 4.0).alias("embedding"))
    found = topk.top_k(frame, F.col("vec_id") % 50 == 0, block=16, query_block=2)
    rows = [(q, i, int(np.dot(*(np.floor([256 * (x % 7 - 3.0), 64 * (x % 11)]) for x in (q, i))))) for q in range(0, 300, 50) for i in range(300) if i != q]
    want = [x for q in range(0, 300, 50) for x in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:5]]
    assert sorted((r.query_id, r.vec_id, r.score) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan and "Broadcast" not in plan


def contamination(texts, items, window):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(lower))
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("null" if i is None else str(i))
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [250_000, 12])
@pytest.mark.parametrize("window", [10, 3, 1])
def test_contamination(spark, odd, block, window):
    import random

    r = random.Random(9)
    texts = [x.text for x in odd.collect()] + [" ".join(r.choice(["a", "b", "C", "d"]) for _ in range(r.randrange(60))) for _ in range(40)]
    items = [(1, "a b c d a b c d a b c"), (2, "A, b"), (3, None), (4, ""), (None, "d d"), (5, "日本語 текст"), (6, "b c d a b c d a b c d d")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = sorted(decontaminate.find_hits(docs, bench, window=window, block_words=block).collect())
    got = [(x._tw_words, sum(s["end"] - s["begin"] for s in x._tw_spans), x._tw_items) for x in found]
    assert got == contamination(texts, items, window)


def test_contamination_query(spark):
    rows = sorted(decontaminate.op9_decontaminate(spark, FOLDER).collect())
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = contamination([docs[r.doc_id] for r in rows], items, 10)
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows] == [(n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for n, h, i in want]


def test_cutting(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Keep. One, two three! rest"), (2, "one two three"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()} == {1: "Keep. ! rest", 3: None}
    assert decontaminate.decontaminate(odd, bench.where("false")).count() == odd.count()
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_a_window_of_many_items_and_equal_items(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(f"i{k:05d}", passage) for k in range(5_000)] + [(f"j{k:04d}", f"{passage} x{k}") for k in range(500)], "item_id string, text string")
    texts = [passage + " end", f"{passage} x7 " * 300, "w1 w2", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in decontaminate.find_hits(rows, items).collect()}
    assert [(x.begin, x.end) for x in found[0]._tw_spans] == [(0, 12)] and len(found[0]._tw_items) == 5_500
    assert [(x.begin, x.end) for x in found[1]._tw_spans] == [(0, 3900)] and not found[2]._tw_items and not found[3]._tw_items
