"""Processing stages against a plain loop over articles."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import stages

STATE = "id long, title string, raw_text string, category string, relevant boolean, relevance_reason string, summary string, title_ru string, tag_id long, total_score double"
TAGS, STOPS, CRITERIA = [(1, ["rig"]), (2, ["pump", "valve"])], [("noise", ["lottery"])], [(1, 60.0, ["rig", "pump"]), (2, 40.0, ["valve"])]


def made(spark):
    def client(row):
        text = row["t"] or ""
        if "boom" in text:
            raise RuntimeError("b" * 2000)
        return {"relevant": "rig" in text or "pump" in text, "reason": "because", "model": "m", "input_tokens": len(text)}

    return stages.article_stages({
        "relevance": stages.by_model(lambda: client, {"t": F.col("raw_text")}, "relevant boolean, reason string"),
        "summary": stages.by_rule({"summary": F.upper("title")}, error=F.when(F.col("raw_text").contains("thin"), "thin")),
        "translation": stages.by_rule({"title_ru": F.concat(F.lit(" ru "), "title")}),
        "tagging": stages.by_rule({"tag_id": F.when(F.col("raw_text").contains("odd"), 77).otherwise(2).cast("long")}),
        "scoring": stages.by_rule({"scores": F.create_map(F.lit(1), F.lit(150.0))}),
    }, tags=TAGS, stop_words=STOPS, criteria=CRITERIA, fallback_tag=5)


def plain(a):
    """One article by the rules, step after step."""
    a, log = dict(a), []
    text = " ".join(a[k] or "" for k in ("title", "summary", "raw_text", "category")).lower()
    if "lottery" in text.split():
        return a | {"relevant": False}, log
    if a["relevant"] is None:
        if "boom" in (a["raw_text"] or ""):
            return a, [("relevance", "error")]
        a["relevant"] = any(w in (a["raw_text"] or "") for w in ("rig", "pump"))
        log.append(("relevance", "ok"))
    if not a["relevant"]:
        return a, log
    if not a["summary"]:
        if "thin" in (a["raw_text"] or ""):
            return a, [*log, ("summary", "error")]
        a["summary"] = a["title"].upper() if a["title"] is not None else None
        log.append(("summary", "ok"))
    title = (a["title"] or "").strip()
    if not a["title_ru"] and title:
        if title[0] < "я" and title.isascii():
            log.append(("translation", "ok"))
            a["title_ru"] = f"ru {a['title']}".strip()
        else:
            a["title_ru"] = title
    text = " ".join(a[k] or "" for k in ("title", "summary", "raw_text", "category")).lower()
    if a["tag_id"] is None:
        hits = {1: "rig" in text, 2: ("pump" in text) + ("valve" in text.split())}
        a["tag_id"] = 2 if "odd" not in (a["raw_text"] or "") else 5 if not any(hits.values()) else max(hits, key=lambda t: (hits[t], -t))
        log.append(("tagging", "ok"))
    if a["total_score"] is None:
        second = round(100 * ("valve" in text) / 3, 2)
        a["total_score"] = round(60 + second * 0.4, 2)
        log.append(("scoring", "ok"))
    return a, log


def test_same_as_a_loop(spark):
    r = random.Random(4)
    words = ["rig", "pump", "valve", "lottery", "boom", "thin", "odd", "x", "y"]
    rows = [{"id": i, "title": r.choice([None, "", "Big rig", "Новый насос", " pumps "]), "raw_text": r.choice([None, "", " ".join(r.choice(words) for _ in range(4))]), "category": r.choice([None, "News"]),
             "relevant": r.choice([None, None, True, False]), "relevance_reason": None, "summary": r.choice([None, "", "kept"]), "title_ru": r.choice([None, "есть"]), "tag_id": r.choice([None, 3]), "total_score": r.choice([None, 7.0])} for i in range(300)]
    done = stages.process(spark.createDataFrame(rows, STATE), made(spark))
    got = {x["id"]: x for x in done.collect()}
    for a in rows:
        want, log = plain(a)
        mine = got[a["id"]]
        assert [(x["stage"], x["status"]) for x in mine["runs"]] == log, a
        assert {k: mine[k] for k in want if k != "relevance_reason"} == {k: v for k, v in want.items() if k != "relevance_reason"}, a
    failed = [x for m in got.values() for x in m["runs"] if x["status"] == "error" and x["stage"] == "relevance"]
    assert failed and all(len(x["error"]) == 1000 and x["input_tokens"] == 0 for x in failed)
    tally = stages.counts(done, ["summary", "scoring"]).first()
    assert tally["processed"] == 300 and tally["scoring"] == sum(("scoring", "ok") in plain(a)[1] for a in rows)


def test_empty_table_and_bad_settings(spark):
    none = stages.process(spark.createDataFrame([], STATE), made(spark))
    assert none.count() == 0 and stages.counts(none, ["summary"]).first()["processed"] == 0
    with pytest.raises(ValueError):
        stages.total_score(F.lit(""), [(1, 50.0, ["a"])], F.create_map(F.lit(1), F.lit(1.0)))
    with pytest.raises(ValueError):
        stages.article_stages({}, tags=[], stop_words=[], criteria=CRITERIA, fallback_tag=1)


def test_no_shuffle(spark):
    done = stages.through(spark.range(1).selectExpr("id", *[f"CAST(NULL AS {t}) AS {n}" for n, t in (c.split() for c in STATE.split(", ")[1:])]), made(spark))
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()


def test_jobs_that_name_one_article_ask_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def client(row):
        asked.add(1)
        return {"relevant": "rig" in row["t"], "reason": "because"}

    only = [stages.Stage("relevance", F.col("relevant").isNull(), stages.by_model(lambda: client, {"t": F.col("raw_text")}, "relevant boolean, reason string"), {"relevant": lambda r: r["relevant"]})]
    articles = spark.createDataFrame([(i, "rig" if i % 2 else "x", True, 3) for i in range(4)], "id long, raw_text string, relevant boolean, tag_id long")
    now = F.lit("2020-01-01").cast("timestamp")
    jobs = spark.range(60).select(F.col("id").alias("job_id"), F.expr("array(id % 3, id % 3, id % 2, 99L)").alias("article_ids"), F.when(F.col("id") < 50, "running").otherwise("ok").alias("status"), F.lit("t").alias("lease_token"), F.when(F.col("id") % 7 == 0, "u").otherwise("t").alias("held_token"), now.alias("lease_expires_at"))
    got = stages.job_results(jobs, articles, only, now).collect()
    want = {(j, i, i % 2 == 1) for j in range(50) if j % 7 for i in (j % 3, j % 2)}
    assert {(r["job_id"], r["id"], r["relevant"]) for r in got} == want and len(got) == len(want)
    assert all(r["tag_id"] is None and len(r["runs"]) == 1 for r in got) and asked.value == 3
