"""Memory folds against handling one event after the other."""

import datetime
import random

import pytest

from tidewire.operators import learning

START = datetime.datetime(2024, 1, 1)


def one_by_one(events, start):
    """Memories by going through the events in order."""
    memory = {k: {"score": s, "failures": f, "n": 0, "events": []} for k, (s, f) in start.items()}
    touched = set()
    for key, at, tie, failed, delta, status, kind in sorted(events, key=lambda e: (e[1], e[2])):
        m = memory.setdefault(key, {"score": 0.0, "failures": 0, "n": 0, "events": []})
        touched.add(key)
        m["previous"] = m["score"]
        if failed:
            m["failures"] += 1
            m["score"], m["retry"] = -float(m["failures"]), at + datetime.timedelta(hours=24)
            m["status"] = "rejected" if m["failures"] >= 3 else "temporary_unavailable"
        else:
            m["score"] = round(max(-100.0, min(100.0, m["score"] + delta)), 2)
            m["status"] = status
        m["n"] += 1
        m["events"] = [*m["events"], tie][-10:]
    return {k: (m["score"], m["previous"], m["failures"], m["status"], m.get("retry"), m["n"], m["events"]) for k, m in memory.items() if k in touched}


def made(seed, n=1500):
    r = random.Random(seed)
    keys = ["domain:hot"] * 6 + [f"k{i}" for i in range(40)]
    return [(r.choice(keys), START + datetime.timedelta(minutes=r.randrange(400)), i, r.random() < 0.02, r.choice([30.0, -25.0, 12.5, -0.25, 0.0, 60.0, -70.0]), r.choice(["active", "muted"]), "evaluated") for i in range(n)]


SCHEMA = "memory_key string, at timestamp, event_id long, failed boolean, delta double, status string, event_type string"


@pytest.mark.parametrize("block", [2048, 3])
def test_folds(spark, monkeypatch, block):
    monkeypatch.setattr(learning, "BLOCK", block)
    events = made(block)
    start = {"k1": (99.5, 0), "domain:hot": (10.0, 2), "unused": (1.0, 1)}
    frame = spark.createDataFrame([*events, (None, START, 1, False, 1.0, "active", "x"), ("k1", None, 1, False, 1.0, "active", "x")], SCHEMA)
    stored = spark.createDataFrame([(k, *v) for k, v in start.items()], "memory_key string, score double, failures long")
    got = {r.memory_key: (r.score, r.previous_score, r.failures, r.status, r.retry_after, r.n_events, [e.event_id for e in r.events]) for r in learning.memory_fold(frame, start=stored).collect()}
    assert got == one_by_one(events, start)
    assert learning.memory_fold(frame.where("false")).count() == 0


def test_decisions_in_order_of_rules(spark):
    rows = [
        ("approved", "new", "reject", "noise", 0, 0, 0, None, "approved"), ("reviewed", "approved", None, "duplicate", 0, 0, 0, None, "approved"), ("reviewed", "rejected", None, "DUPLICATE noise", 0, 0, 0, None, "duplicate"),
        ("reviewed", "rejected", None, "Дубликат", 0, 0, 0, None, "duplicate"), ("reviewed", "rejected", None, "это шум", 0, 0, 0, None, "noise"), ("reviewed", "rejected", "add", None, 3, 3, 0, None, "rejected"), ("evaluated", "new", "reject", None, 3, 3, 3, 90.0, "rejected"),
        ("evaluated", "new", "add", None, 1, 3, 0, None, "sandbox_best"), ("evaluated", "new", "test_more", None, 1, 3, 2, None, "sandbox_best"), ("evaluated", "new", "test_more", None, 1, 3, 0, 65.0, "sandbox_best"), ("evaluated", "new", "test_more", None, 1, 3, 0, 64.0, "sandbox_positive"),
        ("evaluated", "new", None, None, 0, 3, 0, None, "sandbox_negative"), ("evaluated", "new", None, None, 1, 3, 0, None, "neutral"), ("reviewed", None, None, None, None, None, None, None, "neutral"),
    ]
    frame = spark.createDataFrame(rows, "e string, s string, a string, c string, r int, t int, h int, v double, want string")
    kind = learning.decision(frame.e, frame.s, frame.a, frame.c, relevant=frame.r, tested=frame.t, high=frame.h, average=frame.v)
    assert [r.kind for r in frame.select(kind.alias("kind")).collect()] == [r[-1] for r in rows]


def test_which_memories_an_event_touches(spark):
    rows = [(1, START, "reviewed", "duplicate", "A.org", "Oil", "q", " News "), (2, START, "reviewed", "noise", "a.org", "", "q", None), (3, START, "approved", "approved", None, "Oil", "", "")]
    told = learning.memory_events(spark.createDataFrame(rows, "event_id long, at timestamp, event_type string, kind string, domain string, topic string, query string, strategy string")).collect()
    assert [(r.event_id, r.memory_type, r.delta, r.status) for r in told] == [
        (1, "domain", -12, "muted"), (1, "query", -10, "muted"), (1, "strategy", -6, "muted"), (1, "topic_query_domain", -12, "muted"), (2, "domain", -25, "muted"), (2, "query", -20, "muted"), (3, "topic", 18, "active"),
    ]
    assert told[0].memory_key == "domain:a.org" == told[4].memory_key and told[1].memory_key != told[5].memory_key
