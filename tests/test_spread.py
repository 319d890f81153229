"""Percentiles and job rows whose work is not one task's."""

import math
import random

from tidewire.operators import selection, similarity
from tidewire.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plain(values, p):
    values, x = sorted(values), p * (len(values) - 1)
    low, high = values[math.floor(x)], values[math.ceil(x)]
    return low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high


def test_quantiles_of_groups(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *[float(i) for i in range(40)]])) for _ in range(900)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    at = {"least": 0.0, "low": 0.1, "p50": 0.5, "p95": 0.95, "most": 1.0}
    got = {x["k"]: x for x in selection.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(7), "k", "v", at).collect()}
    groups = {k: [v for key, v in rows if key == k and v is not None] for k, _ in rows}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert [got[k][n] for n in at] == [plain(values, p) if values else None for p in at.values()], k


def test_percentiles_hold_no_group_in_one_buffer(spark):
    plan = registry.queries()["cost_percentiles"](spark, FOLDER)._jdf.queryExecution().analyzed().toString()
    assert "percentile(" not in plan


def test_jobs_meet_named_rows_only(spark):
    plan = registry.queries()["hydrated_jobs"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_company_rows_tell_every_judged_pair(spark):
    """Members of a company with their numbers of links hold the same pairs as the join that lists them."""
    found = {}
    for r in registry.queries()["company_pairs"](spark, FOLDER).collect():
        found.setdefault(r["company"], {})[r["id"]] = r["links"]
    told = {(a, b) for links in found.values() for a in links for b in links if a < b and len(links) - 1 in (links[a], links[b])}
    cards = [(r["p_partkey"], r["p_brand"].lower()) for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect()]
    open_ = lambda i: i % 3 == 0 or (i % 4 == 1 and i % 5 != 0)
    want = {(a, b) for a, x in cards for b, y in cards if a < b and x == y and (open_(a) or open_(b))}
    assert told == want and want


def test_company_pairs_are_listed(spark, monkeypatch):
    """Every judged pair is a row, also where a company's members are dealt to several parts."""
    monkeypatch.setattr(similarity, "SPREAD", 3)
    rows = registry.queries()["company_pairs"](spark, FOLDER).collect()
    cards = [(r["p_partkey"], r["p_brand"].lower()) for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect()]
    open_ = lambda i: i % 3 == 0 or (i % 4 == 1 and i % 5 != 0)
    want = sorted((x, a, b) for a, x in cards for b, y in cards if a < b and x == y and (open_(a) or open_(b)))
    assert sorted((r.company, r.id, int(r.other)) for r in rows if r.other is not None) == want and want
    assert {(r.company, r.id) for r in rows} == {(x, i) for x, a, b in want for i in (a, b)} and all(r.links == sum(x == r.company and r.id in (a, b) for x, a, b in want) for r in rows)
