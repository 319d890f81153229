"""Links that are counted by shared subsets against all pairs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewire.operators import similarity, subsets
from tidewire.plans import derived


def made_sets(seed, most, n=400):
    r = random.Random(seed)
    often = lambda: min(int(r.expovariate(0.12)), 60)
    sets = {frozenset(often() for _ in range(r.randrange(1, 2 * most))) for _ in range(n)} | {frozenset([0]), frozenset([0, 1]), frozenset(range(most)), frozenset(range(1, most + 1))}
    return [(i, r.randrange(1, 5), sorted(s)) for i, s in enumerate(sorted(map(sorted, sets)), 1) if len(s) <= most]


def plain(rows, threshold):
    out = {}
    for i, _, s in rows:
        near = [(copies, len({*s} & {*o}) / len({*s} | {*o})) for k, copies, o in rows if k != i and len({*s} & {*o}) / len({*s} | {*o}) >= threshold]
        if near:
            out[i] = (len(near), sum(c for c, _ in near), max(v for _, v in near))
    return out


@pytest.mark.parametrize("threshold", [0.25, 0.5, 0.85, 1.0])
@pytest.mark.parametrize("hot,rows,grown", [(20_000, 1 << 16, 1 << 18), (20, 30, 40)])
def test_subsets_tell_all_links(spark, monkeypatch, threshold, hot, rows, grown):
    for name, value in (("HOT", hot), ("ROWS", rows), ("GROWN", grown)):
        monkeypatch.setattr(subsets, name, value)
    sets, rule = made_sets(hot, 9), subsets.Rule(12, threshold)
    held = subsets.held_elements(spark.createDataFrame(sets, "of long, copies long, stems array<long>"), rule).sort("depth", "k1", "k2").toArrow()
    found = defaultdict(lambda: [0, 0, 0.0])
    for batch in subsets._counted(rule)(iter(held.to_batches(max_chunksize=25))):
        for x in batch.to_pylist():
            own = found[x["of"]]
            own[:] = own[0] + x["links"], own[1] + x["linked"], max(own[2], x["best"])
    assert {k: tuple(v) for k, v in found.items() if v[0]} == plain(sets, threshold)


@pytest.mark.parametrize("short", [16, 5])
def test_classes_are_not_compared_in_blocks(spark, monkeypatch, short):
    monkeypatch.setattr(similarity, "SHORT", short)
    monkeypatch.setattr(similarity, "BLOCK", 30)
    monkeypatch.setattr(subsets, "HOT", 50)
    blocks, compared = similarity._blocks, []
    monkeypatch.setattr(similarity, "_blocks", lambda classes, *columns: compared.append(classes.count()) or blocks(classes, *columns))
    sets = made_sets(7, 8)
    found = similarity.class_links(spark.createDataFrame(sets, "of long, copies long, stems array<long>"))
    assert {r.of: (r.links, r.linked, r.best) for r in found.collect()} == plain(sets, 0.25)
    assert bool(compared) == (short == 5) and similarity.class_links(spark.createDataFrame([], "of long, copies long, stems array<long>")).count() == 0


def test_an_element_of_all_sets_is_parted(spark, monkeypatch):
    monkeypatch.setattr(subsets, "HOT", 10)
    frame = spark.range(200).select(F.col("id").alias("of"), F.lit(1).cast("long").alias("copies"), F.array(F.lit(-1), F.lit(-2), F.lit(-3), F.col("id"), F.col("id") % 20 + 1000).alias("stems"))
    held = subsets.held_elements(frame, subsets.Rule(16, 0.25))
    assert held.where("k1 IN (-1, -2, -3)").groupBy("k1", "k2").count().count() >= 3
    assert {(r.links, r.best) for r in similarity.class_links(frame).collect()} == {(199, 4 / 6)}


def test_jaccard_pairs_compares_no_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_blocks", lambda *_, **__: pytest.fail("classes are compared in blocks"))
    rows = derived.jaccard_pairs(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len({r.id for r in rows}) and any(r.links > 1 for r in rows)
