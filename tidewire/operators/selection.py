"""Choosing and ordering: interleaved lists, hints by topic, learned ranks, and action plans."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import rules
from tidewire.operators.tables import written


def interleaved(rows: DataFrame, *, group: str, order: list[Column], value: str, key: Column, limit: int) -> DataFrame:
    """(turn, group, value): lists in turn, each value once by its key.

    A list passes over values that were taken before. A value belongs to its first
    list at the earliest place there; places are then counted again, so that lists
    stay in step. Only each list's first ``limit`` distinct values can be taken.
    """
    named = rows.withColumn("_key", key).where(F.col("_key").isNotNull() & (F.col("_key") != ""))
    inside = named.groupBy(group, "_key").agg(F.min_by(value, F.struct(*order)).alias(value), F.min(F.struct(*order)).alias("_order"))
    placed = inside.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy("_order"))).where(F.col("_at") <= limit)
    first = placed.groupBy("_key").agg(F.min(F.struct("_at", group)).alias("_first"))
    kept = placed.join(first, "_key").where((F.col("_first._at") == F.col("_at")) & (F.col(f"_first.{group}") == F.col(group)))
    turned = kept.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy("_at")))
    return turned.orderBy("turn", group).limit(limit).select("turn", group, value)


def top_hints(rows: DataFrame, *, topic: str, hint: str, score: str, most: int = 3) -> DataFrame:
    """(topic, rank, hint): the best distinct hints of each topic; spellings that differ in case are one."""
    named = rows.withColumn("_topic", F.lower(F.trim(topic))).withColumn("_hint", F.trim(hint)).where("_topic <> '' AND _hint <> ''")
    best = named.groupBy("_topic", F.lower("_hint").alias("_low")).agg(F.max(F.struct(F.col(score).alias("s"), F.col("_hint").alias("h"))).alias("b"))
    rank = F.row_number().over(Window.partitionBy("_topic").orderBy(F.desc("b.s"), "_low"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most).select(F.col("_topic").alias("topic"), "rank", F.col("b.h").alias("hint"), F.col("b.s").alias("score"))


def combo_hints(rows: DataFrame, *, topic: str, key: str, score: str, status: str, most: int = 3) -> DataFrame:
    """(topic, bucket, rank, key, score): of each topic the best promoted and the worst muted ones."""
    bucket = F.when((F.col(status) == "active") & (F.col(score) > 0), "promoted").when(F.col(status).isin("muted", "rejected") | (F.col(score) < 0), "muted")
    named = rows.select(F.lower(F.trim(topic)).alias("topic"), bucket.alias("bucket"), F.col(key).alias("key"), F.col(score).alias("score")).where("bucket IS NOT NULL AND topic <> ''")
    toward = F.when(F.col("bucket") == "promoted", -F.col("score")).otherwise(F.col("score"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("topic", "bucket").orderBy(toward, "key")))
    return ranked.where(F.col("rank") <= most).select("topic", "bucket", "rank", "key", "score")


def hint_boosts(rows: DataFrame, *, topic: str, hints: str, boost: str) -> DataFrame:
    """(topic, hint, boost): exploded hints of each topic with their largest boost."""
    each = rows.select(F.lower(F.trim(topic)).alias("topic"), F.explode(hints).alias("hint"), F.col(boost).alias("boost")).where("trim(hint) <> ''")
    return each.groupBy("topic", F.lower(F.trim("hint")).alias("hint")).agg(F.max("boost").alias("boost"))


def learned_rank(results: DataFrame, *, query_scores: DataFrame, domain_scores: DataFrame, combos: DataFrame, years: Column, this_year: int) -> DataFrame:
    """Search results (id, query, domain) with a rank learned from memory; muted queries and blocked combinations go.

    ``query_scores`` (query, score, muted), ``domain_scores`` (domain, score) and
    ``combos`` (query, domain, promoted, blocked) hold one row a key.
    """
    newest = F.array_max(years)
    fresh = F.when(newest.isNull(), 0.0).when(newest >= this_year, 12.0).when(newest == this_year - 1, 5.0).otherwise(-12.0)
    q = query_scores.select("query", F.col("score").alias("_q"), F.col("muted").alias("_muted"))
    d = domain_scores.select("domain", F.col("score").alias("_d"))
    joined = results.withColumn("_fresh", fresh).join(q, "query", "left").join(d, "domain", "left").join(combos, ["query", "domain"], "left")
    kept = joined.where(~F.coalesce("_muted", F.lit(False)) & ~F.coalesce("blocked", F.lit(False)))
    score = F.when(F.coalesce("promoted", F.lit(False)), 120.0).otherwise(0.0) + F.coalesce("_q", F.lit(0.0)) * 0.6 + F.coalesce("_d", F.lit(0.0)) * 0.4 + F.col("_fresh")
    return kept.select("id", rules.decimal_round(score, 4).alias("rank_score"))


def new_results(results: DataFrame, known: DataFrame, *, limit: int) -> DataFrame:
    """(id, url, domain): the first result of each address, in order of id, that is neither a known address nor of a known domain."""
    first = results.where("trim(url) <> ''").groupBy("url").agg(F.min("id").alias("id"), F.min_by("domain", "id").alias("domain"))
    fresh = first.join(known.select("url").distinct(), "url", "left_anti").join(known.select("domain").where("domain <> ''").distinct(), "domain", "left_anti")
    return fresh.orderBy("id").limit(limit).select("id", "url", "domain")


def best_strategies(memory: DataFrame, topics: DataFrame, strategies: list[str], iteration: Column) -> DataFrame:
    """(topic, strategy): the active strategy of the highest score and last name, or else those not muted in turn."""
    known = memory.where(F.col("strategy").isin(strategies))
    active = known.where("status = 'active'").groupBy("topic").agg(F.max(F.struct("score", "strategy"))["strategy"].alias("_best"))
    muted = known.where("status = 'muted'").groupBy("topic").agg(F.collect_set("strategy").alias("_muted"))
    every = F.array(*map(F.lit, strategies))
    joined = topics.join(active, "topic", "left").join(muted, "topic", "left")
    left = F.filter(every, lambda s: ~F.array_contains(F.coalesce("_muted", F.array().cast("array<string>")), s))
    turn = F.when(F.size(left) > 0, left).otherwise(every)
    rotated = F.get(turn, ((F.greatest(iteration, F.lit(1)) - 1) % F.size(turn)).cast("int"))
    return joined.select("topic", F.coalesce("_best", rotated).alias("strategy"))


def action_plan(lists: list[DataFrame], *, most: int) -> DataFrame:
    """Actions (action_type, target, priority) of several generators, the most urgent first, each list in its own order where urgency ties, with the policy."""
    numbered = [rows.select("action_type", "target", F.col("priority").cast("double"), F.lit(i).alias("_list")) for i, rows in enumerate(lists)]
    whole = numbered[0]
    for rows in numbered[1:]:
        whole = whole.unionByName(rows)
    cut = whole.orderBy(F.desc("priority"), "_list", "target").limit(most)
    return cut.select("action_type", "target", "priority", rules.action_policy(F.col("action_type")).alias("policy_decision"))


def merged_lists(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have a field the second's wins."""
    names = [c for c in first.columns if c != key]
    a, b = first.select(key, *[F.col(c).alias(f"_a_{c}") for c in names]), second.select(key, *[F.col(c).alias(f"_b_{c}") for c in names])
    return a.join(b, key, "full").select(key, *[F.coalesce(f"_b_{c}", f"_a_{c}").alias(c) for c in names])


def numbered(rows: DataFrame, key: str, *, first: int = 1) -> DataFrame:
    """Rows with consecutive numbers in order of a key: places within sorted ranges, moved by the sizes of the ranges before."""
    ranged = rows.select(key).repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ranges")  # both uses see the same ranges
    inside = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return inside.join(F.broadcast(before), "_part").select(key, (F.col("_before") + F.col("_at") + (first - 1)).alias("number"))


def quantiles(rows: DataFrame, key: str, value: str, at: dict[str, float]) -> DataFrame:
    """(key, names of ``at``): exact interpolated quantiles by key; null where a key has no value.

    Values are counted, dealt by range and written; sums of the ranges tell which of them hold a rank that is asked for, and
    only these are gone through in order. No task holds a key's values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    dealt = written(counts.repartitionByRange(key, value).withColumn("_part", F.spark_partition_id()), "ranges")
    by_key = Window.partitionBy(key)
    parts = dealt.groupBy(key, "_part").agg(F.sum("_n").alias("_held"))
    parts = parts.select(key, "_part", (F.sum("_held").over(by_key.orderBy("_part")) - F.col("_held")).alias("_before"), "_held", F.sum("_held").over(by_key).alias("_all"))
    place = {name: F.lit(p) * (F.col("_all") - 1) for name, p in at.items()}
    ends = {name: (F.floor(x), F.ceil(x)) for name, x in place.items()}
    here = lambda rank, start, n: (rank >= start) & (rank < start + n)
    asked = parts.where(reduce(or_, [here(rank, F.col("_before"), F.col("_held")) for both in ends.values() for rank in both]))
    asked = asked.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), "_before", "_all")
    inner = dealt.join(asked, (dealt["_part"] == asked["_at"]) & dealt[key].eqNullSafe(asked["_key"]))
    start = F.col("_before") + F.sum("_n").over(Window.partitionBy(key, "_part").orderBy(value)) - F.col("_n")
    placed = inner.withColumn("_start", start)
    found = placed.groupBy(key).agg(F.max("_all").alias("_all"), *[F.max(F.when(here(rank, F.col("_start"), F.col("_n")), F.col(value))).alias(f"{name}_{i}") for name, both in ends.items() for i, rank in enumerate(both)])

    def between(name: str) -> Column:
        low, high, x = F.col(f"{name}_0"), F.col(f"{name}_1"), place[name]
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high).alias(name)

    out = found.select(F.col(key).alias("_key"), *[between(name) for name in at])
    keys = rows.select(key).distinct()
    return keys.join(out, keys[key].eqNullSafe(out["_key"]), "left").select(key, *at)
