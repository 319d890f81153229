"""Rules on sources and candidates: regularity, health, memory, feedback and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regularity(articles: DataFrame, now: Column, *, by: str = "source_id", published: str = "published_at", archive_hint: Column | None = None) -> DataFrame:
    """Label of each source from the dates of its articles; whole days count, future dates do not."""
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(published).cast("timestamp"))) / 86_400_000_000)
    hint = archive_hint if archive_hint is not None else F.lit(False)
    stats = articles.withColumn("_d", days).groupBy(by).agg(
        F.count(published).alias("dated"), F.min("_d").alias("age"), F.count_if(F.col("_d").between(0, 30)).alias("last_30"),
        F.count_if(F.col("_d").between(0, 90)).alias("last_90"), F.bool_or(hint).alias("archive_hint"),
    )
    label = (
        F.when(F.col("dated") == 0, "unknown").when(F.col("archive_hint") & (F.col("age") > 90), "archive").when(F.col("age") > 180, "stale")
        .when((F.col("last_30") >= 3) | ((F.col("last_30") >= 1) & (F.col("last_90") >= 4)), "regular")
        .when((F.col("last_90") >= 2) | (F.col("last_30") >= 1), "active_but_sparse").otherwise("stale")
    )
    return stats.select(by, "dated", "last_30", "last_90", label.alias("regularity_label"))


def regularity_score(label: Column) -> Column:
    return F.when(label == "regular", 90).when(label == "active_but_sparse", 60).when(label == "unknown", 35).when(label == "stale", 15).when(label == "archive", 5).otherwise(30)


def availability_score(http_status: Column, gate_reason: Column) -> Column:
    """How well a source answered; a gate reason weighs most."""
    return (
        F.when(gate_reason.isNotNull(), 10).when(http_status.between(200, 299), 90).when(http_status.between(300, 399), 70)
        .when(http_status.isin(401, 403, 429), 20).when(http_status >= 500, 25).when(http_status.isNotNull(), 35).otherwise(55)
    )


def health_score(quality: Column, label: Column, availability: Column, tested: Column) -> Column:
    raw = quality * 0.55 + regularity_score(label) * 0.3 + availability * 0.15 - F.when(tested < 5, 15).otherwise(0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)).cast("decimal(38,10)"), 2).cast("double")


def health_action(score: Column, label: Column, tested: Column, relevant: Column, base: Column) -> Column:
    """What to do with a candidate; the first rule that holds decides."""
    return (
        F.when((tested >= 3) & (relevant == 0), "reject").when(label.isin("archive", "stale") & (relevant < 3), "reject").when(score <= 25, "reject")
        .when((score >= 70) & (tested >= 5) & (relevant >= 3), "add")
        .when((score >= 45) | label.isin("unknown", "active_but_sparse"), F.when(F.coalesce(base, F.lit("")) != "reject", "test_more").otherwise("human_review"))
        .when(base.isin("add", "test_more", "reject", "human_review"), base).otherwise("human_review")
    )


def health_verdict(action: Column, label: Column, score: Column, duplicates: Column) -> Column:
    return (
        F.when(label == "archive", "archive").when(label == "stale", "stale").when(duplicates > 0, "duplicate_risk").when(action == "add", "strong_source")
        .when(action == "test_more", "promising_needs_more_data").when(action == "reject", "weak_source").when(score >= 50, "needs_review").otherwise("risky_needs_review")
    )


def candidate_memory(candidates: DataFrame) -> DataFrame:
    """(id, memory_score, memory_status) of candidates."""
    tested = F.greatest(F.coalesce("tested_articles", F.lit(0)), F.lit(1))
    status, action = F.coalesce("status", F.lit("")), F.coalesce("recommended_action", F.lit(""))
    bonus = (
        F.when(status == "approved", 25).when(status == "rejected", -45).when(status == "paused", -12)
        .when((status == "needs_human_review") & (action == "add"), 8).when(action == "reject", -25).when(action == "test_more", -5).otherwise(0)
    )
    raw = F.coalesce("relevant_articles", F.lit(0)) / tested * 55 + F.coalesce("avg_score", F.lit(0.0)) / 100 * 35 - F.coalesce("noise_count", F.lit(0)) / tested * 10 + bonus
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)).cast("decimal(38,10)"), 2).cast("double")
    return candidates.select("id", score.alias("memory_score"), F.when(status == "rejected", "rejected").when(status == "paused", "muted").otherwise("active").alias("memory_status"))


def topic_feedback(candidates: DataFrame) -> DataFrame:
    """Decisions on candidates by topic, and the boost that follows."""
    status, action = F.coalesce("status", F.lit("")), F.coalesce("recommended_action", F.lit(""))
    decision = F.when(status == "approved", "approved").when((status == "rejected") | (action == "reject"), "rejected").when(status == "paused", "paused").when(action == "test_more", "test_more")
    rows = candidates.select(F.lower(F.trim(F.coalesce("topic", F.lit("")))).alias("topic"), decision.alias("d")).where("topic <> ''")
    counts = rows.groupBy("topic").agg(*[F.count_if(F.col("d") == x).alias(x) for x in ("approved", "rejected", "paused", "test_more")])
    return counts.withColumn("boost", F.col("approved") * 4 + F.col("test_more") * 1.5 - F.col("rejected") * 6 - F.col("paused") * 2)


def budget_reason(usage: dict[str, Column], limits: dict[str, int]) -> Column:
    """Which daily budget is used up, or an empty string; loops compare strictly, and 0 is no limit."""
    out = F.lit("")
    for name, reason, strict in (("candidate_evaluations", "daily_evaluation_budget_reached", False), ("candidates_created", "daily_candidate_budget_reached", False), ("loop_runs", "daily_loop_budget_reached", True)):
        if limits.get(name):
            used = usage[name] > limits[name] if strict else usage[name] >= limits[name]
            out = F.when(used, reason).otherwise(out)
    return out


def content_theme(text: Column, search_topic: Column, topics: dict[str, list[str]], least_hits: int = 2) -> Column:
    """The topic whose keywords the text has most of; the search topic stays on ties and below ``least_hits``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = {name: sum((low.contains(k.lower()).cast("int") for k in words), F.lit(0)) for name, words in topics.items()}
    own = F.coalesce(*[F.when(search_topic == name, n) for name, n in hits.items()], F.lit(0))
    best = F.greatest(*hits.values(), F.lit(0))
    winner = F.coalesce(*[F.when(n == best, F.lit(name)) for name, n in hits.items()])
    return F.when((best >= least_hits) & (best > own), winner).otherwise(search_topic)
