"""Learning from feedback: memory scores as ordered folds, failures with cooldown, and memory of queries.

A memory's score is a fold over its events in order: feedback adds a delta and clamps
to +-100; a failure sets the score to minus the number of failures so far. Both are of
the form x -> min(high, max(low, x + delta)), and such functions compose to one of the
same form, so a fold over any stretch of events is three numbers (and its number of
failures). Events are sorted over all tasks, folded in blocks of bounded size, and the
blocks in blocks again, so a key with a third of all events is no single task's work.
Scores are kept in hundredths, exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import rules
from tidewire.operators.tables import written

#: events, or blocks of events, that are folded at once
BLOCK = 2048
#: events that a memory keeps
KEPT_EVENTS = 10
LIMIT = 10_000
COOLDOWN_HOURS, REJECT_AFTER = 24, 3

_NO_LIMIT = 1 << 50
_STATE = "struct<failures:bigint,low:bigint,high:bigint,delta:bigint>"


def _fn(failures, low, high, delta) -> Column:
    return F.struct(*(F.lit(v).cast("long").alias(n) if not isinstance(v, Column) else v.cast("long").alias(n) for n, v in (("failures", failures), ("low", low), ("high", high), ("delta", delta))))


def _then(a: Column, b: Column) -> Column:
    """The function of two stretches of events, the second after the first; after a failure only what follows counts."""
    clamp = lambda x: F.least(b["high"], F.greatest(b["low"], x + b["delta"]))
    both = _fn(a["failures"], clamp(a["low"]), clamp(a["high"]), a["delta"] + b["delta"])
    return F.when(b["failures"] > 0, _fn(a["failures"] + b["failures"], b["low"], b["high"], b["delta"])).otherwise(both)


def _value(f: Column, start: Column, failures: Column) -> Column:
    """The score (in hundredths) after the events, from the score and the failures before them."""
    x = F.when(f["failures"] > 0, -(f["failures"] + failures) * 100).otherwise(start)
    return F.least(f["high"], F.greatest(f["low"], x + f["delta"]))


def memory_fold(events: DataFrame, *, key: str = "memory_key", at: str = "at", tie: str = "event_id", start: DataFrame | None = None) -> DataFrame:
    """The memory of every key after its events.

    ``events``: key, at, tie, ``failed`` (a failure of the domain), ``delta``, ``status``, ``event_type``. Rows come out as
    (key, score, previous_score, failures, status, event_type, retry_after, n_events, events): status and type are those of the
    last event, a failure's status follows from the number of failures, ``events`` are the last ten. ``start`` (key, score,
    failures) is what was stored before; keys without events stay out. Events without a key or time take no part.
    """
    cents = F.round(F.col("delta") * 100).cast("long")
    failed = F.coalesce("failed", F.lit(False))
    one = F.when(failed, _fn(1, -_NO_LIMIT, _NO_LIMIT, 0)).otherwise(_fn(0, -LIMIT, LIMIT, F.coalesce(cents, F.lit(0))))
    same = _fn(0, -_NO_LIMIT, _NO_LIMIT, 0)
    entry = F.struct(F.col(at).alias("at"), F.col(tie).alias("event_id"), F.col("delta").cast("double").alias("delta"), F.col("status").alias("status"), F.col("event_type").alias("event_type"), failed.alias("failed"))
    order = [F.col(key), F.col(at), F.col(tie), F.col("event_type"), F.col("delta"), F.col("status")]
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    state = F.struct(one.alias("all"), same.alias("but_last"), F.lit(1).cast("long").alias("n"), F.array(entry).alias("events"), F.when(failed, F.col(at)).alias("failed_at"))
    rows = written(rows.select(key, F.monotonically_increasing_id().alias("place"), state.alias("state")), "memory-events")

    def join(a: Column, b: Column) -> Column:
        events_ = F.concat(a["events"], b["events"])
        last = F.slice(events_, F.greatest(F.size(events_) - (KEPT_EVENTS - 1), F.lit(1)), F.lit(KEPT_EVENTS))
        return F.struct(_then(a["all"], b["all"]).alias("all"), _then(a["all"], b["but_last"]).alias("but_last"), (a["n"] + b["n"]).alias("n"), last.alias("events"), F.coalesce(b["failed_at"], a["failed_at"]).alias("failed_at"))

    while True:
        blocks = rows.groupBy(key, F.expr(f"place div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "state"))).alias("s"))
        folded = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.get("s", F.lit(0))["state"], lambda acc, x: join(acc, x["state"]))
        rows = written(blocks.select(key, F.col("block").alias("place"), folded.alias("state")), "memory-blocks")
        if rows.groupBy(key).count().where("count > 1").isEmpty():
            break
    known = start.select(key, F.round(F.col("score") * 100).cast("long").alias("_score"), F.coalesce("failures", F.lit(0)).alias("_failures")) if start is not None else None
    joined = rows.join(known, key, "left") if known is not None else rows.withColumns({"_score": F.lit(0).cast("long"), "_failures": F.lit(0).cast("long")})
    before, fails = F.coalesce("_score", F.lit(0)), F.coalesce("_failures", F.lit(0))
    last = F.element_at(F.col("state.events"), -1)
    total = F.col("state.all.failures") + fails
    return joined.select(
        key, (_value(F.col("state.all"), before, fails) / 100.0).alias("score"), (_value(F.col("state.but_last"), before, fails) / 100.0).alias("previous_score"), total.alias("failures"),
        F.when(last["failed"], F.when(total >= REJECT_AFTER, "rejected").otherwise("temporary_unavailable")).otherwise(last["status"]).alias("status"), last["event_type"].alias("event_type"),
        (F.col("state.failed_at") + F.expr(f"INTERVAL {COOLDOWN_HOURS} HOURS")).alias("retry_after"), F.col("state.n").alias("n_events"), F.col("state.events").alias("events"),
    )


# What each decision adds to the memory of domain, topic, query, strategy and their combination.
DELTAS = {
    "approved": (30, 18, 24, 18, 30), "duplicate": (-12, 0, -10, -6, -12), "noise": (-25, -8, -20, -10, -25), "rejected": (-18, -5, -14, -8, -18),
    "sandbox_best": (22, 8, 22, 8, 22), "sandbox_positive": (12, 8, 12, 8, 12), "sandbox_negative": (-12, -4, -10, -5, -12), "neutral": (0, 0, 0, 0, 0),
}
MUTING = ("duplicate", "noise", "rejected", "sandbox_negative")
MEMORY_TYPES = ("domain", "topic", "query", "strategy", "topic_query_domain")


def decision(event_type: Column, status: Column, action: Column, comment: Column, *, relevant: Column, tested: Column, high: Column, average: Column) -> Column:
    """What an event says about a candidate source: the first rule that holds."""
    said = F.lower(F.concat_ws(" ", F.coalesce(status, F.lit("")), F.coalesce(action, F.lit("")), F.coalesce(comment, F.lit(""))))
    relevant, tested, high, average = (F.coalesce(c, F.lit(0)) for c in (relevant, tested, high, average))
    useful = (event_type == "evaluated") & ((relevant > 0) | (high > 0)) & F.coalesce(action.isin("add", "test_more"), F.lit(False))
    return (
        F.when((event_type == "approved") | (status == "approved"), "approved")
        .when(said.contains("duplicate") | said.contains("дублик"), "duplicate")
        .when(said.contains("noise") | said.contains("шум"), "noise")
        .when((status == "rejected") | (action == "reject"), "rejected")
        .when(useful & ((action == "add") | (high >= 2) | (average >= 65)), "sandbox_best")
        .when(useful, "sandbox_positive")
        .when((event_type == "evaluated") & (tested > 0) & (relevant == 0), "sandbox_negative")
        .otherwise("neutral")
    )


def memory_key(kind: Column, subject: Column, extra: Column) -> Column:
    """The key of a memory; of a domain its name, else a short digest."""
    low = lambda c: F.lower(F.trim(c))
    digest = F.substring(F.sha1(F.concat(kind, F.lit(":"), low(extra), F.lit(":"), low(subject))), 1, 16)
    return F.when(kind == "domain", F.concat(F.lit("domain:"), low(subject))).otherwise(F.concat(kind, F.lit(":"), digest))


def memory_events(rows: DataFrame) -> DataFrame:
    """What each feedback row (event_id, at, event_type, kind, domain, topic, query, strategy) adds to which memories.

    A topic without a delta, and a memory whose subject is empty, gets none.
    """
    topic, query, domain = (F.trim(F.coalesce(c, F.lit(""))) for c in ("topic", "query", "domain"))
    strategy = F.lower(F.trim(F.coalesce("strategy", F.lit(""))))
    combo = F.when((topic != "") & (query != "") & (domain != ""), F.concat(topic, F.lit(" | "), query, F.lit(" | "), domain)).otherwise("")
    extras = (F.lit(""), F.lit(""), topic, topic, F.concat(topic, F.lit("|"), query, F.lit("|"), domain))

    def delta(i: int) -> Column:
        out = F.lit(0)
        for kind, values in DELTAS.items():
            out = F.when(F.col("kind") == kind, values[i]).otherwise(out)
        return out.cast("double")

    def muted(i: int) -> Column:
        return F.col("kind").isin(*MUTING) if i == 0 else delta(i) < 0

    told = F.array(*[
        F.struct(F.lit(kind).alias("memory_type"), subject.alias("subject"), extra.alias("extra"), delta(i).alias("delta"), F.when(muted(i), "muted").otherwise("active").alias("status"))
        for i, (kind, subject, extra) in enumerate(zip(MEMORY_TYPES, (domain, topic, query, strategy, combo), extras, strict=True))
    ])
    kept = F.filter(told, lambda m: (m["subject"] != "") & ((m["memory_type"] != "topic") | (m["delta"] != 0)))
    flat = rows.select("event_id", "at", "event_type", F.explode(kept).alias("m"))
    key = memory_key(F.col("m.memory_type"), F.col("m.subject"), F.col("m.extra"))
    return flat.select(key.alias("memory_key"), "at", "event_id", F.lit(False).alias("failed"), "m.delta", "m.status", "event_type", "m.memory_type", "m.subject")


def domain_failures(rows: DataFrame) -> DataFrame:
    """Failures (event_id, at, domain) as events of the memory of domains."""
    named = rows.where("trim(domain) <> ''")
    subject = F.lower(F.trim("domain"))
    return named.select(memory_key(F.lit("domain"), subject, F.lit("")).alias("memory_key"), "at", "event_id", F.lit(True).alias("failed"), F.lit(0.0).alias("delta"), F.lit(None).cast("string").alias("status"), F.lit("unavailable").alias("event_type"), F.lit("domain").alias("memory_type"), subject.alias("subject"))


def cooling_domains(memory: DataFrame, now: Column) -> DataFrame:
    """Domains that are not asked again yet, or not at all: (memory_key, state)."""
    state = F.when(F.col("status") == "rejected", "rejected").when((F.col("status") == "temporary_unavailable") & (F.col("retry_after") > now), "cooling")
    return memory.where(F.col("memory_key").startswith("domain:")).select("memory_key", state.alias("state")).where("state IS NOT NULL")


def query_memory(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Memory of search queries: (topic, query, found, relevant, tested, avg_score, score, status).

    ``queries`` (topic, query, trusted) are those that were asked; one that found nothing is muted, if its search could be
    trusted. ``results`` (topic, query, relevant_articles, tested_articles, avg_score) are the candidates that they found.
    """
    found = results.where("trim(query) <> ''").groupBy("topic", F.trim("query").alias("query")).agg(
        F.count("*").alias("found"), F.sum(F.coalesce("relevant_articles", F.lit(0))).alias("relevant"), F.sum(F.coalesce("tested_articles", F.lit(0))).alias("tested"), F.avg("avg_score").alias("average"),
    )
    asked = queries.where("trusted AND trim(query) <> ''").select("topic", F.trim("query").alias("query")).distinct()
    joined = asked.join(found, ["topic", "query"], "full")
    n, relevant, tested = (F.coalesce(c, F.lit(0)) for c in ("found", "relevant", "tested"))
    average = rules.decimal_round(F.col("average"), 2)
    score = F.least(F.lit(100.0), n * 10 + relevant / F.greatest(tested, F.lit(1)) * 60 + F.coalesce(average, F.lit(0.0)) * 0.2)
    return joined.select("topic", "query", n.alias("found"), relevant.alias("relevant"), tested.alias("tested"), average.alias("avg_score"), rules.decimal_round(F.when(n == 0, 0.0).otherwise(score), 2).alias("score"), F.when(n == 0, "muted").otherwise("active").alias("status"))
