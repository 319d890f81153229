"""How the source agent did: its decisions in words, metrics of candidates from their articles, and what hinders its work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import rules
from tidewire.plans.register import Register
from tidewire.sources.newsroom import Newsroom

query = Register()
QUERIES, oracle_sql = query.queries, query.oracle_sql

_PAYLOAD = "topic string, candidates int, search struct<status:string>, policy struct<auto:int,human_review:int,blocked:int>, source_id int, initial_job_id int, recommended_action string, candidate_id int, relevant_articles int"


def decisions(actions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Title, summary and tone of each action (JN-10, JN-11).

    ``actions`` has id, task_id, action_type and output, a JSON text; ``tasks`` id and
    topic. An action of no task, or of a type without words, keeps its type as title.
    """
    named = tasks.select(F.col("id").alias("task_id"), F.col("topic").alias("_topic"))
    told = actions.join(named, "task_id", "left").withColumn("o", F.from_json("output", _PAYLOAD))
    field = lambda name, other="—": F.coalesce(F.col(f"o.{name}").cast("string"), F.lit(other))
    kinds: dict[str, tuple[str, Column, Column]] = {
        "source_discovery_plan_built": ("План построен", F.concat(F.lit("Авто: "), field("policy.auto", "0"), F.lit(", вручную: "), field("policy.human_review", "0"), F.lit(", запрещено: "), field("policy.blocked", "0"), F.lit(".")), F.lit("neutral")),
        "discover_sources_finished": ("Поиск источников завершён", F.concat(F.lit("Тема: "), F.coalesce("o.topic", "_topic", F.lit("—")), F.lit(", кандидатов: "), field("candidates", "0"), F.lit(", поиск: "), field("search.status"), F.lit(".")), F.when(F.col("o.candidates") > 0, "good").otherwise("neutral")),
        "approve_source_candidate": ("Кандидат одобрен", F.concat(F.lit("Создан источник #"), field("source_id"), F.lit(", первый сбор: "), field("initial_job_id", "не ставился"), F.lit(".")), F.lit("good")),
    }
    pick = lambda i, other: F.coalesce(*[F.when(F.col("action_type") == k, F.lit(v[i]) if i == 0 else v[i]) for k, v in kinds.items()], other)
    return told.select("id", "action_type", pick(0, F.coalesce("action_type", F.lit(""))).alias("title"), pick(1, F.lit("Детали записаны в журнал действий")).alias("summary"), pick(2, F.lit("neutral")).alias("tone"))


@query("""
    SELECT event_id AS id, action_type, CASE action_type WHEN 'source_discovery_plan_built' THEN 'План построен' WHEN 'discover_sources_finished' THEN 'Поиск источников завершён' WHEN 'approve_source_candidate' THEN 'Кандидат одобрен' ELSE action_type END AS title,
           CASE action_type WHEN 'source_discovery_plan_built' THEN concat('Авто: ', k, ', вручную: 0, запрещено: 1.') WHEN 'discover_sources_finished' THEN concat('Тема: ', COALESCE('topic' || nullif(user_id % 4, 0), COALESCE(r_name, '—')), ', кандидатов: ', k % 3, ', поиск: ', CASE WHEN k % 2 = 0 THEN 'ok' ELSE '—' END, '.')
             WHEN 'approve_source_candidate' THEN concat('Создан источник #', k, ', первый сбор: ', CASE WHEN k % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'не ставился' END, '.') ELSE 'Детали записаны в журнал действий' END AS summary,
           CASE WHEN action_type = 'approve_source_candidate' OR action_type = 'discover_sources_finished' AND k % 3 > 0 THEN 'good' ELSE 'neutral' END AS tone
    FROM (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE event_type WHEN 'view' THEN 'source_discovery_plan_built' WHEN 'click' THEN 'discover_sources_finished' WHEN 'purchase' THEN 'approve_source_candidate' ELSE event_type END AS action_type FROM events) e LEFT JOIN region ON r_regionkey = user_id % 7""")
def action_decisions(room: Newsroom) -> DataFrame:
    """Actions of the log in words (JN-10, JN-11)."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "view", "source_discovery_plan_built").when(F.col("event_type") == "click", "discover_sources_finished").when(F.col("event_type") == "purchase", "approve_source_candidate").otherwise(F.col("event_type"))
    even = k % 2 == 0
    found = F.struct(F.concat(F.lit("topic"), F.nullif(F.col("user_id") % 4, F.lit(0)).cast("string")).alias("topic"), (k % 3).alias("candidates"), F.when(even, F.struct(F.lit("ok").alias("status"))).alias("search"), F.struct(k.alias("auto"), F.lit(1).alias("blocked")).alias("policy"), k.alias("source_id"), F.when(even, F.col("event_id")).alias("initial_job_id"))
    actions = room.table("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("task_id"), kind.alias("action_type"), F.to_json(found).alias("output"))
    tasks = room.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("topic"))
    return decisions(actions, tasks)


def candidate_metrics(articles: DataFrame, by: str) -> DataFrame:
    """What tested articles tell of each candidate, in one aggregation (AGG-32).

    ``articles`` has text_chars, status, prefilter_keep, relevant and total_score.
    """
    state = F.col("status")
    return articles.groupBy(by).agg(
        F.count("*").alias("tested_articles"), F.count_if(F.col("text_chars") > 0).alias("parsed_articles"), F.count_if(state.isin("ok", "rejected")).alias("processed_articles"),
        F.count_if("prefilter_keep").alias("kept_by_prefilter"), F.count_if("relevant").alias("relevant_articles"), F.count("total_score").alias("scored_articles"),
        F.count_if(F.col("total_score") >= 50).alias("high_score_articles"), rules.decimal_round(F.avg("total_score"), 2).alias("avg_score"), F.count_if(state == "rejected").alias("noise_count"),
    )


@query("""
    SELECT a.source_id, COUNT(*) AS tested_articles, COUNT(*) FILTER (WHERE length(raw_text) > 0) AS parsed_articles, COUNT(*) FILTER (WHERE c.relevant IS NOT NULL) AS processed_articles, COUNT(*) FILTER (WHERE NOT text_truncated) AS kept_by_prefilter, COUNT(*) FILTER (WHERE c.relevant) AS relevant_articles,
           COUNT(s.total_score) AS scored_articles, COUNT(*) FILTER (WHERE s.total_score >= 50) AS high_score_articles, CAST(round(CAST(COALESCE(AVG(s.total_score), -1) AS DECIMAL(38,10)), 2) AS DOUBLE) AS avg_score, COUNT(*) FILTER (WHERE c.relevant = FALSE) AS noise_count
    FROM articles a LEFT JOIN article_cards c ON c.article_id = a.id LEFT JOIN article_scores s ON s.article_id = a.id GROUP BY a.source_id""")
def tested_sources(room: Newsroom) -> DataFrame:
    """Metrics of sources from all their articles; -1 without a score (AGG-32, DOM-25)."""
    rows = room.sql("""
        SELECT a.source_id, length(a.raw_text) AS text_chars, NOT a.text_truncated AS prefilter_keep, c.relevant, CASE WHEN c.relevant THEN 'ok' WHEN NOT c.relevant THEN 'rejected' ELSE 'error' END AS status, s.total_score
        FROM articles a LEFT JOIN article_cards c ON c.article_id = a.id LEFT JOIN article_scores s ON s.article_id = a.id""")
    return candidate_metrics(rows, "source_id").withColumn("avg_score", F.coalesce("avg_score", F.lit(-1.0)))


def readiness(checks: DataFrame) -> DataFrame:
    """ready, degraded or blocked, with the codes that say why (DOM-51).

    ``checks`` has code, severity (blocker, warning or info) and found; what is not found
    hinders nothing.
    """
    held = checks.where("found")
    status = F.when(F.bool_or(F.col("severity") == "blocker"), "blocked").when(F.count("*") > 0, "degraded").otherwise("ready")
    return held.agg(status.alias("status"), F.array_join(F.sort_array(F.collect_set("code")), ",").alias("issues"), F.count_if(F.col("severity") == "blocker").alias("blockers"))


@query("""
    WITH c AS (SELECT 'candidate_triage_empty' AS code, 'info' AS severity, (SELECT COUNT(*) FROM source_candidates WHERE status IN ('new', 'needs_human_review')) = 0 AS found
      UNION ALL SELECT 'query_memory_empty', 'info', (SELECT COUNT(*) FROM source_candidates WHERE relevant_articles > 100) = 0
      UNION ALL SELECT 'jobs_stuck', 'warning', (SELECT COUNT(*) FROM jobs WHERE status = 'running' AND attempts >= max_attempts) > 0
      UNION ALL SELECT 'no_active_source', 'blocker', (SELECT COUNT(*) FROM sources WHERE enabled AND archived_at IS NULL) = 0
      UNION ALL SELECT 'runs_budget_reached', 'info', (SELECT COUNT(*) FROM ai_runs) >= 1000)
    SELECT CASE WHEN bool_or(severity = 'blocker') THEN 'blocked' WHEN COUNT(*) > 0 THEN 'degraded' ELSE 'ready' END AS status, COALESCE(string_agg(code, ',' ORDER BY code), '') AS issues, COUNT(*) FILTER (WHERE severity = 'blocker') AS blockers FROM c WHERE found""")
def agent_readiness(room: Newsroom) -> DataFrame:
    """Whether the agent can work: candidates, memory, jobs, sources and the budget in one report (DOM-51)."""
    counted = {
        ("candidate_triage_empty", "info"): (room.table("source_candidates").where(F.col("status").isin("new", "needs_human_review")), F.col("n") == 0),
        ("query_memory_empty", "info"): (room.table("source_candidates").where("relevant_articles > 100"), F.col("n") == 0),
        ("jobs_stuck", "warning"): (room.table("jobs").where("status = 'running' AND attempts >= max_attempts"), F.col("n") > 0),
        ("no_active_source", "blocker"): (room.table("sources").where("enabled AND archived_at IS NULL"), F.col("n") == 0),
        ("runs_budget_reached", "info"): (room.table("ai_runs"), F.col("n") >= 1000),
    }
    whole = None
    for (code, severity), (rows, found) in counted.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), found.alias("found"))
        whole = one if whole is None else whole.unionByName(one)
    return readiness(whole)


@query("""
    WITH x AS (SELECT COALESCE(recommended_action, 'unknown') AS recommendation, CASE WHEN status IN ('approved', 'rejected', 'paused') THEN CASE recommended_action WHEN 'add' THEN status = 'approved' WHEN 'reject' THEN status = 'rejected' WHEN 'test_more' THEN status IN ('approved', 'paused') WHEN 'human_review' THEN TRUE END END AS agreed FROM source_candidates),
    g AS (SELECT CASE WHEN GROUPING(recommendation) = 1 THEN 'all' ELSE recommendation END AS recommendation, COUNT(*) AS total, COUNT(agreed) AS decided, COUNT(*) FILTER (WHERE agreed) AS agreed FROM x GROUP BY ROLLUP (recommendation))
    SELECT recommendation, total, decided, agreed, decided - agreed AS disagreed, CASE WHEN decided > 0 THEN CAST(round(CAST(agreed / decided AS DECIMAL(38,10)), 3) AS DOUBLE) ELSE 0.0 END AS agreement_rate FROM g""")
def candidate_agreement(room: Newsroom) -> DataFrame:
    """How often people decided as the agent advised, by advice and over all (AGG-31)."""
    status, advice = F.col("status"), F.col("recommended_action")
    agreed = F.when(advice == "add", status == "approved").when(advice == "reject", status == "rejected").when(advice == "test_more", status.isin("approved", "paused")).when(advice == "human_review", F.lit(True))
    judged = room.table("source_candidates").select(F.coalesce(advice, F.lit("unknown")).alias("advice"), F.when(status.isin("approved", "rejected", "paused"), agreed).alias("agreed"))
    groups = judged.rollup("advice").agg(F.grouping("advice").alias("whole"), F.count("*").alias("total"), F.count("agreed").alias("decided"), F.count_if("agreed").alias("yes"))
    rate = F.when(F.col("decided") > 0, rules.decimal_round(F.col("yes") / F.col("decided"), 3)).otherwise(0.0)
    return groups.select(F.when(F.col("whole") == 1, "all").otherwise(F.col("advice")).alias("recommendation"), "total", "decided", F.col("yes").alias("agreed"), (F.col("decided") - F.col("yes")).alias("disagreed"), rate.alias("agreement_rate"))
