"""Snapshot changes and queue steps over the newsroom tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import rules
from tidewire.operators import jobs, merge
from tidewire.plans.register import Register
from tidewire.plans.reports import AS_OF
from tidewire.sources.newsroom import Newsroom

query = Register()
QUERIES, oracle_sql = query.queries, query.oracle_sql


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _queue(room: Newsroom) -> DataFrame:
    rows = room.table("jobs").withColumn("run_after", F.lit(None).cast("timestamp_ntz")).withColumn("lease_token", F.concat(F.lit("t"), (F.col("id") % 7).cast("string")))
    return rows.withColumn("lease_expires_at", F.when(F.col("id") % 2 == 0, _as_of() + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("lease_expires_at")))


_LEASE = f"CASE WHEN id % 2 = 0 THEN TIMESTAMP '{AS_OF}' + INTERVAL 1 HOUR ELSE lease_expires_at END"


@query(f"SELECT id, CASE WHEN status = 'running' AND id % 3 <> 0 AND id % 7 = id % 5 AND {_LEASE} > TIMESTAMP '{AS_OF}' THEN 'finalizing' ELSE status END AS status FROM jobs")
def queue_finalizing(room: Newsroom) -> DataFrame:
    """The queue after results of workers were taken up, for those that hold the lease (STR-4)."""
    queue = _queue(room)
    brought = queue.where("id % 3 <> 0").select("id", F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("lease_token"))
    return jobs.begin_finalize(queue, brought, _as_of()).select("id", "status")


@query("SELECT id, CASE WHEN status = 'running' AND id % 7 = id % 3 THEN CASE WHEN id % 4 = 0 THEN 'running' ELSE 'ok' END WHEN status = 'running' THEN 'finalizing' ELSE status END AS status FROM jobs")
def queue_finalized(room: Newsroom) -> DataFrame:
    """The queue after results were applied, or given back where that failed (STR-4)."""
    queue = _queue(room).withColumn("status", F.when(F.col("status") == "running", "finalizing").otherwise(F.col("status")))
    brought = queue.select("id", F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("lease_token"), (F.col("id") % 4 != 0).alias("applied"))
    return jobs.end_finalize(queue, brought).select("id", "status")


@query(f"""
    SELECT id, CASE WHEN status = 'running' AND id % 5 <> 0 AND attempts < max_attempts THEN 'queued' WHEN status = 'running' THEN 'failed' ELSE status END AS status,
           CASE WHEN status = 'running' AND id % 5 <> 0 AND attempts < max_attempts THEN TIMESTAMP '{AS_OF}' + to_seconds(CAST(60 + id % 5 AS BIGINT)) END AS run_after FROM jobs""")
def queue_failures(room: Newsroom) -> DataFrame:
    """The queue after failures, with retries while attempts are left (STR-6)."""
    queue = _queue(room)
    failures = queue.where("status = 'running'").select("id", F.when(F.col("id") % 5 != 0, 60 + F.col("id") % 5).alias("retry_seconds"))
    return jobs.fail(queue, failures, _as_of()).select("id", "status", "run_after")


@query("SELECT id FROM jobs WHERE status = 'queued' AND id % 4 IN (0, 1, 3) ORDER BY created_at, id LIMIT 12")
def claim_by_capability(room: Newsroom) -> DataFrame:
    """The oldest jobs that a worker with two capabilities may take (STR-2)."""
    needs = F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).when(F.col("id") % 4 == 1, F.array(F.lit("fetch"))).when(F.col("id") % 4 == 2, F.array(F.lit("gpu"))).otherwise(F.array(F.lit("ai"), F.lit("gpu")))
    return jobs.claim_by_capability(_queue(room).withColumn("capabilities", needs), ["fetch", "ai"], _as_of(), limit=12)


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'approved' ELSE status END AS status, CASE WHEN id % 4 = 0 THEN 77.5 ELSE avg_score END AS avg_score FROM source_candidates")
def patched_candidates(room: Newsroom) -> DataFrame:
    """Candidates after a patch of some fields of some rows (MUT-6)."""
    rows = room.table("source_candidates").select("id", "status", "avg_score")
    patches = rows.where("id % 2 = 0").select("id", F.lit("approved").alias("status"), F.when(F.col("id") % 4 == 0, 77.5).alias("avg_score"))
    return merge.patched(rows, patches, ["id"])


@query("SELECT event_id, concat('{\"k\":\"', COALESCE(CASE WHEN event_id % 3 = 0 THEN 'new' END, json_extract_string(props, '$.k')), '\"', CASE WHEN event_id % 3 = 1 THEN ',\"seen\":\"yes\"' ELSE '' END, '}') AS payload FROM events")
def merged_payloads(room: Newsroom) -> DataFrame:
    """JSON objects with pairs put in or replaced (MUT-6, 2.16.8)."""
    more = F.when(F.col("event_id") % 3 == 0, '{"k":"new"}').when(F.col("event_id") % 3 == 1, '{"seen":"yes"}')
    return room.table("events").select("event_id", merge.merged_json(F.col("props"), more).alias("payload"))


@query("SELECT id, CASE WHEN published_at > TIMESTAMP '1997-06-01 00:00:00' + INTERVAL 2 DAYS THEN NULL ELSE published_at END AS published_at FROM articles")
def cleared_future_dates(room: Newsroom) -> DataFrame:
    """Articles without dates of the future (MUT-9, FN-2)."""
    as_of = F.lit("1997-06-01 00:00:00").cast("timestamp")
    return room.table("articles").select("id", F.when(~rules.is_future(F.col("published_at").cast("timestamp"), as_of), F.col("published_at")).alias("published_at"))


@query("SELECT c.article_id, c.status FROM article_cards c WHERE c.status <> 'new' AND NOT EXISTS (SELECT 1 FROM user_article_states u WHERE u.user_id = 3 AND u.article_id = c.article_id)")
def migrated_states(room: Newsroom) -> DataFrame:
    """States of all for one user, where the user has none (MUT-10)."""
    own = room.table("user_article_states").where("user_id = 3").select("article_id")
    return merge.insert_new(own, room.table("article_cards").where("status <> 'new'").select("article_id", "status"), ["article_id"], "status")


@query("SELECT source_id, reason, MIN(id) AS id FROM feedback_entries WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM feedback_entries o WHERE o.id % 2 = 0 AND o.source_id IS NOT DISTINCT FROM feedback_entries.source_id AND o.reason IS NOT DISTINCT FROM feedback_entries.reason) GROUP BY source_id, reason")
def inserted_once(room: Newsroom) -> DataFrame:
    """New entries whose fields, nulls included, no entry has (MUT-17)."""
    rows = room.table("feedback_entries").select("id", "source_id", "reason")
    return merge.insert_once(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["source_id", "reason"], "id")


@query("SELECT id + x.d AS id, x.d = 1000 AS inserted FROM sources, (SELECT 0 AS d UNION ALL SELECT 1000) x WHERE id % 2 = 0")
def upsert_flags(room: Newsroom) -> DataFrame:
    """Whether rows of an upsert were new (2.16.12)."""
    rows = room.table("sources").select("id")
    even = rows.where("id % 2 = 0")
    return merge.upsert_flagged(rows, even.unionByName(even.select((F.col("id") + 1000).alias("id"))), ["id"])


@query("SELECT id, pending_deletion OR (id % 5 = 0 AND id NOT IN (SELECT article_id FROM article_scores)) AS pending_deletion FROM articles")
def soft_deletes(room: Newsroom) -> DataFrame:
    """Articles after a soft delete that spares those with a score (MUT-8)."""
    rows = room.table("articles").select("id", "pending_deletion")
    return merge.soft_deleted(rows, rows.where("id % 5 = 0"), room.table("article_scores").select(F.col("article_id").alias("id")))


@query("SELECT a.id FROM articles a LEFT JOIN (SELECT DISTINCT conv_id + 1 AS article_id FROM conversations WHERE turn % 3 <> 0 AND (conv_id + turn) % 5 + 1 <= 2) f ON f.article_id = a.id WHERE f.article_id IS NULL")
def purged_articles(room: Newsroom) -> DataFrame:
    """Articles after a purge by a list that another table gives (2.1.36)."""
    return merge.delete(room.table("articles").select("id"), room.table("feedback_entries").where("usefulness <= 2").select(F.col("article_id").alias("id")), ["id"])




@query("""
    WITH m AS (SELECT id, id - id % 10 + 1 AS target FROM signals WHERE id % 10 IN (3, 4, 7)), r AS (SELECT DISTINCT signal_id AS id FROM signal_feedback WHERE verdict <> ''),
    f AS (SELECT m.* FROM m JOIN signals s ON s.id = m.id WHERE s.merged_into_signal_id IS NULL AND m.id NOT IN (SELECT id FROM r))
    SELECT s.id, COALESCE(f.target, p.target, s.merged_into_signal_id, -1) AS merged_into FROM signals s LEFT JOIN f ON f.id = s.id LEFT JOIN f p ON p.id = s.merged_into_signal_id""")
def merged_signals(room: Newsroom) -> DataFrame:
    """Cards after merges, with their children moved to the root (SIM-15)."""
    rows = room.table("signals").select("id", F.col("merged_into_signal_id").alias("merged_into"))
    merges = rows.where((F.col("id") % 10).isin(3, 4, 7)).select("id", (F.col("id") - F.col("id") % 10 + 1).alias("into"))
    return merge.merged_cards(rows, merges, room.table("signal_feedback").where("verdict <> ''").select(F.col("signal_id").alias("id"))).fillna(-1, ["merged_into"])


@query("SELECT id, CASE WHEN id % 2 = 0 THEN concat(topic, ' (', regexp_extract(url, '://([^/]+)', 1), ')') ELSE topic END AS name FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'src3' ELSE topic END AS topic, url FROM source_candidates) x")
def approved_names(room: Newsroom) -> DataFrame:
    """Names of approved candidates, told apart by domain where a source has the name (MUT-7)."""
    rows = room.table("source_candidates").select("id", F.when(F.col("id") % 2 == 0, "src3").otherwise(F.col("topic")).alias("name"), F.regexp_extract("url", "://([^/]+)", 1).alias("domain"))
    return merge.named_apart(rows, room.table("sources").select("name"), name="name", domain="domain").select("id", "name")


@query("SELECT CASE WHEN queue_name LIKE 'external\\_%' ESCAPE '\\' OR queue_name LIKE 'external-%' THEN 'outer' ELSE 'inner' END AS kind, COUNT(*) AS n FROM jobs GROUP BY 1")
def split_memory(room: Newsroom) -> DataFrame:
    """Rows parted by the beginning of their key (MUT-14)."""
    outer = F.col("queue_name").startswith("external_") | F.col("queue_name").startswith("external-")
    return room.table("jobs").groupBy(F.when(outer, "outer").otherwise("inner").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT article_id, criterion_id, CASE WHEN article_id % 2 = 0 THEN 50.0 ELSE ai_score END AS ai_score FROM (SELECT s.article_id, i.criterion_id, i.ai_score FROM article_scores s JOIN article_score_items i ON i.article_score_id = s.id) x WHERE article_id % 2 = 1 OR criterion_id = 1")
def replaced_items(room: Newsroom) -> DataFrame:
    """Score items after those of some articles were replaced (MUT-5, MUT-11)."""
    scores = room.table("article_scores").select(F.col("id").alias("article_score_id"), "article_id")
    items = room.table("article_score_items").join(scores, "article_score_id").select("article_id", "criterion_id", "ai_score")
    fresh = items.where("article_id % 2 = 0").select("article_id").distinct().select("article_id", F.lit(1).alias("criterion_id"), F.lit(50.0).alias("ai_score"))
    return merge.replace_items(items, fresh, ["article_id"])


@query("SELECT id, attempts FROM jobs WHERE lease_expires_at >= created_at AND status = 'running'")
def leased_jobs(room: Newsroom) -> DataFrame:
    """Running jobs whose lease reaches past their making (STR-3)."""
    return room.table("jobs").where("status = 'running' AND lease_expires_at >= created_at").select("id", "attempts")
