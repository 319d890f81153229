"""Memory that is learned from the events of the newsroom: folds, cooldowns, and memory of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import learning
from tidewire.plans.register import Register
from tidewire.sources.newsroom import Newsroom

query = Register()
QUERIES, oracle_sql = query.queries, query.oracle_sql

#: feedback on candidates, told by the events: who acts picks the candidate, what they do is the decision
_FEEDBACK = """
    SELECT e.event_id, e.ts AS moment, e.event_type AS happened, c.id AS candidate_id, regexp_replace(regexp_replace(c.url, '^https?://', ''), '/.*$', '') AS domain, c.topic,
           concat(c.topic, ' ', CAST(e.user_id % 4 AS STRING)) AS query, CASE e.user_id % 3 WHEN 0 THEN 'News' WHEN 1 THEN 'vendors' ELSE '' END AS strategy,
           CASE e.event_type WHEN 'purchase' THEN 'approved' WHEN 'click' THEN 'evaluated' ELSE 'reviewed' END AS event_type,
           CASE WHEN e.event_type = 'signup' THEN 'rejected' ELSE 'new' END AS status, c.recommended_action AS action,
           CASE WHEN e.event_type = 'signup' AND e.user_id % 2 = 0 THEN 'это Шум' WHEN e.event_type = 'signup' AND e.user_id % 5 = 0 THEN 'a Duplicate' END AS remark,
           c.relevant_articles, c.tested_articles, c.avg_score
    FROM events e JOIN source_candidates c ON c.id = e.user_id % 97 + 1
    WHERE e.event_type IN ('purchase', 'click', 'signup', 'error')
"""


def _events(room: Newsroom) -> DataFrame:
    rows = room.sql(_FEEDBACK).withColumnRenamed("moment", "at")
    kind = learning.decision(F.col("event_type"), F.col("status"), F.col("action"), F.col("remark"), relevant=F.col("relevant_articles"), tested=F.col("tested_articles"), high=F.lit(0), average=F.col("avg_score"))
    told = learning.memory_events(rows.where("happened <> 'error'").withColumn("kind", kind))
    return told.unionByName(learning.domain_failures(rows.where("happened = 'error'")))


_KIND = """CASE WHEN event_type = 'approved' THEN 1 WHEN event_type = 'reviewed' AND remark LIKE '%uplicate%' THEN 2 WHEN event_type = 'reviewed' AND remark LIKE '%Шум%' THEN 3
    WHEN status = 'rejected' OR action = 'reject' THEN 4 WHEN event_type = 'evaluated' AND relevant_articles > 0 AND action = 'add' THEN 5
    WHEN event_type = 'evaluated' AND relevant_articles > 0 AND action = 'test_more' THEN CASE WHEN avg_score >= 65 THEN 5 ELSE 6 END
    WHEN event_type = 'evaluated' AND tested_articles > 0 AND relevant_articles = 0 THEN 7 ELSE 8 END"""

_TOLD = f"""
    WITH told AS (SELECT *, {_KIND} AS k, lower(trim(topic)) AS t, lower(trim(query)) AS q FROM ({_FEEDBACK}) f),
    each AS (
        SELECT 'domain:' || domain AS memory_key, moment, event_id, happened = 'error' AS failed, ([30, -12, -25, -18, 22, 12, -12, 0])[k] AS delta, CASE WHEN k IN (2, 3, 4, 7) THEN 'muted' ELSE 'active' END AS status FROM told
        UNION ALL SELECT 'topic:' || sha1('topic::' || t)[1:16], moment, event_id, FALSE, ([18, 0, -8, -5, 8, 8, -4, 0])[k], CASE WHEN k IN (3, 4, 7) THEN 'muted' ELSE 'active' END FROM told WHERE happened <> 'error' AND t <> '' AND k NOT IN (2, 8)
        UNION ALL SELECT 'query:' || sha1('query:' || t || ':' || q)[1:16], moment, event_id, FALSE, ([24, -10, -20, -14, 22, 12, -10, 0])[k], CASE WHEN k IN (2, 3, 4, 7) THEN 'muted' ELSE 'active' END FROM told WHERE happened <> 'error'
        UNION ALL SELECT 'strategy:' || sha1('strategy:' || t || ':' || lower(strategy))[1:16], moment, event_id, FALSE, ([18, -6, -10, -8, 8, 8, -5, 0])[k], CASE WHEN k IN (2, 3, 4, 7) THEN 'muted' ELSE 'active' END FROM told WHERE happened <> 'error' AND strategy <> ''
        UNION ALL SELECT 'topic_query_domain:' || sha1('topic_query_domain:' || t || '|' || q || '|' || domain || ':' || t || ' | ' || q || ' | ' || domain)[1:16], moment, event_id, FALSE, ([30, -12, -25, -18, 22, 12, -12, 0])[k], CASE WHEN k IN (2, 3, 4, 7) THEN 'muted' ELSE 'active' END
            FROM told WHERE happened <> 'error' AND t <> ''),
    counted AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY memory_key ORDER BY moment, event_id) AS c, row_number() OVER (PARTITION BY memory_key ORDER BY moment DESC, event_id DESC) AS back FROM each),
    listed AS (
        SELECT memory_key, list({{'f': failed, 'd': delta, 'c': c}} ORDER BY moment, event_id) AS steps, max(c) AS failures, count(*) AS n_events, arg_min(CASE WHEN failed THEN CASE WHEN c >= 3 THEN 'rejected' ELSE 'temporary_unavailable' END ELSE status END, back) AS status,
            string_agg(CASE WHEN failed THEN 'x' ELSE CAST(delta AS STRING) END, ',' ORDER BY moment, event_id) FILTER (back <= 10) AS last_deltas, max(moment) FILTER (failed) + INTERVAL 24 HOUR AS retry_after
        FROM counted GROUP BY memory_key)
"""


@query(_TOLD + """
    SELECT memory_key, failures, n_events, status, last_deltas, strftime(retry_after, '%Y-%m-%d %H:%M') AS retry_after,
        list_reduce(list_transform(steps, lambda s: s), lambda a, s: {'f': FALSE, 'd': CASE WHEN s.f THEN -s.c ELSE greatest(-100, least(100, a.d + s.d)) END, 'c': s.c}, {'f': FALSE, 'd': 0, 'c': 0::BIGINT}).d AS score
    FROM listed""")
def feedback_memory(room: Newsroom) -> DataFrame:
    """Scores, last events, failures and cooldown of every memory after all feedback (DOM-21, DOM-22)."""
    memory = learning.memory_fold(_events(room))
    deltas = F.array_join(F.transform("events", lambda e: F.when(e["failed"], "x").otherwise(e["delta"].cast("int").cast("string"))), ",")
    return memory.select("memory_key", "failures", "n_events", "status", deltas.alias("last_deltas"), F.date_format("retry_after", "yyyy-MM-dd HH:mm").alias("retry_after"), F.col("score").cast("int").alias("score"))


@query(_TOLD + """
    SELECT memory_key, CASE WHEN status = 'rejected' THEN 'rejected' ELSE 'cooling' END AS state FROM listed
    WHERE memory_key LIKE 'domain:%' AND (status = 'rejected' OR (status = 'temporary_unavailable' AND retry_after > (SELECT max(ts) FROM events)))""")
def cooling_domains(room: Newsroom) -> DataFrame:
    """Domains in cooldown at the last event, or given up after three failures (DOM-22)."""
    now = room.table("events").agg(F.max("ts")).first()[0]
    return learning.cooling_domains(learning.memory_fold(_events(room).where("memory_key LIKE 'domain:%'")), F.lit(now))


@query("""
    WITH r AS (SELECT *, trim(concat(topic, ' ', CAST(id % 7 AS STRING))) AS query FROM source_candidates WHERE id % 3 <> 0),
    asked AS (SELECT DISTINCT topic, trim(concat(topic, ' ', CAST(id % 9 AS STRING))) AS query FROM source_candidates WHERE id % 4 <> 0),
    f AS (SELECT topic, query, count(*) AS found, sum(relevant_articles) AS relevant, sum(tested_articles) AS tested, CAST(CAST(round(CAST(avg(avg_score) AS DECIMAL(20, 10)), 2) AS DECIMAL(20, 2)) AS DOUBLE) AS avg_score FROM r GROUP BY topic, query)
    SELECT topic, query, COALESCE(found, 0) AS found, COALESCE(relevant, 0)::BIGINT AS relevant, COALESCE(tested, 0)::BIGINT AS tested, avg_score,
        CASE WHEN found IS NULL THEN 0 ELSE round(CAST(least(100.0::DOUBLE, found * 10 + relevant::DOUBLE / greatest(tested, 1) * 60 + COALESCE(avg_score, 0) * 0.2) AS DECIMAL(20, 10)), 2) END::DOUBLE AS score,
        CASE WHEN found IS NULL THEN 'muted' ELSE 'active' END AS status
    FROM asked FULL JOIN f USING (topic, query)""")
def query_memory(room: Newsroom) -> DataFrame:
    """Memory of search queries from what their candidates brought (DOM-22)."""
    candidates = room.table("source_candidates")
    named = lambda n: F.concat("topic", F.lit(" "), (F.col("id") % n).cast("string"))
    asked = candidates.withColumns({"query": named(9), "trusted": F.col("id") % 4 != 0})
    return learning.query_memory(asked, candidates.where("id % 3 <> 0").withColumn("query", named(7)))
