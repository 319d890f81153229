"""Newsroom tables as views over the star-schema and event tables.

Each view is one SQL text that Spark and DuckDB read alike; a view may use those
before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {
    "sources": """
        SELECT CAST(substr(source, 4) AS BIGINT) + 1 AS id, source AS name, CASE WHEN CAST(substr(source, 4) AS BIGINT) % 4 = 3 THEN 'Telegram' ELSE 'News' END AS source_type, CAST(substr(source, 4) AS BIGINT) % 6 <> 5 AS enabled, CASE CAST(substr(source, 4) AS BIGINT) % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'request' WHEN 2 THEN 'playwright' ELSE 'telegram' END AS parse_strategy, CASE WHEN CAST(substr(source, 4) AS BIGINT) = 13 THEN TIMESTAMP '2001-01-01 00:00:00' END AS archived_at
        FROM (SELECT DISTINCT source
        FROM documents UNION SELECT 'src99' AS source) s
    """,
    "articles": """
        SELECT d.doc_id + 1 AS id, CAST(substr(d.source, 4) AS BIGINT) + 1 AS source_id, replace(substr(d.text, 1, 80), chr(10), ' ') AS title, concat(CASE WHEN d.doc_id % 2 = 0 THEN 'https://www.' ELSE 'http://' END, d.lang, '.example.com/', CAST(d.doc_id - d.doc_id % 2 AS STRING), CASE d.doc_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '?from=feed' ELSE '' END) AS url, CASE WHEN d.doc_id % 7 <> 0 THEN o.o_orderdate END AS published_at, o.o_orderdate AS collected_at, d.text AS raw_text, d.doc_id % 9 = 0 AS text_truncated, d.lang AS language, d.doc_id % 53 = 0 AS pending_deletion
        FROM documents d
        JOIN orders o ON o.o_orderkey = d.doc_id + (SELECT min(o_orderkey)
        FROM orders)
    """,
    "article_cards": """
        SELECT d.doc_id + 1 AS article_id, CASE WHEN l.quality = 1 AND d.doc_id % 5 <> 0 THEN substr(d.text, 1, 200) END AS summary, CASE WHEN d.doc_id % 4 = 0 THEN concat('RU ', substr(d.text, 1, 40)) END AS title_ru, CASE WHEN l.quality = 1 THEN TRUE WHEN l.quality = 0 THEN FALSE END AS relevant, CASE WHEN l.quality = 0 THEN 'rejected' WHEN d.doc_id % 17 = 0 THEN 'digest' ELSE 'new' END AS status
        FROM documents d
        LEFT JOIN labels l ON l.doc_id = d.doc_id
        WHERE d.doc_id % 11 <> 0
    """,
    "article_scores": """
        SELECT c.article_id + 1000000 AS id, c.article_id, CAST((c.article_id * 37) % 101 AS DOUBLE) AS total_score
        FROM article_cards c
        WHERE c.relevant AND c.article_id % 6 <> 0
    """,
    "tags": """
        SELECT CAST(r_regionkey AS BIGINT) + 1 AS id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name, TRUE AS enabled, CAST(r_regionkey AS INT) AS sort_order
        FROM region
        UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 101, CAST(n_regionkey AS BIGINT) + 1, n_name, n_nationkey % 8 <> 7, CAST(n_nationkey AS INT)
        FROM nation
    """,
    "article_tags": """
        SELECT c.article_id, 101 + c.article_id % 25 AS tag_id
        FROM article_cards c
        WHERE c.relevant AND c.article_id % 4 <> 0
    """,
    "user_article_states": """
        SELECT user_id, article_id, status, ts AS updated_at
        FROM (SELECT e.user_id, e.event_id % n.c + 1 AS article_id, CASE e.event_type WHEN 'purchase' THEN 'digest' WHEN 'error' THEN 'noise' WHEN 'click' THEN 'archive' WHEN 'signup' THEN 'duplicate' ELSE 'new' END AS status, e.ts, row_number() OVER (PARTITION BY e.user_id, e.event_id % n.c ORDER BY e.ts DESC, e.event_id DESC) AS rn
        FROM events e
        CROSS JOIN (SELECT count(*) AS c
        FROM documents) n) t
        WHERE rn = 1
    """,
    "ai_runs": """
        SELECT l.l_orderkey * 10 + l.l_linenumber AS id, l.l_orderkey % n.c + 1 AS article_id, CASE l.l_linenumber WHEN 1 THEN 'summary' WHEN 2 THEN 'tagging' WHEN 3 THEN 'scoring' ELSE 'relevance' END AS stage, concat('model-', l.l_linestatus) AS model, CASE WHEN l.l_linenumber % 2 = 0 THEN 'en' END AS language, CAST(l.l_quantity AS BIGINT) * 10 AS input_tokens, CAST(l.l_quantity AS BIGINT) AS output_tokens, CAST(l.l_extendedprice / 1000000 AS DOUBLE) AS cost_usd, CASE WHEN l.l_returnflag = 'R' THEN 'error' ELSE 'ok' END AS status, l.l_shipdate AS created_at
        FROM lineitem l
        CROSS JOIN (SELECT count(*) AS c
        FROM documents) n
    """,
    "jobs": """
        SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'external-ai' ELSE 'external-fetch' END AS queue_name, CASE WHEN o_custkey % 3 = 0 THEN 'ru' ELSE 'external' END AS execution_region, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, CAST(o_custkey % 4 AS INT) AS attempts, 3 AS max_attempts, o_orderdate AS created_at, CASE WHEN o_custkey % 5 <> 0 THEN o_orderdate END AS lease_expires_at
        FROM orders
    """,
    "signals": """
        SELECT p_partkey AS id, p_name AS title, p_brand AS theme, CAST(p_size * 2 AS DOUBLE) AS score, CASE WHEN p_size < 10 THEN 'reject' WHEN p_size < 25 THEN 'watch' WHEN p_size < 40 THEN 'shortlist' ELSE 'proven' END AS maturity, CASE WHEN p_partkey % 10 IN (3, 4) THEN p_partkey - 1 END AS merged_into_signal_id
        FROM part
    """,
    "signal_evidence": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS signal_id, concat('https://s', CAST(l_suppkey AS STRING), '.example.org/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS source_url, round(l_discount * 10, 2) AS strength, CASE WHEN l_linenumber <> 4 THEN l_shipdate END AS published_at
        FROM lineitem
    """,
    "signal_feedback": """
        SELECT e.event_id AS id, p.p_partkey AS signal_id, CASE e.event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'merge_duplicate' ELSE '' END AS verdict, CASE WHEN e.event_type = 'view' THEN 'comment_added' ELSE 'status_changed' END AS event_type, e.ts AS created_at
        FROM events e
        JOIN part p ON p.p_partkey = e.event_id % 4000
    """,
    "source_candidates": """
        SELECT s_suppkey AS id, concat('https://', lower(replace(s_name, '#', '-')), '.example.net/news') AS url, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE concat('topic', CAST(s_nationkey % 5 AS STRING)) END AS topic, CASE s_suppkey % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'needs_human_review' WHEN 3 THEN 'paused' ELSE 'new' END AS status, CASE s_suppkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'test_more' WHEN 2 THEN 'reject' END AS recommended_action, CAST(s_suppkey % 8 AS INT) AS tested_articles, CAST(floor((s_suppkey % 8) * (s_suppkey % 3) / 2.0) AS INT) AS relevant_articles, CASE WHEN s_suppkey % 6 <> 0 THEN CAST((s_suppkey * 29) % 100 AS DOUBLE) END AS avg_score, CAST(s_suppkey % 4 AS INT) AS noise_count
        FROM supplier
    """,
    "scoring_criteria": """
        SELECT id, name, CAST(weight AS DOUBLE) AS weight, enabled
        FROM (VALUES (1, 'effect', 40, TRUE), (2, 'novelty', 35, TRUE), (3, 'fit', 25, TRUE), (4, 'retired', 30, FALSE)) AS t(id, name, weight, enabled)
    """,
    "article_score_items": """
        SELECT s.id AS article_score_id, c.id AS criterion_id, CAST((s.article_id * (c.id + 2)) % 101 AS DOUBLE) AS ai_score, CAST((s.article_id * (c.id + 5)) % 101 AS DOUBLE) AS keyword_score
        FROM article_scores s
        CROSS JOIN scoring_criteria c
    """,
    "feedback_entries": """
        SELECT c.conv_id * 100 + c.turn AS id, a.id AS article_id, a.source_id, CASE (c.conv_id + c.turn) % 6 WHEN 0 THEN 'off_topic' WHEN 1 THEN 'incomplete_text' WHEN 2 THEN 'duplicate' WHEN 3 THEN 'bad_translation' WHEN 4 THEN 'good' END AS reason, CASE WHEN c.turn % 3 <> 0 THEN CAST((c.conv_id + c.turn) % 5 + 1 AS INT) END AS usefulness, CASE WHEN c.role = 'user' THEN substr(c.text, 1, 60) END AS comment
        FROM conversations c
        JOIN articles a ON a.id = c.conv_id + 1
    """,
}

#: Spark's own text of a view. A broadcast does not wait for a scalar subquery in its join key ("subquery has not finished"), so the key is a column here.
PLANNED: dict[str, str] = {
    "articles": VIEWS["articles"].split("FROM documents d")[0]
    + """FROM (SELECT x.*, x.doc_id + k.first_key AS order_key
        FROM documents x
        CROSS JOIN (SELECT min(o_orderkey) AS first_key
        FROM orders) k) d
        JOIN orders o ON o.o_orderkey = d.order_key
    """,
}


def needed(sql: str) -> list[str]:
    """Views that a query uses, in the order in which they are defined."""
    wanted: set[str] = set()
    open_ = [sql]
    while open_:
        text = open_.pop()
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.IGNORECASE):
                wanted.add(name)
                open_.append(VIEWS[name])
    return [name for name in VIEWS if name in wanted]


def with_views(sql: str, planned: dict[str, str] | None = None) -> str:
    """The query with the views it uses as common table expressions; ``planned`` has texts that stand for those of ``VIEWS``."""
    texts = VIEWS | (planned or {})
    parts = [f"{name} AS ({texts[name].strip()})" for name in needed(sql)]
    sql = sql.strip()
    if not parts:
        return sql
    head = "WITH RECURSIVE " if sql.upper().startswith("WITH RECURSIVE") else "WITH "
    rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", ", ", sql, flags=re.IGNORECASE) if sql.upper().startswith("WITH") else f" {sql}"
    return head + ", ".join(parts) + rest


_BUILT = "spark.tidewire.newsroom.built:"


def build(spark: SparkSession, folder: str, out: str) -> None:
    """Writes every newsroom table of a folder once; from then on this session's queries over the folder scan what was written.

    A later session names the written tables with ``use``. Without them each query
    derives the tables that it needs.
    """
    for name in VIEWS:
        Newsroom(spark, folder).table(name).write.mode("overwrite").parquet(f"{out}/{name}")
    use(spark, folder, out)


def use(spark: SparkSession, folder: str, out: str) -> None:
    """Lets the session's queries over a folder scan the tables that ``build`` wrote."""
    spark.conf.set(_BUILT + folder, out)


class Newsroom:
    """The newsroom tables of one folder of Parquet files, as DataFrames by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.built = spark, folder, spark.conf.get(_BUILT + folder, None)

    def table(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.spark.read.parquet(f"{self.built}/{name}") if self.built else self.sql(f"SELECT * FROM {name}")
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Runs a query over the tables and views."""
        whole = text if self.built else with_views(text, PLANNED)
        for name in [*BASE, *VIEWS] if self.built else BASE:
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", whole, re.IGNORECASE):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(whole)
