"""Lookups, counts and choices of the editorial desk, planned with DataFrames; their DuckDB texts are written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import rules
from tidewire.operators import selection
from tidewire.plans.register import Register
from tidewire.plans.reports import AS_OF
from tidewire.sources.newsroom import Newsroom

query = Register()
QUERIES, oracle_sql = query.queries, query.oracle_sql


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


# --- lookups ------------------------------------------------------------------


@query("SELECT id, name, parse_strategy FROM sources WHERE enabled AND parse_strategy NOT IN ('telegram', 'playwright') AND archived_at IS NULL ORDER BY id LIMIT 5")
def sources_for_discovery(room: Newsroom) -> DataFrame:
    """Sources whose feed is still to be found, in order of id (FLT-2)."""
    wanted = F.col("enabled") & ~F.col("parse_strategy").isin("telegram", "playwright") & F.col("archived_at").isNull()
    return room.table("sources").where(wanted).orderBy("id").limit(5).select("id", "name", "parse_strategy")


@query("""
    WITH u AS (SELECT id, 1 AS turn, url FROM source_candidates UNION ALL SELECT id, 2, concat('https://www.', topic, '.example.net/feed') FROM source_candidates),
    k AS (SELECT id, turn, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '[#?].*$', ''), '/+$', '') AS k0 FROM u),
    d AS (SELECT id, turn, regexp_replace(k0, '^www\\.', '') AS url_key, split_part(regexp_replace(k0, '^www\\.', ''), '/', 1) AS domain FROM k)
    SELECT 'url' AS kind, url_key AS key, arg_max(id, id * 10 + turn) AS id FROM d GROUP BY url_key
    UNION ALL SELECT 'domain', domain, arg_min(id, id * 10 + turn) FROM d GROUP BY domain""")
def source_inventory(room: Newsroom) -> DataFrame:
    """Addresses of candidates as one list: the last by address, the first by domain (FLT-4)."""
    rows = room.table("source_candidates")
    urls = rows.select("id", F.posexplode(F.array("url", F.concat(F.lit("https://www."), "topic", F.lit(".example.net/feed")))).alias("turn", "url"))
    keyed = urls.select("id", "turn", rules.address_key(F.col("url")).alias("url_key")).withColumn("domain", F.substring_index("url_key", "/", 1))
    at = F.struct("id", "turn")
    by_url = keyed.groupBy("url_key").agg(F.max_by("id", at).alias("id")).select(F.lit("url").alias("kind"), F.col("url_key").alias("key"), "id")
    by_domain = keyed.groupBy("domain").agg(F.min_by("id", at).alias("id")).select(F.lit("domain").alias("kind"), F.col("domain").alias("key"), "id")
    return by_url.unionByName(by_domain)


@query("SELECT a.id, a.url, s.name AS source_name, CAST(length(a.raw_text) AS INTEGER) AS chars FROM articles a JOIN sources s ON s.id = a.source_id WHERE a.url IN ('https://www.en.example.com/6/', 'https://www.de.example.com/100?from=feed', 'https://www.fr.example.com/42/')")
def article_by_url(room: Newsroom) -> DataFrame:
    """Articles of exact addresses with their source and size (FLT-5, SRC-26)."""
    wanted = ["https://www.en.example.com/6/", "https://www.de.example.com/100?from=feed", "https://www.fr.example.com/42/"]
    found = room.table("articles").where(F.col("url").isin(wanted))
    sources = room.table("sources").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return found.join(sources, "source_id").select("id", "url", "source_name", F.length("raw_text").alias("chars"))


@query("""
    SELECT id, topic, status FROM source_candidates WHERE topic ILIKE '%topic%'
    ORDER BY CASE status WHEN 'needs_human_review' THEN 0 WHEN 'testing' THEN 1 WHEN 'approved' THEN 2 ELSE 3 END, id DESC LIMIT 200""")
def candidates_by_status(room: Newsroom) -> DataFrame:
    """Candidates of a topic in the order of their status (FLT-6)."""
    turn = F.when(F.col("status") == "needs_human_review", 0).when(F.col("status") == "testing", 1).when(F.col("status") == "approved", 2).otherwise(3)
    return room.table("source_candidates").where(F.col("topic").ilike("%topic%")).orderBy(turn, F.desc("id")).limit(200).select("id", "topic", "status")


@query("SELECT a.id, c.status, x.topic FROM articles a JOIN article_cards c ON c.article_id = a.id JOIN source_candidates x ON x.id = a.source_id WHERE a.source_id = 3 AND c.status IN ('new', 'error') ORDER BY a.id LIMIT 20")
def candidate_articles(room: Newsroom) -> DataFrame:
    """Unprocessed articles of one candidate (FLT-7)."""
    cards = room.table("article_cards").where(F.col("status").isin("new", "error")).select(F.col("article_id").alias("id"), "status")
    own = room.table("articles").where("source_id = 3").select("id", "source_id").join(cards, "id")
    return own.join(room.table("source_candidates").select(F.col("id").alias("source_id"), "topic"), "source_id").orderBy("id").limit(20).select("id", "status", "topic")


@query("SELECT id, name, weight FROM scoring_criteria WHERE enabled")
def enabled_criteria(room: Newsroom) -> DataFrame:
    """Criteria in use (FLT-24)."""
    return room.table("scoring_criteria").where("enabled").select("id", "name", "weight")


@query("SELECT id, name FROM tags WHERE parent_id IS NULL AND enabled AND name <> 'ASIA' AND name ILIKE '%a%' ORDER BY sort_order, name LIMIT 50")
def radar_topics(room: Newsroom) -> DataFrame:
    """Root tags but for the system's own, by a part of their name (FLT-8, FLT-25)."""
    roots = room.table("tags").where(F.col("parent_id").isNull() & F.col("enabled") & (F.col("name") != "ASIA") & F.lower("name").contains("a"))
    return roots.orderBy("sort_order", "name").limit(50).select("id", "name")


@query("SELECT id, theme, score, maturity FROM signals WHERE maturity <> 'reject' AND merged_into_signal_id IS NULL ORDER BY score DESC, id DESC LIMIT 40")
def best_memory(room: Newsroom) -> DataFrame:
    """Rows of memory that are in use, the best first (FLT-9)."""
    rows = room.table("signals").where((F.col("maturity") != "reject") & F.col("merged_into_signal_id").isNull())
    return rows.orderBy(F.desc("score"), F.desc("id")).limit(40).select("id", "theme", "score", "maturity")


@query(f"SELECT id, queue_name, status FROM jobs WHERE status IN ('queued', 'running') AND queue_name LIKE 'external%' AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1500 DAYS ORDER BY created_at DESC, id DESC LIMIT 30")
def recent_jobs(room: Newsroom) -> DataFrame:
    """Open jobs of some queues, the newest first (FLT-11)."""
    wanted = F.col("status").isin("queued", "running") & F.col("queue_name").startswith("external") & (F.col("created_at") >= _as_of() - F.expr("INTERVAL 1500 DAYS"))
    return room.table("jobs").where(wanted).orderBy(F.desc("created_at"), F.desc("id")).limit(30).select("id", "queue_name", "status")


@query("SELECT event_type, COUNT(*) > 0 AS found, COUNT(*) AS n FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 65 GROUP BY event_type")
def recent_with_payload(room: Newsroom) -> DataFrame:
    """Whether there is an event whose JSON payload contains a pair (FLT-12, 2.16.8)."""
    held = F.get_json_object("props", "$.k").try_cast("int") == 65
    return room.table("events").where(held).groupBy("event_type").agg((F.count("*") > 0).alias("found"), F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE json_exists(props, '$.k') AND regexp_full_match(json_extract_string(props, '$.k'), '[0-9]+') AND CAST(json_extract_string(props, '$.k') AS INTEGER) IN (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')")
def payload_users(room: Newsroom) -> DataFrame:
    """Events whose payload names a known user: the key exists and holds a number (MUT-15, 2.16.8)."""
    events = room.table("events")
    named = events.withColumn("k", F.get_json_object("props", "$.k")).where(F.col("k").rlike("^[0-9]+$")).withColumn("user", F.col("k").cast("long"))
    users = events.where("event_type = 'signup'").select(F.col("user_id").cast("long").alias("user"))
    return named.join(users, "user", "left_semi").select("event_id")


@query("SELECT a.id FROM articles a LEFT JOIN article_cards c ON c.article_id = a.id WHERE a.url IS NOT NULL AND NOT a.pending_deletion AND c.relevant IS NOT FALSE AND a.id % 3 <> 0 ORDER BY a.id DESC LIMIT 80")
def missing_image(room: Newsroom) -> DataFrame:
    """Visible articles that lack a picture, the newest first (FLT-17)."""
    hidden = room.table("article_cards").where("relevant = false").select(F.col("article_id").alias("id"))
    rows = room.table("articles").where(F.col("url").isNotNull() & ~F.col("pending_deletion") & (F.col("id") % 3 != 0))
    return rows.join(hidden, "id", "left_anti").orderBy(F.desc("id")).limit(80).select("id")


@query("""
    SELECT d.source AS owner, d.doc_id, (SELECT COUNT(*) FROM unnest(string_split(d.text, chr(10))) l(x) WHERE trim(x) = '') AS blank_anchors,
           (SELECT COUNT(*) FROM labels l WHERE l.doc_id = d.doc_id) AS facts
    FROM documents d WHERE d.source = 'src3'""")
def documents_of_owner(room: Newsroom) -> DataFrame:
    """Documents of an owner with the number of facts and of blank anchors (FLT-20)."""
    own = room.table("documents").where("source = 'src3'")
    facts = room.table("labels").groupBy("doc_id").agg(F.count("*").alias("facts"))
    blank = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) == "")).cast("long")
    return own.select(F.col("source").alias("owner"), "doc_id", blank.alias("blank_anchors")).join(facts, "doc_id", "left").fillna(0, ["facts"])


@query("WITH h AS (SELECT source, doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL) SELECT source, hash, MIN(doc_id) AS doc_id, COUNT(*) AS uploads FROM h GROUP BY source, hash HAVING COUNT(*) > 1")
def document_by_hash(room: Newsroom) -> DataFrame:
    """Texts that an owner has more than once, by hash (FLT-21, DOC-8)."""
    rows = room.table("documents").where("text IS NOT NULL").select("source", "doc_id", F.sha2("text", 256).alias("hash"))
    return rows.groupBy("source", "hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("uploads")).where("uploads > 1")


@query(f"SELECT status, COUNT(*) FILTER (WHERE lease_expires_at < TIMESTAMP '{AS_OF}') AS stale, COUNT(*) AS n FROM jobs WHERE status IN ('running', 'finalizing') GROUP BY status")
def stale_jobs(room: Newsroom) -> DataFrame:
    """Running jobs and those whose lease is over (FLT-23)."""
    rows = room.table("jobs").where(F.col("status").isin("running", "finalizing"))
    return rows.groupBy("status").agg(F.count_if(F.col("lease_expires_at") < _as_of()).alias("stale"), F.count("*").alias("n"))


@query("SELECT id, status FROM source_candidates WHERE id IN (1, 4, 9, 1000) UNION ALL SELECT id, status FROM source_candidates WHERE NOT EXISTS (SELECT 1 FROM source_candidates WHERE id IN (1, 4, 9, 1000))")
def triage_of(room: Newsroom) -> DataFrame:
    """Triage rows of given candidates, or all where none is there (FLT-26)."""
    rows = room.table("source_candidates").select("id", "status")
    some = rows.where(F.col("id").isin(1, 4, 9, 1000))
    none = some.groupBy().agg((F.count("*") == 0).alias("none"))
    return some.unionByName(rows.join(F.broadcast(none.where("none")), how="left_semi"))


# --- joins -----------------------------------------------------------------------


@query("SELECT a.id, s.name, c.title_ru FROM articles a JOIN sources s ON s.id = a.source_id JOIN article_cards c ON c.article_id = a.id WHERE COALESCE(c.summary, '') <> '' OR COALESCE(c.title_ru, '') <> ''")
def terminology_texts(room: Newsroom) -> DataFrame:
    """Articles with a summary or a translated title (JN-7)."""
    cards = room.table("article_cards").where("coalesce(summary, '') <> '' OR coalesce(title_ru, '') <> ''").select(F.col("article_id").alias("id"), "title_ru")
    sources = room.table("sources").select(F.col("id").alias("source_id"), "name")
    return room.table("articles").select("id", "source_id").join(cards, "id").join(sources, "source_id").select("id", "name", "title_ru")


@query("""
    SELECT a.article_id, f, t FROM (SELECT article_id, unnest(['title_ru', 'summary']) AS f, unnest([title_ru, summary]) AS t FROM article_cards) a
    WHERE trim(COALESCE(t, '')) <> '' AND regexp_matches(t, '(?i)tion')""")
def terminology_rows(room: Newsroom) -> DataFrame:
    """Titles and summaries, one a row, that hold a doubtful form (STR-14)."""
    cards = room.table("article_cards")
    rows = cards.unpivot("article_id", ["title_ru", "summary"], "f", "t")
    return rows.where((F.trim(F.coalesce("t", F.lit(""))) != "") & F.col("t").rlike("(?i)tion"))


@query("SELECT article_id, f, t AS before, regexp_replace(t, 'tion', 'TION', 'g') AS after FROM (SELECT article_id, unnest(['title_ru', 'summary']) AS f, unnest([title_ru, summary]) AS t FROM article_cards) a WHERE contains(t, 'tion')")
def terminology_repairs(room: Newsroom) -> DataFrame:
    """What a repair changes in titles and summaries (STR-15)."""
    rows = room.table("article_cards").unpivot("article_id", ["title_ru", "summary"], "f", "before")
    return rows.withColumn("after", F.regexp_replace("before", "tion", "TION")).where("after <> before")


@query("SELECT s.id, COALESCE(f.verdict, '') AS verdict, s.score FROM signals s LEFT JOIN signal_feedback f ON f.signal_id = s.id WHERE f.verdict IS NULL OR f.verdict IN ('', 'approved', 'reject')")
def training_examples(room: Newsroom) -> DataFrame:
    """Training examples with their verdicts (JN-12)."""
    feedback = room.table("signal_feedback").select(F.col("signal_id").alias("id"), "verdict")
    joined = room.table("signals").select("id", "score").join(feedback, "id", "left")
    return joined.where(F.col("verdict").isNull() | F.col("verdict").isin("", "approved", "reject")).select("id", F.coalesce("verdict", F.lit("")).alias("verdict"), "score")


@query("""
    WITH d AS (SELECT substr(CAST(updated_at AS VARCHAR), 1, 7) AS month, article_id, CASE WHEN user_id = 1 THEN user_id END AS owner, updated_at FROM user_article_states WHERE user_id IN (1, 2)),
    r AS (SELECT *, row_number() OVER (PARTITION BY month, article_id ORDER BY owner IS NOT NULL DESC, updated_at DESC) AS rn FROM d)
    SELECT month, article_id, owner IS NOT NULL AS own FROM r WHERE rn = 1""")
def own_or_shared(room: Newsroom) -> DataFrame:
    """Of each month's entries one's own before the shared one, the latest first (JN-17)."""
    rows = room.table("user_article_states").where("user_id in (1, 2)")
    rows = rows.select(F.date_format("updated_at", "yyyy-MM").alias("month"), "article_id", (F.col("user_id") == 1).alias("own"), "updated_at")
    return rows.groupBy("month", "article_id").agg(F.max(F.struct("own", "updated_at"))["own"].alias("own"))


@query("SELECT s.id, EXISTS (SELECT 1 FROM signal_feedback f WHERE f.signal_id = s.id AND f.verdict <> '') AS reviewed FROM signals s WHERE substr(sha256(s.title), 1, 1) IN ('0', '7', 'a')")
def key_owners(room: Newsroom) -> DataFrame:
    """Signals of given keys, and whether they were reviewed (JN-21)."""
    found = room.table("signals").where(F.substring(F.sha2("title", 256), 1, 1).isin("0", "7", "a")).select("id")
    reviewed = room.table("signal_feedback").where("verdict <> ''").select(F.col("signal_id").alias("id")).distinct().withColumn("r", F.lit(True))
    return found.join(reviewed, "id", "left").select("id", F.coalesce("r", F.lit(False)).alias("reviewed"))


@query("SELECT x.id, s.id AS source_id FROM source_candidates x JOIN sources s ON x.url LIKE concat('%', lpad(CAST(s.id AS VARCHAR), 3, '0'), '.%')")
def candidates_by_name(room: Newsroom) -> DataFrame:
    """Candidates whose address holds a source's number (2.1.14, SRC-27): a key is taken from the address, so that the join has one."""
    number = F.regexp_extract("url", r"([0-9]{3})\.", 1).try_cast("long")
    keyed = room.table("source_candidates").select("id", number.alias("source_id"))
    return keyed.join(room.table("sources").select(F.col("id").alias("source_id")), "source_id")


@query("SELECT s.article_id, string_agg(concat(CAST(i.criterion_id AS VARCHAR), '=', CAST(CAST(i.ai_score AS INTEGER) AS VARCHAR)), ',' ORDER BY i.criterion_id) AS items FROM article_scores s JOIN article_score_items i ON i.article_score_id = s.id JOIN scoring_criteria c ON c.id = i.criterion_id WHERE c.enabled GROUP BY s.article_id")
def score_item_lists(room: Newsroom) -> DataFrame:
    """The criterion scores of each article as one ordered list (JN-23, 2.16.7)."""
    criteria = room.table("scoring_criteria").where("enabled").select(F.col("id").alias("criterion_id"))
    items = room.table("article_score_items").join(criteria, "criterion_id").select(F.col("article_score_id").alias("id"), "criterion_id", "ai_score")
    lists = room.table("article_scores").select("id", "article_id").join(items, "id").groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("criterion_id", "ai_score"))).alias("l"))
    written = F.transform("l", lambda x: F.concat(x["criterion_id"].cast("string"), F.lit("="), x["ai_score"].cast("int").cast("string")))
    return lists.select("article_id", F.array_join(written, ",").alias("items"))


@query("SELECT id, substr(CAST(created_at + INTERVAL 3 HOURS AS VARCHAR), 1, 13) AS local_hour FROM signal_feedback")
def local_hours(room: Newsroom) -> DataFrame:
    """Feedback by the hour of another time zone (2.16.5)."""
    local = F.from_utc_timestamp(F.col("created_at").cast("timestamp"), "Europe/Moscow")
    return room.table("signal_feedback").select("id", F.date_format(local, "yyyy-MM-dd HH").alias("local_hour"))


# --- counts -------------------------------------------------------------------------


@query("""
    SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE c.relevant) AS relevant, COUNT(*) FILTER (WHERE NOT c.relevant) AS irrelevant, COUNT(*) FILTER (WHERE c.relevant IS NULL) AS open_,
           COUNT(*) FILTER (WHERE s.total_score >= 60) AS high, COUNT(*) FILTER (WHERE a.pending_deletion) AS hidden, COUNT(*) FILTER (WHERE c.summary IS NOT NULL) AS summarised,
           CAST(round(CAST(AVG(s.total_score) FILTER (WHERE c.relevant) AS DECIMAL(38,10)), 4) AS DOUBLE) AS avg_score
    FROM articles a LEFT JOIN article_cards c ON c.article_id = a.id LEFT JOIN article_scores s ON s.article_id = a.id""")
def article_metrics(room: Newsroom) -> DataFrame:
    """One row of counts over all articles (AGG-3)."""
    cards = room.table("article_cards").select(F.col("article_id").alias("id"), "relevant", "summary")
    scores = room.table("article_scores").select(F.col("article_id").alias("id"), "total_score")
    rows = room.table("articles").select("id", "pending_deletion").join(cards, "id", "left").join(scores, "id", "left")
    count = lambda c, name: F.count_if(F.expr(c)).alias(name)
    mean = rules.decimal_round(F.avg(F.when(F.col("relevant"), F.col("total_score"))), 4)
    return rows.agg(F.count("*").alias("total"), count("relevant", "relevant"), count("NOT relevant", "irrelevant"), count("relevant IS NULL", "open_"), count("total_score >= 60", "high"), count("pending_deletion", "hidden"), count("summary IS NOT NULL", "summarised"), mean.alias("avg_score"))


@query("SELECT r.article_id, COUNT(DISTINCT r.id) AS runs, COUNT(DISTINCT r.id) FILTER (WHERE r.status = 'ok') AS ok_runs, COUNT(DISTINCT t.tag_id) AS tags FROM ai_runs r LEFT JOIN article_tags t ON t.article_id = r.article_id LEFT JOIN article_scores s ON s.article_id = r.article_id GROUP BY r.article_id")
def run_summary(room: Newsroom) -> DataFrame:
    """Runs of each article beside its tags, counted before they are joined (AGG-6)."""
    runs = room.table("ai_runs").groupBy("article_id").agg(F.countDistinct("id").alias("runs"), F.countDistinct(F.when(F.col("status") == "ok", F.col("id"))).alias("ok_runs"))
    tags = room.table("article_tags").groupBy("article_id").agg(F.countDistinct("tag_id").alias("tags"))
    return runs.join(tags, "article_id", "left").fillna(0, ["tags"])


@query("SELECT (SELECT COUNT(*) FROM events WHERE ts >= DATE '2024-01-10') AS events_, (SELECT COUNT(*) FROM signal_feedback WHERE created_at >= DATE '2024-01-10') AS feedback, (SELECT COUNT(*) FROM signal_feedback f WHERE f.created_at >= DATE '2024-01-10' AND NOT EXISTS (SELECT 1 FROM signals s WHERE s.id = f.signal_id AND s.maturity = 'reject')) AS open_feedback")
def daily_usage(room: Newsroom) -> DataFrame:
    """What was used since a day (AGG-7)."""
    since = F.lit("2024-01-10").cast("timestamp_ntz")
    feedback = room.table("signal_feedback").where(F.col("created_at") >= since)
    rejected = room.table("signals").where("maturity = 'reject'").select(F.col("id").alias("signal_id"))
    counts = [(room.table("events").where(F.col("ts") >= since), "events_"), (feedback, "feedback"), (feedback.join(rejected, "signal_id", "left_anti"), "open_feedback")]
    parts = [rows.agg(F.count("*").alias(name)) for rows, name in counts]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


@query("SELECT id, tested_articles, CAST(round(CAST(relevant_articles AS DECIMAL(38,10)) / greatest(COALESCE(tested_articles, 0), 1), 4) AS DOUBLE) AS relevance_rate FROM source_candidates")
def memory_rates(room: Newsroom) -> DataFrame:
    """Share of relevant articles of what was tested (AGG-8)."""
    rate = F.col("relevant_articles") / F.greatest(F.coalesce("tested_articles", F.lit(0)), F.lit(1))
    return room.table("source_candidates").select("id", "tested_articles", rules.decimal_round(rate, 4).alias("relevance_rate"))


@query("SELECT s.id, (SELECT COUNT(*) FROM signal_evidence e WHERE e.signal_id = s.id) AS evidence_count FROM signals s")
def evidence_counts(room: Newsroom) -> DataFrame:
    """Signals with their evidence counted anew (AGG-24, 2.1.35)."""
    counts = room.table("signal_evidence").groupBy(F.col("signal_id").alias("id")).agg(F.count("*").alias("evidence_count"))
    return room.table("signals").select("id").join(counts, "id", "left").fillna(0, ["evidence_count"])


@query(f"SELECT status, COUNT(*) FILTER (WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL 1000 DAYS) AS over_1000_days, COUNT(*) FILTER (WHERE COALESCE(lease_expires_at, created_at) < TIMESTAMP '{AS_OF}' - INTERVAL 2000 DAYS) AS over_2000_days FROM jobs GROUP BY status")
def retention_counts(room: Newsroom) -> DataFrame:
    """Jobs that are past their retention (AGG-26, AGG-38)."""
    old = lambda c, days: F.count_if(c < _as_of() - F.expr(f"INTERVAL {days} DAYS"))
    return room.table("jobs").groupBy("status").agg(old(F.col("created_at"), 1000).alias("over_1000_days"), old(F.coalesce("lease_expires_at", "created_at"), 2000).alias("over_2000_days"))


@query(f"SELECT id FROM jobs WHERE NOT (status IN ('ok', 'failed') AND COALESCE(lease_expires_at, created_at) < TIMESTAMP '{AS_OF}' - INTERVAL 1200 DAYS)")
def jobs_kept(room: Newsroom) -> DataFrame:
    """The queue after finished jobs past their retention went (STR-8)."""
    gone = F.col("status").isin("ok", "failed") & (F.coalesce("lease_expires_at", "created_at") < _as_of() - F.expr("INTERVAL 1200 DAYS"))
    return room.table("jobs").where(~gone).select("id")


@query("SELECT stage, round(quantile_cont(cost_usd, 0.5), 8) AS p50, round(quantile_cont(cost_usd, 0.95), 8) AS p95, MAX(cost_usd) AS most FROM ai_runs GROUP BY stage")
def cost_percentiles(room: Newsroom) -> DataFrame:
    """Interpolated percentiles by stage (AGG-28)."""
    runs = room.table("ai_runs").select("stage", "cost_usd")
    most = runs.groupBy("stage").agg(F.max("cost_usd").alias("most"))
    found = selection.quantiles(runs, "stage", "cost_usd", {"p50": 0.5, "p95": 0.95}).withColumnRenamed("stage", "_stage")
    joined = most.join(found, F.col("stage").eqNullSafe(F.col("_stage")))
    return joined.select("stage", F.round("p50", 8).alias("p50"), F.round("p95", 8).alias("p95"), "most")


@query("SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE contains(lower(raw_text), 'tion') OR contains(lower(raw_text), 'anal')) AS analytics, COUNT(*) FILTER (WHERE contains(lower(raw_text), 'mark')) AS business FROM articles")
def highlight_counts(room: Newsroom) -> DataFrame:
    """Articles by kinds that words tell (AGG-36)."""
    text = F.lower("raw_text")
    return room.table("articles").agg(F.count("*").alias("total"), F.count_if(text.contains("tion") | text.contains("anal")).alias("analytics"), F.count_if(text.contains("mark")).alias("business"))


@query("SELECT 'signals' AS section, COUNT(*) AS n FROM signals UNION ALL SELECT 'signal_evidence', COUNT(*) FROM signal_evidence UNION ALL SELECT 'signal_feedback', COUNT(*) FROM signal_feedback")
def section_counts(room: Newsroom) -> DataFrame:
    """Rows of each section of an export (AGG-37)."""
    names = ["signals", "signal_evidence", "signal_feedback"]
    parts = [room.table(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("section"), "n") for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT s.id, COALESCE(t.label, 'unaudited') AS label, COUNT(*) AS n FROM sources s LEFT JOIN (SELECT source_id, CASE WHEN COUNT(*) >= 10 THEN 'busy' ELSE 'quiet' END AS label FROM articles GROUP BY source_id) t ON t.source_id = s.id GROUP BY s.id, t.label")
def source_audit_counts(room: Newsroom) -> DataFrame:
    """An audit of all sources at once (STR-13)."""
    label = F.when(F.count("*") >= 10, "busy").otherwise("quiet")
    audited = room.table("articles").groupBy(F.col("source_id").alias("id")).agg(label.alias("label"))
    joined = room.table("sources").select("id").join(audited, "id", "left").fillna("unaudited", ["label"])
    return joined.groupBy("id", "label").agg(F.count("*").alias("n"))


# --- choices ---------------------------------------------------------------------


@query("""
    WITH n AS (SELECT theme, id, title, lower(trim(title)) AS k, row_number() OVER (PARTITION BY theme, lower(trim(title)) ORDER BY id) AS r FROM signals),
    p AS (SELECT theme, title, k, row_number() OVER (PARTITION BY theme ORDER BY id) AS place FROM n WHERE r = 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place, theme) AS first FROM p WHERE place <= 40),
    t AS (SELECT theme, title, row_number() OVER (PARTITION BY theme ORDER BY place) AS turn FROM f WHERE first = 1)
    SELECT turn, theme, title FROM t ORDER BY turn, theme LIMIT 40""")
def interleaved_titles(room: Newsroom) -> DataFrame:
    """Titles of themes in turn, each once (WIN-7, WIN-8, SET-4)."""
    return selection.interleaved(room.table("signals"), group="theme", order=[F.col("id")], value="title", key=F.lower(F.trim("title")), limit=40)


@query("""
    WITH b AS (SELECT lower(trim(theme)) AS topic, lower(trim(title)) AS low, MAX(score) AS score FROM signals GROUP BY 1, 2),
    w AS (SELECT b.topic, b.low, b.score, MAX(trim(s.title)) AS hint FROM b JOIN signals s ON lower(trim(s.theme)) = b.topic AND lower(trim(s.title)) = b.low AND s.score = b.score GROUP BY 1, 2, 3)
    SELECT topic, rank, hint, score FROM (SELECT topic, hint, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, low) AS rank FROM w) r WHERE rank <= 3""")
def topic_hints(room: Newsroom) -> DataFrame:
    """The three best distinct hints of each topic (WIN-9)."""
    return selection.top_hints(room.table("signals"), topic="theme", hint="title", score="score")


@query("""
    WITH m AS (SELECT lower(theme) AS topic, id AS key, score - 50 AS score, CASE id % 4 WHEN 0 THEN 'muted' WHEN 1 THEN 'rejected' ELSE 'active' END AS status FROM signals),
    b AS (SELECT topic, key, score, CASE WHEN status = 'active' AND score > 0 THEN 'promoted' WHEN status IN ('muted', 'rejected') OR score < 0 THEN 'muted' END AS bucket FROM m)
    SELECT topic, bucket, rank, key, score FROM (SELECT *, row_number() OVER (PARTITION BY topic, bucket ORDER BY CASE WHEN bucket = 'promoted' THEN -score ELSE score END, key) AS rank FROM b WHERE bucket IS NOT NULL) r WHERE rank <= 3""")
def combo_hints(room: Newsroom) -> DataFrame:
    """Promoted and muted combinations of each topic (WIN-9)."""
    status = F.when(F.col("id") % 4 == 0, "muted").when(F.col("id") % 4 == 1, "rejected").otherwise("active")
    rows = room.table("signals").select("theme", F.col("id"), (F.col("score") - 50).alias("score"), status.alias("status"))
    return selection.combo_hints(rows, topic="theme", key="id", score="score", status="status")


@query("SELECT lower(theme) AS topic, lower(h) AS hint, MAX(CASE WHEN score >= 50 THEN 8 ELSE 4 END) AS boost FROM (SELECT theme, score, unnest(string_split(title, ' ')) AS h FROM signals) x WHERE trim(h) <> '' GROUP BY 1, 2")
def hint_boosts(room: Newsroom) -> DataFrame:
    """Exploded hints with their largest boost (WIN-10)."""
    rows = room.table("signals").select("theme", F.split("title", " ").alias("hints"), F.when(F.col("score") >= 50, 8).otherwise(4).alias("boost"))
    return selection.hint_boosts(rows, topic="theme", hints="hints", boost="boost")


@query("""
    WITH r AS (SELECT id, language AS query, concat('d', CAST(source_id % 5 AS VARCHAR)) AS domain, list_transform(regexp_extract_all(url, '(?:19|20)[0-9]{2}'), lambda y: CAST(y AS INTEGER)) AS years FROM articles)
    SELECT id, CAST(round(CAST(CASE WHEN query = 'de' AND domain = 'd1' THEN 120 ELSE 0 END + CASE query WHEN 'en' THEN 30 WHEN 'de' THEN 10 ELSE 0 END * 0.6 + CASE domain WHEN 'd1' THEN 20 WHEN 'd2' THEN -5 ELSE 0 END * 0.4
           + CASE WHEN len(years) = 0 THEN 0 WHEN list_max(years) >= 2001 THEN 12 WHEN list_max(years) = 2000 THEN 5 ELSE -12 END AS DECIMAL(38,10)), 4) AS DOUBLE) AS rank_score
    FROM r WHERE query <> 'fr' AND NOT (query = 'en' AND domain = 'd3')""")
def learned_rank(room: Newsroom) -> DataFrame:
    """Search results ranked by what was learned (WIN-11)."""
    spark = room.spark
    years = F.transform(F.regexp_extract_all("url", F.lit("(?:19|20)[0-9]{2}"), F.lit(0)), lambda y: y.cast("int"))
    rows = room.table("articles").select("id", F.col("language").alias("query"), F.concat(F.lit("d"), (F.col("source_id") % 5).cast("string")).alias("domain"), years.alias("years"))
    queries = spark.createDataFrame([("en", 30.0, False), ("de", 10.0, False), ("fr", 0.0, True)], "query string, score double, muted boolean")
    domains = spark.createDataFrame([("d1", 20.0), ("d2", -5.0)], "domain string, score double")
    combos = spark.createDataFrame([("de", "d1", True, False), ("en", "d3", False, True)], "query string, domain string, promoted boolean, blocked boolean")
    return selection.learned_rank(rows, query_scores=queries, domain_scores=domains, combos=combos, years=F.col("years"), this_year=2001)


@query("""
    WITH r AS (SELECT id, url, regexp_extract(url, '://([^/]+)', 1) AS domain FROM articles), k AS (SELECT url, CASE WHEN language = 'fr' THEN regexp_extract(url, '://([^/]+)', 1) ELSE '' END AS domain FROM articles WHERE id % 5 = 0),
    f AS (SELECT url, MIN(id) AS id, MIN(domain) AS domain FROM r GROUP BY url)
    SELECT id, url, domain FROM f WHERE url NOT IN (SELECT url FROM k) AND domain NOT IN (SELECT domain FROM k WHERE domain <> '') ORDER BY id LIMIT 50""")
def new_results(room: Newsroom) -> DataFrame:
    """First occurrences that no known source covers (WIN-12, SRC-10)."""
    rows = room.table("articles").withColumn("domain", F.regexp_extract("url", "://([^/]+)", 1))
    known = rows.where("id % 5 = 0").select("url", F.when(F.col("language") == "fr", F.col("domain")).otherwise("").alias("domain"))
    return selection.new_results(rows.select("id", "url", "domain"), known, limit=50)


@query("""
    WITH m AS (SELECT theme AS topic, ['news', 'company', 'report', 'event'][id % 4 + 1] AS strategy, score, CASE WHEN id % 3 = 0 THEN 'muted' WHEN score > 90 THEN 'active' ELSE 'other' END AS status FROM signals),
    a AS (SELECT topic, arg_max(strategy, concat(lpad(CAST(CAST(score * 1000 AS BIGINT) AS VARCHAR), 12, '0'), strategy)) AS best FROM m WHERE status = 'active' GROUP BY topic),
    g AS (SELECT topic, COALESCE(list(strategy) FILTER (WHERE status = 'muted'), []) AS gone FROM m GROUP BY topic),
    u AS (SELECT topic, list_filter(['news', 'company', 'report', 'event'], lambda s: NOT list_contains(gone, s)) AS lft FROM g)
    SELECT u.topic, COALESCE(a.best, CASE WHEN len(lft) = 0 THEN 'company' ELSE lft[1 % len(lft) + 1] END) AS strategy FROM u LEFT JOIN a ON a.topic = u.topic""")
def best_strategies(room: Newsroom) -> DataFrame:
    """The next search strategy of each topic (WIN-13)."""
    names = ["news", "company", "report", "event"]
    strategy = F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 4 + 1).cast("int"))
    status = F.when(F.col("id") % 3 == 0, "muted").when(F.col("score") > 90, "active").otherwise("other")
    memory = room.table("signals").select(F.col("theme").alias("topic"), strategy.alias("strategy"), "score", status.alias("status"))
    return selection.best_strategies(memory, memory.select("topic").distinct(), names, F.lit(2))


@query("""
    WITH x AS (SELECT 'discover_sources' AS action_type, topic AS target, 90 - id AS priority, 0 AS l FROM source_candidates UNION ALL SELECT 'review_source_candidate', CAST(id AS VARCHAR), COALESCE(avg_score, 0), 1 FROM source_candidates
      UNION ALL SELECT 'tune_source_frequency', name, id, 2 FROM sources UNION ALL SELECT 'drop_table', name, 50, 3 FROM sources)
    SELECT action_type, target, CAST(priority AS DOUBLE) AS priority, CASE WHEN action_type = 'discover_sources' THEN 'auto' WHEN action_type = 'drop_table' THEN 'blocked' ELSE 'human_review' END AS policy_decision FROM x ORDER BY priority DESC, l, target LIMIT 25""")
def action_plan(room: Newsroom) -> DataFrame:
    """Actions of several generators, cut by urgency, with what may be done without a person (SET-3, DOM-19)."""
    candidates, sources = room.table("source_candidates"), room.table("sources")
    make = lambda rows, kind, target, priority: rows.select(F.lit(kind).alias("action_type"), target.alias("target"), priority.alias("priority"))
    return selection.action_plan([
        make(candidates, "discover_sources", F.col("topic"), 90 - F.col("id")), make(candidates, "review_source_candidate", F.col("id").cast("string"), F.coalesce("avg_score", F.lit(0))),
        make(sources, "tune_source_frequency", F.col("name"), F.col("id")), make(sources, "drop_table", F.col("name"), F.lit(50)),
    ], most=25)


@query("WITH p AS (SELECT id, concat(action, '/', CAST(id AS VARCHAR)) AS job FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'discover_sources' ELSE 'recheck_source' END AS action FROM source_candidates) a WHERE action = 'discover_sources') SELECT id, job, 'queued' AS status FROM p")
def plan_jobs(room: Newsroom) -> DataFrame:
    """Jobs of the actions that may run by themselves (DOM-46, STR-7)."""
    kind = F.when(F.col("id") % 2 == 0, "discover_sources").otherwise("recheck_source")
    rows = room.table("source_candidates").select("id", kind.alias("kind")).where(rules.action_policy(F.col("kind")) == "auto")
    return rows.select("id", F.concat("kind", F.lit("/"), F.col("id").cast("string")).alias("job"), F.lit("queued").alias("status"))


@query("""
    WITH a AS (SELECT url, MIN(title) AS title, MIN(language) AS language FROM articles WHERE id % 2 = 0 GROUP BY url), b AS (SELECT url, MAX(title) AS title, CASE WHEN MIN(id) % 3 = 0 THEN 'xx' END AS language FROM articles WHERE id % 3 = 0 GROUP BY url)
    SELECT COALESCE(a.url, b.url) AS url, COALESCE(b.title, a.title) AS title, COALESCE(b.language, a.language) AS language FROM a FULL JOIN b ON a.url = b.url""")
def merged_articles(room: Newsroom) -> DataFrame:
    """Two lists of articles as one, later fields before earlier ones (SET-7)."""
    rows = room.table("articles")
    first = rows.where("id % 2 = 0").groupBy("url").agg(F.min("title").alias("title"), F.min("language").alias("language"))
    second = rows.where("id % 3 = 0").groupBy("url").agg(F.max("title").alias("title"), F.when(F.min("id") % 3 == 0, "xx").alias("language"))
    return selection.merged_lists(first, second, "url")


@query("SELECT f.id, CASE WHEN rn <= 2 THEN 'attached' ELSE 'open' END AS state FROM (SELECT id, row_number() OVER (PARTITION BY signal_id % 20 ORDER BY created_at DESC, id DESC) AS rn FROM signal_feedback) f")
def attached_feedback(room: Newsroom) -> DataFrame:
    """The latest two examples of each group are attached (WIN-5, 2.1.35)."""
    latest = Window.partitionBy(F.col("signal_id") % 20).orderBy(F.desc("created_at"), F.desc("id"))
    return room.table("signal_feedback").select("id", F.when(F.row_number().over(latest) <= 2, "attached").otherwise("open").alias("state"))
