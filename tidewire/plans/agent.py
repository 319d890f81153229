"""Routing, hints, history and exports of the source agent over the newsroom tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import rules
from tidewire.operators import selection
from tidewire.plans.register import Register
from tidewire.sources.newsroom import Newsroom

query = Register()
QUERIES, oracle_sql = query.queries, query.oracle_sql


@query("""
    WITH x AS (SELECT id, parse_strategy = 'playwright' OR id % 7 = 0 AS browser, id % 3 = 0 AS outer_ FROM sources)
    SELECT id, CASE WHEN outer_ AND browser THEN 'external-playwright' WHEN outer_ THEN 'external-fetch' WHEN browser THEN 'playwright' ELSE 'default' END AS queue_name, CASE WHEN outer_ THEN 'external' ELSE 'ru' END AS region, CASE WHEN browser THEN 'playwright' ELSE 'http_fetch' END AS capability FROM x""")
def routed_sources(room: Newsroom) -> DataFrame:
    """Queue, region and capability of the tasks of each source (DOM-35)."""
    rows = room.table("sources").withColumns({"profile": F.when(F.col("id") % 7 == 0, "browser").otherwise("direct"), "region": F.when(F.col("id") % 3 == 0, "external").otherwise("auto")})
    route = rules.source_route(F.col("parse_strategy"), F.col("region"), F.col("profile"))
    return rows.select("id", route.alias("r")).select("id", "r.*")


@query("""
    WITH x AS (SELECT id, trim(regexp_replace(raw_text, '\\s+', ' ', 'g')) AS w, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM articles)
    SELECT id, concat(t, ': ', CASE WHEN regexp_matches(w, '[.!?…]\\s') THEN regexp_extract(w, '^((?:.*?[.!?…](?:\\s|$)){1,2})', 1) ELSE w END) AS summary FROM x""".replace("regexp_extract(w, '^((?:.*?[.!?…](?:\\s|$)){1,2})', 1)", "trim(regexp_extract(concat(w, ' '), '^((?:.*?[.!?…]\\s){2}|.*)', 1))"))
def summary_stubs(room: Newsroom) -> DataFrame:
    """Summaries by rule where no model is asked (DOM-36)."""
    return room.table("articles").select("id", rules.summary_stub(F.col("title"), F.col("raw_text")).alias("summary"))


@query("SELECT id, CASE WHEN source_type = 'Telegram' THEN 'ru' WHEN id % 2 = 0 THEN 'en' ELSE 'none' END AS language FROM sources")
def source_languages(room: Newsroom) -> DataFrame:
    """Language by what a source's category says (FN-23)."""
    category = F.concat("source_type", F.when((F.col("source_type") != "Telegram") & (F.col("id") % 2 == 0), " Международные").otherwise(""))
    return room.table("sources").select("id", F.coalesce(rules.category_language(category), F.lit("none")).alias("language"))


@query("""
    WITH t AS (SELECT 'a' AS topic, unnest(['thtion', 'chlich', 'antion']) AS s UNION ALL SELECT 'b', unnest(['schaft', 'chlich', 'ontion']) UNION ALL SELECT 'c', unnest(['thble', 'ertion'])),
    w AS (SELECT DISTINCT id, substr(unnest(regexp_extract_all(replace(lower(raw_text), 'ё', 'е'), '[a-zа-я0-9]{5,}')), 1, 6) AS s FROM articles),
    n AS (SELECT id, topic, COUNT(*) AS n FROM w JOIN t USING (s) GROUP BY id, topic), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, topic) AS rn, LEAD(n) OVER (PARTITION BY id ORDER BY n DESC, topic) AS up FROM n)
    SELECT id, topic, n AS overlap FROM r WHERE rn = 1 AND n >= 2 AND n > COALESCE(up, 0)""")
def hint_topics(room: Newsroom) -> DataFrame:
    """The one topic that shares the most beginnings of words with a text, two at least (DOM-30)."""
    topics = room.spark.createDataFrame([("a", ["thtion", "chlich", "antion"]), ("b", ["schaft", "chlich", "ontion"]), ("c", ["thble", "ertion"])], "topic string, stems array<string>")
    own = room.table("articles").select("id", F.explode(rules.term_stems(F.col("raw_text"), [])).alias("s"))
    shared = own.join(F.broadcast(topics.select("topic", F.explode("stems").alias("s"))), "s").groupBy("id", "topic").agg(F.count("*").alias("overlap"))
    order = Window.partitionBy("id").orderBy(F.desc("overlap"), "topic")
    ranked = shared.withColumns({"rn": F.row_number().over(order), "up": F.lead("overlap").over(order)})
    return ranked.where((F.col("rn") == 1) & (F.col("overlap") >= 2) & (F.col("overlap") > F.coalesce("up", F.lit(0)))).select("id", "topic", "overlap")


@query("SELECT source_id, substr(CAST(collected_at AS VARCHAR), 1, 7) AS period, COUNT(*) AS articles, COUNT(*) FILTER (WHERE pending_deletion) AS hidden FROM articles GROUP BY 1, 2")
def quality_history(room: Newsroom) -> DataFrame:
    """Quality of sources by period, as rows of a history (AGG-11)."""
    rows = room.table("articles").groupBy("source_id", F.date_format("collected_at", "yyyy-MM").alias("period"))
    return rows.agg(F.count("*").alias("articles"), F.count_if("pending_deletion").alias("hidden"))


@query("""
    SELECT kind, name, SUM(t) AS tested, SUM(r) AS relevant, CAST(round(CAST(least(1.0, SUM(r) / greatest(SUM(t), 1)) AS DECIMAL(38,10)), 4) AS DOUBLE) AS relevance_rate, CAST(round(CAST(least(1.0, SUM(n) / greatest(SUM(t), 1)) AS DECIMAL(38,10)), 4) AS DOUBLE) AS noise_rate
    FROM (SELECT 'topic' AS kind, topic AS name, tested_articles AS t, relevant_articles AS r, noise_count AS n FROM source_candidates UNION ALL SELECT 'status', status, tested_articles, relevant_articles, noise_count FROM source_candidates) x GROUP BY kind, name""")
def observation_rates(room: Newsroom) -> DataFrame:
    """Rates of tests by topic and by status, in one pass (AGG-33, AGG-34)."""
    rows = room.table("source_candidates")
    both = rows.select(F.explode(F.array(F.struct(F.lit("topic").alias("kind"), F.col("topic").alias("name")), F.struct(F.lit("status").alias("kind"), F.col("status").alias("name")))).alias("g"), "tested_articles", "relevant_articles", "noise_count")
    sums = both.groupBy("g.kind", "g.name").agg(F.sum("tested_articles").alias("tested"), F.sum("relevant_articles").alias("relevant"), F.sum("noise_count").alias("n"))
    rate = lambda c: rules.decimal_round(F.least(F.lit(1.0), F.col(c) / F.greatest("tested", F.lit(1))), 4)
    return sums.select("kind", "name", "tested", "relevant", rate("relevant").alias("relevance_rate"), rate("n").alias("noise_rate"))


@query("SELECT rule, COUNT(*) FILTER (WHERE kind = 'triggered') AS triggered, COUNT(*) FILTER (WHERE kind = 'suppressed') AS suppressed FROM (SELECT concat('k', CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR)) AS rule, 'triggered' AS kind FROM events UNION ALL SELECT event_type, 'suppressed' FROM events WHERE event_id % 3 = 0) x GROUP BY rule")
def rule_counts(room: Newsroom) -> DataFrame:
    """How often rules held or were held back, out of JSON memory (AGG-30)."""
    rule = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string"))
    memory = room.table("events").select(F.to_json(F.struct(F.array(rule).alias("triggered"), F.when(F.col("event_id") % 3 == 0, F.array("event_type")).alias("suppressed"))).alias("memory"))
    parsed = memory.select(F.from_json("memory", "triggered array<string>, suppressed array<string>").alias("m"))
    each = parsed.select(F.explode("m.triggered").alias("rule"), F.lit(1).alias("on")).unionByName(parsed.select(F.explode("m.suppressed").alias("rule"), F.lit(0).alias("on")))
    return each.groupBy("rule").agg(F.count_if(F.col("on") == 1).alias("triggered"), F.count_if(F.col("on") == 0).alias("suppressed"))


@query("SELECT id, array_to_string(CASE WHEN id % 2 = 0 THEN [name, 'new'] ELSE [name, 'new', 'NAME'] END, ',') AS keywords FROM tags")
def merged_keywords(room: Newsroom) -> DataFrame:
    """Keyword lists with those that they lack, whatever the case (MUT-3)."""
    old = F.array("name", F.lit("new"))
    new = F.when(F.col("id") % 2 == 0, F.array(F.lower("name"), F.lit("NEW"))).otherwise(F.array(F.lit("New"), F.lit("NAME"), F.lower("name")))
    return room.table("tags").select("id", F.array_join(rules.merged_keywords(old, new), ",").alias("keywords"))


@query("SELECT id, CASE WHEN name = 'src2' THEN 'rss' ELSE parse_strategy END AS parse_strategy, CASE WHEN name = 'src3' THEN FALSE ELSE enabled END AS enabled FROM sources")
def overridden_sources(room: Newsroom) -> DataFrame:
    """Sources with the overrides of a small registry, by name (MUT-16)."""
    registry = room.spark.createDataFrame([("src2", "rss", None), ("src3", None, False)], "name string, _strategy string, _enabled boolean")
    joined = room.table("sources").join(F.broadcast(registry), "name", "left")
    return joined.select("id", F.coalesce("_strategy", "parse_strategy").alias("parse_strategy"), F.coalesce("_enabled", "enabled").alias("enabled"))


@query("""
    SELECT section, COUNT(*) AS n, SUM(id) AS ids FROM (SELECT 'signals' AS section, id FROM signals WHERE merged_into_signal_id IS NULL
      UNION ALL SELECT 'evidence', e.id FROM signal_evidence e WHERE e.signal_id IN (SELECT id FROM signals WHERE merged_into_signal_id IS NULL)
      UNION ALL SELECT 'feedback', f.id FROM signal_feedback f WHERE f.verdict <> '' OR f.signal_id IN (SELECT id FROM signals WHERE merged_into_signal_id IS NULL)) x GROUP BY section""")
def export_bundle(room: Newsroom) -> DataFrame:
    """The sections of an export: free signals, their evidence, and feedback that has a verdict or belongs to them (JN-24, 2.1.10)."""
    signals = room.table("signals").where("merged_into_signal_id IS NULL").select("id")
    keys = signals.select(F.col("id").alias("signal_id"))
    feedback = room.table("signal_feedback")
    told = feedback.where("verdict <> ''")
    parts = {"signals": signals, "evidence": room.table("signal_evidence").join(keys, "signal_id", "left_semi").select("id"), "feedback": told.select("id").unionByName(feedback.where("NOT coalesce(verdict <> '', false)").join(keys, "signal_id", "left_semi").select("id"))}
    whole = None
    for name, rows in parts.items():
        named = rows.select(F.lit(name).alias("section"), "id")
        whole = named if whole is None else whole.unionByName(named)
    return whole.groupBy("section").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("""
    WITH m AS (SELECT id AS old_id, row_number() OVER (ORDER BY id) + 5000 AS new_id FROM signals WHERE theme LIKE 'Brand#1%')
    SELECT f.id, COALESCE(m.new_id, -1) AS signal_id FROM signal_feedback f LEFT JOIN m ON m.old_id = f.signal_id""")
def remapped_feedback(room: Newsroom) -> DataFrame:
    """Feedback of an import with the ids that its signals got (SRC-38, MUT-17)."""
    taken = room.table("signals").where(F.col("theme").startswith("Brand#1")).select(F.col("id").alias("signal_id"))
    ids = selection.numbered(taken, "signal_id", first=5001).withColumnRenamed("number", "_new")
    joined = room.table("signal_feedback").join(ids, "signal_id", "left")
    return joined.select("id", F.coalesce("_new", F.lit(-1)).alias("signal_id"))


@query("""
    SELECT s.id, CASE WHEN v.verdict IS NOT NULL THEN v.verdict WHEN s.score >= 80 THEN 'strong_signal' WHEN s.maturity = 'reject' THEN 'reject' ELSE 'watch_later' END AS label, v.verdict IS NOT NULL AS human
    FROM signals s LEFT JOIN (SELECT signal_id, arg_max(verdict, concat(CAST(created_at AS VARCHAR), lpad(CAST(id AS VARCHAR), 9, '0'))) AS verdict FROM signal_feedback WHERE verdict <> '' GROUP BY signal_id) v ON v.signal_id = s.id""")
def training_labels(room: Newsroom) -> DataFrame:
    """Labels to train on: the last verdict of a person before what the rules say (DOM-32, DOM-33, WIN-2)."""
    verdicts = room.table("signal_feedback").where("verdict <> ''").groupBy(F.col("signal_id").alias("id")).agg(F.max_by("verdict", F.struct("created_at", "id")).alias("verdict"))
    ruled = F.when(F.col("score") >= 80, "strong_signal").when(F.col("maturity") == "reject", "reject").otherwise("watch_later")
    joined = room.table("signals").join(verdicts, "id", "left")
    return joined.select("id", F.coalesce("verdict", ruled).alias("label"), F.col("verdict").isNotNull().alias("human"))


@query("SELECT c.article_id, CASE WHEN c.article_id % 4 = 0 THEN 'duplicate' WHEN c.relevant = false THEN 'rejected' ELSE c.status END AS status FROM article_cards c")
def applied_results(room: Newsroom) -> DataFrame:
    """Cards after results came in, some of them twice: a result is applied once (DOM-10, SRC-33)."""
    cards = room.table("article_cards").select("article_id", "status", "relevant")
    results = cards.where("article_id % 4 = 0").select("article_id", F.lit("duplicate").alias("_new"))
    once = results.unionByName(results).dropDuplicates(["article_id"])
    status = F.when(F.col("relevant") == F.lit(False), "rejected").otherwise(F.col("status"))
    return cards.join(once, "article_id", "left").select("article_id", F.coalesce("_new", status).alias("status"))


@query("""
    SELECT j.id AS job_id, COUNT(a.id) AS articles, COALESCE(SUM(length(a.title)), 0) AS chars FROM (SELECT id, [id % 200 + 1, id % 170 + 1, 100000] AS ids FROM jobs WHERE status = 'queued') j, unnest(j.ids) u(x) LEFT JOIN articles a ON a.id = u.x GROUP BY j.id""")
def hydrated_jobs(room: Newsroom) -> DataFrame:
    """Jobs with the rows that their ids name (DOM-44)."""
    ids = room.table("jobs").where("status = 'queued'").select(F.col("id").alias("job_id"), F.explode(F.array(F.col("id") % 200 + 1, F.col("id") % 170 + 1, F.lit(100000))).alias("id"))
    titles = room.table("articles").select("id", F.length("title").alias("n"), F.lit(1).alias("one"))
    named = titles.join(ids.select("id").distinct(), "id", "left_semi")  # few where many jobs name the same rows: no task joins a frequent id
    joined = ids.join(named, "id", "left").groupBy("job_id").agg(F.count("one").alias("articles"), F.coalesce(F.sum("n"), F.lit(0)).alias("chars"))
    return joined


@query("""
    WITH s AS (SELECT id, 0 AS part, id AS turn FROM articles WHERE id IN (5, 9, 31)), c AS (SELECT a.id, 1 AS part, row_number() OVER (ORDER BY sc.total_score DESC, a.id) AS turn FROM articles a JOIN article_scores sc ON sc.article_id = a.id WHERE a.id NOT IN (5, 9, 31))
    SELECT row_number() OVER (ORDER BY part, turn) AS place, id FROM (SELECT * FROM s UNION ALL SELECT * FROM c ORDER BY part, turn LIMIT 10) x""")
def digest_order(room: Newsroom) -> DataFrame:
    """A digest of ten: saved places first, then the best candidates (DOM-34)."""
    saved = room.table("articles").where(F.col("id").isin(5, 9, 31)).select("id", F.lit(0).alias("part"), F.col("id").cast("double").alias("turn"))
    scores = room.table("article_scores").select(F.col("article_id").alias("id"), F.lit(1).alias("part"), (-F.col("total_score")).alias("turn"))
    rest = scores.join(saved.select("id"), "id", "left_anti")
    ten = saved.unionByName(rest).orderBy("part", "turn", "id").limit(10)
    return ten.select(F.row_number().over(Window.orderBy("part", "turn", "id")).cast("long").alias("place"), "id")


@query("SELECT a.id, CASE WHEN trim(a.url) = '' THEN 'no_url' WHEN length(a.raw_text) < 60 THEN 'thin' WHEN regexp_matches(lower(a.raw_text), 'cloudflare|captcha') THEN 'blocked' WHEN a.published_at < TIMESTAMP '1996-01-01 00:00:00' THEN 'stale' ELSE 'ok' END AS gate FROM articles a")
def gated_articles(room: Newsroom) -> DataFrame:
    """The first gate that keeps a candidate's page out (FN-56, FN-57)."""
    gate = F.when(F.trim("url") == "", "no_url").when(F.length("raw_text") < 60, "thin").when(F.lower("raw_text").rlike("cloudflare|captcha"), "blocked")
    return room.table("articles").select("id", gate.when(F.col("published_at") < F.lit("1996-01-01").cast("timestamp_ntz"), "stale").otherwise("ok").alias("gate"))
