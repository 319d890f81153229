"""Articles through their processing stages: what is due, what comes of it, the log and the counts.

Rules stand in for the model, as no remote one is asked here: an article is relevant
where it has a frequent English or German word, texts under 200 characters get no
answer, and scores come from keywords.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import rules
from tidewire.operators import stages
from tidewire.plans.register import Register
from tidewire.plans.rulebook import _N, TAGS, _found
from tidewire.sources.newsroom import Newsroom

query = Register()
QUERIES, oracle_sql = query.queries, query.oracle_sql

STOPS = [("abuse", ["worthless", "scum"])]
CRITERIA = [(1, 40.0, ["tion", "keit", "ment"]), (2, 35.0, ["the", "und", "pour", "los"]), (3, 25.0, ["novel"])]
_STAGES = ["relevance", "summary", "translation", "tagging", "scoring"]
_LEAST = 200
_KEPT = ["id", "relevant", "relevance_reason", "summary", "title_ru", "tag_id", "total_score"]


def _rows(room: Newsroom) -> DataFrame:
    """Articles with the results that they have so far."""
    return room.sql("""
        SELECT a.id, a.title, a.raw_text, s.source_type AS category, c.summary, c.relevant, c.title_ru, CAST(NULL AS STRING) AS relevance_reason, t.tag_id, sc.total_score
        FROM articles a JOIN sources s ON s.id = a.source_id LEFT JOIN article_cards c ON c.article_id = a.id LEFT JOIN article_tags t ON t.article_id = a.id LEFT JOIN article_scores sc ON sc.article_id = a.id""")


def _due(rows: DataFrame) -> DataFrame:
    return rows.where("relevant IS NULL OR (relevant AND (summary IS NULL OR title_ru IS NULL OR tag_id IS NULL OR total_score IS NULL))")


def _stages() -> list[stages.Stage]:
    text, title = F.col("raw_text"), F.col("title")
    tokens = F.greatest(F.lit(1), F.floor(F.length(text) / 4))
    thin = F.when(F.length(text) < _LEAST, "no answer")
    rule = lambda fields, wrong=None: stages.by_rule(fields, model="rules", error=wrong, tokens=(tokens, F.lit(5)))
    relevant = F.lower(text).contains(" the ") | F.lower(text).contains(" und ")
    replies = {
        "relevance": rule({"relevant": relevant, "reason": F.when(relevant, "frequent word").otherwise("no frequent word")}),
        "summary": rule({"summary": F.substring(rules.summary_stub(title, text), 1, 900)}, thin),
        "translation": rule({"title_ru": title}),
        "tagging": rule({"tag_id": F.lit(0).cast("long")}),
        "scoring": rule({"scores": F.create_map().cast("map<int,double>")}),
    }
    return stages.article_stages(replies, tags=TAGS, stop_words=STOPS, criteria=CRITERIA, fallback_tag=9)


def _score_sql(t: str) -> str:
    one = lambda words: f"round(least(100.0, ({' + '.join(f'''CAST(contains({t}, '{w}') AS INT)''' for w in words)}) / {max(3.0, len(words) ** 0.5)} * 100), 2)"
    total = " + ".join(f"CAST(round(CAST({one(words)} AS DECIMAL(38,10)), 2) AS DOUBLE) * {weight} / 100" for _, weight, words in CRITERIA)
    return f"CAST(round(CAST(least(100.0, greatest(0.0, {total})) AS DECIMAL(38,10)), 2) AS DOUBLE)"


_BLOCK = f"CASE WHEN {_found('t', 'worthless')} THEN 'стоп-слово «worthless» (тег «abuse»)' WHEN {_found('t', 'scum')} THEN 'стоп-слово «scum» (тег «abuse»)' END"
_BASE = """
    WITH state AS (SELECT a.id, a.title, a.raw_text, s.source_type AS category, c.summary, c.relevant, c.title_ru, t.tag_id, sc.total_score FROM articles a JOIN sources s ON s.id = a.source_id
      LEFT JOIN article_cards c ON c.article_id = a.id LEFT JOIN article_tags t ON t.article_id = a.id LEFT JOIN article_scores sc ON sc.article_id = a.id)"""
_STUB = "substr(concat(trim(regexp_replace(title, '\\s+', ' ', 'g')), ': ', array_to_string(list_slice(regexp_split_to_array(regexp_replace(trim(regexp_replace(raw_text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), 1, 2), ' ')), 1, 900)"


def _processed(where: str) -> str:
    """DuckDB's way: every step as columns over the state before it."""
    return _BASE + f""",
    x AS (SELECT *, lower(concat(COALESCE(title, ''), ' ', COALESCE(summary, ''), ' ', COALESCE(raw_text, ''), ' ', COALESCE(category, ''))) AS t, contains(lower(raw_text), ' the ') OR contains(lower(raw_text), ' und ') AS told FROM state WHERE {where}),
    v AS (SELECT * EXCLUDE (relevant), {_BLOCK} AS blocked, relevant AS before FROM x),
    r AS (SELECT *, CASE WHEN blocked IS NOT NULL THEN FALSE ELSE COALESCE(before, told) END AS relevant, blocked IS NULL AND before IS NULL AS asked FROM v),
    s AS (SELECT *, relevant AND summary IS NULL AS due, relevant AND summary IS NULL AND length(raw_text) < {_LEAST} AS failed FROM r),
    n AS (SELECT *, CASE WHEN due AND NOT failed THEN {_STUB} ELSE summary END AS new_summary, relevant AND NOT failed AS on_ FROM s),
    w AS (SELECT *, lower(concat(COALESCE(title, ''), ' ', COALESCE(new_summary, ''), ' ', COALESCE(raw_text, ''), ' ', COALESCE(category, ''))) AS u FROM n),
    g AS (SELECT * EXCLUDE (t), u AS t, on_ AND title_ru IS NULL AND regexp_matches(title, '\\p{{L}}') AND length(regexp_replace(title, '[^\\p{{Cyrillic}}]', '', 'g')) < 0.5 * length(regexp_replace(title, '[^\\p{{L}}]', '', 'g')) AS foreign_ FROM w),
    k AS (SELECT *, {_N[1]} AS a, {_N[2]} AS b, {_N[3]} AS c FROM g)"""


_DUE = "relevant IS NULL OR (relevant AND (summary IS NULL OR title_ru IS NULL OR tag_id IS NULL OR total_score IS NULL))"
_TAG = "CASE WHEN greatest(a, b, c) = 0 THEN 9 WHEN a = greatest(a, b, c) THEN 1 WHEN b = greatest(a, b, c) THEN 2 ELSE 3 END"


@query(_processed(_DUE) + f"""
    SELECT id, relevant, CASE WHEN blocked IS NOT NULL THEN blocked WHEN asked THEN CASE WHEN told THEN 'frequent word' ELSE 'no frequent word' END END AS reason, new_summary AS summary,
           CASE WHEN on_ AND title_ru IS NULL AND trim(title) <> '' THEN substr(trim(title), 1, 200) ELSE title_ru END AS title_ru, COALESCE(CASE WHEN on_ AND tag_id IS NULL THEN {_TAG} ELSE tag_id END, -1) AS tag_id,
           CASE WHEN on_ AND total_score IS NULL THEN {_score_sql('t')} ELSE total_score END AS total_score, failed FROM k""")
def processed_articles(room: Newsroom) -> DataFrame:
    """What comes of the articles that lack a stage; -1 is no tag (DOM-1)."""
    done = stages.process(_due(_rows(room)), _stages(), error_stage="pipeline", keep=_KEPT)
    return done.select("id", "relevant", F.col("relevance_reason").alias("reason"), "summary", "title_ru", F.coalesce("tag_id", F.lit(-1)).alias("tag_id"), "total_score", F.exists("runs", lambda r: r["status"] == "error").alias("failed"))


@query(_processed(_DUE) + """
    SELECT COUNT(*) AS processed, COUNT(*) FILTER (WHERE relevant) AS relevant, COUNT(*) FILTER (WHERE NOT relevant) AS rejected, COUNT(*) FILTER (WHERE failed) AS errors, COUNT(*) FILTER (WHERE asked) AS relevance,
           COUNT(*) FILTER (WHERE due AND NOT failed) AS summary, COUNT(*) FILTER (WHERE foreign_) AS translation, COUNT(*) FILTER (WHERE on_ AND tag_id IS NULL) AS tagging, COUNT(*) FILTER (WHERE on_ AND total_score IS NULL) AS scoring FROM k""")
def stage_counts(room: Newsroom) -> DataFrame:
    """Counts of one run over all articles that lack a stage (DOM-1)."""
    return stages.counts(stages.process(_due(_rows(room)), _stages(), error_stage="pipeline", keep=_KEPT), _STAGES)


@query(_processed(_DUE) + """,
    l AS (SELECT id, length(raw_text) AS n, unnest([CASE WHEN asked THEN 'relevance' END, CASE WHEN due THEN CASE WHEN failed THEN 'pipeline' ELSE 'summary' END END, CASE WHEN foreign_ THEN 'translation' END, CASE WHEN on_ AND tag_id IS NULL THEN 'tagging' END, CASE WHEN on_ AND total_score IS NULL THEN 'scoring' END]) AS stage FROM k)
    SELECT stage, CASE WHEN stage = 'pipeline' THEN 'error' ELSE 'ok' END AS status, COUNT(*) AS runs, SUM(CASE WHEN stage = 'pipeline' THEN 0 ELSE greatest(1, n // 4) END) AS input_tokens FROM l WHERE stage IS NOT NULL GROUP BY ALL""")
def stage_log(room: Newsroom) -> DataFrame:
    """The log of that run by stage and status (DOM-3)."""
    log = stages.run_log(stages.process(_due(_rows(room)), _stages(), error_stage="pipeline", keep=_KEPT), "id")
    return log.groupBy("stage", "status").agg(F.count("*").alias("runs"), F.sum("input_tokens").alias("input_tokens"))


@query(_BASE + """,
    d AS (SELECT id, length(raw_text) < 200 AS thin FROM state WHERE relevant AND summary IS NULL)
    SELECT id, CASE WHEN thin THEN 'error' ELSE 'ok' END AS status, 'summary' AS stage FROM d""")
def summary_stage(room: Newsroom) -> DataFrame:
    """One stage by itself, over the articles that wait for it (DOM-2)."""
    only = [s for s in _stages() if s.name == "summary"]
    return stages.run_log(stages.process(_rows(room).where("relevant AND summary IS NULL"), only, keep=["id"]), "id").select("id", "status", "stage")


def _verdict(row: dict) -> dict:
    """A client's answer, by rule: ``relevant`` where a frequent word occurs; an error for thin texts."""
    if len(row["text"]) < _LEAST:
        raise ValueError("no answer")
    low = row["text"].lower()
    return {"relevant": " the " in low or " und " in low, "reason": "asked", "model": "client"}


@query(f"""
    WITH x AS (SELECT a.id, raw_text, lower(concat(COALESCE(title, ''), ' ', COALESCE(c.summary, ''), ' ', raw_text, ' ', source_type)) AS t, COALESCE(c.status = 'digest', FALSE) AS held FROM articles a JOIN sources s ON s.id = a.source_id LEFT JOIN article_cards c ON c.article_id = a.id)
    SELECT id, CASE WHEN {_BLOCK} IS NULL AND length(raw_text) < {_LEAST} THEN 'error' WHEN {_BLOCK} IS NULL AND (contains(lower(raw_text), ' the ') OR contains(lower(raw_text), ' und ')) THEN 'kept' WHEN held THEN 'skipped_in_digest' ELSE 'deleted' END AS outcome FROM x""")
def rechecked_articles(room: Newsroom) -> DataFrame:
    """Relevance asked anew of every article by a client in batches; what a digest holds stays (DOM-2, DOM-3)."""
    asked = stages.by_model(lambda: _verdict, {"text": F.col("raw_text")}, "relevant boolean, reason string")
    two = [s if s.name == "stop_words" else stages.Stage(s.name, s.lacking, asked, s.changes, s.stops) for s in _stages()[:2]]
    protected = room.table("article_cards").where("status = 'digest'").select(F.col("article_id").alias("id"))
    return stages.recheck(_rows(room), two, protected, "id").select("id", "outcome")


@query(f"""
    WITH j AS (SELECT DISTINCT id AS job_id, unnest([id % 150 + 1, id % 170 + 1]) AS x FROM jobs WHERE status = 'running' AND attempts < 3 AND lease_expires_at >= TIMESTAMP '1996-01-01 00:00:00'),
    r AS (SELECT j.job_id, a.id, raw_text, lower(concat(title, '  ', raw_text, ' ', source_type)) AS t FROM j JOIN articles a ON a.id = j.x JOIN sources s ON s.id = a.source_id),
    v AS (SELECT *, {_BLOCK} IS NULL AND (contains(lower(raw_text), ' the ') OR contains(lower(raw_text), ' und ')) AS good FROM r)
    SELECT job_id, COUNT(*) AS articles, COUNT(*) FILTER (WHERE good AND length(raw_text) >= {_LEAST}) AS scored, COUNT(*) FILTER (WHERE NOT good) AS rejected, COUNT(*) FILTER (WHERE good AND length(raw_text) < {_LEAST}) AS errors FROM v GROUP BY job_id""")
def batch_results(room: Newsroom) -> DataFrame:
    """Results of batch jobs by those that still hold their lease (DOM-9)."""
    jobs = room.table("jobs").select(F.col("id").alias("job_id"), "status", "lease_expires_at", F.lit("t").alias("lease_token"), F.when(F.col("attempts") < 3, "t").otherwise("u").alias("held_token"), F.array(F.col("id") % 150 + 1, F.col("id") % 170 + 1).alias("article_ids"))
    done = stages.job_results(jobs, _rows(room), _stages(), F.lit("1996-01-01").cast("timestamp_ntz"))
    return done.groupBy("job_id").agg(F.count("*").alias("articles"), F.count("total_score").alias("scored"), F.count_if(~F.col("relevant")).alias("rejected"), F.count_if(F.exists("runs", lambda r: r["status"] == "error")).alias("errors"))
