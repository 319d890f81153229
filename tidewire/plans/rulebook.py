"""Text, key and scoring rules over the newsroom tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import rules
from tidewire.functions import text as fn
from tidewire.operators import similarity
from tidewire.plans.register import Register
from tidewire.plans.reports import AS_OF
from tidewire.sources.newsroom import Newsroom

query = Register()
QUERIES, oracle_sql = query.queries, query.oracle_sql

TAGS = [(1, ["ing", "for the", "reing"]), (2, ["worthless", "idiot", "clown"]), (3, ["schaft", "chlich", "keit", "und"])]
STOPS = [("abuse", ["worthless", "scum"]), ("other", ["ing"])]


def _found(text: str, word: str) -> str:
    """DuckDB test of a keyword, for words of plain letters."""
    if len(word) <= 4 or " " in word:
        return f"contains({text}, '{word}')"
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_]){word}($|[^\\p{{L}}\\p{{N}}_])')"


_ALL = "lower(concat(COALESCE(title, ''), ' ', COALESCE(raw_text, ''), ' ', COALESCE(language, '')))"
_N = {tag: "(" + " + ".join(f"CAST({_found('t', w)} AS INT)" for w in words) + ")" for tag, words in TAGS}
_KEY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^https?://', ''), '[#?].*$', ''), '/+$', ''), '^www\\.', '')"


def _search(room: Newsroom) -> DataFrame:
    return room.table("articles").select("id", rules.search_text(F.col("title"), F.col("raw_text"), F.col("language")).alias("t"))


@query(f"""
    WITH x AS (SELECT id, {_ALL} AS t FROM articles), n AS (SELECT id, {_N[1]} AS a, {_N[2]} AS b, {_N[3]} AS c FROM x)
    SELECT id, CASE WHEN greatest(a, b, c) = 0 THEN 9 WHEN a = greatest(a, b, c) THEN 1 WHEN b = greatest(a, b, c) THEN 2 ELSE 3 END AS tag_id,
           CASE WHEN greatest(a, b, c) = 0 THEN 0.15 ELSE CAST(round(CAST(least(0.9, 0.35 + greatest(a, b, c) * 0.08) AS DECIMAL(38,10)), 2) AS DOUBLE) END AS confidence, greatest(a, b, c) AS matches FROM n""")
def keyword_tags(room: Newsroom) -> DataFrame:
    """The tag with the most keywords in an article (DOM-5, FN-15, FN-16)."""
    return _search(room).select("id", rules.keyword_tag(F.col("t"), TAGS, 9).alias("k")).select("id", "k.*")


@query(f"""
    WITH x AS (SELECT id, {_ALL} AS t FROM articles) SELECT id, CASE WHEN {_found('t', 'worthless')} THEN 'стоп-слово «worthless» (тег «abuse»)' WHEN {_found('t', 'scum')} THEN 'стоп-слово «scum» (тег «abuse»)' ELSE 'стоп-слово «ing» (тег «other»)' END AS reason
    FROM x WHERE {_found('t', 'worthless')} OR {_found('t', 'scum')} OR {_found('t', 'ing')}""")
def stop_word_blocks(room: Newsroom) -> DataFrame:
    """Articles that a stop word of a tag keeps out, with the reason (DOM-4)."""
    return _search(room).select("id", rules.stop_word_reason(F.col("t"), STOPS).alias("reason")).where("reason IS NOT NULL")


@query("""
    SELECT s.article_id, CAST(round(CAST(least(100.0, greatest(0.0, SUM(CAST(round(CAST(greatest(COALESCE(ai, keyword_score), keyword_score * 0.2 + COALESCE(ai, keyword_score) * 0.8) AS DECIMAL(38,10)), 2) AS DOUBLE) * c.weight / 100))) AS DECIMAL(38,10)), 2) AS DOUBLE) AS total_score
    FROM article_scores s JOIN (SELECT *, CASE WHEN criterion_id <> 2 THEN least(100.0, greatest(0.0, ai_score * 1.5)) END AS ai FROM article_score_items) i ON i.article_score_id = s.id JOIN scoring_criteria c ON c.id = i.criterion_id GROUP BY s.article_id""")
def score_payloads(room: Newsroom) -> DataFrame:
    """Totals of blended scores, where a criterion may lack the model's (DOM-7)."""
    criteria = room.table("scoring_criteria").select(F.col("id").alias("criterion_id"), "weight")
    ai = F.when(F.col("criterion_id") != 2, F.col("ai_score") * 1.5)
    items = room.table("article_score_items").join(F.broadcast(criteria), "criterion_id").select(F.col("article_score_id").alias("id"), (rules.final_score(F.col("keyword_score"), ai) * F.col("weight") / 100).alias("w"))
    total = rules.decimal_round(rules.clamp(F.sum("w")), 2).alias("total_score")
    return room.table("article_scores").select("id", "article_id").join(items, "id").groupBy("article_id").agg(total)


@query("SELECT round(SUM(weight), 2) AS total, round(SUM(weight), 2) = 100 AS valid FROM scoring_criteria WHERE enabled")
def criteria_weights(room: Newsroom) -> DataFrame:
    """Whether the weights of the criteria in use add up to 100 (DOM-8, MUT-4)."""
    total = F.round(F.sum("weight"), 2)
    return room.table("scoring_criteria").where("enabled").agg(total.alias("total"), (total == 100).alias("valid"))


@query("""
    SELECT id, CAST(round(CAST(least(100.0, greatest(0.0, relevant_articles * 18 + tested_articles * 2 + COALESCE(avg_score, 0) * 0.45 - noise_count * 10 - (id % 3) * 6 + CASE recommended_action WHEN 'add' THEN 25 WHEN 'test_more' THEN 12 WHEN 'human_review' THEN 6 WHEN 'reject' THEN -20 ELSE 0 END)) AS DECIMAL(38,10)), 2) AS DOUBLE) AS learning_score FROM source_candidates""")
def learning_scores(room: Newsroom) -> DataFrame:
    """What a candidate's tests teach (DOM-11)."""
    c = F.col
    score = rules.learning_score(c("tested_articles"), c("relevant_articles"), c("avg_score"), c("noise_count"), c("id") % 3, c("recommended_action"))
    return room.table("source_candidates").select("id", score.alias("learning_score"))


@query("""
    SELECT id, CASE WHEN tested_articles = 0 THEN 'сомнительный' WHEN q >= 65 AND relevant_articles >= 3 THEN 'сильный' WHEN q >= 40 AND relevant_articles > 0 THEN 'перспективный' WHEN q <= 20 THEN 'шумный' ELSE 'сомнительный' END AS label,
           concat_ws(',', CASE WHEN tested_articles < 5 THEN 'few' END, CASE WHEN relevant_articles = 0 THEN 'irrelevant' END, CASE WHEN noise_count > relevant_articles THEN 'noisy' END) AS risks
    FROM (SELECT *, COALESCE(avg_score, 0) + id % 7 * 5 AS q FROM source_candidates) x""")
def candidate_labels(room: Newsroom) -> DataFrame:
    """Labels and risks of tested candidates (DOM-14)."""
    c = F.col
    label = rules.quality_label(F.coalesce("avg_score", F.lit(0)) + c("id") % 7 * 5, c("tested_articles"), c("relevant_articles"))
    return room.table("source_candidates").select("id", label.alias("label"), F.array_join(rules.quality_risks(c("tested_articles"), c("relevant_articles"), c("noise_count")), ",").alias("risks"))


@query("""
    WITH v AS (SELECT id, CASE id % 8 WHEN 0 THEN 'Good' WHEN 1 THEN ' шум ' WHEN 2 THEN 'duplicate' WHEN 3 THEN 'watch_later' WHEN 4 THEN 'unknown' WHEN 5 THEN 'bad_translation' WHEN 6 THEN 'strong_signal' END AS raw, CASE id % 5 WHEN 0 THEN '0.7' WHEN 1 THEN '140' WHEN 2 THEN 'x' WHEN 3 THEN '-3' WHEN 4 THEN '55.555' END AS s FROM signals)
    SELECT id, COALESCE(CASE id % 8 WHEN 0 THEN 'approved' WHEN 1 THEN 'reject' WHEN 2 THEN 'merge_duplicate' WHEN 3 THEN 'watch_later' WHEN 5 THEN 'bad_translation' WHEN 6 THEN 'strong_signal' END, 'none') AS verdict,
           CASE id % 8 WHEN 0 THEN 90 WHEN 1 THEN -80 WHEN 2 THEN 85 WHEN 3 THEN 40 WHEN 5 THEN 45 WHEN 6 THEN 100 ELSE 0 END AS weight, CASE id % 5 WHEN 0 THEN 70.0 WHEN 1 THEN 100.0 WHEN 4 THEN 55.56 ELSE 0.0 END AS score FROM v""")
def verdict_forms(room: Newsroom) -> DataFrame:
    """Verdicts by their usual names, their weight, and scores as per cent (FN-45, FN-50)."""
    pick = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % n + 1).cast("int"))
    raw = pick(8, ["Good", " шум ", "duplicate", "watch_later", "unknown", "bad_translation", "strong_signal", None])
    verdict = rules.normalized_verdict(raw)
    return room.table("signals").select("id", F.coalesce(verdict, F.lit("none")).alias("verdict"), rules.verdict_score(verdict).alias("weight"), rules.normalized_score(pick(5, ["0.7", "140", "x", "-3", "55.555"])).alias("score"))


@query(f"""
    SELECT page_id, {_KEY.format('url')} AS address, concat('query:', substr(sha1(concat('query:t:', lower(trim(url)))), 1, 16)) AS memory, concat('hint:', substr(sha1(lower(concat('hint:T:', url))), 1, 20)) AS feedback FROM pages""")
def page_keys(room: Newsroom) -> DataFrame:
    """Keys of addresses and of agent memory (FN-43, FN-54, FN-55)."""
    rows = room.table("pages")
    return rows.select("page_id", rules.address_key(F.col("url")).alias("address"), rules.memory_key("query", F.col("url"), F.lit("T")).alias("memory"), rules.feedback_key("hint", F.lit("T"), F.col("url")).alias("feedback"))


@query(f"""
    SELECT s.id, substr(sha256(CASE WHEN COUNT(DISTINCT {_KEY.format('e.source_url')}) = 1 THEN concat('url:', MIN({_KEY.format('e.source_url')})) ELSE concat('fact:', array_to_string(list_slice(list_filter(regexp_extract_all(lower(s.title), '[a-zа-яё0-9]{{3,}}'), lambda w: w NOT IN ('the', 'and', 'for', 'with', 'from')), 1, 10), '-')) END), 1, 24) AS signal_key
    FROM signals s JOIN signal_evidence e ON e.signal_id = s.id GROUP BY s.id, s.title""")
def signal_keys(room: Newsroom) -> DataFrame:
    """Keys of signals by their only address or their fact (SIM-13)."""
    urls = room.table("signal_evidence").groupBy(F.col("signal_id").alias("id")).agg(F.collect_set("source_url").alias("urls"))
    return room.table("signals").join(urls, "id").select("id", rules.signal_key(F.col("title"), F.col("urls"), fn.fact_fingerprint(F.col("title"))).alias("signal_key"))


@query("SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(replace(lower(title), 'ё', 'е'), '[a-zа-я0-9]{5,}'), lambda w: substr(w, 1, 6)), lambda s: s NOT IN ('reting', 'chlich') AND NOT regexp_full_match(s, '[0-9]+')))), ' ') AS stems FROM articles")
def title_stems(room: Newsroom) -> DataFrame:
    """Beginnings of the words of titles (FN-51)."""
    return room.table("articles").select("id", F.array_join(F.array_sort(rules.term_stems(F.col("title"), ["reting", "chlich"])), " ").alias("stems"))


@query("""SELECT id, array_to_string(list_slice(list_distinct_in_order, 1, 8), '|') AS companies FROM (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i AND upper(x) NOT IN ('AI', 'HSE', 'PTW', 'LOTO', 'SIMOPS', 'RSS')) AS list_distinct_in_order
    FROM (SELECT id, regexp_extract_all(regexp_replace(title, '[À-ɏͰ-ӿ]', '_', 'g'), '\\b[A-Z][A-Za-z0-9&.-]{2,}(?:\\s+[A-Z][A-Za-z0-9&.-]{2,}){0,2}\\b') AS l FROM articles) x) y""")
def company_names(room: Newsroom) -> DataFrame:
    """Capitalised phrases of titles (FN-48)."""
    return room.table("articles").select("id", F.array_join(rules.companies(F.col("title")), "|").alias("companies"))


@query("""SELECT id, CASE WHEN id % 2 = 0 AND length(regexp_replace(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), '[^a-z]', '', 'g')) > greatest(8, 2 * length(regexp_replace(lower(title), '[^а-яё]', '', 'g'))) THEN 'Добыча' WHEN trim(title) = '' THEN CASE WHEN id % 2 = 0 THEN 'Добыча' ELSE 'Topic' END ELSE trim(regexp_replace(title, '\\s+', ' ', 'g')) END AS theme FROM articles""")
def themes(room: Newsroom) -> DataFrame:
    """Themes in the script of their topic (FN-46)."""
    topic = F.when(F.col("id") % 2 == 0, "Добыча").otherwise("Topic")
    return room.table("articles").select("id", rules.normalized_theme(F.col("title"), topic).alias("theme"))


@query("SELECT stage, model, CAST(round(CAST(SUM((input_tokens * 0.25 + output_tokens * 2.0) / 1000000) AS DECIMAL(38,10)), 6) AS DOUBLE) AS cost FROM ai_runs GROUP BY stage, model")
def token_costs(room: Newsroom) -> DataFrame:
    """What runs cost by their tokens (FN-58, DOM-40)."""
    cost = F.sum(rules.token_cost(F.col("input_tokens"), F.col("output_tokens"), 0.25, 2.0))
    return room.table("ai_runs").groupBy("stage", "model").agg(rules.decimal_round(cost, 6).alias("cost"))


@query("SELECT id, CAST(round(CAST(greatest(epoch(t - date_trunc('day', t)) / 3600.0, 0.01) AS DECIMAL(38,10)), 4) AS DOUBLE) AS hours FROM (SELECT id, date_trunc('second', created_at) + INTERVAL 3 HOURS AS t FROM signal_feedback) x")
def hours_of_day(room: Newsroom) -> DataFrame:
    """Hours since midnight in another time zone (FN-62)."""
    return room.table("signal_feedback").select("id", rules.hours_since_midnight(F.col("created_at").cast("timestamp")).alias("hours"))


@query("SELECT source_id, sha256(string_agg(url, chr(10) ORDER BY id)) AS listing_hash FROM (SELECT source_id, id, url, row_number() OVER (PARTITION BY source_id ORDER BY id) AS rn FROM articles) x WHERE rn <= 10 GROUP BY source_id")
def listing_hashes(room: Newsroom) -> DataFrame:
    """Hashes of the first addresses of listings (FN-26, FN-27, SRC-14)."""
    lists = room.table("articles").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "url"))), lambda x: x["url"]).alias("urls"))
    return lists.select("source_id", rules.listing_hash(F.col("urls")).alias("listing_hash"))


@query("""
    WITH x AS (SELECT id, trim(regexp_replace(raw_text, '\\s+', ' ', 'g')) AS w FROM articles), y AS (SELECT id, w, string_split_regex(w, '[.!?]\\s+')[1] AS f FROM x)
    SELECT id, CASE WHEN w = '' THEN 'Telegram post' ELSE trim(substr(CASE WHEN length(f) + CASE WHEN length(f) < length(w) THEN 1 ELSE 0 END < 25 THEN w WHEN length(f) < length(w) THEN substr(w, 1, length(f) + 1) ELSE f END, 1, 140)) END AS title FROM y""")
def post_titles(room: Newsroom) -> DataFrame:
    """Titles of posts by their first sentence (SRC-16)."""
    return room.table("articles").select("id", rules.post_title(F.col("raw_text")).alias("title"))


@query("""
    SELECT id, CASE id % 6 WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN name WHEN 3 THEN name ELSE 'none' END AS channel, CASE id % 6 WHEN 5 THEN 'none' WHEN 0 THEN concat('https://@', name) WHEN 1 THEN concat('https://t.me/s/', name, '/12') WHEN 2 THEN concat('https://', name) WHEN 3 THEN concat('http://www.telegram.me/', name, '?x=1') ELSE concat('https://vk.com/', name) END AS address FROM sources""")
def channel_names(room: Newsroom) -> DataFrame:
    """Channels and seed addresses by their spellings (SRC-15, SRC-21)."""
    n = F.col("name")
    spelled = F.when(F.col("id") % 6 == 0, F.concat(F.lit("@"), n)).when(F.col("id") % 6 == 1, F.concat(F.lit("https://t.me/s/"), n, F.lit("/12"))).when(F.col("id") % 6 == 2, n).when(F.col("id") % 6 == 3, F.concat(F.lit("http://www.telegram.me/"), n, F.lit("?x=1"))).when(F.col("id") % 6 == 4, F.concat(F.lit("vk.com/"), n)).otherwise(" ")
    return room.table("sources").select("id", F.coalesce(rules.channel_name(spelled), F.lit("none")).alias("channel"), F.coalesce(rules.seed_address(spelled), F.lit("none")).alias("address"))


@query("SELECT doc_id, len(list_distinct(list_filter(list_transform(string_split(COALESCE(text, ''), chr(10)), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> ''))) AS paragraphs FROM documents")
def paragraphs(room: Newsroom) -> DataFrame:
    """How many different paragraphs a text has (SET-6)."""
    return room.table("documents").select("doc_id", F.size(rules.distinct_paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


@query("SELECT id, concat(name, '; A') AS tags FROM sources")
def tag_lists(room: Newsroom) -> DataFrame:
    """Values of a cell, each once whatever its case (SET-5)."""
    cell = F.concat("name", F.lit("; A\n"), F.upper("name"), F.lit(";a ; "))
    return room.table("sources").select("id", F.array_join(rules.split_values(cell), "; ").alias("tags"))


@query("""
    WITH x AS (SELECT id, CASE id % 4 WHEN 0 THEN '1997-02-03' WHEN 1 THEN 'soon' WHEN 2 THEN '2099-01-01 10:00:00' ELSE NULL END AS a, '1996-05-06T07:08:09' AS b FROM articles)
    SELECT id, CASE WHEN id % 4 = 0 THEN TIMESTAMP '1997-02-03 00:00:00' ELSE TIMESTAMP '1996-05-06 07:08:09' END AS published FROM x""")
def first_dates(room: Newsroom) -> DataFrame:
    """The first date of an entry that parses and is not in the future (FN-3, FN-25)."""
    a = F.when(F.col("id") % 4 == 0, "1997-02-03").when(F.col("id") % 4 == 1, "soon").when(F.col("id") % 4 == 2, "2099-01-01 10:00:00")
    found = rules.first_date(a, F.lit("1996-05-06T07:08:09"), as_of=F.lit(AS_OF).cast("timestamp"))
    return room.table("articles").select("id", found.cast("timestamp_ntz").alias("published"))


@query("SELECT id, CASE WHEN language = 'en' AND n >= 40 AND (m < 40 OR n >= 2 * m) THEN 'ok' WHEN n < 40 THEN 'too_short' WHEN NOT (m < 40 OR n >= 2 * m) THEN 'no_gain' ELSE 'mismatch' END AS status FROM (SELECT id, language, length(raw_text) AS n, length(title) * (id % 5) AS m FROM articles) x")
def extraction_status(room: Newsroom) -> DataFrame:
    """What became of an extracted text against the one at hand (FN-32)."""
    status = rules.extraction_status(F.length("raw_text"), F.length("title") * (F.col("id") % 5), F.col("language") == "en", least=40)
    return room.table("articles").select("id", status.alias("status"))


@query("SELECT id, CAST(least(1.0, greatest(0.1, COALESCE(total_score, 50) / 100)) AS DOUBLE) AS strength, CAST(length(substr(raw_text, 1, 900)) AS INTEGER) AS fact_chars FROM articles a LEFT JOIN article_scores s ON s.article_id = a.id".replace("SELECT id,", "SELECT a.id,"))
def article_evidence(room: Newsroom) -> DataFrame:
    """Articles as evidence: strength by score, and a fact of at most 900 characters (DOM-41)."""
    scores = room.table("article_scores").select(F.col("article_id").alias("id"), "total_score")
    rows = room.table("articles").select("id", "raw_text").join(scores, "id", "left")
    return rows.select("id", rules.clamp(F.coalesce("total_score", F.lit(50.0)) / 100, 0.1, 1.0).alias("strength"), F.length(F.substring("raw_text", 1, 900)).alias("fact_chars"))


@query("""
    WITH k AS (SELECT id, theme, trim(lower(regexp_replace(regexp_replace(concat(title, ' (x) / ', theme, ';?'), '\\(.*?\\)', '', 'g'), '[«»"''?]', '', 'g'))) AS c FROM signals)
    SELECT DISTINCT id, trim(regexp_replace(p, '\\s+', ' ', 'g')) AS company FROM (SELECT id, unnest(string_split_regex(c, '\\s*[/;]\\s*')) AS p FROM k) x WHERE length(regexp_replace(p, '[^a-zа-яё]', '', 'g')) >= 2""")
def company_keys(room: Newsroom) -> DataFrame:
    """Keys of companies that a signal names (SIM-2)."""
    named = F.array(F.concat("title", F.lit(" (x) / "), "theme", F.lit(";?")), F.lit("не указана"))
    return room.table("signals").select("id", F.explode(similarity.company_keys(named)).alias("company"))


@query("""
    WITH c AS (SELECT id, id % 3 = 0 AS is_new, id % 4 = 1 AS fresh, id % 5 = 0 AS reviewed, lower(theme) AS k FROM signals),
    p AS (SELECT a.k AS company, a.id, b.id AS other FROM c a JOIN c b ON a.k = b.k AND a.id <> b.id WHERE a.is_new OR b.is_new OR (a.fresh AND NOT a.reviewed) OR (b.fresh AND NOT b.reviewed))
    SELECT m.company, m.id, m.links, CAST(p.other AS VARCHAR) AS other FROM (SELECT company, id, count(*) AS links FROM p GROUP BY company, id) m LEFT JOIN p ON p.company = m.company AND p.id = m.id AND p.other > m.id""")
def company_pairs(room: Newsroom) -> DataFrame:
    """All pairs of cards that name a company and are to be judged, each at its smaller id, with the number of pairs that this is in; a card without a greater one stands alone (SIM-5, SIM-6)."""
    cards = room.table("signals").select("id", (F.col("id") % 3 == 0).alias("is_new"), (F.col("id") % 4 == 1).alias("fresh"), (F.col("id") % 5 == 0).alias("reviewed"), F.array(F.lower("theme")).alias("keys"))
    return similarity.linked_pairs(cards, "keys").withColumnRenamed("key", "company").withColumn("other", F.col("other").cast("string"))


@query("""
    WITH p AS (SELECT a.id AS id_a, b.id AS id_b, a.score + b.score AS weight FROM signals a JOIN signals b ON a.theme = b.theme AND a.id < b.id)
    SELECT id_a, id_b FROM p ORDER BY weight DESC, id_a, id_b LIMIT 400""")
def judged_pairs(room: Newsroom) -> DataFrame:
    """The pairs that are judged first, up to the limit of one run, by the scores of both (a limit as in SIM-8; its order by overlap is not here)."""
    return similarity.heaviest_pairs(room.table("signals").select("id", "score", F.array("theme").alias("keys")), "keys", most=400)


@query("""
    WITH RECURSIVE d AS (SELECT id, CASE WHEN id % 10 = 7 THEN id + 1 WHEN id % 10 = 8 THEN id - 1 ELSE id - 1 END AS target FROM signals WHERE id % 10 NOT IN (0, 5)),
    w AS (SELECT id, target, 0 AS depth FROM d UNION ALL SELECT w.id, d.target, depth + 1 FROM w JOIN d ON d.id = w.target WHERE depth < 12)
    SELECT id, COALESCE(CAST(MIN(target) FILTER (WHERE target % 10 IN (0, 5)) AS VARCHAR), 'cycle') AS root FROM w GROUP BY id""")
def duplicate_roots(room: Newsroom) -> DataFrame:
    """The kept card at the end of each chain of duplicates, or that the chain is a circle (SIM-10)."""
    rows = room.table("signals").select("id")
    target = F.when(F.col("id") % 10 == 7, F.col("id") + 1).otherwise(F.col("id") - 1)
    kept = (F.col("id") % 10).isin(0, 5)
    return similarity.duplicate_roots(rows.where(~kept).select("id", target.alias("target")), rows.where(kept))
