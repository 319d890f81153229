"""Relational reports of the newsroom, as parameterised queries.

Each report is a function of keyword parameters that returns one SQL text over the
tables and views of ``tidewire.sources.newsroom``. Spark plans it; DuckDB can run the
same text, which is how results are checked. Times relative to now are an explicit
``as_of``. Null order and tie-breakers are always spelled out; numbers are rounded
through decimals, so that both engines round alike.
"""

from __future__ import annotations

AS_OF = "2001-08-02 00:00:00"


def quoted(value: str) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def rounded(expression: str, digits: int) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def _ts(value: str) -> str:
    return f"CAST({quoted(value)} AS TIMESTAMP)"


def _back(as_of: str, days: int) -> str:
    return f"({_ts(as_of)} - INTERVAL {int(days)} DAYS)"


def months_back(as_of: str, months: int) -> str:
    """First day of the month ``months`` before, as text."""
    year, month = int(as_of[:4]), int(as_of[5:7])
    at = year * 12 + month - 1 - months
    return f"{at // 12:04d}-{at % 12 + 1:02d}-01 00:00:00"


def _month(ts: str) -> str:
    return f"substr(CAST({ts} AS STRING), 1, 7)"


def _in_month(ts: str, month: str) -> str:
    """Whether a time lies in a month, as a range that a scan can use."""
    at = int(month[:4]) * 12 + int(month[5:7])
    return f"{ts} >= {_ts(month + '-01 00:00:00')} AND {ts} < {_ts(f'{at // 12:04d}-{at % 12 + 1:02d}-01 00:00:00')}"


VISIBLE = "c.relevant IS NOT FALSE AND NOT a.pending_deletion AND s.archived_at IS NULL"
STATES = ["new", "digest", "archive", "noise", "duplicate"]


# --- the article feed -------------------------------------------------------


def feed_articles(*, user_id: int = 1, search: str | None = None, source: str | None = None, tag: str | None = None, status: str | None = None, language: str | None = None, min_score: float | None = None, max_score: float | None = None, date_from: str | None = None, date_to: str | None = None, sort: str = "score_desc", changed_only: bool = False, limit: int = 200) -> str:
    """The ranked feed: a star join with optional filters and three orders (JN-22)."""
    state = "COALESCE(u.status, 'new')"
    day = "CAST(COALESCE(a.published_at, a.collected_at) AS DATE)"
    where = [VISIBLE]
    if status:
        where.append(f"{state} = {quoted(status)}")
    elif changed_only:
        where.append(f"{state} <> 'new'")
    else:
        where.append(f"{state} NOT IN ('noise', 'duplicate', 'archive')")
    if min_score is not None:
        where.append(f"(sc.total_score IS NULL OR sc.total_score >= {float(min_score)})")
    if max_score is not None:
        where.append(f"COALESCE(sc.total_score, 0) <= {float(max_score)}")
    if source:
        where.append(f"s.name = {quoted(source)}")
    if tag:
        where.append(f"(t.name = {quoted(tag)} OR p.name = {quoted(tag)})")
    if language:
        where.append(f"a.language = {quoted(language)}")
    if date_from:
        where.append(f"{day} >= CAST({quoted(date_from)} AS DATE)")
    if date_to:
        where.append(f"{day} <= CAST({quoted(date_to)} AS DATE)")
    if search:
        text = "lower(concat_ws(' ', COALESCE(c.title_ru, ''), COALESCE(a.title, ''), COALESCE(a.raw_text, ''), COALESCE(c.summary, ''), COALESCE(t.name, ''), COALESCE(p.name, '')))"
        where.append(f"{text} LIKE {quoted('%' + search.lower() + '%')}")
    orders = {
        "score_desc": "COALESCE(sc.total_score, 0) DESC, a.published_at DESC NULLS LAST, a.id DESC",
        "date_desc": "COALESCE(a.published_at, a.collected_at) DESC NULLS LAST, a.id DESC",
        "score_asc": "COALESCE(sc.total_score, 0) ASC, a.published_at DESC NULLS LAST, a.id DESC",
    }
    return f"""
        SELECT a.id, a.title, c.title_ru, s.name AS source, {state} AS status, COALESCE(sc.total_score, 0.0) AS score,
               CASE WHEN t.id IS NULL THEN 'untagged' WHEN p.id IS NULL THEN t.name ELSE concat(p.name, ' / ', t.name) END AS tag_path,
               a.published_at, a.language
        FROM articles a
        JOIN sources s ON s.id = a.source_id
        LEFT JOIN article_cards c ON c.article_id = a.id
        LEFT JOIN article_scores sc ON sc.article_id = a.id
        LEFT JOIN article_tags tg ON tg.article_id = a.id
        LEFT JOIN tags t ON t.id = tg.tag_id
        LEFT JOIN tags p ON p.id = t.parent_id
        LEFT JOIN user_article_states u ON u.article_id = a.id AND u.user_id = {int(user_id)}
        WHERE {' AND '.join(where)}
        ORDER BY {orders[sort]} LIMIT {min(int(limit), 5000)}"""


def articles_by_ids(*, ids: tuple[int, ...] = (9, 3, 27, 14, 3)) -> str:
    """Article details in the caller's order (JN-1, JN-16)."""
    asked = ", ".join(f"({k}, {int(i)})" for k, i in enumerate(dict.fromkeys(ids)))
    return f"""
        WITH asked AS (SELECT pos, article_id FROM (VALUES {asked}) AS v(pos, article_id))
        SELECT q.pos, a.id, a.title, s.name AS source, c.summary, sc.total_score, t.name AS tag
        FROM asked q JOIN articles a ON a.id = q.article_id JOIN sources s ON s.id = a.source_id
        LEFT JOIN article_cards c ON c.article_id = a.id LEFT JOIN article_scores sc ON sc.article_id = a.id
        LEFT JOIN article_tags tg ON tg.article_id = a.id LEFT JOIN tags t ON t.id = tg.tag_id"""


def _work(where: str, joins: str = "", limit: int = 20, keep: str = "a.id, a.title, s.name AS source", card: str = "LEFT JOIN") -> str:
    return f"""
        SELECT {keep} FROM articles a JOIN sources s ON s.id = a.source_id {card} article_cards c ON c.article_id = a.id {joins}
        WHERE NOT a.pending_deletion AND {where} ORDER BY a.id LIMIT {int(limit)}"""


def needing_summary(*, limit: int = 200, after_id: int = 0) -> str:
    """Articles without a summary that were not rejected, past a checkpoint (JN-2, FLT-16)."""
    return _work(f"c.summary IS NULL AND c.relevant IS NOT FALSE AND a.id > {int(after_id)}", limit=limit)


def needing_relevance(*, limit: int = 200) -> str:
    """Summarised articles without a verdict (JN-4)."""
    return _work("c.summary IS NOT NULL AND c.relevant IS NULL", limit=limit, card="JOIN")


def needing_tags(*, limit: int = 200) -> str:
    """Relevant summarised articles without a tag: an anti-join (JN-5)."""
    return _work("c.relevant AND c.summary IS NOT NULL AND NOT EXISTS (SELECT 1 FROM article_tags t WHERE t.article_id = a.id)", limit=limit, card="JOIN")


def needing_scores(*, limit: int = 200) -> str:
    """Relevant summarised articles without a score: an anti-join (JN-5)."""
    return _work("c.relevant AND c.summary IS NOT NULL AND NOT EXISTS (SELECT 1 FROM article_scores t WHERE t.article_id = a.id)", limit=limit, card="JOIN")


def needing_pipeline(*, limit: int = 200) -> str:
    """Articles that lack any stage (JN-3)."""
    joins = "LEFT JOIN article_tags t ON t.article_id = a.id LEFT JOIN article_scores sc ON sc.article_id = a.id"
    return _work("(c.article_id IS NULL OR c.relevant IS NULL OR (c.relevant AND (c.summary IS NULL OR c.title_ru IS NULL OR t.tag_id IS NULL OR sc.id IS NULL)))", joins, limit)


def needing_title(*, limit: int = 200) -> str:
    """Articles without a translated title (JN-6, FLT-13)."""
    return _work("c.title_ru IS NULL", limit=limit)


def needing_full_text(*, limit: int = 200, min_chars: int = 500) -> str:
    """Truncated or short texts (FLT-18)."""
    return _work(f"(a.text_truncated OR length(COALESCE(a.raw_text, '')) < {int(min_chars)})", limit=limit, keep="a.id, a.url, a.title, length(COALESCE(a.raw_text, '')) AS n_chars")


def keyset_page(*, after_id: int = 100, limit: int = 100) -> str:
    """Keyset pagination over article ids (FLT-15)."""
    return f"SELECT id, source_id, title FROM articles WHERE id > {int(after_id)} ORDER BY id LIMIT {int(limit)}"


def pending_deletion(*, limit: int = 100) -> str:
    """Soft-deleted articles with their source (FLT-14)."""
    return f"SELECT a.id, a.title, s.name AS source FROM articles a JOIN sources s ON s.id = a.source_id WHERE a.pending_deletion ORDER BY a.id LIMIT {int(limit)}"


def article_candidates(*, terms: tuple[str, ...] = ("worthless", "retitioning"), limit: int = 20) -> str:
    """Articles that contain any of the terms, with a snippet (FLT-19)."""
    hit = " OR ".join(f"lower(concat(COALESCE(title, ''), ' ', COALESCE(raw_text, ''))) LIKE {quoted('%' + t.lower() + '%')}" for t in terms)
    return f"SELECT id, title, substr(COALESCE(raw_text, ''), 1, 240) AS snippet FROM articles WHERE {hit} ORDER BY id DESC LIMIT {int(limit)}"


def signal_article_evidence(*, terms: tuple[str, ...] = ("worthless", "clown", "idiot"), days: int = 2000, limit: int = 80, min_score: float = 40, as_of: str = AS_OF) -> str:
    """Recent visible articles that mention a topic's terms, scored at least ``min_score`` where scored (JN-8)."""
    fields = ["a.title", "c.title_ru", "c.summary", "a.raw_text", "t.name"]
    hit = " OR ".join(f"COALESCE({f}, '') ILIKE {quoted('%' + term + '%')}" for term in terms[:6] for f in fields)
    return f"""
        SELECT a.id, a.title, a.url, s.name AS source, t.name AS tag, COALESCE(sc.total_score, 50.0) AS score,
               least(1.0, greatest(0.1, COALESCE(sc.total_score, 50.0) / 100)) AS strength, substr(COALESCE(c.summary, a.raw_text), 1, 900) AS fact
        FROM articles a JOIN sources s ON s.id = a.source_id LEFT JOIN article_cards c ON c.article_id = a.id
        LEFT JOIN article_scores sc ON sc.article_id = a.id LEFT JOIN article_tags tg ON tg.article_id = a.id LEFT JOIN tags t ON t.id = tg.tag_id
        WHERE {VISIBLE} AND COALESCE(a.published_at, a.collected_at) >= {_back(as_of, days)} AND COALESCE(sc.total_score, 50.0) >= {float(min_score)} AND ({hit})
        ORDER BY COALESCE(sc.total_score, 50.0) DESC, COALESCE(a.published_at, a.collected_at) DESC, a.id LIMIT {int(limit)}"""


# --- statistics -------------------------------------------------------------


def dashboard_stats(*, user_id: int = 1) -> str:
    """Totals in one pass, with per-status counts for the fixed statuses (AGG-13)."""
    by = ", ".join(f"COUNT(*) FILTER (WHERE NOT a.pending_deletion AND c.relevant IS NOT FALSE AND COALESCE(u.status, 'new') = {quoted(x)}) AS n_{x}" for x in STATES)
    return f"""
        SELECT COUNT(*) FILTER (WHERE c.article_id IS NOT NULL AND c.relevant IS NOT FALSE AND NOT a.pending_deletion) AS total,
               COUNT(*) FILTER (WHERE c.relevant AND NOT a.pending_deletion AND c.summary <> '' AND (tg.tag_id IS NOT NULL OR sc.id IS NOT NULL)) AS processed,
               COUNT(*) FILTER (WHERE c.relevant IS FALSE) AS cleaned,
               {rounded('AVG(sc.total_score)', 0)} AS avg_score, {by}
        FROM articles a LEFT JOIN article_cards c ON c.article_id = a.id LEFT JOIN article_scores sc ON sc.article_id = a.id
        LEFT JOIN article_tags tg ON tg.article_id = a.id LEFT JOIN user_article_states u ON u.article_id = a.id AND u.user_id = {int(user_id)}"""


def status_counts(*, user_id: int = 1) -> str:
    """Articles by the user's status, zero-filled in a fixed order (AGG-13)."""
    dim = ", ".join(f"({k}, {quoted(x)})" for k, x in enumerate(STATES))
    return f"""
        WITH dim AS (SELECT pos, status FROM (VALUES {dim}) AS v(pos, status)),
        n AS (SELECT COALESCE(u.status, 'new') AS status, COUNT(*) AS articles FROM articles a LEFT JOIN article_cards c ON c.article_id = a.id
              LEFT JOIN user_article_states u ON u.article_id = a.id AND u.user_id = {int(user_id)}
              WHERE NOT a.pending_deletion AND c.relevant IS NOT FALSE GROUP BY COALESCE(u.status, 'new'))
        SELECT d.pos, d.status, COALESCE(n.articles, 0) AS articles FROM dim d LEFT JOIN n ON n.status = d.status"""


def monthly_platform_stats(*, months: int = 60, as_of: str = AS_OF) -> str:
    """Monthly funnel by collection time (AGG-14)."""
    return f"""
        SELECT {_month('a.collected_at')} AS month, COUNT(*) AS collected, COUNT(*) FILTER (WHERE c.summary IS NOT NULL) AS summarised,
               COUNT(*) FILTER (WHERE c.relevant) AS relevant, COUNT(*) FILTER (WHERE c.relevant IS FALSE) AS rejected,
               COUNT(sc.id) AS scored, COUNT(*) FILTER (WHERE sc.total_score >= 60) AS high, COUNT(*) FILTER (WHERE sc.total_score >= 80) AS top,
               {rounded('AVG(sc.total_score)', 2)} AS avg_score
        FROM articles a LEFT JOIN article_cards c ON c.article_id = a.id LEFT JOIN article_scores sc ON sc.article_id = a.id
        WHERE a.collected_at >= {_ts(months_back(as_of, months))} GROUP BY {_month('a.collected_at')}"""


def monthly_ai_cost(*, months: int = 60, as_of: str = AS_OF) -> str:
    """Runs and cost by month and model (AGG-15)."""
    return f"""
        SELECT {_month('created_at')} AS month, model, COUNT(*) AS runs, {rounded('SUM(cost_usd)', 2)} AS cost_usd
        FROM ai_runs WHERE created_at >= {_ts(months_back(as_of, months))} GROUP BY {_month('created_at')}, model"""


def monthly_user_activity(*, months: int = 90, as_of: str = AS_OF) -> str:
    """Articles by month, user and status (AGG-16)."""
    month = _month("COALESCE(a.published_at, a.collected_at)")
    return f"""
        SELECT {month} AS month, u.user_id, u.status, COUNT(*) AS articles
        FROM user_article_states u JOIN articles a ON a.id = u.article_id
        WHERE COALESCE(a.published_at, a.collected_at) >= {_ts(months_back(as_of, months))} GROUP BY {month}, u.user_id, u.status"""


def ai_cost_report() -> str:
    """Runs, tokens and cost by stage and language (AGG-21)."""
    return f"""
        SELECT stage, language, COUNT(*) AS runs, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, CAST(SUM(output_tokens) AS BIGINT) AS output_tokens,
               {rounded('SUM(cost_usd)', 6)} AS cost_usd, {rounded('AVG(input_tokens + output_tokens)', 2)} AS avg_tokens
        FROM ai_runs GROUP BY stage, language"""


def ai_article_cost_report(*, limit: int = 20, complete_only: bool = True) -> str:
    """Most expensive articles; complete ones have three distinct stages of any status (AGG-22)."""
    having = "HAVING COUNT(DISTINCT stage) = 3" if complete_only else ""
    cost = rounded("SUM(cost_usd) FILTER (WHERE status = 'ok')", 6)
    return f"""
        SELECT article_id, COUNT(DISTINCT stage) AS stages, CAST(SUM(input_tokens) FILTER (WHERE status = 'ok') AS BIGINT) AS input_tokens,
               CAST(SUM(output_tokens) FILTER (WHERE status = 'ok') AS BIGINT) AS output_tokens, {cost} AS ok_cost_usd
        FROM ai_runs GROUP BY article_id {having} ORDER BY ok_cost_usd DESC NULLS LAST, article_id LIMIT {int(limit)}"""


def sources_by_strategy() -> str:
    """Sources by parse strategy (AGG-17)."""
    return "SELECT parse_strategy, COUNT(*) AS sources FROM sources GROUP BY parse_strategy"


def top_sources(*, limit: int = 10) -> str:
    """Sources with most articles (AGG-19)."""
    return f"SELECT s.id, s.name, COUNT(*) AS articles FROM sources s JOIN articles a ON a.source_id = s.id GROUP BY s.id, s.name ORDER BY COUNT(*) DESC, s.id LIMIT {int(limit)}"


def cross_dup_candidates() -> str:
    """Texts that occur under several URLs: nested aggregation (AGG-20)."""
    return "SELECT COUNT(*) AS hashes FROM (SELECT sha256_text FROM (SELECT md5(COALESCE(raw_text, '')) AS sha256_text, url FROM articles) h GROUP BY sha256_text HAVING COUNT(DISTINCT url) > 1) g"


def feedback_source_summary(*, limit: int = 300) -> str:
    """Average ratings and reasons by source (AGG-23)."""
    reasons = ", ".join(f"COUNT(*) FILTER (WHERE f.reason = {quoted(r)}) AS n_{r}" for r in ("off_topic", "incomplete_text", "duplicate", "bad_translation", "good"))
    return f"""
        SELECT s.id, s.name, COUNT(*) AS entries, {rounded('AVG(f.usefulness)', 2)} AS usefulness, {reasons}
        FROM feedback_entries f JOIN sources s ON s.id = f.source_id GROUP BY s.id, s.name ORDER BY COUNT(*) DESC, s.id LIMIT {int(limit)}"""


def feedback_training_set(*, reason: str = "duplicate", limit: int = 500) -> str:
    """Feedback with its article; the filter reads comment OR (reason AND reason = given), as the original has it (JN-13)."""
    return f"""
        SELECT f.id, f.article_id, f.reason, f.comment, a.title, c.summary, s.name AS source
        FROM feedback_entries f LEFT JOIN articles a ON a.id = f.article_id LEFT JOIN article_cards c ON c.article_id = f.article_id LEFT JOIN sources s ON s.id = f.source_id
        WHERE f.comment IS NOT NULL OR f.reason IS NOT NULL AND f.reason = {quoted(reason)} ORDER BY f.id DESC LIMIT {int(limit)}"""


def table_counts() -> str:
    """Row counts of the main tables (FLT-10, AGG-27)."""
    names = ["articles", "article_cards", "article_scores", "article_tags", "sources", "tags", "signals", "jobs"]
    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS n FROM {n}" for n in names)


# --- sources ----------------------------------------------------------------


def list_sources(*, search: str = "src1", limit: int = 50) -> str:
    """Sources whose name matches, enabled first (FLT-3)."""
    return f"SELECT id, name, source_type, enabled, parse_strategy FROM sources WHERE name ILIKE {quoted('%' + search + '%')} ORDER BY enabled DESC, parse_strategy NULLS LAST, id LIMIT {int(limit)}"


def enabled_sources(*, strategy: str | None = None) -> str:
    """Enabled sources, optionally of one strategy (FLT-1)."""
    more = f" AND parse_strategy = {quoted(strategy)}" if strategy else ""
    return f"SELECT id, name, source_type, parse_strategy FROM sources WHERE enabled{more}"


def source_health_report(*, stale_days: int = 3, as_of: str = AS_OF, limit: int = 300) -> str:
    """Verdict of each source from its article count and last article (AGG-18)."""
    return f"""
        SELECT id, name, articles, last_collected_at, verdict FROM (
          SELECT s.id, s.name, COUNT(a.id) AS articles, MAX(a.collected_at) AS last_collected_at,
                 CASE WHEN NOT s.enabled THEN 'disabled' WHEN COUNT(a.id) = 0 THEN 'no_articles' WHEN MAX(a.collected_at) < {_back(as_of, stale_days)} THEN 'stale' ELSE 'ok' END AS verdict
          FROM sources s LEFT JOIN articles a ON a.source_id = s.id GROUP BY s.id, s.name, s.enabled) h
        ORDER BY CASE verdict WHEN 'no_articles' THEN 1 WHEN 'stale' THEN 2 WHEN 'ok' THEN 3 ELSE 4 END, articles, last_collected_at NULLS FIRST, name LIMIT {int(limit)}"""


def source_quality_rows(*, period_from: str = "1995-01-01", period_to: str = "2001-01-01") -> str:
    """Per-source metrics over a period and the quality score (AGG-9, AGG-12); marks and costs are aggregated by article before any join."""
    score = "least(100.0, greatest(0.0, 35.0 * relevant / f + 25.0 * COALESCE(avg_score, 0) / 100 + 25.0 * digest / f - 10.0 * duplicates / f - 5.0 * noise / f))"
    return f"""
        WITH marks AS (SELECT article_id, MAX(CASE WHEN status = 'digest' THEN 1 ELSE 0 END) AS dig, MAX(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) AS dup, MAX(CASE WHEN status = 'noise' THEN 1 ELSE 0 END) AS noi FROM user_article_states GROUP BY article_id),
        costs AS (SELECT article_id, SUM(cost_usd) AS cost FROM ai_runs WHERE status = 'ok' GROUP BY article_id),
        m AS (SELECT a.source_id, c.relevant, sc.total_score, CASE WHEN c.summary IS NOT NULL OR c.relevant IS NOT NULL OR tg.tag_id IS NOT NULL OR sc.id IS NOT NULL THEN 1 ELSE 0 END AS processed,
                CASE WHEN c.relevant IS FALSE OR c.status = 'rejected' THEN 1 ELSE 0 END AS rejected,
                CASE WHEN k.dig = 1 OR c.status = 'digest' THEN 1 ELSE 0 END AS dig, CASE WHEN k.dup = 1 OR c.status = 'duplicate' THEN 1 ELSE 0 END AS dup, CASE WHEN k.noi = 1 OR c.status = 'noise' THEN 1 ELSE 0 END AS noi, COALESCE(co.cost, 0.0) AS cost
              FROM articles a LEFT JOIN article_cards c ON c.article_id = a.id LEFT JOIN article_scores sc ON sc.article_id = a.id LEFT JOIN article_tags tg ON tg.article_id = a.id
              LEFT JOIN marks k ON k.article_id = a.id LEFT JOIN costs co ON co.article_id = a.id
              WHERE a.collected_at >= {_ts(period_from)} AND a.collected_at < {_ts(period_to)}),
        g AS (SELECT s.id, s.name, COUNT(m.source_id) AS found, CAST(COALESCE(SUM(m.processed), 0) AS BIGINT) AS processed, COUNT(*) FILTER (WHERE m.relevant) AS relevant,
                CAST(COALESCE(SUM(m.rejected), 0) AS BIGINT) AS rejected, AVG(m.total_score) AS avg_score, CAST(COALESCE(SUM(m.dig), 0) AS BIGINT) AS digest,
                CAST(COALESCE(SUM(m.dup), 0) AS BIGINT) AS duplicates, CAST(COALESCE(SUM(m.noi), 0) AS BIGINT) AS noise, SUM(m.cost) AS cost, CAST(greatest(COUNT(m.source_id), 1) AS DOUBLE) AS f
              FROM sources s LEFT JOIN m ON m.source_id = s.id GROUP BY s.id, s.name)
        SELECT id, name, found, processed, relevant, rejected, {rounded('avg_score', 2)} AS avg_score, digest, duplicates, noise, {rounded('COALESCE(cost, 0.0)', 4)} AS cost_usd, {rounded(score, 2)} AS quality_score FROM g"""


def topic_gap_rows(*, period_from: str = "1995-01-01", period_to: str = "2001-01-01", target_per_topic: int = 10, limit: int = 10) -> str:
    """Topics short of signals; the period stays in the join, so topics without articles appear (AGG-10)."""
    target = int(target_per_topic)
    return f"""
        WITH g AS (SELECT COALESCE(p.name, t.name) AS topic, COUNT(*) FILTER (WHERE c.relevant) AS signals, AVG(sc.total_score) AS avg_score
              FROM tags t LEFT JOIN tags p ON p.id = t.parent_id LEFT JOIN article_tags tg ON tg.tag_id = t.id
              LEFT JOIN articles a ON a.id = tg.article_id AND a.collected_at >= {_ts(period_from)} AND a.collected_at < {_ts(period_to)}
              LEFT JOIN article_cards c ON c.article_id = a.id LEFT JOIN article_scores sc ON sc.article_id = a.id
              WHERE t.enabled GROUP BY COALESCE(p.name, t.name))
        SELECT topic, signals, {rounded('avg_score', 2)} AS avg_score, greatest({target} - signals, 0) AS gap,
               {rounded(f'least(100.0, greatest({target} - signals, 0) * 100.0 / greatest({target}, 1))', 2)} AS priority
        FROM g ORDER BY greatest({target} - signals, 0) DESC, topic LIMIT {int(limit)}"""


def candidate_triage(*, limit: int = 20) -> str:
    """Open candidates by computed priority (AGG-2)."""
    priority = "CASE COALESCE(recommended_action, '') WHEN 'add' THEN 90 WHEN 'test_more' THEN 70 WHEN 'human_review' THEN 55 WHEN 'reject' THEN 25 ELSE 40 END + least(relevant_articles * 4.0, 24.0) + least(COALESCE(avg_score, 0) / 5, 16.0) - least(noise_count * 5.0, 30.0)"
    return f"SELECT id, url, topic, status, recommended_action, {rounded(priority, 2)} AS priority FROM source_candidates WHERE status NOT IN ('approved', 'rejected') ORDER BY {rounded(priority, 2)} DESC, id LIMIT {int(limit)}"


def candidate_quality_report(*, limit: int = 20) -> str:
    """Approval and relevance rates by topic (AGG-1)."""
    ratio = lambda a, b: f"COALESCE({rounded(f'CAST({a} AS DOUBLE) / NULLIF({b}, 0)', 3)}, 0.0)"
    return f"""
        WITH g AS (SELECT COALESCE(NULLIF(topic, ''), 'Без темы') AS subject, COUNT(*) AS candidates, COUNT(*) FILTER (WHERE status = 'approved') AS approved, COUNT(*) FILTER (WHERE status = 'rejected') AS rejected,
              COUNT(*) FILTER (WHERE status = 'needs_human_review') AS in_review, COUNT(*) FILTER (WHERE recommended_action = 'add') AS add_recommended,
              CAST(SUM(tested_articles) AS BIGINT) AS tested, CAST(SUM(relevant_articles) AS BIGINT) AS relevant, CAST(SUM(noise_count) AS BIGINT) AS noise, AVG(avg_score) AS avg_score
              FROM source_candidates GROUP BY COALESCE(NULLIF(topic, ''), 'Без темы')),
        r AS (SELECT subject, candidates, approved, rejected, in_review, add_recommended, tested, relevant, noise, {rounded('avg_score', 2)} AS avg_score, {ratio('approved', '(approved + rejected)')} AS approval_rate, {ratio('relevant', 'tested')} AS relevance_rate FROM g)
        SELECT * FROM r ORDER BY approval_rate DESC, relevance_rate DESC, rejected, candidates DESC, subject LIMIT {int(limit)}"""


def sandbox_score() -> str:
    """Quality score of tested candidates and the action that follows (DOM-12, DOM-13)."""
    quality = "least(100.0, greatest(0.0, 10.0 * p / d + 35.0 * rel / p + 25.0 * high / p + 20.0 * COALESCE(avg_score, 0) / 100 - 15.0 * noise / d))"
    return f"""
        WITH x AS (SELECT id, CAST(tested_articles AS DOUBLE) AS t, CAST(relevant_articles AS DOUBLE) AS rel, CASE WHEN COALESCE(avg_score, 0) >= 50 THEN CAST(relevant_articles AS DOUBLE) ELSE 0.0 END AS high,
              avg_score, CAST(noise_count AS DOUBLE) AS noise, greatest(CAST(tested_articles AS DOUBLE), 1.0) AS d, greatest(CAST(tested_articles AS DOUBLE), CAST(relevant_articles AS DOUBLE), 1.0) AS p FROM source_candidates),
        q AS (SELECT id, t, rel, high, p, {rounded(quality, 2)} AS quality FROM x)
        SELECT id, quality, CASE WHEN t = 0 THEN 'human_review' WHEN t < 5 THEN 'test_more' WHEN quality >= 55 AND rel >= greatest(3.0, floor(t / 2)) THEN 'add'
               WHEN p >= 3 AND high >= 2 AND quality >= 45 THEN 'test_more' WHEN quality <= 20 THEN 'reject' ELSE 'human_review' END AS action FROM q"""


def recommendation_agreement() -> str:
    """How often decisions agree with recommendations (AGG-29)."""
    agree = "CASE WHEN status = 'approved' THEN recommended_action = 'add' WHEN status = 'rejected' THEN recommended_action = 'reject' END"
    return f"""
        SELECT COALESCE(recommended_action, 'none') AS recommendation, COUNT(*) AS candidates, COUNT({agree}) AS judged, COUNT(*) FILTER (WHERE {agree}) AS agreed,
               {rounded(f'CAST(COUNT(*) FILTER (WHERE {agree}) AS DOUBLE) / NULLIF(COUNT({agree}), 0)', 3)} AS agreement
        FROM source_candidates GROUP BY COALESCE(recommended_action, 'none')"""


def frequency_actions() -> str:
    """Sources to poll more or less often (DOM-18)."""
    base = source_quality_rows()
    return f"""
        WITH quality AS ({base.strip()})
        SELECT id, CASE WHEN quality_score >= 65 AND relevant >= greatest(4, floor(found / 3.0)) THEN 'increase' ELSE 'decrease' END AS action,
               {rounded('CASE WHEN quality_score >= 65 AND relevant >= greatest(4, floor(found / 3.0)) THEN least(68.0, 42 + 0.35 * quality_score + 2.0 * digest) ELSE least(58.0, 38 + 2.0 * noise) END', 2)} AS priority
        FROM quality WHERE found >= 8 AND ((quality_score >= 65 AND relevant >= greatest(4, floor(found / 3.0))) OR (quality_score <= 15 AND noise >= greatest(3, floor(found / 3.0))))"""


def source_audit_verdict() -> str:
    """Rule audit of sources: the last matching rule names the status, the highest sets the priority (DOM-17)."""
    base = source_quality_rows()
    low, noisy, dup = "found >= 5 AND quality_score <= 20", "found >= 5 AND noise >= greatest(3, floor(found / 3.0))", "found >= 5 AND duplicates >= greatest(3, floor(found / 3.0))"
    weak, parser = "found >= 5 AND avg_score < 35", "found >= 5 AND processed = 0"
    return f"""
        WITH quality AS ({base.strip()}),
        r AS (SELECT id, CASE WHEN {parser} THEN 'parser_suspect' WHEN {weak} THEN 'low_score' WHEN {dup} THEN 'duplicating' WHEN {noisy} THEN 'noisy' WHEN {low} THEN 'low_quality' WHEN found = 0 THEN 'stale' END AS status,
              greatest(CASE WHEN found = 0 THEN 62 ELSE 0 END, CASE WHEN {low} THEN 58 ELSE 0 END, CASE WHEN {noisy} THEN 64 ELSE 0 END, CASE WHEN {dup} THEN 57 ELSE 0 END, CASE WHEN {weak} THEN 55 ELSE 0 END, CASE WHEN {parser} THEN 66 ELSE 0 END) AS priority,
              (digest >= 3 AND relevant >= greatest(3, floor(found / 3.0)) AND quality_score >= 55) AS useful FROM quality)
        SELECT id, status, CASE WHEN useful THEN least(priority, 60) ELSE priority END AS priority, CASE WHEN useful THEN 'review' ELSE status END AS recommendation FROM r WHERE status IS NOT NULL"""


# --- signals and digest ------------------------------------------------------


_REVIEWED = "EXISTS (SELECT 1 FROM signal_feedback f WHERE f.signal_id = s.id AND (f.verdict <> '' OR f.event_type = 'comment_added'))"


def signals_list(*, maturity: str | None = None, theme: str | None = None, limit: int = 50) -> str:
    """Unmerged signals with counts of feedback and merged children (JN-18)."""
    more = (f" AND s.maturity = {quoted(maturity)}" if maturity else "") + (f" AND s.theme = {quoted(theme)}" if theme else "")
    return f"""
        WITH fb AS (SELECT signal_id, COUNT(DISTINCT id) AS n FROM signal_feedback GROUP BY signal_id),
        ch AS (SELECT merged_into_signal_id AS signal_id, COUNT(*) AS n FROM signals WHERE merged_into_signal_id IS NOT NULL GROUP BY merged_into_signal_id)
        SELECT s.id, s.title, s.theme, s.score, s.maturity, COALESCE(fb.n, 0) AS feedback, COALESCE(ch.n, 0) AS merged
        FROM signals s LEFT JOIN fb ON fb.signal_id = s.id LEFT JOIN ch ON ch.signal_id = s.id
        WHERE s.merged_into_signal_id IS NULL{more} ORDER BY s.score DESC, s.id LIMIT {int(limit)}"""


def best_evidence() -> str:
    """Best evidence of each signal (WIN-4)."""
    return """
        SELECT signal_id, source_url, strength, published_at FROM (
          SELECT e.*, row_number() OVER (PARTITION BY signal_id ORDER BY strength DESC, published_at DESC NULLS LAST, id DESC) AS rn FROM signal_evidence e) x WHERE rn = 1"""


def signals_for_dedup(*, window_days: int = 30, fresh_days: int = 3, limit: int = 300, as_of: str = AS_OF) -> str:
    """Cards for deduplication: latest verdict, ten best URLs in order, reviewed and fresh flags (JN-20, WIN-2, WIN-3).

    Reviewed cards of any age come first, then those seen within the window. A card is
    first and last seen with its earliest and latest dated evidence.
    """
    urls = ", ".join(f"MAX(CASE WHEN rn = {k} THEN source_url END)" for k in range(1, 11))
    return f"""
        WITH verdicts AS (SELECT signal_id, verdict FROM (SELECT signal_id, verdict, row_number() OVER (PARTITION BY signal_id ORDER BY created_at DESC, id DESC) AS rn FROM signal_feedback WHERE verdict <> '') v WHERE rn = 1),
        urls AS (SELECT signal_id, source_url, row_number() OVER (PARTITION BY signal_id ORDER BY strength DESC, id) AS rn FROM signal_evidence),
        best AS (SELECT signal_id, concat_ws(' ', {urls}) AS urls, COUNT(*) AS n_urls FROM urls WHERE rn <= 10 GROUP BY signal_id),
        dated AS (SELECT signal_id, MIN(published_at) AS first_seen_at, MAX(published_at) AS last_seen_at FROM signal_evidence GROUP BY signal_id),
        seen AS (SELECT DISTINCT signal_id FROM signal_feedback WHERE verdict <> '' OR event_type = 'comment_added')
        SELECT s.id, s.title, s.score, v.verdict, COALESCE(b.urls, '') AS urls, COALESCE(b.n_urls, 0) AS n_urls, (r.signal_id IS NOT NULL) AS reviewed,
               COALESCE(d.first_seen_at >= {_ts(as_of)} - INTERVAL '{int(fresh_days)}' DAY, FALSE) AS fresh, d.last_seen_at
        FROM signals s LEFT JOIN verdicts v ON v.signal_id = s.id LEFT JOIN best b ON b.signal_id = s.id LEFT JOIN dated d ON d.signal_id = s.id LEFT JOIN seen r ON r.signal_id = s.id
        WHERE s.merged_into_signal_id IS NULL AND (r.signal_id IS NOT NULL OR d.last_seen_at >= {_ts(as_of)} - INTERVAL '{int(window_days)}' DAY)
        ORDER BY CASE WHEN r.signal_id IS NOT NULL THEN 0 ELSE 1 END, d.last_seen_at DESC NULLS LAST, s.id DESC LIMIT {int(limit)}"""


def reviewed_urls() -> str:
    """Evidence URLs of reviewed signals or of those merged into them (SET-1); an empty verdict is a verdict here."""
    return """
        WITH reviewed AS (SELECT DISTINCT signal_id AS id FROM signal_feedback WHERE verdict IS NOT NULL)
        SELECT e.source_url AS url FROM signal_evidence e JOIN reviewed r ON r.id = e.signal_id
        UNION SELECT e.source_url FROM signal_evidence e JOIN signals s ON s.id = e.signal_id JOIN reviewed r ON r.id = s.merged_into_signal_id"""


def signal_evidence_list(*, signal_id: int = 2, limit: int = 20) -> str:
    """Evidence of a signal and of those merged into it (JN-19)."""
    return f"""
        SELECT id, signal_id, source_url, strength, published_at FROM signal_evidence
        WHERE signal_id = {int(signal_id)} OR signal_id IN (SELECT id FROM signals WHERE merged_into_signal_id = {int(signal_id)})
        ORDER BY strength DESC, published_at DESC NULLS LAST, id DESC LIMIT {int(limit)}"""


def digest_candidates(*, user_id: int = 1, month: str = "1996-01", limit: int = 20, min_score: float = 0) -> str:
    """Articles and signals of a month for the digest: two ranked lists united, sorted and cut (JN-15, SET-2)."""
    when = "COALESCE(a.published_at, a.collected_at)"
    n = int(limit)
    return f"""
        WITH art AS (SELECT 'article' AS item_type, a.id, a.title, COALESCE(sc.total_score, 0.0) AS score, a.published_at AS happened_at FROM articles a JOIN sources s ON s.id = a.source_id
              LEFT JOIN article_cards c ON c.article_id = a.id LEFT JOIN article_scores sc ON sc.article_id = a.id
              LEFT JOIN user_article_states u ON u.article_id = a.id AND u.user_id = {int(user_id)}
              WHERE {VISIBLE} AND COALESCE(u.status, 'new') NOT IN ('noise', 'duplicate', 'archive') AND {_in_month(when, month)} AND COALESCE(sc.total_score, 0) >= {float(min_score)}
              ORDER BY sc.total_score DESC NULLS LAST, a.published_at DESC NULLS LAST, a.id LIMIT {n}),
        ev AS (SELECT signal_id, published_at FROM (SELECT signal_id, published_at, row_number() OVER (PARTITION BY signal_id ORDER BY strength DESC, published_at DESC NULLS LAST, id DESC) AS rn FROM signal_evidence) x WHERE rn = 1),
        sig AS (SELECT 'signal' AS item_type, s.id, s.title, s.score, ev.published_at AS happened_at FROM signals s JOIN ev ON ev.signal_id = s.id
              WHERE s.maturity <> 'reject' AND {_in_month('ev.published_at', month)} AND s.score >= {float(min_score)} ORDER BY s.score DESC, ev.published_at DESC NULLS LAST, s.id LIMIT {n})
        SELECT * FROM (SELECT * FROM art UNION ALL SELECT * FROM sig) both_ ORDER BY score DESC, happened_at DESC NULLS LAST, item_type, id LIMIT {n}"""


def score_recompute(*, keyword_weight: float = 0.2, ai_weight: float = 0.8) -> str:
    """Totals from criterion scores over enabled criteria, labelled on the unrounded total (AGG-25)."""
    final = rounded(f"greatest(i.ai_score, i.keyword_score * {keyword_weight} + i.ai_score * {ai_weight})", 2)
    total = "least(100.0, greatest(0.0, t))"
    return f"""
        WITH g AS (SELECT i.article_score_id AS id, SUM({final} * c.weight / 100) AS t FROM article_score_items i JOIN scoring_criteria c ON c.id = i.criterion_id AND c.enabled
              GROUP BY i.article_score_id HAVING SUM(c.weight) > 0)
        SELECT id, {rounded(total, 2)} AS total_score, CASE WHEN {total} >= 80 THEN 'Высокая' WHEN {total} >= 65 THEN 'Выше средней' WHEN {total} >= 40 THEN 'Средняя' ELSE 'Низкая' END AS score_label FROM g"""


def score_items_by_article() -> str:
    """Criterion scores of each article in criterion order (JN-23)."""
    return """
        SELECT s.article_id, MAX(CASE WHEN i.criterion_id = 1 THEN i.ai_score END) AS c1, MAX(CASE WHEN i.criterion_id = 2 THEN i.ai_score END) AS c2, MAX(CASE WHEN i.criterion_id = 3 THEN i.ai_score END) AS c3,
               COUNT(*) FILTER (WHERE c.enabled) AS items
        FROM article_scores s JOIN article_score_items i ON i.article_score_id = s.id JOIN scoring_criteria c ON c.id = i.criterion_id GROUP BY s.article_id"""


def tag_tree() -> str:
    """Enabled tags with their parents (JN-9)."""
    return "SELECT t.id, t.name, p.name AS parent, t.sort_order FROM tags t LEFT JOIN tags p ON p.id = t.parent_id WHERE t.enabled"


# --- queue --------------------------------------------------------------------


def job_status_counts() -> str:
    """Jobs by queue and status (AGG-4, AGG-27)."""
    return "SELECT queue_name, status, COUNT(*) AS jobs FROM jobs GROUP BY queue_name, status"


def external_queue_status(*, as_of: str = AS_OF) -> str:
    """Open, running and expired external jobs by queue, with totals (AGG-5)."""
    columns = f"COUNT(*) FILTER (WHERE status = 'queued') AS queued, COUNT(*) FILTER (WHERE status = 'running') AS running, COUNT(*) FILTER (WHERE status = 'running' AND (lease_expires_at IS NULL OR lease_expires_at < {_ts(as_of)})) AS expired, MIN(created_at) FILTER (WHERE status = 'queued') AS oldest_queued, MAX(lease_expires_at) FILTER (WHERE status = 'running') AS latest_lease"
    where = "FROM jobs WHERE execution_region = 'external'"
    return f"SELECT queue_name, {columns} {where} GROUP BY queue_name UNION ALL SELECT 'all' AS queue_name, {columns} {where}"


def lost_jobs(*, as_of: str = AS_OF) -> str:
    """What a sweep makes of running external jobs whose lease is gone (STR-5)."""
    return f"""
        SELECT id, queue_name, attempts, CASE WHEN attempts < max_attempts THEN 'queued' ELSE 'failed' END AS new_status,
               CASE WHEN attempts < max_attempts THEN least(30 * power(2, greatest(attempts - 1, 0)), 1800.0) END AS retry_delay_seconds
        FROM jobs WHERE execution_region = 'external' AND status = 'running' AND (lease_expires_at IS NULL OR lease_expires_at < {_ts(as_of)})"""


def claimable_jobs(*, per_queue: int = 5) -> str:
    """The next jobs of each queue, oldest first (STR-1)."""
    return f"SELECT queue_name, rn, id, attempts + 1 AS attempts FROM (SELECT queue_name, id, attempts, row_number() OVER (PARTITION BY queue_name ORDER BY created_at, id) AS rn FROM jobs WHERE status = 'queued') q WHERE rn <= {int(per_queue)}"


REPORTS = {f.__name__: f for f in (
    feed_articles, articles_by_ids, needing_summary, needing_relevance, needing_tags, needing_scores, needing_pipeline, needing_title, needing_full_text,
    keyset_page, pending_deletion, article_candidates, signal_article_evidence, dashboard_stats, status_counts, monthly_platform_stats, monthly_ai_cost,
    monthly_user_activity, ai_cost_report, ai_article_cost_report, sources_by_strategy, top_sources, cross_dup_candidates, feedback_source_summary,
    feedback_training_set, table_counts, list_sources, enabled_sources, source_health_report, source_quality_rows, topic_gap_rows, candidate_triage,
    candidate_quality_report, sandbox_score, recommendation_agreement, frequency_actions, source_audit_verdict, signals_list, best_evidence, signals_for_dedup,
    reviewed_urls, signal_evidence_list, digest_candidates, score_recompute, score_items_by_article, tag_tree, job_status_counts,
    external_queue_status, lost_jobs, claimable_jobs,
)}

#: further uses of a report under a name of their own
VARIANTS = {
    "feed_search": (feed_articles, {"search": "worthless"}),
    "feed_changed_only": (feed_articles, {"changed_only": True}),
    "feed_by_date": (feed_articles, {"sort": "date_desc", "min_score": 20, "max_score": 90, "language": "en"}),
    "feed_by_tag": (feed_articles, {"tag": "EUROPE", "sort": "score_asc"}),
}


def all_reports() -> dict[str, str]:
    """SQL of every registered report by name."""
    return {name: f() for name, f in REPORTS.items()} | {name: f(**options) for name, (f, options) in VARIANTS.items()}
