"""Tags that belong to topics, and terms of a large glossary in articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import glossary, tag_choice
from tidewire.plans.register import Register
from tidewire.sources.newsroom import Newsroom

query = Register()
QUERIES, oracle_sql = query.queries, query.oracle_sql

_TAGS = "SELECT id, parent_id, row_number() OVER (ORDER BY COALESCE(parent_id, 0), sort_order, id) AS place, name, concat('Market of ', name) AS description FROM tags"
_TOPICS = "SELECT name AS topic FROM tags UNION SELECT concat(p.p_type, ' in ', n.n_name) FROM part p JOIN nation n ON n.n_nationkey = p.p_partkey % 25 WHERE p.p_partkey % 5 = 0 UNION SELECT substr(n_name, 2, 3) FROM nation UNION SELECT concat('with news and market ', r_name) FROM region"


@query(f"""
    WITH t AS ({_TAGS}), o AS (SELECT DISTINCT topic, lower(trim(topic)) AS t FROM ({_TOPICS}) x), own AS (SELECT t.id, t.parent_id, t.place, lower(t.name) AS n, [lower(t.name), lower(t.description)] || CASE WHEN p.id IS NULL THEN [] ELSE [lower(p.name)] END AS fields FROM t LEFT JOIN t p ON p.id = t.parent_id),
    exact AS (SELECT o.topic, own.id FROM o JOIN own ON own.n = o.t), words AS (SELECT topic, t, list_filter(regexp_extract_all(t, '[a-zа-яё0-9]{{4,}}'), lambda w: w NOT IN ('and', 'with', 'news')) AS w FROM o),
    direct AS (SELECT w.topic, own.id, own.parent_id FROM words w JOIN own ON len(list_filter(own.fields, lambda f: contains(w.t, f) OR contains(f, w.t) OR len(list_intersect(w.w, list_filter(regexp_extract_all(f, '[a-zа-яё0-9]{{4,}}'), lambda x: x NOT IN ('and', 'with', 'news')))) > 0)) > 0 WHERE w.topic NOT IN (SELECT topic FROM exact)),
    chosen AS (SELECT topic, id FROM direct UNION SELECT topic, parent_id FROM direct WHERE parent_id IS NOT NULL UNION SELECT d.topic, own.id FROM direct d JOIN own ON own.parent_id = d.id UNION SELECT topic, id FROM exact UNION SELECT e.topic, own.id FROM exact e JOIN own ON own.parent_id = e.id)
    SELECT topic, place, id AS tag_id FROM (SELECT c.topic, c.id, row_number() OVER (PARTITION BY c.topic ORDER BY own.place, c.id) AS place FROM chosen c JOIN own ON own.id = c.id) r WHERE place <= 24""")
def topic_tags(room: Newsroom) -> DataFrame:
    """The tags of each topic, by exact name or by shared words and held names (DOM-28)."""
    return tag_choice.topic_tags(room.sql(_TOPICS), room.sql(_TAGS))


#: a glossary of at most ten thousand terms out of titles: words, and the first two words
_TERMS = """SELECT term FROM (SELECT DISTINCT term FROM (SELECT lower(regexp_extract(title, '^([A-Za-z]{3,} [A-Za-z]{3,}) ', 1)) AS term FROM articles UNION ALL SELECT lower(regexp_extract(title, '([a-z]{6,})[^A-Za-z]*$', 1)) FROM articles) x WHERE length(term) > 5) y ORDER BY term LIMIT 10000"""


def _glossary(room: Newsroom) -> list[glossary.Term]:
    terms = [r.term for r in room.sql(_TERMS).orderBy("term").collect()]  # at most ten thousand
    return [glossary.Term((t,), t.upper(), (), (t,) if i % 2 else ()) for i, t in enumerate(terms)]


@query(f"""
    WITH g AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS n FROM ({_TERMS}) t), a AS (SELECT id, lower(concat_ws(' ', title, raw_text)) AS t FROM articles),
    w AS (SELECT DISTINCT id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) AS term FROM a),
    hits AS (SELECT id, n FROM w JOIN g USING (term) UNION SELECT a.id, g.n FROM a JOIN g ON contains(g.term, ' ') AND contains(a.t, g.term)),
    r AS (SELECT id, n, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM hits)
    SELECT a.id, COALESCE(string_agg(CAST(r.n AS VARCHAR), ',' ORDER BY r.n) FILTER (r.k <= 12), '') AS terms FROM a LEFT JOIN r ON r.id = a.id GROUP BY a.id""")
def glossary_terms(room: Newsroom) -> DataFrame:
    """The first twelve terms of a large glossary that articles call for (FN-34)."""
    found = glossary.relevant_terms(room.table("articles").select("id", "title", "raw_text"), ["title", "raw_text"], _glossary(room))
    return found.select("id", F.array_join(F.transform("terms", lambda n: n.cast("string")), ",").alias("terms"))


@query(f"""
    WITH g AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS n FROM ({_TERMS}) t), a AS (SELECT id, lower(title) AS t FROM articles),
    w AS (SELECT DISTINCT id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) AS term FROM a),
    hits AS (SELECT id, g.term, n FROM w JOIN g USING (term) UNION SELECT a.id, g.term, g.n FROM a JOIN g ON contains(g.term, ' ') AND contains(a.t, g.term)),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM hits),
    l AS (SELECT id, list(term ORDER BY n) FILTER (k <= 12 AND n % 2 = 1) AS terms FROM r GROUP BY id)
    SELECT a.id, replace(replace(list_reduce(list_concat([regexp_replace(t, '([^A-Za-z0-9А-Яа-я])', chr(2) || '\\1' || chr(3), 'g')], COALESCE(list_transform(terms, lambda w: replace(w, ' ', chr(2) || ' ' || chr(3))), [])),
        lambda x, term: regexp_replace(x, '(?i)(^|' || chr(3) || ')' || term || '($|' || chr(2) || ')', '\\1' || upper(term) || '\\2', 'g')), chr(2), ''), chr(3), '') AS enforced
    FROM a LEFT JOIN l ON l.id = a.id""")
def glossary_enforced(room: Newsroom) -> DataFrame:
    """Titles with the preferred forms of a large glossary's terms (FN-35)."""
    rows = room.table("articles").select("id", F.lower("title").alias("title"))
    return glossary.enforced(rows, "title", ["title"], _glossary(room)).select("id", "enforced")
