"""Tables that are written by changes of several tables at once, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import store
from tidewire.operators.tables import new_folder
from tidewire.plans.register import Register
from tidewire.sources.newsroom import Newsroom

query = Register()
QUERIES, oracle_sql = query.queries, query.oracle_sql

_CHOSEN = "SELECT user_id, article_id, substr(CAST(updated_at AS STRING), 1, 7) AS month FROM user_article_states WHERE status = 'digest'"


@query(f"""
    WITH s AS ({_CHOSEN}), h AS (SELECT DISTINCT month, user_id FROM s UNION ALL SELECT DISTINCT month, NULL FROM s),
    i AS (SELECT DISTINCT month, user_id, article_id FROM s WHERE COALESCE(user_id % 3, 1) <> 0 OR article_id % 2 = 0 UNION ALL SELECT DISTINCT month, NULL, article_id FROM s WHERE article_id % 10 = 0)
    SELECT h.month, CAST(h.user_id AS VARCHAR) AS user_id, CASE WHEN h.user_id % 3 = 0 THEN 'again' ELSE 'first' END AS title, count(i.article_id) AS n, COALESCE(string_agg(CAST(i.article_id AS VARCHAR), ',' ORDER BY i.article_id), '') AS articles
    FROM h LEFT JOIN i ON i.month = h.month AND i.user_id IS NOT DISTINCT FROM h.user_id GROUP BY h.month, h.user_id""")
def saved_digests(room: Newsroom) -> DataFrame:
    """Monthly digests with their articles in order, after they were saved twice (SNK-4, MUT-11)."""
    chosen = room.sql(_CHOSEN)
    shared = chosen.where("article_id % 10 = 0").withColumn("user_id", F.lit(None).cast("long"))
    own = chosen.withColumn("user_id", F.col("user_id").cast("long")).select(*shared.columns)
    everyone = own.select("month", "user_id").union(chosen.select("month", F.lit(None).cast("long"))).distinct()
    items = own.union(shared).distinct().select("month", "user_id", F.col("article_id").alias("place"), "article_id", F.lit(None).cast("string").alias("section"))
    head = lambda rows, title: rows.select("month", "user_id", F.lit(title).alias("title"), F.lit("draft").alias("status"))
    tables = store.Store(room.spark, new_folder(room.spark, "digests"))
    store.save_digests(tables, head(everyone, "first"), items)
    store.save_digests(tables, head(everyone.where("user_id % 3 = 0"), "again"), items.where("article_id % 2 = 0"))
    lists = tables.table("digest_items").groupBy("month", "user_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", F.col("article_id").cast("string").alias("a")))).alias("l"))
    joined = tables.table("digests").alias("d").join(lists.alias("i"), [F.col("d.month") == F.col("i.month"), F.col("d.user_id").eqNullSafe(F.col("i.user_id"))], "left")
    articles = F.coalesce(F.array_join(F.transform("l", lambda x: x["a"]), ","), F.lit(""))
    return joined.select("d.month", F.col("d.user_id").cast("string").alias("user_id"), "title", F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n"), articles.alias("articles"))
