"""The part of the tag tree that belongs to a topic: by its exact name, else by names and keywords that share words with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that tell nothing of a topic.
EMPTY_WORDS = ["and", "with", "news"]
MOST_TAGS = 24


def match_text(text: Column) -> Column:
    """Lower case, one spelling of ё, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "ё", "е"), r"\s+", " "))


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("[a-zа-яё0-9]{4,}"), F.lit(0)), lambda w: ~w.isin(EMPTY_WORDS)))


def _grams(text: Column, size: int = 4) -> Column:
    """All stretches of ``size`` characters; of a shorter text the text."""
    n = F.length(text)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array(text))


def topic_tags(topics: DataFrame, tags: DataFrame, *, most: int = MOST_TAGS) -> DataFrame:
    """(topic, place, tag_id): of each topic at most ``most`` tags in order of ``place``.

    ``tags``: id, parent_id, place, name, and perhaps name_en, description, keywords (array). A topic that has the name of a
    tag gets that tag and its children. Else a tag matches whose name, parent's name or description holds the topic, is held by
    it, or shares a word of four letters with it, or of which a keyword is held by it or shares a word; matching tags,
    their parents and their children are chosen. Candidates come from an inverted index of words and of the first
    four-letter stretches of the held text, so no topic is compared with every tag.
    """
    named = topics.select("topic").where("trim(topic) <> ''").distinct().withColumn("t", match_text(F.col("topic")))
    have = set(tags.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    keywords = F.coalesce(F.col("keywords"), F.array().cast("array<string>")) if "keywords" in have else F.array().cast("array<string>")
    rows = tags.select("id", "parent_id", "place", match_text(F.col("name")).alias("n"), F.array(F.col("name"), text("name_en"), text("description")).alias("own"), keywords.alias("keys"))
    parents = rows.select(F.col("id").alias("parent_id"), F.slice("own", 1, 2).alias("above"))
    fields = rows.join(parents, "parent_id", "left").select("id", F.concat(
        F.transform(F.concat("own", F.coalesce("above", F.array().cast("array<string>"))), lambda f: F.struct(match_text(f).alias("f"), F.lit(False).alias("key"))), F.transform("keys", lambda k: F.struct(match_text(k).alias("f"), F.lit(True).alias("key"))),
    ).alias("fields")).select("id", F.explode("fields").alias("x")).select("id", "x.f", "x.key").where("f <> ''").distinct()

    exact = named.join(rows.select(F.col("n").alias("t"), F.col("id").alias("found")), "t").select("topic", "found")
    fuzzy = named.join(exact, "topic", "left_anti")
    shared = fuzzy.select("topic", F.explode(_words(F.col("t"))).alias("w")).join(fields.select("id", F.explode(_words(F.col("f"))).alias("w")), "w").select("topic", "id")
    # a text that is held stands, with its first stretch, in the text that holds it
    first = lambda c: F.substring(c, 1, 4)
    stretches = lambda c: F.array_union(_grams(F.col(c)), F.array_union(_grams(F.col(c), 1), F.array_union(_grams(F.col(c), 2), _grams(F.col(c), 3))))
    in_topic = fuzzy.select("topic", "t", F.explode(stretches("t")).alias("g")).join(fields.select("id", "f", first("f").alias("g")), "g").where(F.col("t").contains(F.col("f"))).select("topic", "id")
    in_field = fields.where("NOT key").select("id", "f", F.explode(stretches("f")).alias("g")).join(fuzzy.select("topic", "t", first("t").alias("g")), "g").where(F.col("f").contains(F.col("t"))).select("topic", "id")
    direct = shared.union(in_topic).union(in_field).distinct()

    up = direct.join(rows.select("id", "parent_id"), "id").where("parent_id IS NOT NULL").select("topic", F.col("parent_id").alias("id"))
    down = lambda chosen: chosen.withColumnRenamed("id", "parent_id").join(rows.select("id", "parent_id"), "parent_id").select("topic", "id")
    exactly = exact.select("topic", F.col("found").alias("id"))
    chosen = direct.union(up).union(down(direct)).union(exactly).union(down(exactly)).distinct()
    ranked = chosen.join(rows.select("id", "place"), "id").withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy("place", "id")))
    return ranked.where(F.col("rank") <= most).select("topic", F.col("rank").alias("place"), F.col("id").alias("tag_id"))
