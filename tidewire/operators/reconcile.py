"""Duplicates within a batch of cards, and a run's cards against the stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators import similarity

# Words that tell nothing of a card.
STOP_WORDS = ["the", "and", "for", "with", "from", "this", "that", "into", "about", "как", "или", "для", "что", "это", "при", "над", "под", "после"]


def batch_tokens(title: Column, companies: Column) -> Column:
    """Distinct words of four letters or more of a title and its companies."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(F.coalesce(companies, F.array().cast("array<string>")), " ")))
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("[a-zа-яё0-9]{4,}"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS)))


def batch_duplicates(cards: DataFrame, *, threshold: float = 0.6) -> DataFrame:
    """(id, duplicate_of) of the cards (id, tokens, score) that are like a stronger one that stays.

    Cards are gone through by falling score, then id; one whose tokens are like those of a card that stays is a duplicate of
    the strongest such. Cards of equal tokens are one class with its strongest as leader, so a title that is repeated a
    million times adds a row for each copy and no pairs. A card without tokens is like none.
    """
    nodes = cards.select("id", F.array_sort(F.transform("tokens", lambda t: F.xxhash64(t))).alias("stems"), F.lit(2).alias("tier"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(0).alias("evidence"))
    return similarity.similar_stars(nodes, threshold=threshold)


def followed(candidates: DataFrame) -> DataFrame:
    """Candidates (key, duplicate_of_id, duplicate_of_key) with the target of their target, where that is a duplicate itself."""
    up = candidates.where("duplicate_of_id IS NOT NULL OR duplicate_of_key IS NOT NULL").select(F.col("key").alias("duplicate_of_key"), F.col("duplicate_of_id").alias("_id"), F.col("duplicate_of_key").alias("_key"), F.lit(True).alias("_moved"))
    joined = candidates.join(up, "duplicate_of_key", "left")
    moved = F.col("_moved").isNotNull()
    return joined.select("key", F.when(moved, F.col("_id")).otherwise(F.col("duplicate_of_id")).alias("duplicate_of_id"), F.when(moved, F.col("_key")).otherwise(F.col("duplicate_of_key")).alias("duplicate_of_key"))


def reconciled(candidates: DataFrame, owners: DataFrame, cards: DataFrame) -> DataFrame:
    """What becomes of each of a run's candidates: (key, action, target, hides).

    ``candidates``: key (once each), duplicate_of_id (of a stored card) or duplicate_of_key (of another candidate). ``owners``:
    key, id, merged_into, reviewed of the stored card that has the key. ``cards``: id, merged_into of all stored cards.

    A candidate whose key is a stored card's is that card: hidden behind another, it goes there; reviewed, it stays its own;
    else, where the candidate is a duplicate, the card is hidden with it (``hides``). A duplicate is merged into the root of its
    target (``target``: a stored id, or ``new:`` and the key of a candidate that is stored for the first time); where no target is
    left it is stored, so that nothing is lost.
    """
    own = owners.select("key", F.col("id").alias("_owner"), F.col("merged_into").alias("_into"), F.coalesce("reviewed", F.lit(False)).alias("_reviewed"))
    joined = candidates.join(own, "key", "left")
    hidden, apart = F.col("_into").isNotNull(), F.coalesce(F.col("_reviewed"), F.lit(False))
    of_id = F.when(hidden, F.col("_into")).when(~apart, F.col("duplicate_of_id"))
    of_key = F.when(~hidden & ~apart, F.col("duplicate_of_key"))
    state = joined.select("key", "_owner", hidden.alias("_hidden"), of_id.alias("_id"), of_key.alias("_key"))
    double = F.col("_id").isNotNull() | F.col("_key").isNotNull()
    stored = state.where(~double).select(F.col("key").alias("_key"), F.col("_owner").alias("_stored"), F.lit(True).alias("_found"))
    roots = similarity.merge_roots(cards, "merged_into").select(F.col("id").alias("_to"), "root")
    told = state.join(stored, "_key", "left").withColumn("_to", F.coalesce("_id", "_stored")).join(roots, "_to", "left")
    new = F.when(F.col("_found") & F.col("_stored").isNull() & F.col("_id").isNull(), F.concat(F.lit("new:"), "_key"))
    target = F.when(double, F.coalesce(F.col("root").cast("string"), new))
    hides = F.when(target.isNotNull() & ~F.col("_hidden") & (F.col("_owner").cast("string") != target), F.col("_owner"))
    return told.select("key", F.when(target.isNull(), "stored").otherwise("merged").alias("action"), target.alias("target"), hides.alias("hides"))
