"""Upserts as snapshot merges: the old snapshot and new rows give the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OVERWRITE, KEEP_IF_NULL, PRESERVE = "overwrite", "keep_if_null", "preserve"


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the last in ``order``."""
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    return rows.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policies: dict[str, str], default: str = OVERWRITE) -> DataFrame:
    """The snapshot after new rows (one for each key).

    Columns of matched rows follow their policy: ``overwrite`` takes the new value,
    ``keep_if_null`` the new one unless it is null, ``preserve`` the old one. Keys
    with null parts never match; new columns that the snapshot lacks are left out.
    """
    columns = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    n = new.select(*keys, F.lit(True).alias("_new"), *[(F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType)).alias(f"_n_{c}") for c in columns])
    joined = o.join(n, keys, "full_outer")

    def value(c: str):
        if c not in new.columns:
            return F.col(f"_o_{c}")
        policy = policies.get(c, default)
        matched = {OVERWRITE: F.col(f"_n_{c}"), KEEP_IF_NULL: F.coalesce(f"_n_{c}", f"_o_{c}"), PRESERVE: F.col(f"_o_{c}")}[policy]
        return F.when(F.col("_old").isNull(), F.col(f"_n_{c}")).when(F.col("_new").isNull(), F.col(f"_o_{c}")).otherwise(matched)

    return joined.select(*keys, *[value(c).alias(c) for c in columns])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Only the new rows whose key the snapshot lacks (on conflict: do nothing); the first of a key by ``order``."""
    first = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last())
    once = new.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return once.join(old.select(*keys), keys, "left_anti").select(*new.columns)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot without the given keys."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_items(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of each new key replaced by the new rows."""
    return delete(old, new, keys).unionByName(new.select(*old.columns))


def patched(old: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot with the patches' values where they are not null; keys that it lacks add no row."""
    names = [c for c in patches.columns if c not in keys]
    p = patches.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in names])
    joined = old.join(p, keys, "left")
    return joined.select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in names else F.col(c) for c in old.columns])


def merged_json(old, new):
    """A JSON object of texts with the pairs of another; of equal keys the other's value stays."""
    kind = "map<string,string>"
    none = F.create_map().cast(kind)
    a, b = (F.coalesce(F.from_json(c, kind), none) for c in (old, new))
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, b)))))


def insert_once(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The new rows whose key the snapshot lacks, where null equals null in keys; the first of a key by ``order``."""
    first = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last())
    once = new.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    known = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_o_{k}"))
        same = test if same is None else same & test
    return once.join(known, same, "left_anti").select(*new.columns)


def upsert_flagged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, inserted): for each new row whether it was put in or changed a row that was there."""
    there = old.select(*keys).distinct().withColumn("_old", F.lit(True))
    return new.select(*keys).distinct().join(there, keys, "left").select(*keys, F.col("_old").isNull().alias("inserted"))


def soft_deleted(rows: DataFrame, gone: DataFrame, guarded: DataFrame, *, key: str = "id") -> DataFrame:
    """Marks ``gone`` rows, but for those that ``guarded`` holds."""
    marked = gone.select(key).distinct().join(guarded.select(key).distinct(), key, "left_anti").withColumn("_gone", F.lit(True))
    return rows.join(marked, key, "left").withColumn("pending_deletion", F.col("pending_deletion") | F.coalesce("_gone", F.lit(False))).select(*rows.columns)


def merged_cards(cards: DataFrame, merges: DataFrame, reviewed: DataFrame, *, key: str = "id", pointer: str = "merged_into") -> DataFrame:
    """Cards after merges (id, into): reviewed and merged cards stay as they are, and children of a merged card point at its root.

    ``into`` is a root, and no card is merged and merged into at once.
    """
    free = merges.join(reviewed.select(key).distinct(), key, "left_anti").join(cards.where(F.col(pointer).isNotNull()).select(key), key, "left_anti")
    roots = free.where(F.col(key) != F.col("into")).dropDuplicates([key]).select(key, F.col("into").alias("_root"))
    above = roots.select(F.col(key).alias("_parent"), F.col("_root").alias("_next"))
    joined = cards.join(roots, key, "left").join(above, F.col(pointer) == F.col("_parent"), "left")
    return joined.withColumn(pointer, F.coalesce("_root", "_next", pointer)).select(*cards.columns)


def named_apart(rows: DataFrame, taken: DataFrame, *, name: str, domain: str) -> DataFrame:
    """Rows with their domain added to names that are taken."""
    known = taken.select(F.lower(name).alias("_low")).distinct().withColumn("_taken", F.lit(True))
    joined = rows.withColumn("_low", F.lower(name)).join(known, "_low", "left")
    return joined.withColumn(name, F.when(F.col("_taken"), F.concat(F.col(name), F.lit(" ("), F.col(domain), F.lit(")"))).otherwise(F.col(name))).select(*rows.columns)
