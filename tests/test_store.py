"""Changes that appear whole or not at all."""

import pytest
from pyspark.sql import functions as F

from tidewire.operators import store as stores

DIGESTS = "month string, user_id long, title string, status string"
ITEMS = "month string, user_id long, place long, article_id long, section string"


@pytest.fixture()
def store(spark, tmp_path):
    return stores.Store(spark, str(tmp_path / "store"), buckets=4)


def state(store):
    heads = sorted(store.table("digests").collect(), key=str)
    items = sorted(((r.month, r.user_id, r.sort_order, r.article_id) for r in store.table("digest_items").collect()), key=str)
    return [tuple(h) for h in heads], items


def saved(spark, store):
    digests = spark.createDataFrame([("2024-01", 1, "one", "draft"), ("2024-01", None, "shared", "draft"), ("2024-02", 1, "two", "draft")], DIGESTS)
    items = spark.createDataFrame([("2024-01", 1, 9, 11, None), ("2024-01", 1, 3, 12, "s"), ("2024-01", None, 1, 13, None), ("2024-02", 1, 1, 14, None), ("2030-01", 5, 1, 15, None)], ITEMS)
    stores.save_digests(store, digests, items)


def test_header_and_items_change_together(spark, store):
    saved(spark, store)
    first = state(store)
    assert first[1] == sorted([("2024-01", 1, 1, 12), ("2024-01", 1, 2, 11), ("2024-01", None, 1, 13), ("2024-02", 1, 1, 14)], key=str)
    stores.save_digests(store, spark.createDataFrame([("2024-01", None, "again", "sent"), ("2024-02", 1, "empty", "draft")], DIGESTS), spark.createDataFrame([("2024-01", None, 1, 99, None)], ITEMS))
    heads, items = state(store)
    assert ("2024-01", None, "again", "sent") in heads and len(heads) == 3 and items == sorted([("2024-01", 1, 1, 12), ("2024-01", 1, 2, 11), ("2024-01", None, 1, 99)], key=str)
    assert store.version() == 2 and store.table("digests", 1).where("title = 'shared'").count() == 1


def test_a_change_that_fails_leaves_the_old_state(spark, store):
    saved(spark, store)
    before = state(store)
    digests = spark.createDataFrame([("2024-01", 1, "broken", "draft")], DIGESTS)
    items = spark.createDataFrame([("2024-01", 1, 1, 50, None)], ITEMS).withColumn("article_id", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        stores.save_digests(store, digests, items)
    assert state(store) == before and store.version() == 1
    assert store.clean() and state(store) == before


def test_two_changes_from_one_version(spark, store):
    saved(spark, store)
    late = stores.Change(store)
    late.replace("digests", spark.createDataFrame([("2024-01", 1, "late", "draft")], DIGESTS), ["month", "user_id"])
    stores.save_digests(store, spark.createDataFrame([("2024-01", 1, "first", "draft")], DIGESTS), spark.createDataFrame([], ITEMS))
    with pytest.raises(stores.Conflict):
        late.commit()
    assert {r.title for r in store.table("digests").where("user_id = 1 AND month = '2024-01'").collect()} == {"first"}
    assert store.clean(keep=1) and store.table("digests").count() == 3


def test_documents_and_logs(spark, store):
    keys = "owner_id long, sha256 string"
    documents = spark.createDataFrame([(1, "a", "x.pdf"), (1, "a", "copy.pdf"), (2, "a", "y.pdf")], f"{keys}, name string")
    anchors = spark.createDataFrame([(1, "a", 1, "t"), (1, "a", 1, "t"), (1, "a", 2, "u"), (2, "a", 1, "v")], f"{keys}, number int, text string")
    facts = spark.createDataFrame([(1, "a", "f"), (2, "a", "g")], f"{keys}, fact string")
    stores.save_documents(store, documents, anchors, facts)
    stores.save_documents(store, documents.where("owner_id = 1").limit(1), anchors.where("number = 2"), facts.where("false"))
    assert store.table("documents").count() == 2 and sorted(r.text for r in store.table("document_anchors").collect()) == ["u", "v"] and [r.fact for r in store.table("document_facts").collect()] == ["g"]

    log = spark.createDataFrame([(1, "ok", 0.5), (2, "error", 0.0)], "id long, status string, cost double")
    rules = {"known status": F.col("status").isin("ok", "error"), "cost": F.col("cost") >= 0}
    assert stores.append_log(store, "runs", log, key="id", rules=rules) == 2 and stores.append_log(store, "runs", log, key="id", rules=rules) == 2
    with pytest.raises(ValueError, match="'known status': 1"):
        stores.append_log(store, "runs", spark.createDataFrame([(3, None, 1.0), (4, "ok", 1.0)], log.schema), key="id", rules=rules)
    assert store.table("runs").count() == 4
