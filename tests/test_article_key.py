"""Articles whose documents are broadcast: few documents beside many orders, as on larger tables."""

import shutil
from pathlib import Path

import pytest

from tidewire.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def few_documents(spark, tmp_path):
    for table in Path(FOLDER).iterdir():
        if table.name != "documents.parquet":
            (shutil.copytree if table.is_dir() else shutil.copy)(table, tmp_path / table.name)
    spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 9").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")  # between what both sides are thought to have
    yield str(tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def total(name, rows):
    return {r["table_name"]: r["n"] for r in rows}["articles"] if name == "table_counts" else rows[0]["total"] if name == "article_metrics" else len(rows)


@pytest.mark.parametrize("name", ["table_counts", "article_metrics", "soft_deletes", "first_dates"])
def test_documents_are_broadcast(spark, few_documents, name):
    assert total(name, registry.queries()[name](spark, few_documents).collect()) == 9
