"""Stored tables that change together: versions with a manifest that is put in place last.

A table's rows lie in buckets of their key's hash, each bucket in folders that are never changed. A change writes new folders
for the buckets that it touches and then one manifest that names the folders of all tables; until that file stands under the
next number, readers see the version before, whole. A task that is run again, a lost executor or a driver that ends half-way
leave folders that no manifest names; ``clean`` removes them. Of two changes that start from one version the second fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: buckets of a table; a change writes those again whose keys it has
BUCKETS = 32


class Conflict(RuntimeError):
    """Another change was made since this one began."""


class Store:
    """Tables under one folder, by name."""

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._files = self._path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(path)) if self._files.exists(path) else []

    def version(self) -> int:
        """The number of the last change; 0 before the first."""
        return max((int(n) for n in self._names(f"{self.root}/manifests") if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._files.open(self._path(f"{self.root}/manifests/{version:012d}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as a version has it (the last)."""
        return self._read(self.manifest(version)[name])

    def _read(self, entry: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        folders = [f"{self.root}/{f}" for b, fs in entry["buckets"].items() if buckets is None or int(b) in buckets for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    @contextmanager
    def change(self) -> Iterator[Change]:
        """Changes of any number of tables that appear together when the block ends; where it fails, none does."""
        change = Change(self)
        yield change
        change.commit()

    def clean(self, keep: int = 2) -> list[str]:
        """Removes manifests but the last ``keep``, and folders that none of these name; no change may be under way."""
        last = self.version()
        for name in self._names(f"{self.root}/manifests"):
            if not name.isdigit() or int(name) <= last - keep:
                self._files.delete(self._path(f"{self.root}/manifests/{name}"), False)
        named = {f.split("/")[1] for v in self._names(f"{self.root}/manifests") for e in self.manifest(int(v)).values() for fs in e["buckets"].values() for f in fs}
        gone = [n for n in self._names(f"{self.root}/data") if n not in named]
        for name in gone:
            self._files.delete(self._path(f"{self.root}/data/{name}"), True)
        return gone


class Change:
    """A change that is being written."""

    def __init__(self, store: Store) -> None:
        self.store, self.base = store, store.version()
        self.tables = store.manifest(self.base)

    def _written(self, rows: DataFrame, bucket: Column) -> dict[int, str]:
        """Rows in a new folder, by bucket."""
        folder = f"data/{uuid.uuid4().hex}"
        whole = f"{self.store.root}/{folder}"
        rows.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(whole)
        return {int(n.partition("=")[2]): f"{folder}/{n}" for n in self.store._names(whole) if n.startswith("_bucket=")}

    def _bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.store.buckets)).cast("int")

    def replace(self, name: str, rows: DataFrame, keys: list[str], *, groups: DataFrame | None = None) -> None:
        """The rows of each key that ``rows`` (or ``groups``, where a key may be left without any) has, in place of what the table has of it.

        Keys are equal as in a unique index that takes nulls as equal. Rows of other keys stay.
        """
        entry = self.tables.get(name)
        gone = (rows if groups is None else groups.select(*keys).union(rows.select(*keys))).select(*keys).distinct()
        touched = {r[0] for r in gone.select(self._bucket(keys)).distinct().collect()}  # at most as many as there are buckets
        if entry:
            old = self.store._read(entry, touched)
            marked = gone.select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = [old[k].eqNullSafe(marked[f"_{k}"]) for k in keys]
            kept = old.join(marked, [self._bucket(keys) == self._bucket([f"_{k}" for k in keys]), *same], "left_anti")
            rows = kept.unionByName(rows.select(*old.columns))
        written = self._written(rows, self._bucket(keys))
        buckets = {int(b): fs for b, fs in (entry or {"buckets": {}})["buckets"].items() if int(b) not in touched}
        self.tables[name] = {"schema": rows.schema.jsonValue(), "buckets": {b: fs for b, fs in {**buckets, **{b: [f] for b, f in written.items()}}.items()}}

    def append(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows beside what the table has; nothing is read."""
        entry = self.tables.get(name) or {"schema": rows.schema.jsonValue(), "buckets": {}}
        rows = rows.select(*StructType.fromJson(entry["schema"]).names)
        buckets = {int(b): list(fs) for b, fs in entry["buckets"].items()}
        for b, folder in self._written(rows, self._bucket(keys)).items():
            buckets.setdefault(b, []).append(folder)
        self.tables[name] = {"schema": entry["schema"], "buckets": buckets}

    def commit(self) -> None:
        store = self.store
        folder = f"{store.root}/manifests"
        store._files.mkdirs(store._path(folder))
        draft = store._path(f"{folder}/.{uuid.uuid4().hex}")
        stream = store._files.create(draft, True)
        stream.write(bytearray(json.dumps(self.tables).encode()))
        stream.close()
        context = store._hadoop.fs.FileContext.getFileContext(draft.toUri(), store._conf)
        options = store.spark.sparkContext._gateway.new_array(getattr(store._hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(store._hadoop.fs, "Options$Rename").NONE
        try:
            context.rename(draft, store._path(f"{folder}/{self.base + 1:012d}"), options)
        except Exception as failed:
            store._files.delete(draft, False)
            if "already" in str(failed) or "exist" in str(failed):
                raise Conflict(f"version {self.base + 1} is there") from failed
            raise


def save_digests(store: Store, digests: DataFrame, items: DataFrame) -> None:
    """Digests (month, user_id, title, status) and their articles (month, user_id, place, article_id, section), header and items at once.

    One digest a month and user, and one that belongs to no user; a digest that is saved again has its items replaced and
    numbered from 1 in order of ``place``.
    """
    keys = ["month", "user_id"]
    numbered = items.join(digests.select(*keys).distinct().select(*[F.col(k).alias(f"_{k}") for k in keys]), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi")
    ordered = numbered.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "article_id", "section"))).alias("i"))  # the articles of one digest
    flat = ordered.select(*keys, F.posexplode("i").alias("at", "i")).select(*keys, (F.col("at") + 1).alias("sort_order"), "i.article_id", "i.section")
    with store.change() as change:
        change.replace("digests", digests, keys)
        change.replace("digest_items", flat, keys, groups=digests)


def save_documents(store: Store, documents: DataFrame, anchors: DataFrame, facts: DataFrame) -> None:
    """Documents by owner and content hash with their anchors and facts: a document that is saved again has both replaced."""
    keys = ["owner_id", "sha256"]
    with store.change() as change:
        change.replace("documents", documents.dropDuplicates(keys), keys)
        change.replace("document_anchors", anchors.dropDuplicates([*keys, "number"]), keys, groups=documents)
        change.replace("document_facts", facts, keys, groups=documents)


def append_log(store: Store, name: str, rows: DataFrame, *, key: str, rules: dict[str, Column]) -> int:
    """Adds rows to a log that only grows, or, where any breaks a rule, none: the rules that are broken are told with their counts."""
    broken = rows.agg(F.count("*").alias("_n"), *[F.count_if(~F.coalesce(test, F.lit(False))).alias(rule) for rule, test in rules.items()]).first().asDict()
    count = broken.pop("_n")
    told = {rule: n for rule, n in broken.items() if n}
    if told:
        raise ValueError(f"rows that break rules: {told}")
    with store.change() as change:
        change.append(name, rows, [key])
    return count
