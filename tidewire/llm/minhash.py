"""Near-duplicate detection with bottom-k sketches from one hash function.

A document is the set of hashes of its word shingles; its sketch holds the ``k``
smallest. Documents with equal sets are one class from here on. Inverted lists of
the retained values generate candidates: two similar documents share so many of
their sketch values that they share one among their rarest few, so only those lists
are opened. Candidates are filtered by the Jaccard estimate of the sketch of the
union and verified on full sets. In a list every member is first compared with two
leaders; lists of three or more that still hold
several components are then compared in whole, in blocks of bounded size, on full
sets. No list is cut.

The numbers of values and the estimate's bound lie six standard deviations from
what a pair at the threshold gives, for sets larger than the sketch.

Defined results: a null text, or one without words, has an empty set and is linked
with nothing; a text of fewer words than a shingle is one shingle; rows of one id
count as one document; rows with a null id are compared, and a class of null ids
alone has a null component and is kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import bytes_np as B
from tidewire.llm.components import components
from tidewire.llm.shared import mapped, written

SKETCH = 32
#: members and shingles of a block of a list, on average at most
BLOCK = 256
BLOCK_SHINGLES = 1 << 19


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int, values: np.ndarray, table: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a buffer."""
    starts, ends, first = B.word_spans(data, offsets, table)
    hashes = B.span_hashes(B.prefix_sums(data, values), starts, ends)
    grams = B.ngram_hashes(hashes, words)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            yield B.ngram_hashes(hashes[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.empty(0, np.uint64)


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    values, table = B.byte_values(True), B.word_bytes(B.BLANKS)
    data, offsets = B.text_buffer(column)
    for _, _, part, at in B.groups(data, offsets):
        yield from shingle_sets(part, at, words, values, table)


def _sketch(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, high, low, sketches = [], [], [], []
            for found in _sets(batch.column("text"), words):
                digest = xxhash.xxh3_128_intdigest(found.tobytes())
                sizes.append(len(found))
                high.append((digest >> 64) - (1 << 63))
                low.append((digest & ((1 << 64) - 1)) - (1 << 63))
                sketches.append((found[:k] ^ np.uint64(1 << 63)).view(np.int64))  # in the order of signed numbers
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))],
                names=["id", "n", "high", "low", "sketch"],
            )

    return run


def _similar(common, first, second, percent: int):
    return 100 * common >= percent * (first + second - common)


def _verify(words: int, percent: int):
    """Keeps the pairs whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (_sets(batch.column(n), words) for n in ("text_a", "text_b"))
            good = []
            for x, y in zip(first, second, strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(bool(_similar(common, len(x), len(y), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _compare_blocks(words: int, percent: int):
    """Links between the members of two blocks of one list, on full sets; a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("one").type.value_type.field("id").type
            for one, two, same in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), batch.column("same").to_pylist(), strict=True):
                members = one if same else one + two
                sets = list(_sets(pa.array([m["text"] for m in members], pa.string()), words))
                sizes = np.array([len(s) for s in sets])
                flat = np.concatenate(sets)
                of = np.repeat(np.arange(len(sets)), sizes)
                _, column = np.unique(flat, return_inverse=True)
                common = np.zeros((len(sets), len(sets)), np.float32)
                for at in range(0, int(column.max(initial=-1)) + 1, 4096):
                    here = (column >= at) & (column < at + 4096)
                    part = np.zeros((len(sets), 4096), np.float32)
                    part[of[here], column[here] - at] = 1
                    common += part @ part.T
                good = np.argwhere(np.triu(_similar(common.astype(np.int64), sizes[:, None], sizes[None, :], percent), 1))
                label = {m["component"]: m["component"] for m in members}

                def root(x, label=label):
                    while label[x] != x:
                        x = label[x]
                    return x

                found = []
                for i, j in good.tolist():
                    x, y = root(members[i]["component"]), root(members[j]["component"])
                    if x != y:
                        label[x] = y
                        found.append((members[i]["id"], members[j]["id"]))
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    return run


class NearDuplicates:
    """Classes and components of one table of documents."""

    def __init__(self, documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, sketch: int = SKETCH, block: int = BLOCK):
        self.spark, self.words, self.percent, self.k, self.block = documents.sparkSession, words, percent, sketch, block
        t = percent / 100
        #: values that two similar full sketches share at least
        self.least = max(1, math.floor(sketch * t - 6 * math.sqrt(sketch * t * (1 - t))))
        rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        self.id = rows.schema["id"].dataType
        fields = [T.StructField("id", self.id), *(T.StructField(n, T.LongType()) for n in ("n", "high", "low")), T.StructField("sketch", T.ArrayType(T.LongType()))]
        self.texts = rows
        self.sketches = written(mapped(rows, _sketch(words, sketch), T.StructType(fields)), "sketches")
        self.classes = written(self.sketches.where("n > 0").groupBy("high", "low").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")

    def lists(self) -> DataFrame:
        """(value, id): the inverted lists that are opened, of two or more members."""
        nodes = self.classes.where("id is not null")
        retained = nodes.select("id", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
        shared = retained.groupBy("value").agg(F.count("*").alias("c")).where("c > 1")
        mine = retained.join(shared, "value").groupBy("id", "kept").agg(F.sort_array(F.collect_list(F.struct("c", "value"))).alias("shared"))
        least = F.least(F.lit(self.least), F.ceil(F.col("kept") / 2).cast("int"))
        take = F.size("shared") - least + 1  # values that no other has are the rarest
        opened = mine.where(take > 0).select("id", F.explode(F.slice("shared", F.lit(1), take)).alias("s"))
        return opened.select("id", F.col("s.value").alias("value"))

    def _estimated(self, pairs: DataFrame) -> DataFrame:
        """Pairs of which the union's sketch shows enough common values."""
        own = self.classes.select("id", "sketch")
        a, b = (own.select(F.col("id").alias(n), F.col("sketch").alias(f"sketch_{n}")) for n in "ab")
        joined = pairs.join(a, "a").join(b, "b")
        union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, self.k)
        common = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union))
        return joined.where(common >= F.least(F.lit(self.least), F.floor(F.size(union) / 2))).select("a", "b")

    def _verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("id").alias(n), F.col("text").alias(f"text_{n}")) for n in "ab")
        joined = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
        return mapped(joined, _verify(self.words, self.percent), T.StructType([T.StructField("a", self.id), T.StructField("b", self.id)]))

    def links(self) -> DataFrame:
        """(id, component) of the classes that are linked with another."""
        lists = written(self.lists(), "lists")
        texts = written(self.texts.where("id is not null").join(lists.select("id").distinct(), "id", "left_semi"), "near-texts")
        leaders = lists.groupBy("value").agg(F.array(F.min("id"), F.min(F.struct(F.xxhash64("id"), "id"))["id"]).alias("leaders"))
        met = lists.join(leaders, "value").select("id", F.explode("leaders").alias("leader")).where("id <> leader")
        pairs = met.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        found = components(self._verified(self._estimated(pairs), texts))
        sizes = self.classes.select("id", "n")
        placed = lists.join(found, "id", "left").join(sizes, "id").withColumn("component", F.coalesce("component", "id"))
        signature = F.struct(F.count("*").alias("c"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.min("id").alias("m"))
        open_ = placed.groupBy("value").agg(signature.alias("same"), F.count("*").alias("c"), F.sum("n").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("c > 2 and lo < hi")
        blocks = F.ceil(F.greatest(F.col("c") / self.block, F.col("n") / BLOCK_SHINGLES)).cast("int")
        once = open_.groupBy("same").agg(F.min("value").alias("value"), F.first("c").alias("c"), F.first("n").alias("n")).select("value", blocks.alias("blocks"))
        members = placed.join(once, "value").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        blocks = members.join(texts, "id").groupBy("value", "blocks", "block").agg(F.collect_list(F.struct("id", "component", "text")).alias("one"))
        spread = blocks.select("value", "block", "one", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        sides = spread.select("value", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "one")
        left = sides.where("block = x")
        right = sides.where("block = y").select("value", "x", "y", F.col("one").alias("two"))
        compared = left.join(right, ["value", "x", "y"]).select("one", "two", (F.col("x") == F.col("y")).alias("same"))
        more = mapped(compared, _compare_blocks(self.words, self.percent), T.StructType([T.StructField("a", self.id), T.StructField("b", self.id)]))
        return components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).union(more))

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept) of every document."""
        representative = self.classes.select("high", "low", F.col("id").alias("of"))
        linked = self.links().select(F.col("id").alias("of"), "component")
        named = self.sketches.select("id", "n", "high", "low").join(representative, ["high", "low"], "left").join(linked, "of", "left")
        component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "of"))
        out = named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
        return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(documents: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents of which each group of near duplicates keeps the one with the smallest id; columns stay as they are."""
    gone = NearDuplicates(documents, doc_id=doc_id, **options).result().where("not kept and doc_id is not null").select(F.col("doc_id").alias("_tw_gone"))
    return documents.join(gone, F.col(doc_id) == F.col("_tw_gone"), "left_anti")


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document (three-word shingles, similarity 0.85)."""
    return NearDuplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85).result()
