"""Exact top-k search by inner product with vector-approximation files.

Candidates are packed into blocks, which are dealt to lanes. A block has for each vector
the number of its quantisation cell in every dimension (the approximation, one byte)
beside the exact components. For a block of queries the cells are scanned for bounds
of the score; the exact scores of the vectors with the highest bounds give a score that
the kth result reaches, and exact vectors are read where the bound reaches it too. Queries are a stated set; every lane reads their blocks, a
bounded number of them in a task.

Defined results: rows with a null id, a null vector, or null or non-finite
components take no part; vectors are compared with those of their own length;
candidates with the query's id are left out; repeated candidate rows count each,
ties go to the smaller id; a repeated query id is answered once; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.shared import mapped, written

BLOCK = 4096
QUERY_BLOCK = 1024
#: queries that a task compares with its candidates
QUERIES = 16 * QUERY_BLOCK
CELLS = 16
_EXACT = float(1 << 53)
_NONE = np.iinfo(np.int64).min


def _pack(block: int):
    """Packs vectors of each length into blocks of at most ``block`` rows, components as narrow as they fit (``wide`` bytes); a task holds one block a length."""

    def emit(length: int, ids: np.ndarray, exact: np.ndarray) -> pa.RecordBatch:
        low, high = exact.min(0, initial=0), exact.max(0, initial=0)
        step = np.maximum(1, -((low - high - 1) // CELLS))
        cells = ((exact - low) // step).astype(np.uint8)
        kind = np.dtype(np.int16 if -(1 << 15) <= low.min() and high.max() < 1 << 15 else np.int64)
        columns = [[length], [kind.itemsize], [ids.tobytes()], [exact.astype(kind).tobytes()], [cells.tobytes()], [low.tobytes()], [step.tobytes()]]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["length", "wide", "ids", "exact", "cells", "low", "step"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            vectors = batch.column("vector")
            sizes = vectors.value_lengths().to_numpy()
            flat, edges = vectors.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            names = batch.column("id").to_numpy()
            for length in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == length)
                ids, exact = names[rows], flat[edges[rows][:, None] + np.arange(length)]
                if length in held:
                    ids, exact = np.concatenate([held[length][0], ids]), np.concatenate([held[length][1], exact])
                while len(ids) >= block:
                    yield emit(length, ids[:block], exact[:block])
                    ids, exact = ids[block:], exact[block:]
                held[length] = ids, exact
        for length, (ids, exact) in held.items():
            if len(ids):
                yield emit(length, ids, exact)

    return run


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: in floating point where that is exact."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def search_block(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, exact: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate id, score) of the k best candidates of one block for each query."""
    floor = low + cells.astype(np.int64) * step
    upper = _product(np.maximum(queries, 0), floor + step - 1) + _product(np.minimum(queries, 0), floor)
    own = query_ids[:, None] == ids
    upper[own] = _NONE
    few = min(len(ids), max(4 * k, 32))
    first = np.argpartition(upper, len(ids) - few, axis=1)[:, len(ids) - few :]
    sure = np.stack([exact[c] @ v for v, c in zip(queries, first, strict=True)]) if len(queries) else np.empty((0, few), np.int64)
    sure[np.take_along_axis(own, first, 1)] = _NONE
    least = np.sort(sure, axis=1)[:, max(0, few - k)]  # no more than the kth score
    reach = (upper >= least[:, None]) & ~own
    read = np.flatnonzero(reach.any(0))
    scores, reach, names = _product(queries, exact[read]), reach[:, read], ids[read]
    q, c = np.nonzero(reach & (scores >= least[:, None]))
    s, names = scores[q, c], names[c]
    order = np.lexsort((names, -s, q))
    kept = order[np.arange(len(q)) - np.searchsorted(q, q) < k]  # q is in order
    return q[kept], names[kept], s[kept]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = row["length"]
                query_ids, ids, low, step = (np.frombuffer(row[n], np.int64) for n in ("q_ids", "ids", "low", "step"))
                queries, exact = (np.frombuffer(row[n], f"i{row[w]}").astype(np.int64).reshape(-1, d) for n, w in (("q_exact", "q_wide"), ("exact", "wide")))
                cells = np.frombuffer(row["cells"], np.uint8).reshape(-1, d)
                q, c, s = search_block(queries, query_ids, ids, exact, cells, low, step, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(c), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


_BLOCKS = "length int, wide int, ids binary, exact binary, cells binary, low binary, step binary"


def top_k(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products of floor(scale * component)."""
    spark = vectors.sparkSession
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bad = F.exists("_tw_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (
        vectors.where(is_query.isNotNull() & F.col(vec_id).isNotNull())
        .select(F.col(vec_id).cast("long").alias("id"), is_query.alias("is_query"), F.col(vector).cast("array<double>").alias("_tw_v"))
        .where(F.col("_tw_v").isNotNull() & (F.size("_tw_v") > 0) & ~bad)
        .select("id", "is_query", F.transform("_tw_v", lambda x: F.floor(x * F.lit(float(scale)))).alias("vector"))
    )
    packed = mapped(rows.select("id", "vector"), _pack(block), _BLOCKS).repartition(lanes)
    asked = written(rows.where("is_query").dropDuplicates(["id"]).select("id", "vector"), "queries")
    parts = asked.count() // QUERIES + 1
    blocks = written(mapped(asked.repartition(parts), _pack(query_block), _BLOCKS), "query_blocks")
    queries = blocks.repartition(parts).select("length", F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"), F.col("exact").alias("q_exact"))
    pairs = packed.join(queries.hint("shuffle_replicate_nl"), "length")  # blocks are read again, not copied or broadcast
    found = mapped(pairs, _search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    """Five best other vectors for every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
