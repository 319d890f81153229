"""Suffix-array dedup of repeated byte strings.

In each bucket an enhanced suffix array of the segments is built (prefix doubling;
LCP values by descending the doubling levels). A stack scan of the LCP values walks
the common-prefix interval tree: every interval of at least ``length`` bytes is a
set of all occurrences of one string, and it is reported when its occurrences have
different bytes before them (a segment's first byte counts as having its own), that
is, when it cannot be extended to the left. A segment that occurs several times is
reported whole.

Defined results: a null text is empty; texts shorter than ``length`` keep all; each
of repeated rows is covered by the others; strings never cross texts; an empty table
gives no rows. Kept text of the general form drops bytes of a character cut in two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import bytes_np as B
from tidewire.llm.repeats import Elements, RepeatJob, joined_spans
from tidewire.llm.shared import mapped

_STEP = 7


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1, in the order of the keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.empty(len(keys), np.int32)
    new[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
    return new


def enhanced_suffix_array(data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array of the given starts, LCP with the predecessor); ``ends`` is the end of the segment of each byte."""
    n = len(data)
    at = np.arange(n)
    keys = np.zeros(n, np.int64)
    wide = np.concatenate([data.astype(np.int64) + 1, np.zeros(_STEP, np.int64)])
    for k in range(_STEP):
        keys = (keys << 9) | np.where(at + k < ends, wide[k : k + n], 0)
    levels, size, longest = [(_STEP, _ranks(keys))], _STEP, int((ends - at).max(initial=0))
    while size < longest:
        rank = levels[-1][1]
        later = np.zeros(n, np.int64)
        later[: n - size] = np.where(at[: n - size] + size < ends[: n - size], rank[size:], 0)
        levels.append((size * 2, _ranks((rank.astype(np.int64) << 32) | later)))
        size *= 2
    final = levels[-1][1]
    order = starts[np.argsort(final[starts], kind="stable")]
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(a), np.int64)
    for size, rank in reversed(levels):
        x, y = a + lcp, b + lcp
        inside = (x < ends[a]) & (y < ends[b])
        same = np.zeros(len(a), bool)
        same[inside] = rank[x[inside]] == rank[y[inside]]
        lcp += np.where(same, np.minimum(size, ends[a] - x), 0)
    for _ in range(_STEP - 1):
        x, y = a + lcp, b + lcp
        inside = np.flatnonzero((x < ends[a]) & (y < ends[b]))
        lcp[inside[data[x[inside]] == data[y[inside]]]] += 1
    return order, np.concatenate([[0], lcp])


def maximal_intervals(lcp: np.ndarray, left: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the LCP intervals of at least ``length`` with diverse left bytes.

    ``left`` is the byte before each suffix; negative values are all different.
    """
    out: list[tuple[int, int, int]] = []
    deep = lcp >= length
    edges = np.flatnonzero(np.diff(np.concatenate([[0], deep.view(np.int8), [0]])))
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        depths, lefts = lcp[begin:end].tolist(), left[begin - 1 : end].tolist()
        # each open interval: depth, first suffix, common left byte (None: diverse)
        stack: list[list] = []
        for k, depth in enumerate(depths):
            first, common = begin - 1 + k, lefts[k]
            if common < 0:
                common = None
            while stack and stack[-1][0] > depth:
                d, f, c = stack.pop()
                c = c if c is not None and c == common else None
                if c is None:
                    out.append((d, f, begin - 1 + k))
                first, common = f, c
            if stack and stack[-1][0] == depth:
                if stack[-1][2] != common:
                    stack[-1][2] = None
            else:
                stack.append([depth, first, common])
        common = lefts[-1] if lefts[-1] >= 0 else None
        while stack:
            d, f, c = stack.pop()
            common = c if c is not None and c == common else None
            if common is None:
                out.append((d, f, end - 1))
    return out


def _intervals(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(edges of the segments, suffix array, maximal intervals) of a row of segments."""
    sizes = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(b"".join(segments), np.uint8)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    starts = B.ranges(edges[:-1], np.maximum(0, sizes - length + 1))
    order, lcp = enhanced_suffix_array(data, np.repeat(edges[1:], sizes), starts)
    left = np.where(order > 0, data[np.maximum(order - 1, 0)].astype(np.int64), -1)
    left[order == edges[np.searchsorted(edges, order, "right") - 1]] = -1
    return edges, order, maximal_intervals(lcp, left, length)


def find_groups(length: int):
    """Yields (segment, first byte, bytes, group) of all members of the maximal repeat groups."""

    def find(segments: list[bytes], counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        edges, order, intervals = _intervals(segments, length)
        for segment, (text, n) in enumerate(zip(segments, counts, strict=True)):
            if n > 1:
                yield segment, 0, len(text), xxhash.xxh3_64_intdigest(text) - (1 << 63)
        for depth, first, last in intervals:
            members = order[first : last + 1]
            of = np.searchsorted(edges, members, "right") - 1
            begins = (members - edges[of]).tolist()
            group = xxhash.xxh3_64_intdigest(segments[of[0]][begins[0] : begins[0] + depth]) - (1 << 63)
            for segment, begin in zip(of.tolist(), begins, strict=True):
                yield segment, begin, depth, group

    return find


def find_repeats(length: int):
    """The finder of maximal repeats of at least ``length`` bytes."""

    def find(segments: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edges, order, intervals = _intervals(segments, length)
        sizes = np.diff(edges)
        found = sorted(intervals)
        deepest = np.zeros(len(order), np.int64)
        for depth, first, last in found:  # deeper ones are inside and come later
            deepest[first : last + 1] = depth
        member = np.flatnonzero(deepest)
        whole = np.flatnonzero(counts > 1)
        begins = np.concatenate([edges[whole], order[member]])
        return joined_spans(edges, begins, np.concatenate([sizes[whole], deepest[member]]))

    return find


def repeat_job(documents: DataFrame, *, length: int = 200, gram: int | None = None, **options) -> RepeatJob:
    """The job of repeated byte strings; its ``occurrences()`` are those of all maximal repeats."""
    return RepeatJob(documents, Elements(length, gram or max(1, min(32, length // 4)), None), find_repeats(length), **options)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts as members of the groups named by their hashes."""
    for batch in batches:
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        groups, sizes = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts], [len(t) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(sizes, pa.int64()), batch.column("copy"), pa.array([0] * len(texts), pa.int64())], names=["group", "size", "copy", "begin"])


def repeat_groups(documents: DataFrame, *, length: int = 200, **options) -> DataFrame:
    """(group, size, doc_id, begin): the maximal repeat groups with all their occurrences, in bytes.

    A group is one repeated string, named by its hash. Repeats that run over several
    sampled grams come as one group for each gram's segments. Texts that are equal as a
    whole are searched once; each has what is found, and they are a group themselves.
    """
    job = repeat_job(documents, length=length, **options)
    members = job.find_all(find_groups(length))
    found = job.places.join(members, ["high", "low"]).select("group", "size", "key", (F.col("start") + F.col("begin")).alias("begin"))
    found = found.join(job.state.where("is_chosen").select("key", "copy").distinct(), "key").select("group", "size", "copy", "begin").distinct()
    copied = job.state.where("copied and is_chosen").select("key", "copy").distinct()
    texts = job.placed.where(F.octet_length("text") >= length).join(copied, "key").dropDuplicates(["key"]).select("text", "copy")
    whole = mapped(texts, _whole, "group long, size long, copy string, begin long")
    return found.union(whole).join(job.state.select("copy", "doc_id"), "copy").select("group", "size", "doc_id", "begin").distinct()


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Removal digest of every document for repeated 200-byte strings."""
    found = repeat_job(spark.read.parquet(f"{sf_dir}/documents.parquet")).removed(digest=True)
    return found.select("doc_id", F.col("n_elements").alias("n_bytes"), "n_removed", F.size("removed_runs").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))
