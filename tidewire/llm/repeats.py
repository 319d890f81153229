"""Repeated strings across a corpus: shared plan of the two substring operators.

A text is a sequence of elements (bytes or words), and windows of ``length``
elements are judged. Every window has a sampled gram: the one of the smallest hash
among its ``length - gram + 1`` grams. Equal windows have equal sampled grams, so

1. texts are cut into runs of consecutive window starts with one sampled gram, and
   only runs whose gram is sampled again somewhere are looked at further;
2. the elements of such a run (a segment) go to the bucket of its gram, equal
   segments once for each batch of texts, with their number;
3. in each bucket repeated strings are found by the operator's own method, and
   reported by segment;
4. those reports are joined back to the segments' places, and united by text.

Equal whole texts are judged once: all their windows are repeated. Buckets of grams
that are sampled more than ``hot_runs`` times are split by the windows themselves,
each window then being a segment. Rows are told apart by a 64-bit hash of id and text.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import bytes_np as B

#: window starts in a run at most; longer runs (periodic texts) are cut
RUN = 1024
#: text bytes that are searched for repeats at once, in whole buckets
BUCKET_BYTES = 3 << 17

#: (segments, number of occurrences of each) -> (segment index, first element, elements) of repeats
Finder = Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Elements:
    """How a text is taken as elements; ``separators`` None stands for bytes."""

    def __init__(self, length: int, gram: int, separators: list[int] | None):
        self.length, self.gram, self.separators = length, gram, separators
        self.values = B.byte_values(False)
        self.table = None if separators is None else B.word_bytes(separators)

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        return None if self.table is None else B.word_spans(data, offsets, self.table)

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gram hashes, first element of each text and past the last)."""
        sums = B.prefix_sums(data, self.values)
        if self.table is None:
            at = np.arange(max(0, len(data) - self.gram + 1))
            return B.span_hashes(sums, at, at + self.gram), offsets
        starts, ends, first = B.word_spans(data, offsets, self.table)
        return B.ngram_hashes(B.span_hashes(sums, starts, ends), self.gram), first

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first start, starts, sampled gram, whether the gram occurs twice in the run)."""
        h, first = self.hashes(data, offsets)
        width = self.length - self.gram + 1
        least = B.sliding_min(h, width)
        room = np.diff(first) - self.length + 1
        text = np.flatnonzero(room > 0)
        valid = B.ranges(first[:-1][text], room[text])
        if not len(valid):
            return tuple(np.empty(0, np.int64) for _ in range(5))
        m = least[valid]
        begin = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (valid[1:] != valid[:-1] + 1)]))
        size = np.diff(np.append(begin, len(valid)))
        if size.max() > RUN:
            pieces = -(-size // RUN)
            place = B.ranges(np.zeros(len(size), np.int64), pieces)
            whole = np.repeat(size, pieces)
            begin = np.repeat(begin, pieces) + place * RUN
            size = np.minimum(RUN, whole - place * RUN)
        start = valid[begin]
        view = np.lib.stride_tricks.sliding_window_view(h, width)
        twice = np.empty(len(start), bool)
        for i in range(0, len(start), 4096):
            a, b = start[i : i + 4096], start[i : i + 4096] + size[i : i + 4096] - 1
            twice[i : i + 4096] = a + view[a].argmin(1) != b + width - 1 - view[b][:, ::-1].argmin(1)
        of = np.searchsorted(first, start, "right") - 1
        return of, start - first[of], size, m[begin], twice


def _sample(elements: Elements):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_buffer(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for i, _, part, at in B.groups(data, offsets):
                of, start, size, gram, twice = elements.runs(part, at)
                if len(of):
                    place = (start << 12) | (size << 1) | twice
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(keys[i + of]), pa.array(place)], names=["gram", "key", "place"])

    return run


def _segments(elements: Elements, places_only: bool):
    """Cuts the segments of repeated grams out of their texts."""
    extra = elements.length - 1

    def cut(data, offsets, rows, plans):
        """(bucket, segment, row, start) of each segment."""
        spans = elements.spans(data, offsets)
        first = offsets if spans is None else spans[2]
        raw = data.tobytes()
        at, grams, places, hots = plans
        for k, row in enumerate(rows):
            base, end = int(first[k]), int(first[k + 1])
            own = slice(at[row], at[row + 1])
            for gram, place, hot in zip(grams[own].tolist(), places[own].tolist(), hots[own].tolist(), strict=True):
                start, size = place >> 12, (place & 4095) >> 1
                for a, n in ((start + x, 1) for x in range(size)) if hot else ((start, size),):
                    lo, hi = base + a, base + a + n + extra
                    if hi > end:
                        continue
                    if spans is None:
                        segment = raw[lo:hi]
                    else:
                        segment = b" ".join([raw[x:y] for x, y in zip(spans[0][lo:hi].tolist(), spans[1][lo:hi].tolist(), strict=True)])
                    yield gram, segment, row, a, hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [i for i, chosen in enumerate(batch.column("chosen").to_pylist()) if chosen]
            if not rows:
                continue
            picked = batch.take(pa.array(rows))
            plans = B.list_fields(picked.column("runs"), "gram", "place", "hot")
            keys = picked.column("key").to_numpy().tolist()
            data, offsets = B.text_buffer(picked.column("text"))
            for i, j, part, at in B.groups(data, offsets, 4 << 20):
                kept: dict[tuple[int, bytes], list] = {}
                out: list[tuple[int, int, int, int]] = []
                for gram, segment, row, a, hot in cut(part, at, range(i, j), plans):
                    digest = xxhash.xxh3_128_intdigest(segment)
                    high, low = (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)
                    if places_only:
                        out.append((high, low, keys[row], a))
                    elif (high, low) in kept:
                        kept[high, low][3] += 1
                    else:
                        kept[high, low] = [high if hot else gram, high, low, 1, segment]
                if places_only and out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["high", "low", "key", "start"])
                elif kept:
                    columns = list(zip(*kept.values(), strict=True))
                    kinds = [pa.int64()] * 4 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "high", "low", "n", "segment"])

    return run


def _joined(finder: Finder):
    """A finder's spans as one batch."""

    def search(names: np.ndarray, segments: list[bytes], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, begin, size = finder(segments, counts)
        columns = [names[at, 0], names[at, 1], begin.astype(np.int64), size.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["high", "low", "begin", "size"])

    return search


def _listed(finder: Callable[[list[bytes], np.ndarray], Iterator[tuple[int, int, int, int]]], rows: int = 20_000):
    """Group members as batches of a bounded number of rows."""

    def search(names: np.ndarray, segments: list[bytes], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        members = finder(segments, counts)
        while part := list(itertools.islice(members, rows)):
            at, begin, size, group = np.array(part, np.int64).T
            columns = [names[at, 0], names[at, 1], begin, size, group]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["high", "low", "begin", "size", "group"])

    return search


def _find(search):
    """Finds repeats in whole buckets (rows come ordered by bucket), a bounded number of bytes at a time."""

    def emit(held: dict[tuple[int, int], list]) -> Iterator[pa.RecordBatch]:
        yield from search(np.array(list(held), np.int64).reshape(-1, 2), [v[1] for v in held.values()], np.array([v[0] for v in held.values()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        amount, last = 0, None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("bucket", "high", "low", "n", "segment")]
            for bucket, high, low, n, segment in zip(*columns, strict=True):
                if bucket != last and amount >= BUCKET_BYTES:
                    yield from emit(held)
                    held, amount = {}, 0
                last = bucket
                if (high, low) in held:
                    held[high, low][0] += n
                else:
                    held[high, low] = [n, segment]
                    amount += len(segment)
        if held:
            yield from emit(held)

    return run


def united(begins: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that spans cover."""
    if not len(begins):
        return []
    order = np.argsort(begins)
    begins, ends = begins[order], np.maximum.accumulate((begins + sizes)[order])
    first = np.flatnonzero(np.concatenate([[True], begins[1:] > ends[:-1]]))
    return list(zip(begins[first].tolist(), ends[np.append(first[1:], len(ends)) - 1].tolist(), strict=True))


def joined_spans(edges: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs that spans cover in a row of segments, as (segment, first element, elements); no span crosses an edge."""
    order = np.argsort(begins, kind="stable")
    begins = begins[order]
    ends = np.maximum.accumulate(begins + sizes[order])
    of = np.searchsorted(edges, begins, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], (begins[1:] > ends[:-1]) | (of[1:] != of[:-1])])) if len(begins) else np.empty(0, np.int64)
    last = np.append(first[1:], len(ends))[: len(first)] - 1
    return of[first], begins[first] - edges[of[first]], ends[last] - begins[first]


def _remove(elements: Elements, digest: bool):
    """Size, removed elements and what is kept of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            edge, begins, lengths = B.list_fields(batch.column("spans"), "begin", "size")
            copied = batch.column("copied").to_pylist()
            column = batch.column("text")
            data, offsets = B.text_buffer(column)
            for i, j, part, at in B.groups(data, offsets, 4 << 20):
                raw = part.tobytes()
                spans = elements.spans(part, at)
                first = at if spans is None else spans[2]
                for k in range(j - i):
                    base, n = int(first[k]), int(first[k + 1] - first[k])
                    cover = united(begins[edge[i + k] : edge[i + k + 1]], lengths[edge[i + k] : edge[i + k + 1]])
                    if copied[i + k] and n >= elements.length:
                        cover = [(0, n)]
                    edges = [0, *[x for pair in cover for x in pair], n]
                    rest = list(zip(edges[::2], edges[1::2], strict=True))
                    if spans is None:
                        text = b"".join([raw[base + a : base + b] for a, b in rest])
                    elif digest:
                        text = b" ".join([raw[x:y] for a, b in rest for x, y in zip(spans[0][base + a : base + b].tolist(), spans[1][base + a : base + b].tolist(), strict=True)])
                    else:  # the text between the removed words stays as it is
                        cuts = [int(at[k]), *[x for a, b in cover for x in (int(spans[0][base + a]), int(spans[1][base + b - 1]))], int(at[k + 1])]
                        text = b"".join([raw[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)])
                    sizes.append(n)
                    removed.append(sum(b - a for a, b in cover))
                    runs.append([{"begin": a, "end": b} for a, b in cover])
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "ignore"))
            names = [n for n in batch.schema.names if n not in ("key", "text", "spans", "copied")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())],
                names=[*names, "n_elements", "n_removed", "removed_runs", "kept"],
            )

    return run


class RepeatJob:
    """The repeats of one table of documents, as DataFrames."""

    def __init__(self, documents: DataFrame, elements: Elements, finder: Finder, *, doc_id: str = "doc_id", text: str = "text", hot_runs: int = 50_000):
        self.elements, self.id_type = elements, documents.schema[doc_id].dataType
        parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        whole = F.coalesce(F.col(text), F.lit(""))
        rows = documents.select(F.xxhash64(F.col(doc_id), whole).alias("key"), F.col(doc_id).alias("doc_id"), whole.alias("text"))
        sampled = rows.select("key", "text").mapInArrow(_sample(elements), "gram long, key long, place long")
        twice = (F.col("place") % 2).cast("int")
        grams = sampled.groupBy("gram").agg(F.count("*").alias("n"), F.max(twice).alias("twice")).where("n > 1 or twice = 1").select("gram", (F.col("n") > hot_runs).alias("hot"))
        runs = sampled.join(grams, "gram").groupBy("key").agg(F.collect_set(F.struct("gram", "place", "hot")).alias("runs"))
        marked = rows.select("key", "doc_id", F.md5("text").alias("copy"))
        copies = marked.groupBy("copy").agg(F.count("*").alias("n"), F.min("key").alias("chosen"))
        state = marked.distinct().join(copies, "copy").select("key", "doc_id", "copy", (F.col("n") > 1).alias("copied"), (F.col("chosen") == F.col("key")).alias("is_chosen"))
        plan = state.join(runs, "key", "left").select("key", "copied", (F.col("is_chosen") & F.col("runs").isNotNull()).alias("chosen"), F.when(F.col("is_chosen"), F.col("runs")).alias("runs"))
        self.placed = rows.select("key", "text").repartition(parts, "key")
        with_plan = self.placed.join(plan.hint("shuffle_hash"), "key", "left").select("key", "text", "chosen", "runs")
        segments = with_plan.mapInArrow(_segments(elements, False), "bucket long, high long, low long, n long, segment binary")
        self.dealt = segments.repartition(parts, "bucket").sortWithinPartitions("bucket")
        #: repeats by segment: (high, low) is the segment's hash
        self.repeats = self.dealt.mapInArrow(_find(_joined(finder)), "high long, low long, begin long, size long")
        #: places of the segments
        self.places = with_plan.mapInArrow(_segments(elements, True), "high long, low long, key long, start long")
        self.state = state

    def find_all(self, finder: Callable[[list[bytes], np.ndarray], Iterator[tuple[int, int, int, int]]]) -> DataFrame:
        """What a finder of group members finds: (high, low, begin, size, group)."""
        return self.dealt.mapInArrow(_find(_listed(finder)), "high long, low long, begin long, size long, group long")

    def occurrences(self) -> DataFrame:
        """(key, begin, size): every occurrence of a repeat, in elements of its text."""
        return self.places.join(self.repeats, ["high", "low"]).select("key", (F.col("start") + F.col("begin")).alias("begin"), "size")

    def removed(self, digest: bool) -> DataFrame:
        """(doc_id, n_elements, n_removed, removed_runs, kept); kept is the text that remains or its sha256."""
        spans = self.occurrences().groupBy("key").agg(F.collect_set(F.struct("begin", "size")).alias("spans"))
        found = self.state.select("key", "doc_id", "copied").join(spans, "key", "left")
        joined = self.placed.join(found.hint("shuffle_hash"), "key", "left")
        run = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
        schema = T.StructType([T.StructField("doc_id", self.id_type), T.StructField("n_elements", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_runs", T.ArrayType(run)), T.StructField("kept", T.StringType())])
        return joined.select("key", "doc_id", "text", "copied", "spans").mapInArrow(_remove(self.elements, digest), schema)
