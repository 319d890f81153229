"""Periodic run detection over words: linear-time runs on an ordered alphabet (Ellert and Fischer).

The words of a text are numbered, and only the order of the numbers is used. A Lyndon
array (the next smaller suffix of every position) is made from left to right for the
order and for its reverse; every comparison of two suffixes starts from what earlier
ones matched, so a position is inspected again only where a match is extended. There is
no suffix array, no table of common prefixes and no fingerprint. Every run has the
Lyndon word at one of its positions, under one of the orders, as its root.

Most texts hold no run. In a run of at least three periods and ``min_length`` words every
window of ``min_length // 3`` words stands twice (length >= 2 * period + window), so only
stretches covered by windows that stand twice in their text go through the Lyndon arrays:
a run lies in one such stretch with its neighbours' windows. Windows are told apart by
exact ranks of pairs, doubled level by level.

Defined results: a null or empty text has no words and no runs; each row is treated by
itself, whatever its id (null and repeated ids too); columns other than the id and the
text are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import bytes_np as B
from tidewire.llm.shared import mapped

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def next_smaller(x: list[int]) -> tuple[list[int], list[int]]:
    """For each position, the next one with a smaller suffix (the length where none is) and how far the two match.

    ``reach`` is the furthest inspected position; [star, reach) equals the same stretch ``delta`` earlier, so pairs
    with an end there have their match from the pair ``delta`` earlier. Along the chain of previous smaller suffixes a
    match is the lesser of two known ones where these differ. Only where neither settles it are words compared.
    """
    n = len(x)
    after, after_match = [n] * n, [0] * n
    before, before_match = [-1] * n, [0] * n
    reach = delta = star = 0
    for right in range(1, n):
        left, known, last = right - 1, 0, -1
        while True:
            match, settled = known, False
            if last >= 0 and before_match[last] != known:
                match, settled = min(known, before_match[last]), True
            elif right + known < reach:
                b, room = right - delta, reach - right
                a = left - delta if left >= star else left
                if a == b:
                    match, settled = room, True
                else:
                    if a > b:
                        a, b = b, a
                    earlier = after_match[a] if after[a] == b else before_match[b] if before[b] == a else -1
                    if earlier >= 0:
                        match, settled = min(earlier, room), earlier != room
            if not settled:
                while right + match < n and x[left + match] == x[right + match]:
                    match += 1
                if right + match > reach:
                    reach, delta, star = right + match, right - left, right
            if right + match < n and x[left + match] < x[right + match]:
                before[right], before_match[right] = left, match
                break
            after[left], after_match[left] = right, match
            known, last, left = match, left, before[left]
            if left < 0:
                break
    return after, after_match


def periodic_runs(x: list[int], min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, period, length) of all maximal runs of at least ``min_exponent`` (3 or more) periods and ``min_length`` elements."""
    n = len(x)
    found = set()
    for y in (x, [-c for c in x]):
        after, matches = next_smaller(y)
        for i in range(n):
            match = matches[i]
            period = after[i] - i
            # the first root of a run begins less than a period after the run
            if match <= (min_exponent - 2) * period or match + 2 * period <= min_length:
                continue
            if i >= period and after[i - period] == i and matches[i - period] >= period:
                continue  # not the first root
            start = i
            while start and i - start < period and x[start - 1] == x[start - 1 + period]:
                start -= 1
            length = i + period + match - start
            if length >= max(min_length, min_exponent * period):
                found.add((start, period, length))
    return sorted(found)


def _stretches(words: np.ndarray, edges: np.ndarray, window: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(text, first word, past the last word) of stretches of at least ``least`` words whose windows stand twice in their text."""
    of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    left = edges[1:][of] - np.arange(len(words))
    at, size = np.arange(len(words)), 1
    keys = (of << 32) | words
    number = np.zeros(len(words), np.int64)
    alive = np.zeros(len(words) + 1, bool)
    while len(at):
        _, rank, count = np.unique(keys, return_inverse=True, return_counts=True)
        number[at] = rank
        at = at[count[rank] > 1]
        if size == window:
            break
        step = min(size, window - size)
        alive[:] = False
        alive[at] = True
        at = at[left[at] >= size + step]
        at = at[alive[at + step]]
        keys = (number[at] << 32) | number[at + step]
        size += step
    if not len(at):
        return
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) > window) | (np.diff(of[at]) != 0)]))
    end = np.append(begin[1:], len(at)) - 1
    for first, last in zip(at[begin].tolist(), at[end].tolist(), strict=True):
        if last + window - first >= least:
            yield int(of[first]), first, last + window


def text_runs(texts: list[list[bytes]], min_length: int, min_exponent: int) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, period, length) of the texts that have any, by number of the text."""
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = pd.factorize(np.array([w for t in texts for w in t] or [b""], object))[0].astype(np.int64)[: edges[-1]]
    found: dict[int, list[tuple[int, int, int]]] = {}
    for of, begin, end in _stretches(words, edges, max(1, min_length // 3), min_length):
        at = begin - int(edges[of])
        runs = [(at + s, p, n) for s, p, n in periodic_runs(words[begin:end].tolist(), min_length, min_exponent)]
        if runs:
            found.setdefault(of, []).extend(runs)
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those that a run holds after its first period."""
    kept = np.ones(len(words), bool)
    for start, period, length in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def find_runs(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", min_length: int = 24, min_exponent: int = 3, digest: bool = False) -> DataFrame:
    """(id, n_words, runs by start and period, collapsed) of every row: a run is a maximal stretch of one period.

    ``collapsed`` is the text without the words that repeat a run's first period, joined by one space (with ``digest``
    its SHA-256). There is no shuffle: a task holds the words of about a megabyte of texts, or of one longer text.
    """
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods are not searched")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, text_column):
            texts = [(t or b"").split() for t in batch.column(text_column).cast(pa.binary()).to_pylist()]
            found = text_runs(texts, min_length, min_exponent)
            kept = [b" ".join(collapse(t, found[i]) if i in found else t) for i, t in enumerate(texts)]
            runs = [[{"start": s, "length": n, "period": p} for s, p, n in found.get(i, ())] for i in range(len(texts))]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            collapsed = pa.array([hashlib.sha256(k).hexdigest() for k in kept]) if digest else pa.array(kept, pa.binary()).cast(pa.string())
            columns = [batch.column(id_column), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, kind), collapsed]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "n_words", "runs", "collapsed"])

    rows = documents.select(id_column, text_column)
    kind = rows.schema[id_column].dataType.simpleString()
    return mapped(rows, run, f"`{id_column}` {kind}, n_words long, runs array<{RUN}>, collapsed string")


def with_repeated_tail(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with the tails of a tenth of the texts (crc32 of the id divisible by 10) made periodic."""
    g = F.expr("crc32(cast(doc_id as string)) div 10")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    cut = documents.select("doc_id", "text", g.alias("_g"), F.when(chosen, words).alias("_words")).withColumn("_n", F.expr("nullif(array_size(_words), 0)"))
    cut = cut.withColumn("_a", F.expr("int(_g % _n)")).withColumn("_p", F.expr("int(1 + (_n - _a) div (3 + _g % 8))"))
    tail = "if(_n > _a + _p, transform(sequence(_a + _p, _n - 1), i -> element_at(_words, int(_a + (i - _a) % _p + 1))), array())"
    text = F.expr(f"if(_n is null, text, array_join(concat(slice(_words, 1, _a + _p), {tail}), ' '))")
    return cut.select("doc_id", text.alias("text"))


def run_digests(found: DataFrame) -> list[Column]:
    """Number of runs, the run of greatest exponent and the digest of all runs, of rows with ``runs``."""
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = f"aggregate(runs, cast(null as {RUN}), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))"
    return [
        F.size("runs").cast("long").alias("n_runs"),
        *(F.expr(f"{best}.{name}").alias(name) for name in ("start", "length", "period")),
        F.expr(f"(1000 * {best}.length) div {best}.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
    ]


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of at least 24 words and three periods of every document, a tenth of which get a periodic tail."""
    found = find_runs(with_repeated_tail(spark.read.parquet(f"{sf_dir}/documents.parquet")), digest=True)
    return found.select("doc_id", *run_digests(found), F.col("collapsed").alias("collapsed_sha256"))
