"""Substring dedup of repeated word sequences by level-wise doubling.

In each bucket windows of one word are counted; a window of twice the length is a
candidate only where both its halves are repeated, and so on up to ``length`` words
(the last level joins two overlapping windows), until no candidate survives.

Defined results: a null text has no words; texts of fewer words than ``length`` keep
all; each of repeated rows is covered by the others; windows never cross texts; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import bytes_np as B
from tidewire.llm.repeats import Elements, RepeatJob


def _repeated(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, whether it occurs more than once)."""
    _, number = np.unique(keys, return_inverse=True)
    return number, np.bincount(number, weights=weight)[number] > 1


def find_windows(length: int):
    """The finder of repeated windows of ``length`` words."""

    def find(segments: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        split = [s.split(b" ") for s in segments]
        sizes = np.array([len(s) for s in split], np.int64)
        words = pd.factorize(np.array([w for s in split for w in s], object))[0].astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        of = np.repeat(np.arange(len(sizes)), sizes)
        left = edges[1:][of] - np.arange(len(words))  # words from here to the end of the segment
        weight = np.minimum(counts, 2).astype(float)[of]
        number, more = _repeated(words, weight)
        at = np.flatnonzero(more)
        size = 1
        while len(at) and size < length:
            step = min(size, length - size)
            alive = np.zeros(len(words) + 1, bool)
            alive[at] = True
            at = at[left[at] >= size + step]
            at = at[alive[at + step]]
            if not len(at):
                break
            keys, more = _repeated((number[at] << 32) | number[at + step], weight[at])
            number = number.copy()
            number[at] = keys
            at, size = at[more], size + step
        if not len(at):
            none = np.empty(0, np.int64)
            return none, none, none
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(of[at]) != 0)]))
        run = np.diff(np.append(begin, len(at)))
        first = at[begin]
        return of[first], first - edges[of[first]], run + length - 1

    return find


def repeat_job(documents: DataFrame, *, length: int = 35, gram: int | None = None, **options) -> RepeatJob:
    """The job of repeated word windows."""
    return RepeatJob(documents, Elements(length, gram or max(1, length // 4), B.BLANKS), find_windows(length), **options)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Removal digest of every document for repeated windows of 35 words."""
    found = repeat_job(spark.read.parquet(f"{sf_dir}/documents.parquet")).removed(digest=True)
    return found.select("doc_id", F.col("n_elements").alias("n_words"), "n_removed", F.col("kept").alias("kept_sha256"))
