"""Toxicity by weak supervision.

Voters are lexicon terms and word-beginning patterns found by their association with
the labelled rows. A generative label model (latent class, fitted by EM) estimates
the prior and how often each voter fires for either class; from the residual
correlations of the voters given the class each voter's weight is lowered, so that
voters that say the same thing do not count twice. A linear classifier is trained
on the posterior labels and scores every text.

Bound: the model is fitted on at most about ``max_rows`` labelled rows, taken by a
hash of their ids. Of the features of these rows every one becomes a voter that
``min_texts`` of them have, ``min_toxic`` toxic ones among these, and whose log odds
lie ``min_odds`` above those of all; there is no further limit. Corpus texts are
scored whole and all.

Defined results: a null or empty text, or one without words, gets the score of a text where no voter
fires; labels that are null are left out; with no labelled row of either class the
score is the share of toxic labels (0 where there is none); a column of the score's
name is replaced; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import bytes_np as B
from tidewire.llm.shared import mapped, written

MAX_ROWS = 20_000
PATTERN_LETTERS = 5
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class ToxicityModel:
    terms: dict[str, int]
    patterns: dict[str, int]
    weights: np.ndarray
    bias: float
    #: estimates of the label model, for inspection: prior, firing rates of both classes, correlation weights
    prior: float
    rates: np.ndarray
    discount: np.ndarray

    def voters(self, text: str | None) -> list[int]:
        """Indices of the voters that fire."""
        words = set(_WORD.findall(text.lower())) if text else set()
        out = {self.terms[w] for w in words & self.terms.keys()}
        return sorted(out | {self.patterns[p] for p in {w[:PATTERN_LETTERS] for w in words} & self.patterns.keys()})

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[self.voters(text)].sum(), -60, 60))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and word beginnings with the number of texts and of toxic texts that have them, for runs of rows."""
    for batch in B.slices(batches, "text"):
        texts, toxic = Counter(), Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            words = set(_WORD.findall(text.lower())) if text else set()
            found = [*((0, w) for w in words), *((1, s) for s in {w[:PATTERN_LETTERS] for w in words if len(w) > PATTERN_LETTERS})]
            texts.update(found)
            if y:
                toxic.update(found)
        kinds, names = zip(*texts, strict=True) if texts else ((), ())
        counts = [pa.array([by[k] for k in texts], pa.int64()) for by in (toxic, texts)]
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(names, pa.string()), *counts], names=["kind", "name", "on", "n"])


class Votes:
    """Which of ``m`` voters fire in each row, as the concatenated lists of their numbers."""

    def __init__(self, lists: list[list[int]], m: int):
        self.m, self.sizes = m, np.fromiter(map(len, lists), np.int64, len(lists))
        self.index = np.fromiter((v for row in lists for v in row), np.int64, int(self.sizes.sum()))
        self.edges = np.concatenate([[0], np.cumsum(self.sizes)])

    def by_voter(self, weights: np.ndarray) -> np.ndarray:
        """For each voter the summed weights of the rows where it fires."""
        return np.bincount(self.index, np.repeat(weights, self.sizes), self.m)

    def by_row(self, weights: np.ndarray) -> np.ndarray:
        """For each row the summed weights of the voters that fire."""
        sums = np.concatenate([[0.0], np.cumsum(weights[self.index])])
        return sums[self.edges[1:]] - sums[self.edges[:-1]]

    def together(self, counts: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first voter, second voter, summed weights) of the pairs of different voters that fire in one row, some rows at a time."""
        keys, sums = np.empty(0, np.int64), np.empty(0)
        squares = np.concatenate([[0], np.cumsum(self.sizes**2)])
        a = 0
        while a < len(self.sizes):
            b = max(a + 1, int(np.searchsorted(squares, squares[a] + most, "right")) - 1)
            own, n = self.index[self.edges[a] : self.edges[b]], self.sizes[a:b]
            row = np.repeat(np.arange(a, b), n)
            left = np.repeat(own, self.sizes[row])
            right = own[B.ranges(self.edges[row] - self.edges[a], self.sizes[row])]
            new = np.concatenate([keys, (left * self.m + right)[left != right]])
            weight = np.concatenate([sums, np.repeat(counts[row], self.sizes[row])[left != right]])
            keys, at = np.unique(new, return_inverse=True)
            sums, a = np.bincount(at, weight, len(keys)), b
        return keys // self.m, keys % self.m, sums


def _votes(fires: np.ndarray | Votes) -> Votes:
    return fires if isinstance(fires, Votes) else Votes([np.flatnonzero(row).tolist() for row in fires], fires.shape[1])


def _discount(fires: Votes, together: tuple[np.ndarray, np.ndarray, np.ndarray], post: np.ndarray, rates: np.ndarray, counts: np.ndarray, least: float = 0.1) -> np.ndarray:
    """Weights of voters, the lower the more they are correlated with others given the class.

    A residual is a vote less its expectation, which is of rank two; so sums of products
    of residuals follow from the votes that fire together and from sums by voter. Voters
    that never fire together have no positive correlation.
    """
    low, high = rates
    clean, toxic = fires.by_voter((1 - post) * counts), fires.by_voter(post * counts)
    q00, q01, q11 = (counts * (1 - post) ** 2).sum(), (counts * post * (1 - post)).sum(), (counts * post**2).sum()

    def less(v, w):
        expected = clean[v] * low[w] + toxic[v] * high[w] + clean[w] * low[v] + toxic[w] * high[v]
        return expected - (q00 * low[v] * low[w] + q01 * (low[v] * high[w] + high[v] * low[w]) + q11 * high[v] * high[w])

    every, (v, w, both) = np.arange(fires.m), together
    scale = np.sqrt(np.maximum(fires.by_voter(counts) - less(every, every), 0)) + 1e-9
    related = np.clip((both - less(v, w)) / (scale[v] * scale[w]), 0, 1)
    return 1 / (1 + np.bincount(v, np.where(related > least, related, 0), fires.m))


def label_model(fires: np.ndarray | Votes, labels: np.ndarray, counts: np.ndarray | None = None, rounds: int = 30) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(posterior of each row, prior, firing rates [2, voters], weight of each voter); a row stands for ``counts`` equal texts (one each by default).

    The given labels enter as one more voter whose accuracy is estimated like the others'.
    """
    fires = _votes(fires)
    counts = np.ones(len(fires.sizes)) if counts is None else counts
    n, m = counts.sum(), fires.m
    post = labels.astype(float) * 0.96 + 0.02
    discount, together = np.ones(m), fires.together(counts)
    prior, rates = float(post @ counts / n), np.zeros((2, m))
    for step in range(rounds):
        toxic, clean = post * counts, (1 - post) * counts
        on, off = toxic.sum(), clean.sum()
        prior = float((on + 1) / (n + 2))
        rates = np.stack([(fires.by_voter(side) + 0.05) / (total + 1) for side, total in ((clean, off), (toxic, on))])
        right1, right0 = (toxic @ labels + 2) / (on + 2.1), (clean @ (1 - labels) + 2) / (off + 2.1)
        if step % 10 == 9:
            discount = _discount(fires, together, post, rates, counts)
        ratio = np.log(rates[1] / rates[0])
        silent = np.log((1 - rates[1]) / (1 - rates[0]))
        logit = np.log(prior / (1 - prior)) + (discount * silent).sum() + fires.by_row(discount * (ratio - silent))
        logit = logit + np.where(labels == 1, np.log(right1 / (1 - right0)), np.log((1 - right1) / right0))
        post = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    return post, prior, rates, discount


def linear_classifier(fires: np.ndarray | Votes, target: np.ndarray, counts: np.ndarray, steps: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; a row stands for ``counts`` equal texts."""
    fires = _votes(fires)
    share = counts / counts.sum()
    v, bend = np.ones(fires.m + 1), 1.0  # the largest curvature, by power iteration
    for _ in range(50):
        v = v / np.linalg.norm(v)
        z = share * (fires.by_row(v[:-1]) + v[-1])
        v = np.append(fires.by_voter(z), z.sum())
        bend = float(np.linalg.norm(v))
    rate = 4 / (1.05 * bend + 1e-6)
    w, v = np.zeros(fires.m + 1), np.zeros(fires.m + 1)
    reg = np.full(fires.m + 1, penalty)
    reg[-1] = 0
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(fires.by_row(v[:-1]) + v[-1], -40, 40)))
        wrong = (p - target) * share
        new = v - rate * (np.append(fires.by_voter(wrong), wrong.sum()) + reg * v)
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def learn(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", max_rows: int = MAX_ROWS, min_texts: int = 4, min_toxic: int = 2, min_odds: float = 1.5) -> ToxicityModel:
    """Fits the model; ``labels`` holds only rows that may be learned from."""
    known = labels.where(F.col(toxic).isNotNull()).select(F.col(doc_id).alias("id"), (F.col(toxic) != 0).cast("int").alias("y"))
    total, positive = known.agg(F.count("*"), F.sum("y")).first()
    plain = ToxicityModel({}, {}, np.zeros(0), 0.0, (positive or 0) / total if total else 0.0, np.zeros((2, 0)), np.zeros(0))
    plain.bias = float(np.log(plain.prior / (1 - plain.prior))) if 0 < plain.prior < 1 else (60.0 if plain.prior else -60.0)
    if not total or not 0 < plain.prior < 1:
        return plain
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    # at most about max_rows ids are broadcast, so that no text is shuffled for the sample
    rows = written(documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id").select("text", "y"), "labelled")
    counted = mapped(rows, _features, "kind int, name string, on long, n long").groupBy("kind", "name").agg(F.sum("on").alias("on"), F.sum("n").alias("n"))
    odds = F.log((F.col("on") + 0.1) / (F.col("n") - F.col("on") + 0.1)) - F.lit(plain.bias)
    voting = counted.where((F.col("n") >= min_texts) & (F.col("on") >= min_toxic) & (odds > min_odds)).select("kind", "name").collect()  # words of at most max_rows texts
    terms, patterns = (sorted(r["name"] for r in voting if r["kind"] == kind) for kind in (0, 1))
    model = ToxicityModel({t: i for i, t in enumerate(terms)}, {p: len(terms) + i for i, p in enumerate(patterns)}, plain.weights, plain.bias, plain.prior, plain.rates, plain.discount)
    m = len(terms) + len(patterns)
    if not m:
        return plain
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text"):
            fired = [shared.value.voters(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(fired, pa.list_(pa.int32())), batch.column("y")], names=["fired", "y"])

    sample = mapped(rows, votes, "fired array<int>, y int").groupBy("fired", "y").agg(F.count("*").alias("n")).collect()  # at most max_rows rows, of voter numbers
    sample.sort(key=lambda r: (r["fired"], r["y"]))
    fires = Votes([r["fired"] for r in sample], m)
    y, counts = (np.array([r[name] for r in sample], float) for name in ("y", "n"))
    post, model.prior, model.rates, model.discount = label_model(fires, y, counts)
    model.weights, model.bias = linear_classifier(fires, post, counts)
    return model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in B.slices(batches, "_tw_text"):
            scores = [model.score(t) for t in batch.column("_tw_text").to_pylist()]
            keep = [n for n in batch.schema.names if n != "_tw_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(scores, pa.float64())], names=[*keep, "_tw_toxicity"])

    return run


def score(documents: DataFrame, model: ToxicityModel, *, text: str = "text", out: str = "_tw_toxicity") -> DataFrame:
    """Adds the toxicity score of every text as column ``out``, which is replaced where it is there."""
    given = documents.withColumn("_tw_text", F.col(text)).drop(out)
    schema = T.StructType([*(f for f in given.schema.fields if f.name != "_tw_text"), T.StructField("_tw_toxicity", T.DoubleType())])
    return mapped(given, _score(documents.sparkSession.sparkContext.broadcast(model)), schema).withColumnRenamed("_tw_toxicity", out)


def held_out(doc_id: str):
    """Rows that labels are never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fifth."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    found = score(documents, learn(documents, labels), out="score")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
