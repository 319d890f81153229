"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of ``dimensions`` ones and minus ones. An
n-gram's vector binds its letters' vectors, each permuted (rolled) by its place, by
multiplication; a text's vector is the bundle (sum) of those of its n-grams; a
language's prototype is the bundle of its training texts' unit vectors. A text gets
the language with the largest cosine.

Defined results: a null text or one without a letter is ``und`` with score 0, as is
any text where no prototype could be learned; texts of any length are read whole;
ties go to the smaller language name; other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 1024
ORDER = 3
#: n-gram vectors that a worker keeps (one kilobyte each); a full store is emptied
STORE = 1 << 15


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


class Profiles:
    """Text vectors; n-grams run over letters, with one 0 for whatever lies between words."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER):
        self.dimensions, self.order = dimensions, order
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.store = np.empty((STORE, dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.PCG64([7001, code])).integers(0, 2, self.dimensions, np.int8)
            self.letters[code] = bits * np.int8(2) - np.int8(1)
        return self.letters[code]

    def ngrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(n-gram keys, counts)."""
        codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        if not codes.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = np.concatenate([[0], codes, [0]])
        codes = codes[(codes != 0) | np.concatenate([[True], codes[:-1] != 0])]
        width = len(codes) - self.order + 1
        if width < 1:
            codes = np.concatenate([codes, np.zeros(1 - width, np.int64)])
            width = 1
        keys = np.zeros(width, np.int64)
        for k in range(self.order):
            keys = (keys << 21) | codes[k : k + width]
        return np.unique(keys, return_counts=True)

    def vector(self, text: str | None) -> np.ndarray | None:
        """The bundled vector of a text as a unit vector, or None without letters."""
        keys, counts = self.ngrams(text) if text else ((), ())
        if not len(keys):
            return None
        out = np.zeros(self.dimensions, np.float32)
        for i in range(0, len(keys), 4096):  # long texts of many scripts in slices
            part = keys[i : i + 4096].tolist()
            out += counts[i : i + 4096].astype(np.float32) @ self.store[self._places(part)].astype(np.float32)
        size = float(np.linalg.norm(out))
        return out / size if size else out

    def _places(self, keys: list[int]) -> list[int]:
        if len(self.rows) + len(keys) > STORE:
            self.rows.clear()
        for key in keys:
            if key not in self.rows:
                place = len(self.rows)
                bound = np.ones(self.dimensions, np.int8)
                for k in range(self.order):
                    bound *= np.roll(self.letter((key >> (21 * (self.order - 1 - k))) & 0x1FFFFF), self.order - 1 - k)
                self.store[place] = bound
                self.rows[key] = place
        return [self.rows[k] for k in keys]


@functools.lru_cache(2)
def _profiles(dimensions: int, order: int) -> Profiles:
    return Profiles(dimensions, order)


def _bundle(dimensions: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        profiles = _profiles(dimensions, order)
        for batch in batches:
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if (v := profiles.vector(text)) is not None:
                    sums.setdefault(name, np.zeros(dimensions))
                    sums[name] += v
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total)], names=["lang", "at", "value"])

    return run


def learn_prototypes(labelled: DataFrame, *, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, order: int = ORDER) -> dict[str, np.ndarray]:
    """A unit prototype vector for each language of the labelled rows.

    Each task sends one vector a language; what reaches the driver is one vector for
    each distinct language.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sums = rows.mapInArrow(_bundle(dimensions, order), "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for row in sums.toLocalIterator():
        found.setdefault(row["lang"], np.zeros(dimensions))[row["at"]] = row["value"]
    return {name: v / (np.linalg.norm(v) or 1.0) for name, v in sorted(found.items())}


def _predict(names: list[str], matrix, dimensions: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prototypes, profiles = matrix.value, _profiles(dimensions, order)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("_tw_text").to_pylist():
                v = profiles.vector(text) if names else None
                if v is None:
                    langs.append("und")
                    scores.append(0.0)
                else:
                    cosines = prototypes @ v
                    best = int(np.argmax(cosines))
                    langs.append(names[best])
                    scores.append(float(min(1.0, max(0.0, cosines[best]))))
            keep = [n for n in batch.schema.names if n != "_tw_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return run


def identify(documents: DataFrame, prototypes: dict[str, np.ndarray], *, text: str = "text", order: int = ORDER) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the cosine, from 0 to 1); columns of these names are replaced."""
    names = list(prototypes)
    dimensions = len(next(iter(prototypes.values()))) if names else 1
    matrix = documents.sparkSession.sparkContext.broadcast(np.array([prototypes[n] for n in names], np.float32))
    given = documents.withColumn("_tw_text", F.col(text)).drop(*{"lang_pred", "score"})
    schema = T.StructType([f for f in given.schema.fields if f.name != "_tw_text"] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return given.mapInArrow(_predict(names, matrix, dimensions, order), schema)


def op10_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose id's crc32 is not 1 modulo 3."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    prototypes = learn_prototypes(documents.where(~held))
    found = identify(documents.select("doc_id", held.alias("held_out"), "text"), prototypes)
    return found.select("doc_id", "held_out", "lang_pred", "score")
