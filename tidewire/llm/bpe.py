"""Byte-pair encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round the pairs of
neighbours are looked up by binary search over the sorted pair keys, each word's
lowest rank is taken, and all its occurrences are merged, until no word has a
pair left. Words come from white-space pieces of the text, whose encodings are
kept in a bounded cache in each task; nothing is left out.

Defined results: a null text is an empty text and has no ids; strings of special
tokens in a text become their ids, as the tokenizers library does it; texts of any
length are encoded whole; repeated rows are each encoded.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import bytes_np as B
from tidewire.llm.pieces import PieceCache, PieceSplitter
from tidewire.llm.shared import mapped

_KEY = np.int64(1 << 24)
_FAR = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary file of the tokenizers library with byte-level symbols and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.splitter = PieceSplitter(path)
        named = vocab | self.splitter.special
        self.tokens = {i: t.encode() for t, i in named.items()}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * int(_KEY) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        #: of each piece with its decoded text, and of each piece with its ids alone
        self.cache = PieceCache(self.splitter, self.encode_all, self.entries)
        self.ids_cache = PieceCache(self.splitter, self.encode_all, list)

    @functools.cached_property
    def decimal(self) -> dict[int, bytes]:
        return {i: b"%d" % i for i in self.tokens}

    @functools.cached_property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Length of the decimal number and of the token of each id, and one for the space."""
        out = np.zeros((2, max(self.tokens) + 1), np.int64)
        for i, t in self.tokens.items():
            out[:, i] = len(self.decimal[i]) + 1, len(t) + 1
        return out[0], out[1]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, offsets of each word)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        full = lengths > 0
        last = offsets[1:][full] - 1
        ids[last] = self.final[np.frombuffer(b"".join(words), np.uint8)[last]]
        word = np.repeat(np.arange(len(words)), lengths)
        out_ids, out_word = [], []
        while len(ids):
            pair = ids[:-1] * _KEY + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.ranks[at], _FAR)
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(np.append(rank, _FAR), begin)
            size = np.diff(np.append(begin, len(ids)))
            done = np.repeat(least == _FAR, size)
            if done.any():
                out_ids.append(ids[done])
                out_word.append(word[done])
            hit = np.append(rank, _FAR) == np.repeat(least, size)
            hit &= ~done
            if not hit.any():
                break
            left = np.flatnonzero(hit)
            first = np.concatenate([[True], np.diff(left) != 1])  # of a chain of neighbours every second is merged
            chain = left[first][np.cumsum(first) - 1]
            left = left[(left - chain) % 2 == 0]
            ids[left] = self.merged[least[np.searchsorted(begin, left, "right") - 1]]
            keep = ~done
            keep[left + 1] = False
            ids, word = ids[keep], word[keep]
        if not out_ids:
            return np.empty(0, np.int64), np.zeros(len(words) + 1, np.int64)
        word = np.concatenate(out_word)
        ids = np.concatenate(out_ids)[np.argsort(word, kind="stable")]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])

    def encode_all(self, words: list[str]) -> list[bytes]:
        ids, offsets = self.encode_words([w.encode() for w in words])
        raw, edges = ids.astype("<u4").tobytes(), (offsets * 4).tolist()
        return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def entries(self, encoded: list[bytes]) -> list[tuple[int, bytes, bytes, bytes]]:
        """(count, ids, decimal ids, decoded text) of each encoded piece."""
        ids = np.frombuffer(b"".join(encoded), "<u4").astype(np.int64)
        at = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int64)
        numbers = ids.tolist()
        written, decoded = b" ".join(map(self.decimal.__getitem__, numbers)), self.decode(numbers)
        edges = [np.concatenate([[0], np.cumsum(size[ids])])[at].tolist() for size in self.sizes]
        return [
            (len(e) // 4, e, written[a : b - 1] if e else b"", decoded[c : d - 1] if e else b"")
            for e, a, b, c, d in zip(encoded, edges[0], edges[0][1:], edges[1], edges[1][1:], strict=False)
        ]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The text of ids: tokens with a space between, as the library does it without a decoder."""
        return b" ".join(map(self.tokens.__getitem__, ids))

    def encode_texts(self, texts: list[str | None]) -> Iterator[list[tuple[int, bytes, bytes, bytes]]]:
        """For each text the entries of its pieces that have ids."""
        for found in self.cache.texts(texts):
            yield [e for e in found if e[0]]


@functools.lru_cache(2)
def loaded(path: str) -> WordBpe:
    """One encoder for each worker process."""
    return WordBpe(path)


def _encode_ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in B.slices(batches, "_tw_text"):
            raw = [b"".join(found) for found in bpe.ids_cache.texts(batch.column("_tw_text").to_pylist())]
            count = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(raw))])
            keep = [n for n in batch.schema.names if n != "_tw_text"]
            columns = [*(batch.column(n) for n in keep), pa.array(count), pa.ListArray.from_arrays(pa.array(ends), flat)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "_tw_count", "_tw_ids"])
        bpe.ids_cache.clear()  # the process stays for tasks of other stages

    return run


def _encode(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in B.slices(batches, "_tw_text"):
            count, ids, decoded = [], [], []
            for entries in bpe.encode_texts(batch.column("_tw_text").to_pylist()):
                count.append(sum(e[0] for e in entries))
                if digest:
                    ids.append(hashlib.sha256(b" ".join([e[2] for e in entries])).hexdigest())
                    decoded.append(hashlib.sha256(b" ".join([e[3] for e in entries])).hexdigest())
                else:
                    ids.append(np.frombuffer(b"".join([e[1] for e in entries]), "<u4").astype(np.int32))
                    decoded.append(b" ".join([e[3] for e in entries]).decode())
            keep = [n for n in batch.schema.names if n != "_tw_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), pa.array(count, pa.int64()), pa.array(ids, pa.string() if digest else pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                names=[*keep, "_tw_count", "_tw_ids", "_tw_decoded"],
            )
        bpe.cache.clear()  # the process stays for tasks of other stages

    return run


def encode(documents: DataFrame, path: str, *, text: str = "text", decoded: bool = True, digest: bool = False) -> DataFrame:
    """Adds ``n_tokens``, ``ids`` and, if ``decoded``, their decoded text (with digest: sha256 of the decimal ids and of the decoded text).

    Columns of these names in the input are replaced; others pass through.
    """
    names = ("n_tokens", "ids", "decoded") if decoded or digest else ("n_tokens", "ids")
    kept = documents.drop(*names) if text not in names else documents
    given = kept.withColumn("_tw_text", F.col(text))
    kind = T.StringType() if digest else T.ArrayType(T.IntegerType())
    fields = [*kept.schema.fields, T.StructField("_tw_count", T.LongType()), T.StructField("_tw_ids", kind)]
    if len(names) == 3:
        out = mapped(given, _encode(path, digest), T.StructType([*fields, T.StructField("_tw_decoded", T.StringType())]))
    else:
        out = mapped(given, _encode_ids(path), T.StructType(fields))
    return out.drop(*(n for n in names if n in kept.columns)).withColumnsRenamed({"_tw_count": "n_tokens", "_tw_ids": "ids", "_tw_decoded": "decoded"})


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Digest of ids and decoded text of every document."""
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(documents, public_tokenizers.path("word_bpe_49k.json"), digest=True)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
