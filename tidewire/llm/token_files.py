"""Token-id files with Elias-Fano encoded document boundaries.

Format: a folder of Parquet files, one row for each block of consecutive documents.
``ids`` is the concatenated id array in ``id_width`` little-endian bytes an id;
document boundaries (one more than documents, from 0 to the block's id count) are
Elias-Fano coded: ``low_bits`` low bits of each are packed in ``low``, the high
parts are unary in the bit vector ``high``, and ``samples`` holds the place of every
``SAMPLE``-th set bit, so that select gives an offset without reading the rest.
``part`` and ``block`` give the order; rows are in ascending id order.

Defined results: a null or empty text is a document of the end id alone; null
document ids come first; rows with one id are ordered by their text (repeated rows
stay separate documents); an empty table gives no block; of other columns the file
keeps none.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import bytes_np as B
from tidewire.llm.pieces import PieceSplitter
from tidewire.llm.shared import new_folder

SAMPLE = 64
BLOCK_IDS = 1 << 20
#: words that a worker remembers in each of two generations, and bytes of texts that it encodes at once
GENERATION = 400_000
SLICE_BYTES = 6 << 20


class EliasFano:
    """A non-decreasing sequence of integers from 0 in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: list[int]):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, universe = len(values), int(values[-1]) + 1 if len(values) else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        at = (values >> low_bits) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        unary[at] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes(), at[::SAMPLE].tolist())

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        window = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little")
        return (window >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it."""
        at, left = self.samples[i // SAMPLE], i % SAMPLE
        byte = self.high[at // 8] >> (at % 8)
        base = at
        while left >= (count := byte.bit_count()):
            left -= count
            base = (base // 8 + 1) * 8
            byte = self.high[base // 8]
        for _ in range(left):
            byte &= byte - 1
        place = base + (byte & -byte).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def values(self) -> np.ndarray:
        """All values."""
        place = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (place - np.arange(self.n)) << self.low_bits
        if self.low_bits and self.n:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, -1)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits))
        return out


class LibraryEncoder:
    """Ids by the tokenizers library, which is given each word that a worker does not remember.

    White-space pieces of a slice of texts are numbered by Arrow, so that each distinct
    one is looked at once; one of plain letters is a word and at most one stop.
    """

    def __init__(self, path: str):
        self.splitter = PieceSplitter(path)
        self.library = self.splitter.library
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of normalised words, remembered in two generations of bounded size."""
        if len(self.new) > GENERATION:
            self.new, self.old = {}, self.new
        lacking = set(words) - self.new.keys()
        again = lacking & self.old.keys()
        self.new.update(zip(again, map(self.old.__getitem__, again), strict=True))
        if lacking := list(lacking - again):
            found = self.library.encode_batch_fast(lacking, add_special_tokens=False)
            lists = [e.ids for e in found]
            raw = np.fromiter(itertools.chain.from_iterable(lists), self.kind).tobytes()
            ends = list(itertools.accumulate(map(len, lists), initial=0))
            w = self.width
            self.new.update((word, raw[a * w : b * w]) for word, a, b in zip(lacking, ends, ends[1:], strict=False))
        return list(map(self.new.__getitem__, words))

    def _unusual(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of any form."""
        parts = [self.splitter.pieces(p) for p in pieces]
        names = list(dict.fromkeys(x for p in parts for x in p if x not in self.splitter.special))
        words = self.splitter.words(names)
        spelled = dict(zip(names, words, strict=True))
        flat = list({w for ws in words for w in ws})
        by = dict(zip(flat, self.word_ids(flat), strict=True))
        special = {t: i.to_bytes(self.width, "little") for t, i in self.splitter.special.items()}
        return [b"".join(special[x] if x in special else b"".join([by[w] for w in spelled[x]]) for x in p) for p in parts]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, edges of each text) of a string column."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        numbered = lists.flatten().dictionary_encode()
        pieces, index = numbered.dictionary, numbered.indices.to_numpy()
        plain = pc.match_substring_regex(pieces, "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$").to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(pieces.filter(pa.array(plain)))
        words = pc.utf8_rtrim(low, ".,").dictionary_encode()
        stops = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(low, -1), pa.array([".", ","])), -1).to_numpy()
        known = words.dictionary.to_pylist()
        entries = self.word_ids([".", ",", *known]) + self._unusual(pieces.filter(pa.array(~plain)).to_pylist())
        # each piece is one entry, or two with a stop
        first, second = np.empty(len(pieces), np.int64), np.full(len(pieces), -1, np.int64)
        first[plain] = words.indices.to_numpy() + 2
        first[~plain] = np.arange(int((~plain).sum())) + 2 + len(known)
        second[plain] = stops
        flat = np.frombuffer(b"".join(entries), self.kind)
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // self.width
        begins = np.cumsum(sizes) - sizes
        taken = np.stack([first, second], 1).ravel()
        used = taken[taken >= 0]
        flat = flat[B.ranges(begins[used], sizes[used])]  # now the ids of each distinct piece
        sizes = sizes[first] + np.where(second >= 0, sizes[second], 0)
        begins = np.cumsum(sizes) - sizes
        each = sizes[index]
        ids = flat[B.ranges(begins[index], each)]
        ends = np.concatenate([[0], np.cumsum(each)])
        return ids, ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, a bounded slice of texts at a time."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(sizes)])
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(total, total[i] + SLICE_BYTES, "right")) - 1)
            ids, edges = self.column(texts.slice(i, j - i))
            raw, edges = ids.tobytes(), (edges * self.width).tolist()
            yield from (raw[a:b] for a, b in zip(edges, edges[1:], strict=False))
            i = j


@functools.lru_cache(2)
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(id_type)),
        T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("id_width", T.IntegerType()),
        T.StructField("low_bits", T.IntegerType()), T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType()),
        T.StructField("samples", T.ArrayType(T.IntegerType())), T.StructField("ids", T.BinaryType()),
    ])


def _write_blocks(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = end_id.to_bytes(encoder.width, "little")
        part, block = TaskContext.get().partitionId(), 0
        names, parts, sizes = [], [], []
        kind = None

        def flush() -> pa.RecordBatch:
            ids = b"".join(parts)
            ef = EliasFano.of(np.concatenate([[0], np.cumsum(sizes)]))
            row = {"part": part, "block": block, "doc_ids": pa.array(names, kind).to_pylist(), "n_docs": len(sizes), "n_ids": sum(sizes), "id_width": encoder.width, "low_bits": ef.low_bits, "low": ef.low, "high": ef.high, "samples": ef.samples, "ids": ids}
            fields = [("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(kind)), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("id_width", pa.int32()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.list_(pa.int32())), ("ids", pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in fields], names=[n for n, _ in fields])

        held = 0
        for batch in batches:
            kind = batch.column("_tw_id").type
            ids = batch.column("_tw_id").to_pylist()
            for name, encoded in zip(ids, encoder.texts(batch.column("_tw_text")), strict=True):
                names.append(name)
                parts += [encoded, end]
                sizes.append(len(encoded) // encoder.width + 1)
                held += sizes[-1]
                if held >= block_ids:
                    yield flush()
                    names, parts, sizes, held, block = [], [], [], 0, block + 1
        if sizes:
            yield flush()

    return run


def write_token_files(documents: DataFrame, tokenizer: str, folder: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encodes the texts and writes them in ascending id order.

    Texts are range-partitioned by id and, so that many rows of one id or without one
    are parted too, by the beginning of the text; no task holds more than its range. A
    block holds at least ``block_ids`` ids, but for the last of a partition.
    """
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(doc_id).alias("_tw_id"), F.col(text).alias("_tw_text"))
    ordered = rows.repartitionByRange(n, F.col("_tw_id").asc_nulls_first(), F.substring("_tw_text", 1, 32).asc_nulls_first()).sortWithinPartitions(F.col("_tw_id").asc_nulls_first(), F.col("_tw_text").asc_nulls_first())
    blocks = ordered.mapInArrow(_write_blocks(tokenizer, end_id, block_ids), _schema(rows.schema["_tw_id"].dataType))
    blocks.write.option("compression", "zstd").parquet(folder)


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            coded = EliasFano(row["n_docs"] + 1, row["low_bits"], row["low"], row["high"], row["samples"])
            edges = np.fromiter(map(coded.select, range(row["n_docs"] + 1)), np.int64, row["n_docs"] + 1)
            ids = np.frombuffer(row["ids"], f"<u{row['id_width']}")
            checks = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            n = row["n_docs"]
            column = batch.column("doc_ids")
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["doc_ids"], column.type.value_type), pa.array(edges[:-1]), pa.array(np.diff(edges)), pa.array(checks, pa.int64())],
                names=["part", "block", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def read_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files.

    Block sizes are added up within partitions of the file, and partition totals
    (one row for each) over all.
    """
    blocks = spark.read.parquet(folder)
    sizes = blocks.select("part", "block", "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("block_start")).join(parts, "part")
    kind = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("doc_id", kind),
        T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    found = blocks.mapInArrow(_read_blocks, schema)
    return found.join(starts, ["part", "block"]).select("doc_id", (F.col("part_start") + F.col("block_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token-id files of all documents and reads their boundaries back."""
    import public_tokenizers

    folder = new_folder(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_boundaries(spark, folder)
