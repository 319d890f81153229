"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are put into one suffix automaton over words (or, past
``block_words`` words, into several automata of that bounded size, applied one
after another), which is broadcast. Document words are streamed through it while
the longest matching length is tracked; a document word is hit when it lies in an
occurrence of a window of ``window`` consecutive item words. An item with fewer
words is one window.

Defined results: a null or empty text or item has no words and is never hit; null
item ids are named ``null``; repeated rows are each judged alone; an empty item
table hits nothing; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import bytes_np as B
from tidewire.llm.shared import mapped

#: bytes outside words; A-Z are lower-cased first and so belong to words
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    """Normalised words of a text."""
    data, offsets = B.text_buffer(pa.array([text], pa.string()))
    starts, ends, _ = B.word_spans(data, offsets, B.word_bytes(SEPARATORS))
    raw = data.tobytes().translate(_LOWER)
    return [raw[s:e] for s, e in zip(starts, ends, strict=True)]


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ids: dict[bytes, int] = {}
        same: dict[tuple[bytes, ...], set[str]] = {}
        for name, words in items:
            same.setdefault(tuple(words), set()).add(name)
        #: names of the items of each distinct word sequence
        self.names = list(same.values())
        sequences = [[self.ids.setdefault(w, len(self.ids)) for w in words] for words in same]
        for sequence in sequences:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
        #: by state and length of a window that ends there, the indices of its items
        self.ends: dict[int, dict[int, set[int]]] = {}
        for k, sequence in enumerate(sequences):
            n = min(window, len(sequence))
            state = length = 0
            for symbol in sequence:
                state, length = self.step(state, length, symbol)
                if n and length >= n:
                    self.ends.setdefault(self._holder(state, n), {}).setdefault(n, set()).add(k)
        self.least = min((min(window, len(s)) for s in sequences if s), default=0)
        self.reach: list[tuple[int, ...]] = self._reach()
        pairs = {(a, b) for s in sequences for a, b in zip(s, s[1:], strict=False)}
        values = B.byte_values(True)
        words = list(self.ids)
        flat = np.frombuffer(b"".join(words), np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        hashes = B.span_hashes(B.prefix_sums(flat, values), edges[:-1], edges[1:]) if words else np.empty(0, np.uint64)
        self.vocabulary = np.sort(hashes)
        self.pairs = np.unique(B.mix(hashes[[a for a, _ in pairs]] * np.uint64(3) + hashes[[b for _, b in pairs]])) if pairs else np.empty(0, np.uint64)

    def _add(self, size: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, parent: int, child: int, symbol: int) -> int:
        copy = self._add(self.size[parent] + 1)
        self.next[copy], self.link[copy] = dict(self.next[child]), self.link[child]
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(symbol) == child:
            self.next[parent][symbol] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        found = self.next[last].get(symbol)
        if found is not None:  # another item has brought this string
            return found if self.size[found] == self.size[last] + 1 else self._split(last, found, symbol)
        new = self._add(self.size[last] + 1)
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = new
            last = self.link[last]
        if last >= 0:
            found = self.next[last][symbol]
            self.link[new] = found if self.size[found] == self.size[last] + 1 else self._split(last, found, symbol)
        return new

    def step(self, state: int, length: int, symbol: int) -> tuple[int, int]:
        """The longest suffix of the text read so far that is in the items."""
        while state and symbol not in self.next[state]:
            state = self.link[state]
            length = self.size[state]
        if symbol in self.next[state]:
            return self.next[state][symbol], length + 1
        return 0, 0

    def _holder(self, state: int, n: int) -> int:
        """The state of the last n symbols."""
        while self.size[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _reach(self) -> list[tuple[int, ...]]:
        """For each state, the states with window ends among itself and its suffixes."""
        out: list[tuple[int, ...]] = [()] * len(self.size)
        for state in sorted(range(len(self.size)), key=self.size.__getitem__):
            above = out[self.link[state]] if state else ()
            out[state] = (*above, state) if state in self.ends else above
        return out

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(first word, past last word, state) of each occurring window; its items are ``ends`` of the state and its length."""
        state = length = 0
        for at, word in enumerate(words):
            symbol = self.ids.get(word)
            state, length = (0, 0) if symbol is None else self.step(state, length, symbol)
            for holder in self.reach[state]:
                for n in self.ends[holder]:
                    if n <= length:
                        yield at + 1 - n, at + 1, holder

    def items_of(self, windows: set[tuple[int, int]]) -> set[str]:
        """Names of the items that have one of the windows (state, length)."""
        found: set[int] = set().union(*[self.ends[state][n] for state, n in windows])
        return set().union(*[self.names[k] for k in found])


def _runs(auto: SuffixAutomaton, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Word runs that can hold a window: all words known, and all neighbours neighbours in an item."""
    if not auto.least or not len(hashes):
        return []
    if auto.least == 1:
        at = np.minimum(np.searchsorted(auto.vocabulary, hashes), len(auto.vocabulary) - 1)
        good, extra = auto.vocabulary[at] == hashes, 0
        cut = first[1:-1]
    else:
        pair = B.mix(hashes[:-1] * np.uint64(3) + hashes[1:])
        if not len(pair) or not len(auto.pairs):
            return []
        at = np.minimum(np.searchsorted(auto.pairs, pair), len(auto.pairs) - 1)
        good, extra = auto.pairs[at] == pair, 1
        inner = first[1:-1]
        good[inner[(inner > 0) & (inner <= len(good))] - 1] = False  # not across texts
        cut = np.empty(0, np.int64)
    flags = np.zeros(len(good) + 2, np.int8)
    flags[1:-1] = good
    change = np.diff(flags)
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    out = []
    for s, e in zip(begin.tolist(), end.tolist(), strict=True):
        if len(cut):
            inner = [s, *cut[(cut > s) & (cut < e)].tolist(), e]
            out += zip(inner, inner[1:], strict=False)
        elif e - s + extra >= auto.least:
            out.append((s, e + extra))
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _scan(auto, values, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = auto.value
        for batch in batches:
            texts = batch.column("_tw_text")
            data, offsets = B.text_buffer(texts)
            counts = np.zeros(batch.num_rows, np.int64)
            spans: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
            windows: list[set[tuple[int, int]]] = [set() for _ in range(batch.num_rows)]
            for i, j, part, at in B.groups(data, offsets):
                starts, ends, first = B.word_spans(part, at, table)
                counts[i:j] = np.diff(first)
                if not len(starts):
                    continue
                hashes = B.span_hashes(B.prefix_sums(part, values), starts, ends)
                raw = None
                for s, e in _runs(automaton, hashes, first):
                    raw = raw or part.tobytes().translate(_LOWER)
                    words = [raw[x:y] for x, y in zip(starts[s:e], ends[s:e], strict=True)]
                    row = int(np.searchsorted(first, s, "right")) - 1
                    base, own = s - int(first[row]), spans[i + row]
                    for a, b, state in automaton.matches(words):
                        if own and own[-1][0] <= base + a <= own[-1][1]:  # runs grow as they are found
                            own[-1] = (own[-1][0], max(own[-1][1], base + b))
                        else:
                            own.append((base + a, base + b))
                        windows[i + row].add((state, b - a))
            before = batch.column("_tw_spans").to_pylist() if "_tw_spans" in batch.schema.names else [None] * batch.num_rows
            named = batch.column("_tw_items").to_pylist() if "_tw_items" in batch.schema.names else [None] * batch.num_rows
            joined = [_union([(x["begin"], x["end"]) for x in old or []] + new) for old, new in zip(before, spans, strict=True)]
            names = [sorted({*(old or ()), *automaton.items_of(new)}) for old, new in zip(named, windows, strict=True)]
            keep = [n for n in batch.schema.names if n not in ("_tw_spans", "_tw_items", "_tw_words")]
            columns = [batch.column(n) for n in keep] + [
                pa.array(counts),
                pa.array([[{"begin": a, "end": b} for a, b in x] for x in joined], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                pa.array(names, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "_tw_words", "_tw_spans", "_tw_items"])

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_hits(documents: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = 250_000) -> DataFrame:
    """Adds ``_tw_words``, ``_tw_spans`` (hit word runs) and ``_tw_items`` (ids of items with occurring windows).

    Items stream to the driver one at a time and are cut into automata of at most
    ``block_words`` words each; one automaton's broadcast is bounded by that, and
    further blocks are applied as further passes over the same rows.
    """
    spark = documents.sparkSession
    out = documents.withColumn("_tw_text", F.col(text)).withColumns({"_tw_words": F.lit(0).cast("long"), "_tw_spans": F.lit(None).cast(_SPAN), "_tw_items": F.lit(None).cast("array<string>")})
    schema = out.schema
    values, table = B.byte_values(True), B.word_bytes(SEPARATORS)

    def apply(frame: DataFrame, block: list[tuple[str, list[bytes]]]) -> DataFrame:
        auto = spark.sparkContext.broadcast(SuffixAutomaton(block, window))
        plain = frame.select(*[c for c in frame.columns if c not in ("_tw_words", "_tw_spans", "_tw_items")], "_tw_words", "_tw_spans", "_tw_items")
        return mapped(plain, _scan(auto, values, table), T.StructType([schema[c] for c in plain.columns]))

    block: list[tuple[str, list[bytes]]] = []
    size, applied = 0, False
    for row in items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.col(item_text)).toLocalIterator():
        words = item_words(row[1])
        if size and size + len(words) > block_words:
            out, block, size, applied = apply(out, block), [], 0, True
        if words:
            block.append((row[0], words))
            size += len(words)
    if block or not applied:
        out = apply(out, block)
    return out.drop("_tw_text")


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = B.word_bytes(SEPARATORS)
    for batch in batches:
        texts, spans = batch.column("_tw_text").to_pylist(), batch.column("_tw_spans").to_pylist()
        for k, runs in enumerate(spans):
            if runs:
                data, offsets = B.text_buffer(pa.array([texts[k]], pa.string()))
                starts, ends, _ = B.word_spans(data, offsets, table)
                raw, at, parts = data.tobytes(), 0, []
                for run in runs:
                    parts.append(raw[at : starts[run["begin"]]])
                    at = int(ends[run["end"] - 1])
                texts[k] = b"".join([*parts, raw[at:]]).decode("utf-8")
        at = batch.schema.names.index("_tw_text")
        yield batch.set_column(at, "_tw_text", pa.array(texts, pa.string()))


def decontaminate(documents: DataFrame, items: DataFrame, *, text: str = "text", max_coverage: float = 1.0, **options) -> DataFrame:
    """Documents with the hit word runs cut out of the text.

    Documents of which at least ``max_coverage`` of the words are hit are left out
    (1.0: only those of which nothing would remain). Columns stay as they are.
    """
    found = find_hits(documents, items, text=text, **options)
    hit = F.aggregate("_tw_spans", F.lit(0), lambda a, x: a + x["end"] - x["begin"])
    kept = found.where((F.col("_tw_words") == 0) | (hit < F.col("_tw_words") * F.lit(max_coverage))).withColumn("_tw_text", F.col(text))
    cleaned = mapped(kept, _clean, kept.schema)
    return cleaned.withColumn(text, F.col("_tw_text")).select(*documents.columns)


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contamination digest of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_hits(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("_tw_spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["begin"]).cast("long"))
    return found.select(
        "doc_id", F.col("_tw_words").alias("n_words"), hit.alias("n_hit"), F.size("_tw_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_tw_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
