"""Numpy over whole Arrow batches of texts: word spans and polynomial hashes.

Texts are handled as one UTF-8 buffer with document offsets, in groups of a
bounded number of bytes (a single longer text is a group of its own).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_S = np.uint64(32)
_pow: dict[str, np.ndarray] = {}

#: space, tab, line feed, vertical tab, form feed, carriage return
BLANKS = [0x20, *range(0x09, 0x0E)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    if len(_pow.get("p", ())) < n:
        size = max(n, GROUP_BYTES + 1024)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for name, base in (("p", _ODD), ("q", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _pow[name] = np.multiply.accumulate(steps)
    return _pow["p"][:n], _pow["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> _S)
    h = h * _MIX
    return h ^ (h >> _S)


def byte_values(lower: bool) -> np.ndarray:
    """A fixed random 64-bit value for each byte; with lower, A-Z count as a-z."""
    values = np.random.Generator(np.random.PCG64(20011)).integers(1, 1 << 63, 256, np.uint64)
    if lower:
        values[65:91] = values[97:123]
    return values


def word_bytes(separators: list[int]) -> np.ndarray:
    table = np.ones(256, bool)
    table[separators] = False
    return table


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(data: np.ndarray, offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of at most ``limit`` bytes: (first, past last, bytes, offsets)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in runs of whole rows whose texts have a bounded number of bytes, so that what is made of few rows is held at once."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(column))
        for i, j, _, _ in groups(data, offsets):
            yield batch.slice(i, j - i)


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and for each text the index of its first word (one more at the end)."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    p, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * p[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans from the prefix sums; equal spans give equal hashes."""
    _, q = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive elements at each start; shorter inputs give none."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * _ODD + h[k : k + len(out)]
    return mix(out)


def list_fields(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """Offsets, and the named fields, of a column of lists of structs; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    inner = column.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]), *(inner.field(n).to_numpy(zero_copy_only=False) for n in names)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated integer ranges start..start+length."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, lengths)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive elements."""
    if len(h) < w:
        return np.empty(0, h.dtype)
    out, have = h, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
