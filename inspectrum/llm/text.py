"""Texts as NumPy arrays inside tasks: words, their hashes, and Arrow columns.

A word is a maximal run of bytes outside a set of separators. Its 64-bit hash is the
same in every task and on every machine, so hashes can be shuffled and joined.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words, as a class of regular expressions and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text handled at once inside a task.
CHUNK_BYTES = 2_000_000

_GOLD, _MIX_A, _MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: no other column can clash; a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def whole_rows(df: DataFrame) -> DataFrame:
    """Each row as one struct `row`, so that no column of it can clash with those of an operator; `row.*` gives it back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def field_of_row(name: str) -> Column:
    return F.col("row").getField(name)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def chained(*parts: np.ndarray) -> np.ndarray:
    """A hash of several hashes, in order."""
    out = np.full(len(parts[0]), 0x2545F4914F6CDD1D, np.uint64)
    for p in parts:
        out = mixed((out + p) * _GOLD + np.uint64(1))
    return out


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column without nulls, and where each text starts in them (one more offset than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes each; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def hand_back() -> None:
    """Free memory goes back to the machine, so that a worker that waits for its next task holds what it uses and no more."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class WordHasher:
    """Hashes of the words of many texts at once.

    `separators` are the bytes between words; A-Z count as a-z. The hash of a word is
    a sum of random numbers per byte, weighted by powers of an odd number, so it comes
    from differences of one running sum over the bytes of all texts.
    """

    _BASE = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, separators: bytes | None = None) -> None:
        separators = SPACES.encode() if separators is None else separators
        self._inside = np.ones(256, bool)
        self._inside[list(separators)] = False
        lower = np.arange(256, dtype=np.uint64)
        lower[65:91] += np.uint64(32)
        self._byte = mixed((lower + np.uint64(1)) * _GOLD)
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self._power = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, self._BASE))])
            inverse = np.uint64(pow(int(self._BASE), -1, 1 << 64))
            self._inverse = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, inverse))])

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and how many words each text has; `hashes` then names parts of this text."""
        n = len(data)
        if n >= len(self._power):
            self._grow(2 * n)
        inside = self._inside[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        self._total = np.zeros(n + 1, np.uint64)
        np.cumsum(self._byte[data] * self._power[:n], out=self._total[1:])
        return starts, ends, np.diff(np.searchsorted(starts, offsets))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = self._total
        return mixed((total[ends] - total[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64) * _GOLD)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and how many each text has."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
        starts, ends, counts = self.words(data, offsets)
        return self.hashes(starts, ends), counts


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from all values in order and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from all bytes in order and where each value starts."""
    if len(data) >= 2**31:
        kind, off = pa.large_binary(), offsets.astype(np.int64)
    else:
        kind, off = pa.binary(), offsets.astype(np.int32)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
