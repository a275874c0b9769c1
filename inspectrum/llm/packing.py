"""Packing of token pieces into sequences of fixed length, online and in bounded space.

Each task keeps a fixed number of open sequences. A piece goes to the open sequence
that it fills best; if it fits none and all are open, the fullest is closed. What is
open at the end of a task is packed again, with fewer tasks each round, until one
task is left; a round leaves at most `OPEN` sequences a task, so rounds shrink.

Null texts are empty, and an empty text is its end token alone. Repeated rows are
packed each on its own. An empty table gives no pieces.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from inspectrum.llm.text import WordHasher, binary_column, chunks, hand_back, string_buffers, texts_of
from inspectrum.llm.tokens import REMEMBERED_CHARS
from inspectrum.sources.workspace import discard, materialize

LENGTH, OPEN, MERGE = 2048, 256, 8
END_ID = 1
#: Bytes of texts that are tokenized at once: arrays over them are many times as large.
TOGETHER_BYTES = 400_000


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space and encodes runs of a pattern apart.

    Words are told by their 64-bit hashes, with A-Z as a-z, since the tokenizer lowers case. Every distinct word is
    split into runs once per worker process, and every distinct run is encoded once; many new
    runs are encoded together: the last id of each is one that ends a word. Known words
    are a sorted array of hashes beside where their ids lie in one array. When they are too many,
    those that came in several ranges of texts stay, the more common ones first.
    """

    #: Words of characters below this one have one form and lower case character by character; others are encoded whole.
    _PLAIN = "\u0250"
    _RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    _KEPT = 500_000

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        self._ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._split = regex.compile(self._RUNS).findall
        self._hasher = WordHasher()
        self._runs: dict[str, bytes] = {}
        self._hashes, self._starts, self._sizes, self._ids = (np.zeros(0, k) for k in (np.uint64, np.int64, np.int64, np.int32))
        self._uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        self._runs.clear()
        common = np.sort(self._uses)[-(self._KEPT // 2) :]
        kept = np.flatnonzero(self._uses >= max(2, common[0] + 1))
        sizes = self._sizes[kept]
        ends = np.cumsum(sizes)
        self._ids = self._ids[np.repeat(self._starts[kept] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self._hashes, self._starts, self._sizes, self._uses = self._hashes[kept], ends - sizes, sizes, self._uses[kept]

    def _raw(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def _learn_runs(self, runs: list[str]) -> None:
        for at in range(0, len(runs), 5000):
            some = runs[at : at + 5000]
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<i4")
            cuts = (np.flatnonzero(self._ends[ids]) + 1).tolist()
            if len(cuts) == len(some):
                raw = ids.tobytes()
                self._runs.update(zip(some, (raw[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
            else:
                self._runs.update((r, self._raw(r)) for r in some)

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word; short plain words go by their runs."""
        split: list[tuple[str, ...] | list[str] | None] = []
        for w in words:
            if not w.isascii() and max(w) >= self._PLAIN or len(w) > REMEMBERED_CHARS:
                split.append(None)
                continue
            low = w.lower()
            if low.isalpha():
                split.append((low,))
            elif low[:-1].isalpha() and low[-1] in ".,":
                split.append((low[:-1], low[-1]))
            else:
                split.append(self._split(low))
        self._learn_runs(list({r for found in split if found for r in found}.difference(self._runs)))
        runs = self._runs
        return [self._raw(w) if found is None else b"".join([runs[r] for r in found]) for w, found in zip(words, split, strict=True)]

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        raw = self._of_words(words)
        sizes = np.array([len(r) // 4 for r in raw], np.int64)
        at = np.searchsorted(self._hashes, hashes)
        self._starts = np.insert(self._starts, at, len(self._ids) + np.cumsum(sizes) - sizes)
        self._sizes = np.insert(self._sizes, at, sizes)
        self._hashes = np.insert(self._hashes, at, hashes)
        self._uses = np.insert(self._uses, at, 0)
        self._ids = np.concatenate([self._ids, np.frombuffer(b"".join(raw), "<i4")])

    def encode(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Ranges of texts, all their ids in order with the end id after each text, and ids per text."""
        data, offsets = string_buffers(column)
        for a, b in chunks(offsets, TOGETHER_BYTES):
            part = data[offsets[a] : offsets[b]]
            if len(self._hashes) > self._KEPT:
                self._forget()
            if not len(part):
                yield a, b, np.full(b - a, end_id, np.int32), np.ones(b - a, np.int64)
                continue
            starts, ends, words = self._hasher.words(part, offsets[a : b + 1] - offsets[a])
            distinct, first, back = np.unique(self._hasher.hashes(starts, ends), return_index=True, return_inverse=True)
            at = np.searchsorted(self._hashes, distinct)
            new = np.flatnonzero(self._hashes[np.minimum(at, len(self._hashes) - 1)] != distinct) if len(self._hashes) else np.arange(len(distinct))
            if len(new):
                raw = part.tobytes()
                where = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
                self._learn(distinct[new], [raw[x:y].decode("utf-8", "surrogatepass") for x, y in where])
                at = np.searchsorted(self._hashes, distinct)
            self._uses[at] += 1
            at = at[back]
            sizes = self._sizes[at]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            ids = self._ids[np.repeat(self._starts[at] - upto[:-1], sizes) + np.arange(upto[-1])]
            limits = upto[np.concatenate([[0], np.cumsum(words)])]
            yield a, b, np.insert(ids, limits[1:], end_id), np.diff(limits) + 1


@functools.cache
def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a worker process, which runs them one after the other."""
    return WordTokenizer(path)


def pieces(df: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids binary, doc_tokens): each document's ids, and the end id, cut at multiples of `length`.

    `ids` are unsigned little-endian 32-bit numbers.
    """
    names = ["doc_id", "start", "length", "ids", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        for batch in batches:
            for a, b, ids, sizes in tokenizer.encode(batch.column(1), end_id):
                n = (sizes + length - 1) // length
                row = np.repeat(np.arange(b - a), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * length
                size = np.minimum(length, sizes[row] - start)
                offsets = np.concatenate([[0], np.cumsum(size * 4)])
                raw = binary_column(ids.astype("<i4").view(np.uint8), offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(start), pa.array(size), raw, pa.array(sizes[row])], names)
        hand_back()

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")


class _Windows:
    """The open sequences of one task."""

    def __init__(self, length: int, limit: int) -> None:
        self._length, self._limit = length, limit
        self._free: list[tuple[int, int]] = []  # (room, number), ascending
        self._rows: dict[int, list[int]] = {}
        self._next = 0
        self.closed: list[tuple[int, list[int]]] = []

    def put(self, row: int, size: int) -> None:
        if size == self._length:
            self.closed.append((self._next, [row]))
            self._next += 1
            return
        i = bisect_left(self._free, (size, -1))
        if i < len(self._free):
            room, number = self._free.pop(i)
        else:
            if len(self._free) >= self._limit:
                _, full = self._free.pop(0)
                self.closed.append((full, self._rows.pop(full)))
            room, number = self._length, self._next
            self._next += 1
            self._rows[number] = []
        self._rows[number].append(row)
        if room == size:
            self.closed.append((number, self._rows.pop(number)))
        else:
            insort(self._free, (room - size, number))

    def rest(self) -> list[tuple[int, list[int]]]:
        return [(number, self._rows[number]) for _, number in self._free]


def _pack_task(length: int, limit: int, last: bool):
    """A task's pass over (length, ...) rows: adds window number, offset and whether the window is closed.

    Rows wait only while their window is open, so at most `limit` windows are in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(length, limit)
        held: dict[int, tuple] = {}
        count, schema = 0, None

        def flush(done: list[tuple[int, list[int]]], closed: bool) -> pa.RecordBatch:
            out: list[tuple] = []
            for number, rows in done:
                offset = 0
                for r in rows:
                    row = held.pop(r)
                    out.append((*row, number, offset, closed))
                    offset += row[2]
            columns = list(zip(*out, strict=True)) if out else [[]] * (len(schema) + 3)
            kinds = [*schema.types, pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*schema.names, "window", "offset", "closed"])

        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[count] = row
                windows.put(count, row[2])
                count += 1
            if windows.closed:
                yield flush(windows.closed, True)
                windows.closed = []
        if schema is not None:
            yield flush(windows.rest(), last)

    return run


def pack(cut: DataFrame, length: int = LENGTH, open_windows: int = OPEN, merge: int = MERGE) -> DataFrame:
    """Adds sequence_id and offset to rows (doc_id, start, length, ids_crc32, doc_tokens), one per piece of at most `length` tokens.

    Sequences are numbered from 0 without gaps; offsets in a sequence have no gaps either.
    """
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, closed boolean"
    part = F.spark_partition_id().cast("long").alias("part")
    rounds, waiting = [], cut.select(*columns)
    tasks = None
    while True:
        last = tasks == 1
        packed = materialize(waiting.mapInArrow(_pack_task(length, open_windows, last), schema).select("*", part), "packed")
        rounds.append(packed)
        if last:
            break
        tasks = packed.filter("not closed").select(F.count_distinct("part")).first()[0] if tasks is None else tasks
        tasks = max(1, -(-tasks // merge))
        waiting = packed.filter("not closed").select(*columns)
        waiting = waiting.coalesce(1) if tasks == 1 else waiting.repartition(tasks, F.xxhash64("doc_id", "start"))
    done = [t.filter("closed").withColumn("round", F.lit(i)) for i, t in enumerate(rounds)]
    table = done[0]
    for t in done[1:]:
        table = table.unionByName(t)
    # One row for each task of each round, numbered by a running sum.
    sizes = table.groupBy("round", "part").agg(F.count_distinct("window").alias("n"))
    before = W.orderBy("round", "part").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select("round", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = W.partitionBy("round", "part").orderBy("window")
    windows = table.select("round", "part", "window").distinct().withColumn("rank", F.row_number().over(ranked) - 1)
    numbers = windows.join(base, ["round", "part"]).select("round", "part", "window", (F.col("base") + F.col("rank")).alias("sequence_id"))
    out = materialize(table.join(numbers, ["round", "part", "window"]).select(*columns, "sequence_id", "offset"), "sequences")
    discard(*rounds)
    return out


def pack_documents(df: DataFrame, tokenizer_path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with the CRC of their ids and their place in the sequences."""
    cut = pieces(df, tokenizer_path, length, id_col=id_col, text_col=text_col)
    return pack(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), length)
