"""Language-model scores: an interpolated, modified Kneser-Ney model of word pairs.

Words are counted first. Their sorted 64-bit hashes are an array in files, and a word's
place in it is its number. Word pairs are then counted as numbers: each task sums
its pairs, sends sorted blocks to shards by hash, and each shard merges its blocks into
one sorted array in a file, with counts. Shards split the pairs of a frequent first
word by the second one, so no word decides the size of a shard. Discounts, followers
of each word and distinct predecessors of each word come from the shards. Tasks that
score texts map all files and look pairs up by binary search.

Null texts are empty; an empty text is its end alone. Rows are scored one by one. A row
without a doc_id is neither held out nor learned from; the crc of the id decides. Repeated rows
are learned from each time. With nothing to learn from, every token has probability one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectrum.llm.arrays import map_arrays, write_arrays
from inspectrum.llm.text import WordHasher, chunks, hand_back, mixed, string_buffers, text_or_empty
from inspectrum.sources.workspace import delete_folder, discard, materialize, work_path

#: Every text ends with this token. Ids are 32-bit numbers.
END = np.uint64(0x9D39247E33776D41)
#: Words in a file, pairs in a shard before they are merged, pairs that a task holds before it sends them.
WORDS_A_FILE, PAIRS_A_SHARD, PAIRS_HELD = 1_000_000, 2_000_000, 2_000_000
#: Bytes of text whose tokens are looked up at once, and that are hashed at once: arrays over them are many times as large.
TOGETHER_BYTES, HASHED_BYTES = 1_000_000, 250_000
_BLOCK = 22  # pairs of one first word are split by the second word's number, in blocks of 2 ** 22
ADDED = 0.1


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


@dataclass
class Words:
    """Files of sorted word hashes and their counts; `firsts` are the numbers of the first word of each file."""

    folder: str
    sizes: list[int]
    total: int
    per_file: int

    @property
    def distinct(self) -> int:
        return sum(self.sizes)

    def open(self) -> None:
        """Map the files; once in a task."""
        opened = [map_arrays(f"{self.folder}/words-{i}", [("<u8", n), ("<i8", n)]) for i, n in enumerate(self.sizes)]
        self._hashes, self._counts = [o[0] for o in opened], [o[1] for o in opened]
        self._firsts = np.cumsum([0, *self.sizes]).tolist()

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each word; the number of distinct words and 0 for unknown ones."""
        asked, back = np.unique(hashes, return_inverse=True)
        number = np.full(len(asked), self.distinct, np.int64)
        count = np.zeros(len(asked), np.int64)
        limits = np.searchsorted(_file_of(asked, len(self.sizes)), np.arange(len(self.sizes) + 1))
        for i, (own, counts) in enumerate(zip(self._hashes, self._counts, strict=True)):
            a, b = limits[i], limits[i + 1]
            if a < b and len(own):
                at = np.minimum(np.searchsorted(own, asked[a:b]), len(own) - 1)
                hit = own[at] == asked[a:b]
                number[a:b] = np.where(hit, at + self._firsts[i], self.distinct)
                count[a:b] = np.where(hit, counts[at], 0)
        return number[back], count[back]


def _file_of(hashes: np.ndarray, files: int) -> np.ndarray:
    """Files hold equal ranges of hashes."""
    return ((hashes >> np.uint64(40)) * np.uint64(files)) >> np.uint64(24)


def _tokens(column: pa.Array, hasher: WordHasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts, their token hashes with an end after each text, and tokens per text."""
    data, offsets = string_buffers(column)
    for a, b in chunks(offsets, TOGETHER_BYTES):
        own = offsets[a : b + 1]
        parts = [hasher(data[own[c] : own[d]], own[c : d + 1] - own[c]) for c, d in chunks(own, HASHED_BYTES)]
        words, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield a, b, np.insert(words, np.cumsum(counts), END), counts + 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        found = [np.unique(t, return_counts=True) for _, _, t, _ in _tokens(batch.column(0), hasher)]
        if found:
            words, n = _summed(np.concatenate([w for w, _ in found]), np.concatenate([n for _, n in found]))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])
    hand_back()


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of n for each."""
    if not len(keys):
        return keys, n.astype(np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Groups of rows that come sorted by `key`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[-1][key][0].as_py() != values[a]:
                yield held[-1][key][0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[-1][key][0].as_py(), pa.Table.from_batches(held)


def learn_words(texts: DataFrame, folder: str, per_file: int) -> Words:
    """Count every token of `text` and write the sorted hashes and counts."""
    counts = materialize(texts.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    words = write_words(counts, folder, per_file)
    discard(counts)
    return words


def write_words(counts: DataFrame, folder: str, per_file: int = WORDS_A_FILE) -> Words:
    """Files of the hashes of a written table (word, n) in order, with their counts."""
    distinct, total = counts.agg(F.count("*"), F.sum("n")).first()
    if distinct >= 2**32 - 2:
        raise ValueError("word numbers are 32-bit")
    files = max(1, -(-distinct // per_file))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _file_of(b.column(0).to_numpy().view(np.uint64), files).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), *b.columns], ["file", "word", "n"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, table in _grouped(batches, "file"):
            words = table["word"].to_numpy().view(np.uint64)
            order = np.argsort(words)
            write_arrays(f"{folder}/words-{file}", [words[order], table["n"].to_numpy()[order]])
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([len(words)], pa.int64())], ["file", "n"])

    dealt = counts.mapInArrow(place, "file int, word long, n long").repartition(files, "file").sortWithinPartitions("file")
    sizes = dict(dealt.mapInArrow(write, "file int, n long").collect())
    return Words(folder, [sizes.get(i, 0) for i in range(files)], total or 0, per_file)


def _shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    first, second = pairs >> np.uint64(32), (pairs & np.uint64(0xFFFFFFFF)) >> np.uint64(_BLOCK)
    return (mixed(first * np.uint64(0x9E3779B97F4A7C15) + second) % np.uint64(shards)).astype(np.int64)


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys as compressed differences, then counts."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return pa.compress(steps.tobytes() + n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(block: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(block, decompressed_size=12 * size, codec="zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(raw[: 8 * size].reshape(8, size).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(raw[8 * size :].reshape(4, size).T).view("<u4").ravel()


def _pairs(numbers: np.ndarray, counts: np.ndarray, start: int) -> np.ndarray:
    """(previous token, token) of every token; the start number comes before each text."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[np.cumsum(counts) - counts] = start
    return (before.astype(np.uint64) << np.uint64(32)) | numbers.astype(np.uint64)


def discounts(counts_of_counts: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from how many keys have count 1, 2, 3, 4."""
    n1, n2, n3, n4 = counts_of_counts
    if not (n1 and n2):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    more = [k - (k + 1) * y * b / a if a else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(more, 1))


@dataclass
class Model:
    words: Words
    shards: list[int]
    pair_discounts: tuple[float, float, float]
    folder: str

    def open(self) -> None:
        self.words.open()
        self._pairs = [map_arrays(f"{self.folder}/pairs-{i}", [("<u8", n), ("<u4", n)]) for i, n in enumerate(self.shards)]
        size = self.words.distinct + 2
        parts = [map_arrays(f"{self.folder}/dense-{i}", [("<f8", n), ("<f8", n), ("<f8", n)]) for i, n in enumerate(_dense_sizes(size, self.words.per_file))]
        self._dense = parts

    def _of_word(self, which: int, numbers: np.ndarray) -> np.ndarray:
        out = np.empty(len(numbers))
        file = numbers // self.words.per_file
        for i in np.unique(file).tolist():
            own = file == i
            out[own] = self._dense[i][which][numbers[own] - i * self.words.per_file]
        return out

    def _counts(self, pairs: np.ndarray) -> np.ndarray:
        shard = _shard_of(pairs, len(self.shards))
        order = np.lexsort((pairs, shard))
        limits = np.searchsorted(shard[order], np.arange(len(self.shards) + 1))
        out = np.zeros(len(pairs), np.int64)
        for i, (keys, n) in enumerate(self._pairs):
            own = order[limits[i] : limits[i + 1]]
            if len(own) and len(keys):
                at = np.minimum(np.searchsorted(keys, pairs[own]), len(keys) - 1)
                out[own] = np.where(keys[at] == pairs[own], n[at], 0)
        return out

    def score(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of every token."""
        v = self.words.distinct
        pairs, back = np.unique(_pairs(numbers, counts, v + 1), return_inverse=True)
        before, token = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        n = self._counts(pairs)
        lower = self._of_word(0, token)
        kept, total = self._of_word(1, before), self._of_word(2, before)
        discount = np.array([0.0, *self.pair_discounts])[np.minimum(n, 3)]
        seen = np.where(total > 0, (n - discount) / np.maximum(total, 1), 0.0)
        return np.log10(seen + np.where(total > 0, kept, 1.0) * lower)[back]


def _dense_sizes(size: int, per_file: int) -> list[int]:
    return [min(per_file, size - a) for a in range(0, size, per_file)]


def learn(texts: DataFrame, words_a_file: int = WORDS_A_FILE, pairs_a_shard: int = PAIRS_A_SHARD) -> Model:
    """A model of the column `text`. All files are under one new folder of the shared folder."""
    spark = texts.sparkSession
    folder = work_path(spark, "language-model")
    words = learn_words(texts, folder, words_a_file)
    v, shards = words.distinct, max(1, -(-words.total // pairs_a_shard))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHasher(), [], 0
        words.open()

        def send() -> pa.RecordBatch:
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[first], np.diff(first, append=len(keys)).astype(np.uint32)
            del first
            # By pieces: a hash needs several arrays of the same length.
            shard = np.concatenate([_shard_of(keys[i : i + 250_000], shards).astype(np.int32) for i in range(0, len(keys), 250_000)])
            order = np.argsort(shard, kind="stable")
            limits = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
            del shard
            keys, n = keys[order], n[order]
            full = [i for i in range(shards) if limits[i] < limits[i + 1]]
            blocks = [_packed(keys[limits[i] : limits[i + 1]], n[limits[i] : limits[i + 1]]) for i in full]
            sizes = [limits[i + 1] - limits[i] for i in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(sizes, pa.int64()), pa.array(blocks, pa.binary())], ["shard", "n", "block"])

        for batch in batches:
            for _, _, tokens, counts in _tokens(batch.column(0), hasher):
                held.append(_pairs(words.find(tokens)[0], counts, v + 1))
                size += len(tokens)
                if size >= PAIRS_HELD:
                    yield send()
                    size = 0
                    hand_back()
        if size:
            yield send()
        hand_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Write each shard; rows of (kind, id, a, b, c): counts of counts, followers, predecessors, size."""
        for shard, table in _grouped(batches, "shard"):
            blocks = [_unpacked(b, n) for b, n in zip(table["block"].to_pylist(), table["n"].to_pylist(), strict=True)]
            keys, n = _summed(*(np.concatenate(c) for c in zip(*blocks, strict=True)))
            del blocks, table
            n = n.astype(np.uint32)
            write_arrays(f"{folder}/pairs-{shard}", [keys, n])
            zero = np.zeros(4, np.int64)
            yield from _rows(2, np.array([1, 2, 3, 4]), np.array([(n == k).sum() for k in (1, 2, 3, 4)]), zero, zero)
            yield from _rows(3, np.array([shard]), np.array([len(keys)]), zero[:1], zero[:1])
            word, times = np.unique(keys.astype(np.uint32), return_counts=True)
            yield from _rows(1, word, times, np.zeros(len(word), np.int8), np.zeros(len(word), np.int8))
            del word, times
            before = (keys >> np.uint64(32)).astype(np.uint32)
            start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
            tally = [np.add.reduceat(x.astype(np.int32), start) for x in (n == 1, n == 2, n > 2)]
            yield from _rows(0, before[start], *tally)
            del keys, n, before, start, tally
            hand_back()

    form = "kind int, id long, a long, b long, c long"
    sent = texts.select("text").mapInArrow(count_pairs, "shard int, n long, block binary").repartition(shards, "shard").sortWithinPartitions("shard")
    parts = materialize(sent.mapInArrow(merge, form), "pairs")
    sums = materialize(parts.groupBy("kind", "id").agg(*[F.sum(c).alias(c) for c in "abc"]), "pairs")
    # Five numbers and one size for each shard.
    small = {(r.kind, r.id): r.a for r in sums.filter("kind >= 2").collect()}
    sizes = [small.get((3, i), 0) for i in range(shards)]
    d = discounts([small.get((2, k), 0) for k in (1, 2, 3, 4)])
    tally = sums.filter("kind = 1").agg(*[F.count_if(F.col("a") == k) for k in (1, 2, 3, 4)], F.count_if(F.col("a") > 2), F.sum("a")).first()
    low = discounts(list(tally[:4]))
    types = tally[5] or 0
    spread = (low[0] * tally[0] + low[1] * tally[1] + low[2] * tally[4]) / types if types else 1.0

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By word number: its probability after any word, and as a first word the share that it leaves to that, and its total.

        A file's rows stream by, each into its place.
        """
        file, arrays = None, []

        def close() -> pa.RecordBatch:
            write_arrays(f"{folder}/dense-{file}", arrays)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32())], ["file"])

        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for x, y in pairwise(cuts) if len(of) else ():
                if of[x] != file:
                    if file is not None:
                        yield close()
                    file = int(of[x])
                    size = _dense_sizes(v + 2, words_a_file)[file]
                    arrays = [np.full(size, spread / (v + 1)), np.ones(size), np.zeros(size)]
                lower, share, total = arrays
                kind, number, a, b, c, followed = (batch.column(i).to_numpy()[x:y] for i in range(1, 7))
                number = number - file * words_a_file
                own = kind == 1
                lower[number[own]] += (a[own] - np.array([0.0, *low])[np.minimum(a[own], 3)]) / max(types, 1)
                own = kind == 0
                total[number[own]] = followed[own]
                left = d[0] * a[own] + d[1] * b[own] + d[2] * c[own]
                share[number[own]] = left / np.maximum(total[number[own]], 1)
        if file is not None:
            yield close()
        arrays = []
        hand_back()

    # How often a word is followed: the sum of its pairs' counts.
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.open()
        counts = words._counts
        firsts = words._firsts
        for batch in batches:
            number, kind = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            total = np.zeros(len(number), np.int64)
            file = np.searchsorted(firsts, number, "right") - 1
            for i in range(len(counts)):
                own = (file == i) & (number < v)
                total[own] = counts[i][number[own] - firsts[i]]
            total[number == v + 1] = ends
            yield pa.RecordBatch.from_arrays([pa.array((number // words_a_file).astype(np.int32)), *batch.columns, pa.array(np.where(kind == 0, total, 0))], ["file", "kind", "id", "a", "b", "c", "total"])

    ends = texts.count()
    files = len(_dense_sizes(v + 2, words_a_file))
    # A row of no kind for each file, so that every file is written.
    every = spark.range(files).select(F.lit(-1).alias("kind"), (F.col("id") * words_a_file).alias("id"), *[F.lit(0).cast("long").alias(c) for c in "abc"])
    rows = sums.filter("kind < 2").unionByName(every)
    numbered = rows.mapInArrow(totals, f"file int, {form}, total long").repartition(files, "file").sortWithinPartitions("file")
    numbered.mapInArrow(dense, "file int").write.format("noop").mode("overwrite").save()
    discard(parts, sums)
    return Model(words, sizes, d, folder)


def _rows(kind: int, ids: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    for at in range(0, len(ids), 50_000):
        part = slice(at, at + 50_000)
        columns = [pa.array(x[part].astype(np.int64)) for x in (ids, a, b, c)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind), pa.int32()), *columns], ["kind", "id", "a", "b", "c"])


def scored(texts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of rows with these first two columns and `text`."""
    form = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    total, distinct = model.words.total, model.words.distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        model.open()
        for batch in batches:
            for a, b, tokens, counts in _tokens(batch.column(2), hasher):
                numbers, seen = model.words.find(tokens)
                start = np.cumsum(counts) - counts
                base = np.log10((seen + ADDED) / (total + ADDED * (distinct + 1)))
                base, score = np.add.reduceat(base, start), np.add.reduceat(model.score(numbers, counts), start)
                known = np.add.reduceat((seen > 0).astype(np.int64), start)
                perplexity = 10 ** np.minimum(-score / counts, 300)
                columns = [counts, known, np.full(len(counts), total), base, score, perplexity]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), *map(pa.array, columns)], [f.split()[0] for f in form.split(", ")])
        hand_back()

    return texts.select("doc_id", "held_out", "text").mapInArrow(run, form)


def language_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """Score every row by a model of the rows that are not held out."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
    model = learn(texts.filter("doc_id is not null and not held_out"), **sizes)
    out = materialize(scored(texts, model), "scores")
    delete_folder(out.sparkSession, model.folder)
    return out
