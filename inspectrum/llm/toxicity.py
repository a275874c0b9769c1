"""Severity of toxic texts by cumulative-link ordinal regression on sparse features.

A text's features are its words and their first letters, hashed. Those that go with toxic
labels most, by chi-square, are selected. Labels only say toxic or not, so grades are
set from them: grade 0 is not toxic, and toxic rows are split into grades 1, 2 and 3
at the thirds of their density of strongly associated features. The model has one
weight for each feature and ordered thresholds: P(grade >= k) is the logistic of the
weighted features less the k-th threshold. Expected severity is the sum of these.

Selection and fit use about `TRAIN_ROWS` labelled documents, chosen by a hash of the id, which
bounds what reaches the driver; every document is scored, over its whole text.

Null texts are empty and have no features. Rows with null labels or ids teach nothing; a document with
several labels is toxic if any says so. Rows are scored one by one. Without any toxic
label nothing is toxic. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectrum.llm.text import WordHasher, chained, chunks, list_column, string_buffers, texts_of

TRAIN_ROWS, FEATURES, LEAST_ROWS = 20_000, 300, 5
BUCKETS, PREFIXES, GRADES = 1 << 22, (4, 5, 6), 3
#: A feature is strongly associated if it is this many times as frequent in toxic rows.
STRONG = 20.0
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())

Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _features(column: pa.Array, hasher: WordHasher) -> Iterator[tuple[int, int, Rows]]:
    """Ranges of texts with (text, bucket, times) of every distinct feature, and words of each text."""
    data, offsets = string_buffers(column)
    for a, b in chunks(offsets):
        part = data[offsets[a] : offsets[b]]
        if not len(part):
            yield a, b, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(b - a, np.int64))
            continue
        starts, ends, words = hasher.words(part, offsets[a : b + 1] - offsets[a])
        text = np.repeat(np.arange(b - a), words)
        found = [(text, hasher.hashes(starts, ends))]
        for size in PREFIXES:
            long = ends - starts > size
            prefix = hasher.hashes(starts[long], starts[long] + size)
            found.append((text[long], chained(prefix, np.full(len(prefix), size, np.uint64))))
        keys = np.concatenate([t.astype(np.int64) * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64) for t, h in found])
        keys, times = np.unique(keys, return_counts=True)
        yield a, b, (keys // BUCKETS, keys % BUCKETS, times, words)


@dataclass
class Model:
    """`place` gives a selected feature's index, and -1 for others."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def place(self) -> np.ndarray:
        out = np.full(BUCKETS, -1, np.int32)
        out[self.buckets] = np.arange(len(self.buckets))
        return out


def values(times: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Presence counts once, and density on top."""
    return 1.0 + np.log1p(100.0 * times / np.maximum(words, 1))


def probabilities(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ..."""
    return 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -500, 500)))


def fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grades: np.ndarray, n_features: int, rounds: int = 600, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds of the largest likelihood of the grades, by accelerated gradient steps.

    Thresholds are a first one and positive gaps, so they stay ordered. Entries are (row, feature, value).
    """
    n = len(grades)
    point = np.concatenate([np.zeros(n_features), [2.0], np.zeros(GRADES - 1)])
    look, norm = point.copy(), np.bincount(row, value**2, n).max(initial=1.0)
    rate = 2.0 / (norm + GRADES + 1)
    for k in range(rounds):
        w, gaps = look[:n_features], np.exp(look[n_features + 1 :])
        thresholds = look[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        above = np.concatenate([np.ones((n, 1)), probabilities(np.bincount(row, value * w[feature], n), thresholds), np.zeros((n, 1))], 1)
        at = np.arange(n)
        high, low = above[at, grades], above[at, grades + 1]
        p = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high) / p, low * (1 - low) / p
        by_score = slope_high - slope_low
        by_threshold = np.zeros(GRADES + 2)
        np.add.at(by_threshold, grades, -slope_high)
        np.add.at(by_threshold, grades + 1, slope_low)
        by_threshold = by_threshold[1:-1]
        tail = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate([np.bincount(feature, value * by_score[row], n_features), [tail[0]], tail[1:] * gaps]) / n
        gradient[:n_features] -= ridge * w
        after = look + rate * gradient * 4
        look = after + k / (k + 3) * (after - point)
        point = after
    gaps = np.exp(point[n_features + 1 :])
    return point[:n_features], point[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Select features and fit the grades on a bounded sample of labelled rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, train_rows / max(1, known.count()))
    sample = known.filter(F.abs(F.xxhash64("doc_id", F.lit("toxic")) % 1_000_000) < int(share * 1_000_000))
    # Bounded: about `train_rows` rows of two numbers.
    rows = texts_of(df, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(_SEPARATORS)
        for batch in batches:
            toxic = batch.column(2).to_numpy() > 0
            for a, b, (text, bucket, _, _) in _features(batch.column(1), hasher):
                both, n = np.unique(bucket * 2 + toxic[a:b][text], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both // 2), pa.array(np.where(both % 2, n, 0)), pa.array(np.where(both % 2, 0, n))], ["bucket", "bad", "good"])

    counted = rows.mapInArrow(count, "bucket long, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    totals = rows.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    bad, good = max(1, totals[0]), max(1, totals[1])
    n = bad + good
    seen = F.col("bad") + F.col("good")
    off = F.col("bad") * n - seen * bad
    chi = off.cast("double") * off / (seen * bad * good).cast("double") / F.greatest(F.lit(1), n - seen)
    chosen = counted.filter((seen >= LEAST_ROWS) & (off > 0)).select("bucket", "bad", "good", chi.alias("chi")).orderBy(F.desc("chi"), "bucket").limit(FEATURES).collect()
    model = Model(np.array([r.bucket for r in chosen], np.int64), np.zeros(len(chosen)), np.array([50.0, 51.0, 52.0]))
    if not chosen or not totals[0]:
        return model
    strong = np.array([(r.bad + 0.1) / bad >= STRONG * (r.good + 0.1) / good for r in chosen])
    table = rows.mapInArrow(_selected(model), "doc_id long, toxic int, n_words long, features array<int>, times array<int>").orderBy("doc_id", "n_words").toArrow()
    sizes = np.array([len(x) for x in table["features"].to_pylist()], np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    feature, times = (np.array([v for x in table[c].to_pylist() for v in x], np.int64) for c in ("features", "times"))
    words, toxic = table["n_words"].to_numpy(), table["toxic"].to_numpy() > 0
    density = np.bincount(row, times * strong[feature], len(sizes)) / np.maximum(words, 1)
    limits = np.quantile(density[toxic], [1 / 3, 2 / 3]) if toxic.any() else [0, 0]
    grades = np.where(toxic, 1 + (density[:, None] > limits).sum(1), 0)
    model.weights, model.thresholds = fit(row, feature, values(times, words[row]), grades, len(chosen))
    return model


def _selected(model: Model):
    """Selected features of each row with an id and a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, place = WordHasher(_SEPARATORS), model.place()
        for batch in batches:
            for a, b, (text, bucket, times, words) in _features(batch.column(1), hasher):
                own = place[bucket] >= 0
                counts = np.bincount(text[own], minlength=b - a)
                lists = [list_column(x, counts, pa.int32()) for x in (place[bucket[own]], times[own].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(words), *lists], ["doc_id", "toxic", "n_words", "features", "times"])

    return run


def severities(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, severity, toxic): the expected and the most probable grade, and whether it is probably above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, place = WordHasher(_SEPARATORS), model.place()
        for batch in batches:
            for a, b, (text, bucket, times, words) in _features(batch.column(1), hasher):
                own = place[bucket] >= 0
                text, times = text[own], times[own]
                score = np.bincount(text, model.weights[place[bucket[own]]] * values(times, words[text]), b - a) if len(text) else np.zeros(b - a)
                above = probabilities(score, model.thresholds)
                exact = np.concatenate([np.ones((b - a, 1)), above], 1) - np.concatenate([above, np.zeros((b - a, 1))], 1)
                columns = [pa.array(above.sum(1)), pa.array(exact.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= 0.5)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["doc_id", "expected_severity", "severity", "toxic"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, expected_severity double, severity int, toxic boolean")
