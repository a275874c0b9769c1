"""Document fingerprints by locally consistent parsing.

A text is parsed bottom up. On each level, runs of one symbol become one symbol; then
deterministic coin tossing reduces symbols to six labels, each from a symbol and its
left neighbours alone; every local maximum of the labels starts a phrase, and a phrase
is named by a hash of its symbols. Equal substrings are so cut alike except near their
ends, wherever they stand. A fingerprint holds the smallest names of all levels, each told by its level
too, and the likeness of two is the estimated share of names that both texts have. Names of low levels
make texts of a few words alike if they share some of them; those of high levels stand for long passages.

Nulls are empty texts, whose fingerprint is empty; two empty fingerprints are alike (1.0), an
empty and another not (0.0). Rows are fingerprinted one by one. For edits, rows stand in
order of (doc_id, text), a null doc_id first, and the first follows the last; a lone
document follows itself. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectrum.llm.text import chained, mixed, texts_of

#: Levels of phrases that give names to a fingerprint, and how many names it holds.
LEVELS, NAMES = 3, 64
_BASE = 0xD1342543DE82EF95


class Parser:
    """Parses many texts at once; keeps tables of powers between calls."""

    def __init__(self) -> None:
        self._power = self._inverse = np.zeros(0, np.uint64)
        own, left = np.divmod(np.arange(1 << 14), 1 << 7)
        differ = own ^ left
        at = np.bitwise_count(np.maximum(differ & -differ, 1) - 1)
        # Labels below 128 after one toss: the next one by a table of (label, left label).
        self._toss = (2 * at + ((own >> at) & 1)).astype(np.uint8)
        self._symbol = mixed(np.arange(1, 0x110001, dtype=np.uint64))

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self._power):
            base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
            self._power, self._inverse = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * n, b)])) for b in (base, inverse))
        return self._power[:n], self._inverse[:n]

    def _coin_toss(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Labels 0 to 5; neighbours in a text differ.

        A label names the lowest bit that differs from the left neighbour, and its value. A text's
        first symbol is compared with itself, the lowest bit changed.
        """
        left = np.empty_like(symbols)
        left[1:] = symbols[:-1]
        left[first] = symbols[first] ^ np.uint64(1)
        differ = symbols ^ left
        at = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
        labels = (at << np.uint8(1)) | ((symbols >> at.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
        for _ in range(3):
            beside = np.empty_like(labels)
            beside[1:] = labels[:-1]
            beside[first] = labels[first] ^ np.uint8(1)
            labels = self._toss[(labels.astype(np.uint16) << np.uint16(7)) | beside]
        return labels

    def _level(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the phrases of all texts, and where each text starts in them. No text is empty."""
        change = np.ones(len(symbols), bool)
        change[1:] = symbols[1:] != symbols[:-1]
        change[starts] = True
        at = np.flatnonzero(change)
        run = np.diff(np.append(at, len(symbols)))
        starts = np.searchsorted(at, starts)
        symbols = symbols[at]
        long = run > 1
        symbols[long] = chained(symbols[long], run[long].astype(np.uint64))
        labels = self._coin_toss(symbols, starts)
        peak = np.zeros(len(symbols), bool)
        peak[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
        last = np.append(starts[1:], len(symbols)) - 1
        peak[last] = False
        peak[starts] = True
        cut = np.flatnonzero(peak)
        power, inverse = self._powers(len(symbols))
        total = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * power, out=total[1:])
        ends = np.append(cut[1:], len(symbols))
        names = chained((total[ends] - total[cut]) * inverse[cut], (ends - cut).astype(np.uint64))
        return names, np.searchsorted(cut, starts)

    def names(self, texts: list[str], levels: int = LEVELS) -> list[list[np.ndarray]]:
        """Phrase names of each level, in text order, for each text: one list of arrays for each level."""
        full = [i for i, t in enumerate(texts) if t]
        out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] * len(texts) for _ in range(levels)]
        if not full:
            return out
        points = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum([0, *(len(texts[i]) for i in full[:-1])])
        symbols = self._symbol[points]
        for found in out:
            symbols, starts = self._level(symbols, starts)
            for i, part in zip(full, np.split(symbols, starts[1:]), strict=True):
                found[i] = part
        return out

    def sketches(self, texts: list[str]) -> list[np.ndarray]:
        """The smallest distinct names of each text, as 32-bit numbers in order; a name counts apart on each level."""
        tagged = [[(mixed(n + np.uint64(level)) >> np.uint64(32)).astype(np.uint32) for n in found] for level, found in enumerate(self.names(texts))]
        return [_least(np.concatenate(own)) for own in zip(*tagged, strict=True)]


def _least(names: np.ndarray) -> np.ndarray:
    """The `NAMES` smallest distinct ones, in order: sorted among the smallest of all, and of more only where names repeat."""
    most = 4 * NAMES
    while most < len(names):
        some = np.unique(np.partition(names, most - 1)[:most])
        if len(some) >= NAMES:
            return some[:NAMES]
        most *= 4
    return np.unique(names)[:NAMES]


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common names: among the smallest names of both, those that both have."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    union = np.union1d(a, b)[:NAMES]
    return float(np.isin(union, a, assume_unique=True)[np.isin(union, b, assume_unique=True)].sum() / len(union))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for batch in batches:
            for part in _parts(batch.column(1).to_pylist()):
                found = [written(s) for s in parser.sketches(batch.column(1).slice(part.start, part.stop - part.start).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def _parts(texts: list[str], size: int = 100_000) -> Iterator[slice]:
    """Slices of about `size` characters."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield slice(first, i + 1)
            first, total = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


_FIRST = -(2**63)


def _followed(texts: DataFrame) -> DataFrame:
    """Rows dealt into ranges of doc_id, each range followed by the first row of the next one.

    Columns range, tail, doc_id, text. As many ranges as shuffle partitions; only their bounds and
    smallest ids pass the driver.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = texts.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("id"))
    quantiles = ids.select(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 20_000)).first()[0]
    bounds = sorted(set(quantiles or []))
    limits = np.array(bounds, np.int64)

    @F.pandas_udf("long")
    def range_of(id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, id.to_numpy(np.int64), "right").astype(np.int64))

    heads = dict(ids.select(range_of("id").alias("r"), "id").groupBy("r").agg(F.min("id")).collect())
    order = sorted(heads)
    before = {r: order[i - 1] for i, r in enumerate(order)}

    @F.pandas_udf("array<long>")
    def targets(id: pd.Series) -> pd.Series:
        own = np.searchsorted(limits, id.to_numpy(np.int64), "right").tolist()
        return pd.Series([[r, before[r]] if heads[r] == i else [r] for r, i in zip(own, id.tolist(), strict=True)])

    placed = texts.select("doc_id", "text", F.posexplode(targets(F.coalesce("doc_id", F.lit(_FIRST)))).alias("tail", "range"))
    return placed.repartition(n, "range").sortWithinPartitions("range", "tail", "doc_id", "text").select("range", "tail", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """`text` with its last quarter replaced by as much of the start of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compared_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each row's text and of its edited text, and their likeness to it and to the next row's."""
    form = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        rest: list[tuple[int, int, int | None, str]] = []

        def result(rows: list[tuple[int, int, int | None, str]]) -> pa.RecordBatch:
            """Of every row but the last, which only follows."""
            use = [i for i in range(len(rows) - 1) if rows[i][1] == 0 and rows[i + 1][0] == rows[i][0]]
            changed = [edited(rows[i][3], rows[i + 1][3]) for i in use]
            sketch = parser.sketches([r[3] for r in rows])
            other = parser.sketches(changed)
            columns = [
                pa.array([rows[i][2] for i in use], pa.int64()),
                pa.array([len(rows[i][3]) for i in use], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([written(sketch[i]) for i in use], pa.string()),
                pa.array([written(s) for s in other], pa.string()),
                pa.array([likeness(sketch[i], s) for i, s in zip(use, other, strict=True)], pa.float64()),
                pa.array([likeness(sketch[i], sketch[i + 1]) for i in use], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in form.split(", ")])

        for batch in batches:
            rest += zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for part in list(_parts([r[3] for r in rest[:-1]])):
                yield result(rest[part.start : part.stop + 1])
            rest = rest[-1:]

    return _followed(texts_of(df, id_col, text_col)).mapInArrow(run, form)
