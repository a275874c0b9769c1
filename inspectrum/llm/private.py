"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the certain spans. The field then labels every other token that holds a
digit or an at sign: tokens side by side share a potential, and so do distant tokens
that are equal or hold the same digits, so a number that is plainly a phone number
once is one wherever it stands. Tokens inside certain spans are fixed; the rest follow by
loopy belief propagation in each document until messages stop changing, and confident ones add spans.

Weights maximise the pseudo-likelihood of the labels that the patterns give to a sample
of about `TRAIN_DOCS` documents, chosen by a hash of the id; it is a bounded sample of
labelled rows, and everything else covers every document and whole texts. Each token is tied to the
next one of its kind, and to the nearest certain one before and after it however far that
is, so a document has at most a few edges per token.

Null texts are empty and have no spans. Rows are judged one by one; repeated rows get equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectrum.llm.text import texts_of

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
TRAIN_DOCS, CONFIDENT = 20_000, 0.9
#: Messages go round until none changes by more than this; at least so many rounds are allowed, and some for each step of the longest path.
STILL, ROUNDS, ROUNDS_A_STEP = 1e-3, 64, 4

_ANY = re.compile(r"[0-9@]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_OUTER = "\"'`,;:!?<>[]{}|*#."

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """A run of address characters before an at sign, and a domain after it."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free, 0
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Certain spans, by start and then kind."""
    if not _ANY.search(text):
        return []
    found = list(_emails(text))
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
            found.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((*m.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


class Tokens:
    """The tokens of a document that can be personal data, with their features and edges."""

    def __init__(self, text: str, base: list[Span]) -> None:
        self.spans = [m.span() for m in _TOKEN.finditer(text)]
        self.fixed = np.zeros(len(self.spans), np.int64)
        i = 0
        # Both lists go by start; a token belongs to the first certain span that meets it.
        for start, end, kind in base:
            while i > 0 and self.spans[i - 1][1] > start:
                i -= 1
            while i < len(self.spans) and self.spans[i][0] < end:
                if self.spans[i][1] > start and not self.fixed[i]:
                    self.fixed[i] = 1 + kind
                i += 1
        words = [text[a:b].strip(_OUTER) for a, b in self.spans]
        self.features = np.array([self._features(w) for w in words], np.float64).reshape(len(words), FEATURES)
        chain, skip, last = [], [], {}
        where: dict = {}
        for k, w in enumerate(words):
            if k and self.spans[k][0] - self.spans[k - 1][1] <= 2:
                chain.append((k - 1, k))
            digits = re.sub("[^0-9]", "", w)
            for key in {("same", w.lower()), ("digits", digits[-7:]) if len(digits) >= 6 else ("same", w.lower())}:
                if w and key in last:
                    skip.append((last[key], k))
                last[key] = k
                if w:
                    where.setdefault(key, []).append(k)
        # A certain token speaks to all of its kind up to the next certain one, also to those that are not next to it.
        sure = set()
        for same in where.values():
            for order in (same, same[::-1]):
                known = None
                for k in order:
                    if self.fixed[k]:
                        known = k
                    elif known is not None:
                        sure.add((min(known, k), max(known, k)))
        self.longest = max((len(same) for same in where.values()), default=0)
        self.sure = np.array(sorted(sure.difference(skip)), np.int64).reshape(-1, 2)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(sorted(set(skip)), np.int64).reshape(-1, 2)

    @staticmethod
    def _features(w: str) -> list[float]:
        digits = sum(c.isdigit() for c in w)
        letters = sum(c.isalpha() for c in w)
        dots, at = w.count("."), w.find("@")
        limits = (0, 1, 3, 6, 9, 12, 20)
        return [
            1.0, at > 0, at > 0 and "." in w[at:], w.startswith("+"), "(" in w or ")" in w, "-" in w[1:], dots == 3 and not letters, 0 < dots < 3, letters > 0, letters > digits,
            w.isdigit(), "=" in w or "/" in w, *(a <= digits < b for a, b in zip(limits, (*limits[1:], 10**9), strict=True)),
        ]


FEATURES = len(Tokens._features("0"))
_SIZE = FEATURES + 2 * LABELS


def _neighbours(edges: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How many neighbours of each label each token has."""
    out = np.zeros((len(labels), LABELS))
    if len(edges):
        np.add.at(out, (edges[:, 0], labels[edges[:, 1]]), 1)
        np.add.at(out, (edges[:, 1], labels[edges[:, 0]]), 1)
    return out


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Weights (labels x features and neighbour counts) of the largest pseudo-likelihood, by accelerated gradient steps."""
    weights = look = np.zeros((LABELS, _SIZE))
    if not len(rows):
        # Nothing is known: equal neighbours agree, and no label is likely by itself.
        weights[0, 0] = 1.0
        weights[np.arange(LABELS), FEATURES + LABELS + np.arange(LABELS)] = 1.0
        return weights
    rng = np.random.default_rng(3)
    # Shapes that the patterns look for are hidden at times, so that neighbours and other features count too.
    rows = np.concatenate([rows, np.where(rng.random((len(rows), _SIZE)) < 0.5, 0, rows)])
    labels = np.concatenate([labels, labels])
    want = np.eye(LABELS)[labels]
    rate = 4.0 / max(1e-9, np.linalg.eigvalsh(rows.T @ rows / len(rows))[-1])
    for k in range(rounds):
        score = rows @ look.T
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        after = look - rate / 2 * ((p - want).T @ rows / len(rows) + ridge * look)
        look = after + k / (k + 3) * (after - weights)
        weights = after
    return weights


def beliefs(tokens: Tokens, weights: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Probability of every label of every token, by loopy belief propagation; certain tokens are fixed."""
    own = tokens.features @ weights[:, :FEATURES].T
    own = np.where(tokens.fixed[:, None] > 0, np.where(np.arange(LABELS) == tokens.fixed[:, None], 0.0, -50.0), own)
    tables = [weights[:, FEATURES + k * LABELS : FEATURES + (k + 1) * LABELS] for k in range(2)]
    tables = [(t + t.T) / 2 for t in tables]
    if rounds is None:
        rounds = ROUNDS + ROUNDS_A_STEP * max(tokens.longest, len(tokens.chain))
    edges = np.concatenate([tokens.chain, tokens.skip, tokens.sure])
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    kind = np.tile(np.repeat([0, 1], [len(tokens.chain), len(tokens.skip) + len(tokens.sure)]), 2)
    potential = np.stack(tables)[kind]
    back = (np.arange(len(source)) + len(edges)) % max(1, len(source))
    messages = np.zeros((len(source), LABELS))
    for _ in range(rounds if len(edges) else 0):
        total = own.copy()
        np.add.at(total, target, messages)
        sent = (total[source] - messages[back])[:, None, :] + potential
        top = sent.max(2, keepdims=True)
        new = (top + np.log(np.exp(sent - top).sum(2, keepdims=True)))[:, :, 0]
        new -= new.max(1, keepdims=True)
        still = np.abs(new - messages).max() <= STILL
        messages = 0.5 * messages + 0.5 * new
        if still:
            break
    total = own.copy()
    np.add.at(total, target, messages)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def all_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """Certain spans and those that the field adds, by start and then kind."""
    if not _ANY.search(text):
        return base
    tokens = Tokens(text, base)
    free = np.flatnonzero(tokens.fixed == 0)
    if not len(free):
        return base
    p = beliefs(tokens, weights)
    added: list[Span] = []
    for i in free[(p[free].argmax(1) > 0) & (p[free].max(1) >= CONFIDENT)].tolist():
        start, end = tokens.spans[i]
        start += len(text[start:end]) - len(text[start:end].lstrip(_OUTER))
        end = start + len(text[start:end].rstrip(_OUTER))
        kind = int(p[i].argmax()) - 1
        if added and added[-1][2] == kind and not text[added[-1][1] : start].strip():
            added[-1] = (added[-1][0], end, kind)
        else:
            added.append((start, end, kind))
    return sorted([*base, *added], key=lambda s: (s[0], s[2]))


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """Weights from a sample of about `train_docs` rows. Tokens of the sample come as counted feature rows."""
    texts = texts_of(df, id_col, text_col)
    share = min(1.0, train_docs / max(1, texts.count()))
    sample = texts.filter(F.abs(F.xxhash64("doc_id", F.lit("private")) % 1_000_000) < int(share * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                if _ANY.search(text):
                    t = Tokens(text, base_spans(text))
                    found.append(np.concatenate([t.features, np.minimum(_neighbours(t.chain, t.fixed), 9), np.minimum(_neighbours(t.skip, t.fixed), 9), t.fixed[:, None]], 1).astype(np.uint8))
            rows, n = np.unique(np.concatenate([*found, np.zeros((0, _SIZE + 1), np.uint8)]), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(n.astype(np.int64))], ["row", "n"])

    counted = sample.mapInArrow(run, "row binary, n long").groupBy("row").agg(F.sum("n").alias("n")).orderBy("row").collect()
    table = np.array([np.frombuffer(r.row, np.uint8) for r in counted], np.float64).reshape(-1, _SIZE + 1)
    # A row counts with the root of its frequency, at most ten times.
    times = np.minimum(10, np.ceil(np.sqrt([r.n for r in counted]))).astype(np.int64) if counted else np.zeros(0, np.int64)
    table = np.repeat(table, times, axis=0)
    return fit(table[:, :-1], table[:, -1].astype(np.int64))


def find_private(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): certain spans and all spans of each row, arrays of (kind, start, end) in code points."""
    weights = learn(df, id_col, text_col)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            spans = [all_spans(t, b, weights) for t, b in zip(texts, base, strict=True)]
            columns = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in row] for row in rows], pa.list_(item)) for rows in (base, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "spans"])

    form = "array<struct<kind: string, start: long, end: long>>"
    return texts_of(df, id_col, text_col).mapInArrow(run, f"doc_id long, base {form}, spans {form}")


def digests(found: DataFrame) -> DataFrame:
    """Counts and a digest of the certain spans, and all spans as text."""

    def text(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def masked(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`df` with every span of its text replaced by its kind in angle brackets; overlapping spans become one, of the first kind."""
    weights = learn(df, id_col, text_col)

    def hide(text: str) -> str:
        out, at = [], 0
        for start, end, kind in all_spans(text, base_spans(text), weights):
            if start >= at:
                out.append(f"{text[at:start]}<{KINDS[kind]}>")
            at = max(at, end)
        return "".join(out) + text[at:] if out else text

    where = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if t is None else hide(t) for t in batch.column(where).to_pylist()], batch.schema.types[where])
            yield batch.set_column(where, batch.schema.field(where), texts)

    return df.mapInArrow(run, df.schema)
