"""Byte-level BPE by a sentencepiece model that is written from a rank file.

The ranks become a BPE model without training: a piece is a token's bytes, each byte
written as one printable character, its score is the negative rank, and the
normaliser is the identity. Merging the pair with the best score, leftmost first, is
then the merge order of the rank file. Texts are split into pre-tokens first; each
distinct pre-token meets the model once per task.

Nulls are empty texts; an empty text has no ids and decodes to no bytes. Rows are
independent: repeated rows give repeated results, an empty table an empty result.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectrum.llm.text import binary_column, list_column, texts_of

#: Distinct pieces of text that a task remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 500_000, 48

#: Unicode's White_Space, the class that `\s` stands for in the pattern of pre-tokens.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it is printable, else one above U+00FF."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model: piece 0 is unknown, piece r + 1 is the token of rank r."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must count from 0 without gaps")
    shown = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes_field(1, _bytes_field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _int_field(3, kind))

    normal, unknown, bpe = 1, 2, 2
    pieces = [piece("<unk>", 0.0, unknown)]
    pieces += [piece("".join(shown[b] for b in token), -float(rank), normal) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _int_field(3, bpe) + _int_field(4, len(pieces))
    normalizer = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    return b"".join(pieces) + _bytes_field(2, trainer) + _bytes_field(3, normalizer)


class Codec:
    """Encodes texts and decodes ids; built once in each task."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str) -> None:
        import regex
        import sentencepiece

        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._whole = {t: i for i, t in enumerate(tokens)}
        self._shown = byte_characters()
        explicit = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")
        self._split = regex.compile(explicit)
        # Pre-tokens never reach over the end of a run of other characters, so such runs can be remembered whole.
        self._runs = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
        self._known = _Memory(self._ids_of_run)
        lengths = np.array([len(t) for t in tokens], np.int64)
        self._lengths, self._starts = lengths, np.cumsum(lengths) - lengths
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _ids_of_run(self, run: str) -> bytes:
        ids: list[int] = []
        for pre in self._split.findall(run):
            raw = pre.encode("utf-8", "surrogatepass")
            whole = self._whole.get(raw)
            if whole is not None:
                ids.append(whole)
            else:
                ids += [i - 1 for i in self._pieces.encode("".join(map(self._shown.__getitem__, raw)))]
        return np.array(ids, "<i4").tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and the number of ids of each text."""
        self._known.shrink()
        known, runs = self._known, self._runs
        parts = [b"".join(map(known.__getitem__, runs.findall(t))) for t in texts]
        return np.frombuffer(b"".join(parts), "<i4"), np.array([len(p) // 4 for p in parts], np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes in order and where each text starts in them."""
        ends = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        size = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self._lengths[ids], out=size[1:])
        out = np.empty(size[-1], np.uint8)
        for a in range(0, len(ids), 1 << 20):
            b = min(a + (1 << 20), len(ids))
            shift = np.repeat(self._starts[ids[a:b]] - size[a:b], self._lengths[ids[a:b]])
            out[size[a] : size[b]] = self._bytes[shift + np.arange(size[a], size[b])]
        return out, size[ends]


class _Memory(dict):
    """Results by text, computed when first asked for; long texts are not kept."""

    def __init__(self, compute) -> None:
        super().__init__()
        self._compute = compute

    def __missing__(self, text: str):
        out = self._compute(text)
        if len(text) <= REMEMBERED_CHARS:
            self[text] = out
        return out

    def shrink(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()


def transcode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary): the ids of each whole text and the bytes they decode to."""
    ranks = read_ranks(ranks_path)
    tokens = sorted(ranks, key=ranks.__getitem__)
    model = model_bytes(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, tokens, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, counts = codec.encode(part.column(1).to_pylist())
                decoded = binary_column(*codec.decode(ids, counts))
                yield pa.RecordBatch.from_arrays([part.column(0), list_column(ids, counts, pa.int32()), decoded], ["doc_id", "ids", "decoded"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    """Number of ids and digests of the ids, as decimals, and of the decoded bytes."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
