"""Encoding and packing against the tokenizers' own libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from inspectrum.llm import packing, tokens

from .cases import EDGE_TEXTS, documents_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.read_ranks(RANKS), special_tokens={})


def _random_texts(alphabet: str, n: int) -> list[str]:
    rng = random.Random(5)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_codec_equals_library(library):
    ranks = tokens.read_ranks(RANKS)
    codec = tokens.Codec(tokens.model_bytes(ranks), sorted(ranks, key=ranks.__getitem__), public_tokenizers.PATTERN)
    texts = EDGE_TEXTS + _random_texts("abzAZ '’sté09 \n\t\x00\x1c\x85\xa0 中️😀!?.", 4000)
    ids, counts = codec.encode(texts)
    for t, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == library.encode_ordinary(t), repr(t)
    data, starts = codec.decode(ids, counts)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, starts[1:], strict=False)] == texts


def test_ranks_need_no_gaps():
    with pytest.raises(ValueError):
        tokens.model_bytes({b"a": 0, b"b": 2})


def test_digests(spark, library):
    rows = tokens.digests(tokens.transcode(documents_of(spark), RANKS, public_tokenizers.PATTERN)).collect()
    want = []
    for d, t in documents_of(spark).select("doc_id", "text").collect():
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_word_tokenizer_equals_library():
    own, library = packing.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    texts = EDGE_TEXTS + ["<|endoftext|> x", "IT'S I'll"] + _random_texts("abcXYZ '’!?.,-09éÉßİΣσ\n\t\r\x00 １ä̈中<|endoftext|>\x1c\x85", 4000)
    for _ in range(2):  # again from memory
        for a, b, ids, sizes in own.encode(pa.array(texts), 1):
            for t, part in zip(texts[a:b], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                assert part.tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], repr(t)


def test_common_words_are_learned_once(monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER_BYTES", 400)
    own, library = packing.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    own._KEPT, learned, learn = 60, [], own._learn

    def counted(hashes, words):
        learned.extend(words)
        learn(hashes, words)

    own._learn = counted
    rng = random.Random(4)
    texts = ["common words stay " + " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(20)) for _ in range(40)]
    ids = [i for _, _, found, _ in own.encode(pa.array(texts), 1) for i in found.tolist()]
    assert ids == [i for t in texts for i in [*library.encode(t, add_special_tokens=False).ids, 1]]
    assert [learned.count(w) for w in ("common", "words", "stay")] == [1, 1, 1] and len(own._hashes) < 150


def _check_packed(rows, texts, length):
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    by: dict = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for d, parts in by.items():
        ids = [*library.encode(texts[d], add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and 0 < r.length <= length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return sum(r.length for r in rows) / (len(sequences) * length)


def test_packing(spark):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice(["the", "of", "packing"]) for _ in range(rng.randint(0, 90))) for i in range(400)}
    texts[400] = "word " * 700
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert _check_packed(packing.pack_documents(df, WORDS, length=64).collect(), texts, 64) > 0.93


def test_packing_bounded_windows(spark):
    cut = spark.createDataFrame([(i, 0, 40, 0, 40) for i in range(100)], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long").coalesce(1)
    rows = packing.pack(cut, length=64, open_windows=3).collect()
    assert len({r.sequence_id for r in rows}) == 100 and {r.offset for r in rows} == {0}


def test_packing_edges(spark):
    df = documents_of(spark)
    rows = packing.pack_documents(df, WORDS).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 1  # a null text is its end alone
    assert sum(1 for r in rows if r.doc_id == 7 and r.start == 0) == 2  # repeated rows are packed each
    assert packing.pack_documents(df.limit(0), WORDS).count() == 0
