"""Quality rules, quotes, language scores, private data, fingerprints, severities and the pipeline."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from compare import rows_of
from inspectrum.llm import language, parsing, private, quality, quotes, toxicity
from inspectrum.llm.text import WordHasher

from .cases import LONG, ROWS, documents_of

JUNK = "one### two*** three$$$ four&&& " * 30
CLEAN = " ".join(f"Sentence{i} of{i} plain{i} words{i} ends{i} here{i}." for i in range(12))


def _oracle(sql: str, **tables) -> tuple:
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), rows_of(columns, cur.fetchall())


def _quality_rows():
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "z"]
    rows = list(ROWS)
    for d in range(20, 80):
        text = "\n".join(" ".join(rng.choice(words) + rng.choice(["", ".", "!", "#"]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8)))
        rows.append((d, text))
    rows += [(d, f"{CLEAN} Number {d}.") for d in range(100, 160)] + [(d, JUNK) for d in range(200, 206)]
    rows += [(300, "same line of words\n" * 30), (301, "a b c a b c a b c d a b c"), (302, "x\x0by\x1cz \r\n\r\nx"), (303, "THIS!! IS!! LOUD!! " * 30)]
    return rows


def test_quality_equals_sql(spark):
    rows = _quality_rows()
    got = quality.quality_table(documents_of(spark, rows))
    frame = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    assert _oracle(quality.oracle(), documents=frame) == (sorted(got.columns), rows_of(got.columns, map(tuple, got.collect())))


def test_quality_verdicts(spark):
    rows = _quality_rows()
    got = {r.doc_id: r for r in quality.quality_table(documents_of(spark, rows)).collect()}
    assert all(got[d].kept for d in range(100, 160))
    assert not any(got[d].kept for d in [*range(200, 206), 300, 301, 303, 2, 3])
    kept = quality.keep_good(documents_of(spark, rows))
    assert kept.columns == documents_of(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}
    assert quality.quality_table(documents_of(spark, [])).count() == 0


def test_a_rule_that_is_often_wrong_is_outvoted(spark):
    """One rule fires on a fifth of all documents whatever the others say; two others fire together. Abstentions change nothing."""
    n = len(quality.RULES)
    rng, rows = random.Random(5), []
    for d in range(4000):
        votes = [2] * n
        if d % 10 == 0:
            votes[1], votes[2] = 0, 0 if rng.random() < 0.9 else 2
        if rng.random() < 0.2:
            votes[0] = 0
        if rng.random() < 0.3:
            votes[3] = 1
        rows.append((votes,))
    got = {tuple(r.votes): r.quality for r in quality.posteriors(spark.createDataFrame(rows, "votes array<int>")).collect()}
    for votes, p in got.items():
        assert (p >= quality.KEEP_FROM) == (votes[1] == votes[2] == 2), votes
    assert sum(p >= quality.KEEP_FROM for votes, p in got.items() if 0 in votes) == 2
    assert abs(got[(2,) * n] - got[(2, 2, 2, 1) + (2,) * (n - 4)]) < 0.01


def test_quality_runs_no_python(spark):
    plan = quality.quality_table(documents_of(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


CHAT = [
    (1, 0, "user", "Hello there. How are you today?\nI wonder about Spark."),
    (1, 1, "assistant", "On Monday, user wrote:\n> Hello there. How are you\n> today?\nFine, thanks. And you?"),
    (1, 2, "user", ">> Hello there. How are you today?\n> Fine, thanks. And you?\n\nWell enough."),
    (1, 3, "assistant", "> I wonder about Spark.\nIt is an engine."),
    (1, 4, "user", "> It is an engine.\nOf what kind?\n> not said by anyone\nok"),
    (1, 5, "user", None),
    (None, 0, "user", "> x\ny"),
    (2, 0, "user", ""),
    (2, None, "user", "same"),
    (2, 1, "a", "same"),
    (2, 1, "a", "same"),
    (2, 1, "b", "> same\nright"),
    (2, 3, "b", "> > right\n> no\nyes"),
    (3, 0, "user", LONG),
    (3, 1, "user", "> " + LONG[:40]),
    (None, None, None, None),
] + [(4, k, "u", f"> turn {k - 1} says.\nturn {k} says.") for k in range(40)]


def _chat(spark, rows):
    return spark.createDataFrame([(*r, 0, "b") for r in rows], "conv_id long, turn long, role string, text string, depth int, body string").repartition(3)


def test_quotes_equal_sql(spark):
    got = quotes.reply_ordered(_chat(spark, CHAT))
    frame = pd.DataFrame(CHAT, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    assert _oracle(quotes.ORACLE, conversations=frame) == (sorted(got.columns), rows_of(got.columns, map(tuple, got.collect())))


def test_replies(spark):
    got = {(r.conv_id, r.position): r for r in quotes.reply_ordered(_chat(spark, CHAT)).collect() if r.conv_id}
    assert [got[1, k].turn for k in range(6)] == [0, 1, 2, 3, 4, 5]
    assert [got[1, k].parent_turn for k in range(6)] == [None, 0, 1, 0, 3, None]
    assert got[1, 1].body == "Fine, thanks. And you?" and got[1, 5].thread_turn == 5
    assert [got[4, k].depth for k in range(40)] == list(range(40))
    assert quotes.reply_ordered(_chat(spark, [])).count() == 0


def _tokens(text: str) -> list:
    return [("w", w) for w in re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})))] + ["end"]


def _kneser_ney(train: list) -> tuple:
    """A plain reference: probability of a token after another one, counts and distinct tokens."""
    count, pair = Counter(t for x in train for t in x), Counter((u, w) for x in train for u, w in zip(["start", *x], x, strict=False))
    d = [0.0, *language.discounts([sum(n == k for n in pair.values()) for k in (1, 2, 3, 4)])]
    before = Counter(w for _, w in pair)
    low = [0.0, *language.discounts([sum(n == k for n in before.values()) for k in (1, 2, 3, 4)])]
    spread = sum(low[min(n, 3)] for n in before.values()) / len(pair) if pair else 1.0
    total, left = Counter(), Counter()
    for (u, _), n in pair.items():
        total[u] += n
        left[u] += d[min(n, 3)]

    def p(u, w):
        lower = spread / (len(count) + 1) + (before[w] - low[min(before[w], 3)]) / max(len(pair), 1)
        if not total[u]:
            return lower
        n = pair[u, w]
        return (n - d[min(n, 3)]) / total[u] + left[u] / total[u] * lower

    return p, count


@pytest.mark.parametrize("sizes", [{}, {"words_a_file": 300, "pairs_a_shard": 2000}])
def test_language_scores_equal_plain_model(spark, sizes):
    """Also with several files and shards."""
    rng = random.Random(7)
    rows = ROWS + [(d, " ".join(rng.choice(["a", "B", "b", "c", "dé", "e" + str(rng.randint(0, 200))]) for _ in range(rng.randint(0, 60)))) for d in range(20, 120)]
    got = language.language_scores(documents_of(spark, rows), **sizes).collect()
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    train = [_tokens(t or "") for (d, t), h in zip(rows, held, strict=True) if d is not None and not h]
    p, count = _kneser_ney(train)
    n, v = sum(count.values()), len(count)
    want = []
    for (d, t), h in zip(rows, held, strict=True):
        x = _tokens(t or "")
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        score = sum(math.log10(p(u, w)) for u, w in zip(["start", *x], x, strict=False))
        want.append((d, h, len(x), sum(w in count for w in x), n, round(base, 6), round(score, 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got), key=str) == sorted(want, key=str)
    some = list(count)
    assert abs(sum(p("start", w) for w in some) + p("start", "unknown") - 1) < 1e-9


def test_language_without_training(spark):
    assert language.language_scores(documents_of(spark, [])).count() == 0
    alone = next(d for d in range(1000) if zlib.crc32(str(d).encode()) % 10 == 0)
    row = language.language_scores(documents_of(spark, [(alone, "a b")])).first()
    assert (row.n_known, row.train_tokens, row.score) == (0, 0, 0.0)


def test_language_tokens_take_little_memory():
    """Texts are hashed by small ranges, whose tokens come together as before."""
    column = pa.array([f"{LONG} {i}" for i in range(40)] + ["", LONG * 4, ""])
    tracemalloc.start()
    got = [(b - a, words, counts) for a, b, words, counts in language._tokens(column, WordHasher())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    assert sum(n for n, _, _ in got) == 43
    assert np.concatenate([c for _, _, c in got]).tolist() == [len(t.split()) + 1 for t in column.to_pylist()]
    whole = language._tokens(pa.array(column.to_pylist()[-4:]), WordHasher())
    assert np.concatenate([w for _, _, w, _ in whole]).tolist() == np.concatenate([w for _, w, _ in got]).tolist()[-sum(len(t.split()) + 1 for t in column.to_pylist()[-4:]) :]


def test_word_hashes():
    hasher, texts = WordHasher(), ["Aa bb\x0bbB", "", "  ", "aA", "é a"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    hashes, counts = hasher(np.frombuffer(data, np.uint8), offsets)
    assert counts.tolist() == [3, 0, 0, 1, 2]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] and len(set(hashes.tolist())) == 4


def _plain_spans(t: str) -> str:
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(g) <= 19 and (sum(g[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in g[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("0129.@+-() aZ%_é") for _ in range(rng.randint(0, 40)))
        assert ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, b, k in private.base_spans(t)) == _plain_spans(t), repr(t)
    assert private.base_spans("1" * 200_000 + "a" * 200_000 + "@") == []


PERSONAL = "Call +1 (539) 555-5986 or write to bob.42@mail8.example.com from 10.0.0.1, card 4467459322516291. "


def _personal_rows():
    rng = random.Random(4)
    rows = list(ROWS) + [(d, f"Text {rng.randint(0, 99)} with " + PERSONAL.replace("555-5986", f"555-{rng.randint(1000, 9999)}")) for d in range(1000, 1400)]
    rows += [(d, f"Version {d}.{rng.randint(0, 9)} has {rng.randint(1, 99)} files and {rng.randint(1000, 99999)} lines.") for d in range(60, 100)]
    return rows + [(200, PERSONAL + "é later call (539) 555-5986 again, in 3 days.")]


def test_private_data(spark):
    rows = _personal_rows()
    df = documents_of(spark, rows)
    got = {(r.doc_id, r.base_sha256): r for r in private.digests(private.find_private(df)).collect()}
    for d, t in rows:
        base = _plain_spans(t or "")
        r = got[d, hashlib.sha256(base.encode()).hexdigest()]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        if d != 200:
            assert r.spans == base, t
    at = rows[-1][1].index("(539) 555-5986", 40)
    assert f"phone:{at}:{at + 14}" in got[200, hashlib.sha256(_plain_spans(rows[-1][1]).encode()).hexdigest()].spans
    masked = private.masked(df)
    assert masked.columns == df.columns
    hidden = next(r.text for r in masked.collect() if r.doc_id == 200)
    assert hidden == "Call <phone> or write to <email> from <ip>, card <card>. é later call <phone> again, in 3 days."
    assert private.find_private(documents_of(spark, [])).count() == 0


def test_certain_numbers_reach_all_occurrences():
    """A number that is certain once is found in each of 50 places, near or far, before and after it."""
    weights = np.zeros((private.LABELS, private._SIZE))
    weights[0, 0] = 1.0
    weights[np.arange(private.LABELS), private.FEATURES + private.LABELS + np.arange(private.LABELS)] = 1.0
    weights[4, private.FEATURES + private.LABELS + 4] = 4.5
    for place in (0, 25, 50):
        parts = ["call 420777123457 at noon today"] * 50
        parts.insert(place, "call +420777123457 at noon today")
        text = " ; ".join(parts)
        found = private.all_spans(text, private.base_spans(text), weights)
        assert [text[a:b].lstrip("+") for a, b, k in found if k == 3] == ["420777123457"] * 51


def test_messages_run_until_they_stop():
    """Beliefs in a chain without certain tokens equal those of exact sums, at any distance from what tells them."""
    words = ["(555)x1"] + ["7"] * 60
    tokens = private.Tokens(" ".join(words), [])
    weights = np.zeros((private.LABELS, private._SIZE))
    weights[1, 4] = 4.0
    weights[np.arange(private.LABELS), private.FEATURES + np.arange(private.LABELS)] = 7.0
    tokens.skip = tokens.skip[:0]
    own, pair = tokens.features @ weights[:, : private.FEATURES].T, np.exp(weights[:, private.FEATURES : private.FEATURES + private.LABELS])
    want, ahead = [], np.ones(private.LABELS)
    behind = [np.ones(private.LABELS)]
    for x in np.exp(own[:0:-1]):
        behind.append(pair @ (x * behind[-1]) / (x * behind[-1]).sum())
    for x, y in zip(np.exp(own), behind[::-1], strict=True):
        p = x * ahead * y
        want.append(p / p.sum())
        ahead = pair @ (x * ahead) / (x * ahead).sum()
    assert want[-1][1] > 0.4
    assert np.abs(private.beliefs(tokens, weights) - np.array(want)).max() < 0.02


def test_fingerprints(spark):
    rows = ROWS + [(d, f"{d} {LONG[d : d + 2000]}") for d in range(50, 70)]
    got = parsing.compared_with_edits(documents_of(spark, rows)).collect()
    order = sorted(((d if d is not None else -(2**63), t or "", d) for d, t in rows), key=lambda x: x[:2])
    want = []
    for i, (_, t, d) in enumerate(order):
        changed = parsing.edited(t, order[(i + 1) % len(order)][1])
        want.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    by = {r.doc_id: r for r in got}
    assert by[5].fingerprint == by[6].fingerprint and by[5].near_next == 1.0 and by[2].fingerprint == ""
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert all(r.near_edited > 0.3 for r in got if r.doc_id and r.doc_id >= 50)
    single = {r.doc_id: r.fingerprint for r in parsing.fingerprints(documents_of(spark, rows)).collect()}
    assert all(single[d] == r.fingerprint for d, r in by.items())
    assert parsing.compared_with_edits(documents_of(spark, [])).count() == 0
    assert parsing.compared_with_edits(documents_of(spark, [(1, "alone in the table")])).first().near_next == 1.0


def test_parsing_is_locally_consistent():
    """A long common substring is cut alike in other surroundings, at any offset."""
    rng = random.Random(8)
    made = lambda n: "".join(rng.choice("abcde fgh") for _ in range(n))
    common, parser = made(3000), parsing.Parser()
    for shift in (0, 1, 7, 50):
        a, b = (set(x.tolist()) for x in parser.names([made(400) + common + made(300), made(shift) + common + made(9)])[-1])
        assert len(a & b) > 0.9 * min(len(a), len(b)) * 3000 / 3700
    runs = parser.names(["a" * 500 + "b", "a" * 501 + "b"], 1)[0]
    assert runs[0].tolist() != runs[1].tolist()


_BITS = (1 << 64) - 1


def _mixed(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _BITS
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _BITS
    return x ^ (x >> 31)


def _chained(*parts: int) -> int:
    out = 0x2545F4914F6CDD1D
    for p in parts:
        out = _mixed(((out + p) * 0x9E3779B97F4A7C15 + 1) & _BITS)
    return out


def _plain_level(symbols: list[int]) -> list[int]:
    """One level of phrases, symbol by symbol: runs, four coin tosses, local maxima, names."""
    runs: list[list[int]] = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    symbols = [s if n == 1 else _chained(s, n) for s, n in runs]
    labels = symbols
    for _ in range(4):
        tossed = []
        for i, own in enumerate(labels):
            differ = own ^ (labels[i - 1] if i else own ^ 1)
            at = (differ & -differ).bit_length() - 1
            tossed.append(2 * at + (own >> at & 1))
        labels = tossed
    phrases: list[list[int]] = []
    for i, s in enumerate(symbols):
        if i == 0 or (i < len(symbols) - 1 and labels[i - 1] < labels[i] > labels[i + 1]):
            phrases.append([])
        phrases[-1].append(s)
    return [_chained(sum(s * pow(0xD1342543DE82EF95, k, 1 << 64) for k, s in enumerate(p)) & _BITS, len(p)) for p in phrases]


def _plain_fingerprint(text: str) -> list[int]:
    symbols, found = [_mixed(ord(c) + 1) for c in text], set()
    for level in range(parsing.LEVELS if text else 0):
        symbols = _plain_level(symbols)
        found |= {_mixed(n + level & _BITS) >> 32 for n in symbols}
    return sorted(found)[: parsing.NAMES]


def test_fingerprints_equal_a_plain_parser(spark):
    rng = random.Random(4)
    texts = ["", "a", "aa", "ab", "aaaaaaaab" * 40, "é\U0001f600 x" * 9, "x" * 5000, LONG[:9000]]
    texts += ["".join(rng.choice("ab \ncde") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    want = [_plain_fingerprint(t) for t in texts]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in parsing.compared_with_edits(documents_of(spark, rows)).collect()}
    for d, t in rows:
        following = texts[(d + 1) % len(texts)]
        changed = _plain_fingerprint(parsing.edited(t, following))
        assert got[d].fingerprint == "".join(f"{x:08x}" for x in want[d])
        assert got[d].edited_fingerprint == "".join(f"{x:08x}" for x in changed)
        for other, near in ((changed, got[d].near_edited), (want[(d + 1) % len(texts)], got[d].near_next)):
            union = sorted({*want[d], *other})[: parsing.NAMES]
            common = len(set(union) & set(want[d]) & set(other))
            alike = common / len(union) if want[d] and other else float(not want[d] and not other)
            assert abs(near - alike) < 1e-12


def test_short_texts_keep_names_when_their_end_changes(spark):
    """Texts of 40 characters or more share names with their edited text."""
    rng = random.Random(9)
    words = "the river runs under old stone bridges while small boats carry grain and salt to towns".split()
    rows = [(d, " ".join(rng.choice(words) for _ in range(8 + d % 12))) for d in range(300)]
    got = parsing.compared_with_edits(documents_of(spark, [(d, t) for d, t in rows if len(t) >= 40])).collect()
    assert len(got) > 200 and all(r.near_edited > 0 for r in got)
    assert sum(r.near_edited for r in got) / len(got) > 0.4


def test_severities(spark):
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(300)]

    def text(bad: int) -> str:
        words = rng.choices(plain, k=80)
        for _ in range(bad):
            words[rng.randrange(80)] = rng.choice(["nastyA,", "Nastyb!", "vileness"])
        return " ".join(words)

    rows = [(d, text(0 if d % 4 else 1 + d // 4 % 12)) for d in range(800)]
    labels = spark.createDataFrame([(d, 0 if d % 4 else 1, 0) for d in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, text int")
    model = toxicity.learn(documents_of(spark, rows), labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.severities(documents_of(spark, rows + [(900, None), (901, "")]), model).collect()}
    unseen = range(400, 800)
    assert sum(got[d].toxic == (d % 4 == 0) for d in unseen) > 0.97 * 400
    light, heavy = ([got[d].expected_severity for d in unseen if d % 4 == 0 and d // 4 % 12 in k] for k in ((0, 1), (10, 11)))
    assert np.mean(heavy) > np.mean(light) + 0.5
    assert not got[900].toxic and not got[901].toxic
    none = toxicity.learn(documents_of(spark, rows), labels.filter("toxic = 0"))
    assert not any(r.toxic for r in toxicity.severities(documents_of(spark, rows), none).collect())
    assert toxicity.learn(documents_of(spark, []), labels.limit(0)).buckets.size == 0


def test_ordinal_fit_finds_order():
    rng = np.random.default_rng(3)
    x = rng.random(3000) * 4
    grades = np.digitize(x + rng.logistic(scale=0.15, size=3000), [1, 2, 3])
    weights, thresholds = toxicity.fit(np.arange(3000), np.zeros(3000, np.int64), x, grades, 1)
    assert np.allclose(thresholds / weights[0], [1, 2, 3], atol=0.15)


def _pipeline_rows():
    rng = random.Random(11)
    rows = []
    for d in range(40):
        lines = [" ".join(rng.choice(["plain", f"words{rng.randint(0, 99)}", f"text{rng.randint(0, 999)}"]) for _ in range(15)) + "." for _ in range(6)]
        rows.append((d, "\n".join(lines)))
    rows += [(100, JUNK), (101, None), (102, rows[0][1]), (103, rows[1][1].replace("plain", "plane", 1)), (104, rows[2][1] + "\n" + PERSONAL)]
    return rows


def test_pipeline_stages(spark):
    """Stage by stage: what goes, what stays, and what changes."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(d, t, "en", "s", len(t or "")) for d, t in _pipeline_rows()]
    docs, seen = spark.createDataFrame(rows, schema), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
            assert all(r.n_chars == len(r.text) for r in seen[name].values())
    assert set(seen["quality rules"]) == set(range(40)) | {102, 103, 104}
    assert 102 not in seen["line dedup"] and set(range(40)) <= set(seen["line dedup"])
    assert set(range(40)) <= set(seen["near dedup"])
    if 104 in seen["private data"]:
        assert "555-5986" not in seen["private data"][104].text
    assert set(seen["packing"]) == set(seen["private data"])
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "") if empty.columns[:2] == ["doc_id", "text"] else empty
        assert empty.count() == 0
