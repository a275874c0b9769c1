"""Spelling variants, shards and the manifest against brute force, and against their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import rows_of
from inspectrum.llm import lines, manifest, near, private, quality, sharding, spelling

from .cases import ROWS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, `range` int, n long, word string, place int, digest string, size int"


def _documents(spark, rows):
    """Whole documents and columns whose names the operators use inside."""
    langs, extra = ["en", None, "de", "é"], ("x", 1, 2, "w", 3, "d", 4)
    data = [(d, t, langs[(d or 0) % 4], None if d == 5 else "s", None if t is None else len(t), *extra) for d, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def _words(rng, n):
    out = []
    for _ in range(n):
        w = "".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(6, 11)))
        i = rng.randrange(len(w))
        out += rng.choices([w, w[:i] + w[i + 1 :], w[:i] + "a" + w[i:], w[:i] + "b" + w[i + 1 :]], k=rng.randint(1, 4)) + [w] * rng.choice([0, 1, 30])
    return out


def _rows():
    rng = random.Random(5)
    texts = [" ".join(rng.sample(x, len(x))) for x in (_words(rng, 40) for _ in range(12))]
    return ROWS + [(20 + i, t) for i, t in enumerate(texts)] + [(40, "Repeated REPEATED rEpEaTeD\x00Repeated×repeated"), (41, None), (5, "second row of id five")]


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _variants(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: sorted((-words[v], v) for v in words if v != w and _near(w, v)) for w in words}
    form = {w: v[0][1] for w, v in near.items() if v and -v[0][0] >= 10 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return Counter(out)


def _oracle(sql, frame):
    con = duckdb.connect()
    con.register("documents", frame)
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), rows_of(columns, cur.fetchall())


def _pandas(rows, df):
    return pd.DataFrame([tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()], columns=["doc_id", "text", "lang", "source", "n_chars"]).astype(
        {"doc_id": "Int64", "n_chars": "Int64"}
    )


def test_variants_equal_brute_force_and_sql(spark):
    rows = _rows()
    docs = _documents(spark, rows)
    got = spelling.variants(spelling.altered_words(docs))
    mine = Counter(map(tuple, got.collect()))
    want = _variants(rows)
    assert mine == want and any(r[1] for r in want)
    assert _oracle(spelling.ORACLE, _pandas(rows, docs)) == (sorted(got.columns), rows_of(got.columns, mine.elements()))


def test_variants_of_nothing_and_of_ties(spark):
    assert spelling.variants(spelling.altered_words(_documents(spark, []))).count() == 0
    words = {"baaaaaa": 50, "aaaaaab": 50, "aaaaaaa": 5, "aaaaaaaa": 50, "zzzzzzz": 2, "abababa": 700, "abababb": 70, "ababbbb": 7}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: r for r in spelling.variants(frame).collect()}
    # Of equal counts the smallest word; a chain ends at its last form.
    assert got["aaaaaaa"].form == "aaaaaaaa" and got["aaaaaaa"].n_near == 3
    assert (got["abababb"].form, got["ababbbb"].form, got["ababbbb"].root) == ("abababa", "abababb", "abababa")
    assert got["zzzzzzz"].root == "zzzzzzz" and got["zzzzzzz"].n_near == 0


def test_merged_lists_find_every_pair_once():
    """Whatever the dictionary, words of one list and their bounds lose no pair and count none twice."""
    rng = random.Random(3)
    for turn in range(24):
        words = {w for w in _words(rng, 40) if len(w) >= 7}
        grams = sorted({w[p : p + 3] for w in words for p in range(len(w) - 2)})
        cut = spelling.Decomposer({g for g in grams if rng.random() < turn % 5 / 4})
        lists, found = defaultdict(list), Counter()
        for w in words:
            assert "".join(w[a:b] for a, b in cut.grams(w)) and all(a > 0 or b < len(w) for a, b in cut.lists(w))
            for (a, b), span in cut.lists(w).items():
                lists[w[:a], w[b:]].append((w[a:b], 2, *span))
        for (head, tail), members in lists.items():
            found.update({w: x[0] for w, x in spelling.near_in_list(head, tail, members).items()})
        assert {w: found[w] for w in words} == {w: sum(_near(w, v) for v in words if v != w) for w in words}


def _shards(rows, n=40):
    keyed = sorted(
        (int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), d is not None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows
    )
    total, upto, slots, out = sum(k[3] for k in keyed), 0, Counter(), []
    for _, known, d, size, crc in keyed:
        shard = min(n - 1, (2 * upto + size) * n // (2 * total))
        out.append((d if known else None, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        upto += size
    return Counter(out)


@pytest.mark.parametrize("ranges, sampled", [(1024, 32), (7, 2), (1, 1)])
def test_shards_do_not_depend_on_the_sample(spark, ranges, sampled):
    rows = _rows() + [(100 + i, "one text of a third of all rows") for i in range(40)] + [(7, "a repeated row")] * 20
    docs = _documents(spark, rows)
    got = sharding.shards_of(docs, ranges=ranges, sampled=sampled)
    mine = Counter(map(tuple, got.collect()))
    assert mine == _shards(rows)
    if ranges == 1024:
        assert _oracle(sharding.ORACLE, _pandas(rows, docs)) == (sorted(got.columns), rows_of(got.columns, mine.elements()))
        assert "Python" not in got._jdf.queryExecution().toString()


def test_shards_are_near_equal_and_gapless(spark):
    rows = [(i, "x" * (i * 37 % 300)) for i in range(4000)]
    got = sharding.shards_of(_documents(spark, rows)).collect()
    sizes, slots = Counter(), defaultdict(set)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].add(r.slot)
    assert sorted(sizes) == list(range(40)) and max(sizes.values()) - min(sizes.values()) <= 2 * 316
    assert all(s == set(range(len(s))) for s in slots.values())
    assert sharding.shards_of(_documents(spark, [])).count() == 0


def test_ranges_of_a_repeated_key_are_cut(spark):
    """Half of the rows are one row: its copies are dealt over many ranges."""
    rows = [(1, "same")] * 3000 + [(i, f"text {i}") for i in range(3000)]
    keys = sharding.keyed(_documents(spark, rows)).cache()
    bounds = sharding.splitters(keys, 50, 32)
    dealt = keys.withColumn("key", sharding._key()).groupBy(sharding.range_of(bounds).alias("r")).agg(F.count("*").alias("n")).collect()
    assert len(dealt) > 40 and max(r.n for r in dealt) < 600


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, add=0):
    def part(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    d, text, lang, source, n = row
    return _hash(*map(part, (d, source, lang, None if n is None else n + add, text)))


def _proofs(nodes):
    """Root, and for each node its steps (side of the sibling, sibling)."""
    level, members, steps = list(nodes), [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(level) > 1:
        for i in range(0, len(level) - 1, 2):
            for m in members[i]:
                steps[m].append((1, level[i + 1]))
            for m in members[i + 1]:
                steps[m].append((0, level[i]))
        if len(level) % 2:
            for m in members[-1]:
                steps[m].append((2, ""))
        members = [sum(members[i : i + 2], []) for i in range(0, len(level), 2)]
        level = [_hash(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], steps


def _manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[lang] = _proofs([_leaf(r) for r in by[lang]])
    root, outer = _proofs([trees[x][0] for x in langs])
    out = []
    for lang, above in zip(langs, outer):
        for r, own in zip(by[lang], trees[lang][1]):
            path = own + above
            value = _leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for side, sibling in path:
                value = _hash(sibling, value) if side == 0 else _hash(value, sibling)
            out.append((r[0], _leaf(r), trees[lang][0], root, _hash(*(s for _, s in path)), value, value == root))
    return Counter(out)


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest_equals_brute_force(spark, levels):
    """Blocks of two leaves, of eight and of a thousand give the same trees."""
    rows = _rows() + [(200 + i, f"text {i}") for i in range(60)]
    docs = _documents(spark, rows)
    got = manifest.manifest(docs, levels)
    mine = Counter(map(tuple, got.collect()))
    assert mine == _manifest([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert {r[-1] for r in mine} == {True, False}
    if levels == 10:
        assert _oracle(manifest.ORACLE, _pandas(rows, docs)) == (sorted(got.columns), rows_of(got.columns, mine.elements()))


def test_manifest_of_nothing_and_of_one_row(spark):
    assert manifest.manifest(_documents(spark, [])).count() == 0
    one = manifest.manifest(_documents(spark, [(3, "x")])).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == _hash() and one.verified


def test_open_tree_extends_witnesses():
    """After every append the witness of each leaf leads to the root of its open subtree."""
    tree, nodes = manifest.OpenTree(64, 6), [hashlib.sha256(bytes([i])).digest() for i in range(37)]
    for i, node in enumerate(nodes):
        tree.append(node)
        for height, a, b, digest in tree._open:
            for j in range(a, b):
                steps, siblings = tree._steps[j, :height].tobytes(), tree._siblings[j, :height].tobytes()
                assert manifest.folded(nodes[j], steps, siblings) == digest
    root = tree.close(6)
    steps, siblings = (x.to_pylist() for x in tree.witnesses())
    assert all(manifest.folded(n, s, p) == root for n, s, p in zip(nodes, steps, siblings))


CLASHING = "__t __w __l __g __c __v __p __quality __n_words __id __kept __rows __again __drop id kept rows again gone row n votes key text_ deal node".split()


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like helpers come through the stages that drop rows or change texts."""
    text = " ".join(f"Word{i} of{i} this{i} page{i} reads{i} well{i}." for i in range(12))
    rows = [(1, text, 7), (2, text + " End here.", 8), (3, "other lines\nother lines\n" + text.replace("page", "leaf"), 9), (None, text, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int").withColumns({c: F.concat(F.lit(f"{c}-"), F.col("mark")) for c in CLASHING})
    for stage in (quality.keep_good, near.without_near_duplicates, lines.without_similar_lines, private.masked):
        out = stage(df)
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}-{r['mark']}" for r in got for c in CLASHING)
