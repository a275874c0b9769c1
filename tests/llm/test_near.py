"""Near duplicates, fuzzy lines and components against brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectrum.llm import blocks, graph, lines, near

from .cases import documents_of


class _Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)] + [(5, 5)]
    want = _Union()
    for a, b in edges:
        if a != b:
            want.join(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert got == {x: want.find(x) for x in list(want)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _words(text: str, width: int) -> frozenset:
    w = text.translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})).split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def _brute(texts: dict, width: int, percent: int) -> dict:
    sets, union = {d: _words(t or "", width) for d, t in texts.items()}, _Union()
    for d in texts:
        union.find(d)
    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            union.join(a, b)
    return {d: (len(sets[d]), union.find(d)) for d in texts}


def _variants(n_groups: int, seed: int) -> dict:
    """Groups of copies with edits around the threshold, singles, and a passage that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    shared = rng.choices(vocabulary, k=30)
    texts, d = {}, 0
    for g in range(n_groups):
        base = rng.choices(vocabulary, k=rng.choice([8, 40, 120]))
        for _ in range(rng.choice([1, 1, 2, 5, 30 if g % 10 == 0 else 2])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[d] = " ".join(copy + (shared if g % 3 == 0 else [])).capitalize()
            d += 1
    return texts


def test_near_duplicates_equal_brute_force(spark):
    for width, percent, seed in ((3, 85, 1), (5, 80, 2)):
        texts = _variants(60, seed)
        rows = near.near_duplicates(documents_of(spark, list(texts.items())), width, percent).collect()
        want = _brute(texts, width, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_dense_group_is_read_deeper(spark):
    """Regions of few nodes: depth, blocks of equal signatures and pairs across components all come in."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for d in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(400)] = f"x{d}"
        rows.append((d, " ".join(copy)))
    want = _brute(dict(rows), 3, 85)
    nodes = documents_of(spark, rows).select("doc_id", "text").mapInArrow(near._sketch(3), "node long, n long, k1 long, k2 long, signature binary")
    found = near.regions(nodes, limit=20)
    assert found.groupBy("region").count().agg(F.max("count")).first()[0] <= 40
    got = near.near_duplicates(documents_of(spark, rows), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_edges(spark):
    rows = near.near_duplicates(documents_of(spark)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 11 and by[2].n_shingles == by[3].n_shingles == by[8].n_shingles == 0
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept
    assert by[None].component_id is None and by[None].kept and by[9].n_shingles == 1
    assert near.near_duplicates(documents_of(spark, [])).count() == 0
    kept = near.without_near_duplicates(documents_of(spark))
    assert kept.columns == documents_of(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]


def test_signature_estimates(spark):
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 2000).astype(np.uint64))
    sig = near.signatures([a, a[: len(a) // 2]])
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.15


def _line_brute(texts: dict) -> dict:
    own = {(d, i): x.lower().strip(lines.SPACES) for d, t in texts.items() for i, x in enumerate((t or "").split("\n"))}
    own = {k: x for k, x in own.items() if len(x) >= lines.LEAST_CHARS}
    sets, union = {k: lines.shingles(x) for k, x in own.items()}, _Union()
    for a, b in combinations(sorted(own), 2):
        common = len(sets[a] & sets[b])
        if common >= lines.SIMILAR * (len(sets[a]) + len(sets[b]) - common):
            union.join(a, b)
    return {k: union.find(k) for k in own}


def test_similar_lines_equal_brute_force(spark):
    rng = random.Random(3)
    letters = "abcdefghij klmnop"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randint(30, 200))) for _ in range(40)]
    texts = {}
    for d in range(60):
        made = []
        for b in rng.sample(bases, 5):
            x = list(b)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.choice(letters)
            made.append("".join(x).upper() if rng.random() < 0.3 else "".join(x))
        texts[d] = "\n".join(made)
    want = _line_brute(texts)
    rows = lines.similar_lines(documents_of(spark, list(texts.items()))).collect()
    assert {(r.doc_id, r.line): (r.first_doc_id, r.first_line) for r in rows} == want
    assert all(r.kept == (want[(r.doc_id, r.line)] == (r.doc_id, r.line)) for r in rows)
    clean = {r.doc_id: r.text for r in lines.without_similar_lines(documents_of(spark, list(texts.items()))).collect()}
    for d, t in texts.items():
        rest = "\n".join(x for i, x in enumerate(t.split("\n")) if want.get((d, i), (d, i)) == (d, i))
        assert clean.get(d, "") == rest


def test_lines_edges(spark):
    df = documents_of(spark)
    out = lines.without_similar_lines(df)
    assert out.columns == df.columns
    texts = [(r.doc_id, r.text) for r in out.collect()]
    assert (6, "same text in two documents, which are equal in every word of it") not in texts
    assert (3, None) in texts and (2, "") in texts and len(texts) == 10
    assert lines.similar_lines(documents_of(spark, [])).count() == 0


def test_lines_meet_in_their_first_band():
    """Two lines that share many bands are compared in one of them alone, and blocks of few lines in the first pass alone."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(40)]
    text = " ".join(words)
    texts = [text, text + "x", text[:-1], " ".join(words[:36] + ["changed"] + words[37:])]
    nodes = pa.array(range(len(texts)), pa.int64())
    (signed,) = lines._signed(iter([pa.RecordBatch.from_arrays([nodes, pa.array(texts)], ["node", "text"])]))
    full = lines._bands_of(lines.signatures(texts))
    assert (full & np.uint64(31)).tolist() == [list(range(lines.BANDS))] * len(texts)
    for x in range(len(texts)):
        for y in range(x):
            shared = np.flatnonzero(full[x] == full[y]).tolist()
            assert len(shared) > 1
            rows = signed.take(pa.array([x, y] * len(shared)))
            n, twice = len(rows), np.repeat(shared, 2)
            columns = [pa.array(twice * 100), pa.array([2] * n, pa.int32()), rows["node"], rows["node"], pa.array(twice, pa.int32()), rows["signature"], rows["bands"]]
            dealt = pa.RecordBatch.from_arrays(columns, ["deal", "half", "node", "component", "number", "signature", "bands"])
            met = pa.Table.from_batches(list(blocks.meeting(lines._short_signatures, 30, lines._first_met)(iter([dealt]))))
            assert sorted(met.to_pylist(), key=str) == sorted(({"deal": shared[0] * 100, "node": i} for i in (x, y)), key=str)
    sizes = {1: 2, 2: 4, 3: 5, 33: 30}
    rows = sorted((band, n) for band, size in sizes.items() for n in range(size))
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["band", "node"])
    named = pa.Table.from_batches(list(lines._blocks(iter([batch]), named=True)))
    of = {}
    for block in named["block"].to_pylist():
        of[block] = of.get(block, 0) + 1
    assert sorted((n, block & 31, bool(block & 32)) for block, n in of.items()) == [(2, 1, False), (4, 2, False), (5, 3, True), (30, 1, True)]


def test_only_lines_with_repeated_bands_are_sent(tmp_path, monkeypatch):
    """A band is sent on if two different lines have it, in one task or in two; a repeated line alone is none."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(lines, "MARKS", 50)
    rng = random.Random(13)
    texts = ["".join(rng.choices("abcdefghij ", k=80)) for _ in range(30)]
    pairs = [t + "x" for t in texts[:3]]
    tasks = [[*zip(range(30), texts, strict=True), (100, pairs[0])], [(101, pairs[1]), (102, pairs[2]), *zip(range(20, 30), texts[20:], strict=True)]]
    batches = [[pa.RecordBatch.from_arrays([pa.array([n]), pa.array([t])], ["node", "text"]) for n, t in rows] for rows in tasks]
    sent = pa.concat_tables([pa.Table.from_batches(lines._marks(4)(iter(b))) for b in batches]).sort_by("shard").combine_chunks()
    sizes = dict(zip(*pa.Table.from_batches(lines._write_repeated(str(tmp_path))(iter(sent.to_batches()))).to_pydict().values(), strict=True))
    repeated = lines.Words(str(tmp_path), [sizes.get(i, 0) for i in range(4)], sum(sizes.values()), 0)
    found = pa.Table.from_batches([b for t in batches for b in lines._bands(repeated)(iter(t))])
    named = {n: set(lines._bands_of(lines.signatures([t]))[0].view(np.int64).tolist()) for rows in tasks for n, t in rows}
    shared = {(band, n) for i in range(3) for n in (i, 100 + i) for band in named[i] & named[100 + i]}
    assert shared and set(zip(found["band"].to_pylist(), found["node"].to_pylist(), strict=True)) == shared
    short = lines._short_signatures(found["signature"])
    assert short.shape == (len(found), lines.BINS) and short.max() < 16


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    from inspectrum.sources import workspace

    seen, write = [], workspace.materialize

    def noted(df, name):
        seen.append(spark.conf.get(workspace._CLEANUP))
        return write(df, name)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lines, "materialize", noted)
        lines.similar_lines(documents_of(spark, [(1, "one line of text\none line of text")])).collect()
    assert set(seen) == {"true"} and spark.conf.get(workspace._CLEANUP, "false") == "false"


def test_blocks_of_streamed_bands(monkeypatch):
    """Every pair of a band meets in a block or through its least node, however batches cut the rows."""
    import pyarrow as pa

    monkeypatch.setattr(lines, "BLOCK", 4)
    rng = random.Random(9)
    rows = sorted({(band, rng.randint(0, 10**6)) for band in range(60) for _ in range(rng.choice([1, 2, 3, 5, 9, 30]))})
    rows = sorted(rows + rows[::7])
    for step in (1, 3, 10, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[a : a + step]], pa.int64()) for i in (0, 1)], ["band", "node"]) for a in range(0, len(rows), step)]
        blocks: dict = {}
        for b in lines._blocks(iter(batches)):
            for block, node in zip(*(c.to_pylist() for c in b.columns), strict=True):
                blocks.setdefault(block, []).append(node)
        union = _Union()
        for nodes in blocks.values():
            assert len(nodes) <= 5
            for n in nodes:
                union.join(n, nodes[0])
        for band in range(60):
            nodes = {n for x, n in rows if x == band}
            if len(nodes) > 1:
                assert len({union.find(n) for n in nodes}) == 1
        assert len(set(n for ns in blocks.values() for n in ns)) == sum(len(s) for s in ({n for x, n in rows if x == b} for b in range(60)) if len(s) > 1)


def _line_components(texts: list[str]) -> dict:
    """The first line of each group of a text of distinct lines, from the counts of common shingles."""
    sets = [lines.shingles(x) for x in texts]
    number = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        has[i, [number[x] for x in s]] = 1
    common, n = has @ has.T, has.sum(1)
    union = _Union()
    for i, j in zip(*np.nonzero(common >= lines.SIMILAR * (n[:, None] + n[None, :] - common) - 1e-3), strict=True):
        union.join(int(i), int(j))
    return {i: union.find(i) for i in range(len(texts))}


def test_lines_of_a_large_band_all_meet(spark):
    """More lines of one template than a block holds: pairs above the threshold, the others below it."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = [rng.choice(letters) for _ in range(200)]

    def edited(text: list, n: int) -> list:
        out = list(text)
        for k in rng.sample(range(10, 190), n):
            out[k] = rng.choice("0123456789")
        return out

    texts = []
    for _ in range(800):
        own = edited(base, 3)
        texts += ["".join(own), "".join(edited(own, 2))]
    texts = list(dict.fromkeys(texts))
    rng.shuffle(texts)
    rows = lines.similar_lines(documents_of(spark, [(1, "\n".join(texts))])).collect()
    want = _line_components(texts)
    assert len(set(want.values())) > 100
    assert {r.line: r.first_line for r in rows} == want


def test_pairs_of_blocks(spark):
    """Each pair across components meets under one key, whatever the sizes of blocks and components."""
    rng = random.Random(6)
    rows = [(g, g * 1000 + k, (g * 1000 + k) if rng.random() < share else g * 1000, b"") for g, (n, share) in enumerate([(40, 0.1), (60, 0.9), (30, 0), (5, 1), (1, 1)]) for k in range(n)]
    got = blocks.dealt(spark.createDataFrame(rows, "group long, node long, component long, signature binary"), 7).collect()
    met: dict = {}
    for r in got:
        met.setdefault(r.deal, []).append(r)
    pairs = []
    for deal in met.values():
        assert len(deal) < 60 and len({r.group for r in deal}) == 1
        pairs += [(min(a.node, b.node), max(a.node, b.node)) for a, b in combinations(deal, 2) if a.component != b.component and (a.half == 2 or a.half != b.half)]
    want = [(a[1], b[1]) for a, b in combinations(rows, 2) if a[0] == b[0] and a[2] != b[2]]
    assert sorted(pairs) == sorted(want)


def test_family_just_below_the_threshold(spark):
    """More documents of one template than a region holds: planted pairs above the threshold, all others below it."""
    rng = np.random.default_rng(12)
    base = [f"b{i}" for i in range(400)]
    texts, n = [], 0
    for _ in range(900):
        own = list(base)
        for k in rng.choice(400, 12, replace=False):
            own[k] = f"x{(n := n + 1)}"
        twin = list(own)
        for k in rng.choice(400, 8, replace=False):
            twin[k] = f"x{(n := n + 1)}"
        texts += [" ".join(own), " ".join(twin)]
    order = rng.permutation(len(texts))
    rows = [(int(d), texts[i]) for d, i in enumerate(order)]
    sets = [_words(t, 3) for _, t in rows]
    number = {s: i for i, s in enumerate(set().union(*sets))}
    has = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        has[i, [number[x] for x in s]] = 1
    common, size = has @ has.T, has.sum(1)
    union = _Union()
    for i, j in zip(*np.nonzero(100 * common >= 85 * (size[:, None] + size[None, :] - common)), strict=True):
        union.join(int(i), int(j))
    want = {i: union.find(i) for i in range(len(rows))}
    assert len(set(want.values())) > 300
    nodes = documents_of(spark, rows).select("doc_id", "text").mapInArrow(near._sketch(3), "node long, n long, k1 long, k2 long, signature binary")
    assert near.regions(nodes).agg(F.max("depth")).first()[0] > near.DEPTH
    assert {r.doc_id: r.component_id for r in near.near_duplicates(documents_of(spark, rows), 3, 85).collect()} == want


def test_short_lines_equal_brute_force(spark):
    """Lines shorter than a shingle, of a few shingles and of up to 40 characters, equal and with an edit at an end."""
    rng = random.Random(21)
    bases = ["}", "Yes", "menu", "*" * 6, "Contact", "ab" * 5, "All rights reserved."]
    bases += ["".join(rng.choice("abcdefgh ijk") for _ in range(rng.randint(8, 39))) for _ in range(60)]
    texts = {}
    for d in range(40):
        made = []
        for x in rng.sample(bases, 12):
            made.append(rng.choice([x, x, x.upper(), x + rng.choice("xyz"), rng.choice("xyz") + x, "  " + x, ""]))
        texts[d] = "\n".join(made)
    want = _line_brute(texts)
    assert {(d, i) for d, t in texts.items() for i, x in enumerate(t.split("\n")) if x.strip()} == set(want)
    rows = lines.similar_lines(documents_of(spark, list(texts.items()))).collect()
    assert {(r.doc_id, r.line): (r.first_doc_id, r.first_line) for r in rows} == want


def test_line_signatures_recall():
    """Pairs at 0.8 of few and of many shingles share a band and agree in enough bins."""
    rng = random.Random(1)
    cut, letters = blocks.least_agreement(lines.BINS, 0.8), "abcdefghijklmnopqrstuvwxyz"
    for common in (4, 8, 32, 120):
        pairs = []
        for _ in range(5000):
            core = "".join(rng.choices(letters, k=common + lines.SHINGLE - 1))
            more = rng.choices(letters, k=common // 4)
            pairs.append(("".join(more[: common // 8]) + core, core + "".join(more[common // 8 :])))
        equal = lines.signatures([a for a, _ in pairs]) == lines.signatures([b for _, b in pairs])
        bands = equal[:, : lines.BANDS * lines.ROWS].reshape(len(pairs), lines.BANDS, lines.ROWS).all(2).any(1)
        assert bands.all() and (equal.sum(1) >= cut).all(), common


def test_least_agreement():
    for places in (64, 128):
        for share in (0.8, 0.85):
            k = blocks.least_agreement(places, share)
            below = [sum(math.comb(places, i) * share**i * (1 - share) ** (places - i) for i in range(n)) for n in (k, k + 1)]
            assert below[0] <= 1e-7 < below[1]
