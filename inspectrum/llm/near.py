"""Near-duplicate documents by a forest of sorted MinHash orders.

A document is the set of its distinct word shingles. Documents with equal sets are one
node. Every node has one MinHash signature; each tree of the forest reads it in an
order of its own and sorts nodes by it, so nodes that share a long prefix are
neighbours. A tree is cut into regions of equal prefixes of a small depth. Inside
a region, nodes whose signatures agree in enough places are candidates. Every link is
confirmed on the full sets.

Components need few of the links. First each node meets its most similar neighbours of
each region; for that, regions with too many nodes are read deeper, so depth follows
density. Then every candidate pair whose ends are still in different components is
compared too, in regions of the small depth that hold more than one component, whatever their size: large ones are cut
into blocks, and every two blocks meet. There the nodes' own sets, or of large sets the least values, decide
which pairs leave the block at all. No candidate that could join two components is left out.

Null and wordless texts have empty sets and no links. Fewer words than a shingle has are
one shingle. Rows are judged one by one: rows that repeat a doc_id get equal results if
their texts are equal. A row without a doc_id is a node of no one: it counts its
shingles, has no component and is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectrum.llm.blocks import agreement, dealt, least_agreement, list_values, meeting, pairs_across
from inspectrum.llm.graph import components
from inspectrum.llm.text import WordHasher, chained, chunks, field_of_row, list_column, string_buffers, texts_of, whole_rows
from inspectrum.sources.workspace import discard, materialize

#: Values of a signature, trees of the forest, depth at which regions start, nodes of a region that is not read deeper.
#: A pair at 0.8 shares no region of the first depth with probability (1 - 0.8^3)^21 = 3 x 10^-7.
VALUES, TREES, DEPTH, REGION = 128, 21, 3, 512
#: Nodes of a block of a large region.
BLOCK = 1024
#: Values of a set's sketch: sets of up to so many are compared exactly where they meet.
SKETCH = 1024
#: Neighbours that each node is compared with in each region at first.
NEAREST = 3

_rng = np.random.default_rng(20)
_MULTIPLY = (_rng.integers(1, 2**32, VALUES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_FLIP = _rng.integers(0, 2**32, VALUES, dtype=np.uint64).astype(np.uint32)
#: No value: of an empty set.
_NONE = np.uint32(0xFFFFFFFF)


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    if len(hashes) >= width:
        rows = chained(*(hashes[i : len(hashes) - width + 1 + i] for i in range(width)))
    else:
        rows = np.zeros(0, np.uint64)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rows[at : at + n - width + 1]))
        elif n:
            out.append(chained(*(hashes[at + i : at + i + 1] for i in range(n))))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of MinHash values for each set."""
    out = np.full((len(sets), VALUES), _NONE, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        values = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        high, low = (values >> np.uint64(32)).astype(np.uint32), values.astype(np.uint32)
        for k in range(VALUES):
            out[full, k] = np.minimum.reduceat((high ^ _FLIP[k]) * _MULTIPLY[k] + low, starts)
    return out


def _sets_of(column: pa.Array, hasher: WordHasher, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = string_buffers(column)
    for a, b in chunks(offsets):
        yield a, b, shingle_sets(*hasher(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), width)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for a, b, sets in _sets_of(batch.column(1), hasher, width):
                n = pa.array([len(s) for s in sets], pa.int64())
                # Two sums of mixed hashes and the size name a set.
                key = [
                    pa.array([int(chained(s ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets], pa.int64())
                    for salt in (0, 0x5DEECE66D)
                ]
                sig = pa.array([r.tobytes() for r in signatures(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, *key, sig], ["doc_id", "n_shingles", "k1", "k2", "signature"])

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for a, b, sets in _sets_of(batch.column(1), hasher, width):
                values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                lists = list_column(values, np.array([len(s) for s in sets], np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["node", "shingles"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = string_buffers(column)
    return data.view(np.uint32).reshape(-1, VALUES)


def _prefixes(depth: int, trees: range | None):
    """Region names at a depth: (node, tree, region). With `trees` None the tree is in the rows."""

    def names(sig: np.ndarray, tree: np.ndarray) -> np.ndarray:
        first = tree * (VALUES // TREES)
        out = chained(tree.astype(np.uint64) + np.uint64(depth << 8))
        rows = np.arange(len(sig))
        for d in range(depth):
            out = chained(out, sig[rows, (first + d) % VALUES].astype(np.uint64))
        return out.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _matrix(batch.column(1))
            for t in trees or [None]:
                tree = np.full(len(sig), t) if t is not None else batch.column(2).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tree, pa.int32()), pa.array(names(sig, tree))], ["node", "tree", "region"])

    return run


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of regions with two nodes or more, and how many."""
    sizes = rows.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(sizes, "region")


def shallow_regions(nodes: DataFrame) -> DataFrame:
    """(region, node, tree, n) of all trees at the first depth: all pairs that can be candidates share one of them."""
    return materialize(_counted(nodes.select("node", "signature").mapInArrow(_prefixes(DEPTH, range(TREES)), "node long, tree int, region long")), "regions")


def regions(nodes: DataFrame, limit: int = REGION, shallow: DataFrame | None = None) -> DataFrame:
    """(region, node, tree, depth) of all trees: prefixes that hold at most `limit` nodes; deeper ones are twice as deep each time.

    Nodes whose whole signatures agree cannot be told apart by depth. They are dealt into
    blocks of about `limit`, and every block also holds the region's smallest node.
    """
    form = "node long, tree int, region long"
    level, depth, out = shallow_regions(nodes) if shallow is None else shallow, DEPTH, None
    while True:
        small = level.filter(F.col("n") <= limit).select("region", "node", "tree", F.lit(depth).alias("depth"))
        out = small if out is None else out.unionByName(small)
        large = level.filter(F.col("n") > limit)
        if large.isEmpty():
            return out
        if depth == VALUES:
            least = large.groupBy("region").agg(F.min("node").alias("least"))
            blocks = large.join(least, "region").withColumn("block", F.expr(f"pmod(xxhash64(node), (n + {limit} - 1) div {limit})"))
            form = [F.xxhash64("region", "block").alias("region"), "tree", F.lit(0).alias("depth")]
            return out.unionByName(blocks.select(*form, "node").unionByName(blocks.select(*form, F.col("least").alias("node"))).distinct())
        depth = min(VALUES, 2 * depth)
        deeper = large.select("node", "tree").join(nodes.select("node", "signature"), "node").select("node", "signature", "tree")
        level = materialize(_counted(deeper.mapInArrow(_prefixes(depth, None), form)), "regions")


def _met_before(sig: np.ndarray, tree: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the nodes of each pair also share a region of the first depth in an earlier tree."""
    out = np.zeros(len(x), bool)
    for t in range(tree):
        own = sig[:, (t * (VALUES // TREES) + np.arange(DEPTH)) % VALUES]
        out |= (own[x] == own[y]).all(1)
    return out


def _first_met(table: pa.Table, sig: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    tree = table["tree"].to_numpy()[x]
    out = np.ones(len(x), bool)
    for t in np.unique(tree).tolist():
        own = tree == t
        out[own] = ~_met_before(sig, t, x[own], y[own])
    return out


def _sketched(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return *list_values(table["least"]), table["size"].to_numpy()


def _candidates(least_equal: int, nearest: int):
    """Pairs inside each region, each node with those it agrees with most; rows come sorted by region."""

    def of_region(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node = table["node"].to_numpy()
        sig = _matrix(table["signature"])
        a, b = [], []
        for at in range(0, len(node), 64):
            own = slice(at, min(at + 64, len(node)))
            equal = agreement(sig[own], sig)
            equal[node[own][:, None] == node[None, :]] = -1
            best = np.argsort(-equal, axis=1, kind="stable")[:, :nearest]
            x, y = np.repeat(np.arange(len(equal)), best.shape[1]), best.ravel()
            good = equal[x, y] >= least_equal
            a.append(node[own][x[good]])
            b.append(node[y[good]])
        a, b = np.concatenate(a), np.concatenate(b)
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def pairs(table: pa.Table) -> pa.RecordBatch | None:
            region = table["region"].to_numpy()
            if not len(region):
                return None
            cuts = [0, *(np.flatnonzero(np.diff(region)) + 1).tolist(), len(region)]
            found = [of_region(table.slice(x, y - x)) for x, y in pairwise(cuts) if y - x > 1]
            if not found:
                return None
            a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            both = np.unique(np.stack([a, b], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            region = table["region"].to_numpy()
            last = int(np.searchsorted(region, region[-1])) if len(region) else 0
            if (out := pairs(table.slice(0, last))) is not None:
                yield out
            rest = table.slice(last)
        if rest is not None and (out := pairs(rest)) is not None:
            yield out

    return run


def _pairs(places: DataFrame, nodes: DataFrame, least_equal: int) -> DataFrame:
    """Each node with its most similar neighbours of each region."""
    rows = places.join(nodes.select("node", "signature"), "node")
    rows = rows.select("region", "node", "signature").repartition("region").sortWithinPartitions("region")
    return rows.mapInArrow(_candidates(least_equal, NEAREST), "a long, b long").distinct()


def _unsettled(shallow: DataFrame, labels: DataFrame, limit: int = REGION) -> DataFrame:
    """(group, node, component, tree) of the regions of the first depth that hold more than one component.

    In a region of up to `limit` nodes, one without a label has no candidate there.
    """
    labelled = shallow.join(labels, "node", "left").filter((F.col("n") > limit) | F.col("component").isNotNull())
    labelled = labelled.select(F.col("region").alias("group"), "node", F.coalesce("component", "node").alias("component"), "tree")
    mixed = labelled.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return labelled.join(mixed.select("group"), "group", "left_semi")


def _with_signatures(deals: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    rows = deals.join(nodes.select("node", "signature"), "node").select("deal", "half", "node", "component", "signature", "tree", *more)
    return rows.repartition("deal").sortWithinPartitions("deal")


def _across(deals: DataFrame, nodes: DataFrame, least_equal: int) -> DataFrame:
    """The rows of `deals` whose nodes meet a candidate of another component there."""
    met = _with_signatures(deals, nodes).mapInArrow(meeting(_matrix, least_equal, _first_met), "deal long, node long")
    return deals.join(met, ["deal", "node"], "left_semi")


def _links_across(deals: DataFrame, nodes: DataFrame, sets: DataFrame, least_equal: int, percent: int) -> DataFrame:
    """Candidate pairs across components, each in the first tree in which they meet, that are similar by their sketches.

    A sketch is sent once for a node and deal, not for a pair, and only true links and a few more leave the deal.
    """
    sketches = sets.select("node", F.slice("shingles", 1, SKETCH).alias("least"), F.size("shingles").alias("size")).dropDuplicates(["node"])
    rows = _with_signatures(deals.join(sketches, "node"), nodes, "least", "size")
    return rows.mapInArrow(pairs_across(_matrix, least_equal, percent / 100, _sketched, _first_met), "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("common")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", common.alias("common"))
    return joined.filter(100 * F.col("common").cast("long") >= percent * union).select("a", "b").distinct()


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): sets of `width` words, links at `percent` of the union."""
    texts = texts_of(df, id_col, text_col)
    base = materialize(texts.mapInArrow(_sketch(width), "doc_id long, n_shingles long, k1 long, k2 long, signature binary"), "sketches")
    keyed = base.filter("n_shingles > 0 and doc_id is not null")
    # Equal sets have equal signatures, so any of them is the node's.
    nodes = materialize(keyed.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")), "nodes")
    least_equal = least_agreement(VALUES, percent / 100)
    shallow = shallow_regions(nodes)
    places = materialize(regions(nodes, shallow=shallow), "places")

    def ends_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def sets_of(ends: DataFrame) -> DataFrame:
        named = texts.join(ends, texts["doc_id"] == ends["node"], "left_semi")
        return materialize(named.mapInArrow(_full_sets(width), "node long, shingles array<long>"), "sets")

    first = materialize(_pairs(places, nodes, least_equal), "pairs")
    ends = materialize(ends_of(first), "ends")
    sets = sets_of(ends)
    links = materialize(_confirmed(first, sets, percent), "links")
    labels = components(links)
    labelled = materialize(ends.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels")
    deals = materialize(dealt(_unsettled(shallow, labelled), BLOCK), "deals")
    across = materialize(_across(deals, nodes, least_equal), "across")
    late = sets_of(across.select("node").distinct().join(ends, "node", "left_anti"))
    known = sets.unionByName(late)
    more = materialize(_confirmed(_links_across(across, nodes, known, least_equal, percent), known, percent), "links")
    found = components(links.unionByName(more))
    named = nodes.join(found, "node", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "node").alias("component"))
    joined = base.drop("signature").join(named, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    result = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    out = materialize(result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near")
    discard(base, nodes, shallow, places, first, ends, sets, links, labelled, deals, across, late, more)
    return out


def without_near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with one document of each group of near duplicates, the one of the smallest id; of rows that repeat it, one.

    Rows without an id stay.
    """
    judged = near_duplicates(df, width, percent, id_col, text_col).filter("doc_id is not null")
    flags = judged.groupBy(F.col("doc_id").alias("id")).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("rows"))
    rows = whole_rows(df).withColumn("id", field_of_row(id_col).cast("long"))
    joined = rows.join(flags.filter("kept"), "id")
    # Rows of one id differ only if their texts do.
    again = F.when(F.col("rows") > 1, F.xxhash64(field_of_row(text_col))).otherwise(0)
    alone = joined.withColumn("again", again).dropDuplicates(["id", "again"]).select("row.*")
    return alone.unionByName(rows.filter("id is null").select("row.*"))
