"""All pairs of large groups, compared block by block over tasks.

A group is too large for one task when it holds many nodes. Its nodes are dealt into
blocks, and every two blocks meet under a key of their own, so each pair of nodes is
compared in exactly one place. Only pairs across components matter: a group that is one
component is left out, and blocks of its largest component do not meet each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes of a block.
BLOCK = 2048


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places each row of `a` agrees with each row of `b`."""
    if len(a) * len(b) <= 20_000:
        return (a[:, None, :] == b[None, :, :]).sum(2, dtype=np.int16)
    equal = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        equal += a[:, k][:, None] == b[:, k][None, :]
    return equal


def least_agreement(places: int, share: float, miss: float = 1e-7) -> int:
    """In how many of `places` a pair agrees at least, but for a chance of `miss`, if it agrees in each with probability `share`."""
    below = 0.0
    for k in range(places):
        below += math.comb(places, k) * share**k * (1 - share) ** (places - k)
        if below > miss:
            return k
    return places


def dealt(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """`rows` (group, node, component, ...) with `deal` and `half`, once for each two blocks that meet.

    Rows of half 0 meet those of half 1; rows of half 2 meet each other. No row may repeat.
    """
    sizes = rows.groupBy("group", "component").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("group").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("parts"))
    counts = [F.expr(f"({n} + {block} - 1) div {block}").alias(a) for n, a in (("top.c", "n_main"), ("(n - top.c)", "n_rest"))]
    groups = sizes.filter("parts > 1").select("group", F.col("top.component").alias("main"), *counts)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("component") == F.col("main"), F.col("n_main")).otherwise(F.col("n_rest")))
    main = "transform(sequence(0L, n_rest - 1), j -> struct(0 as kind, own as i, j as j, 0 as half))"
    to_main = "transform(sequence(0L, n_main - 1), i -> struct(0 as kind, i as i, own as j, 1 as half))"
    to_rest = "transform(sequence(0L, n_rest - 1), k -> struct(1 as kind, least(own, k) as i, greatest(own, k) as j, CASE WHEN own < k THEN 0 WHEN own > k THEN 1 ELSE 2 END as half))"
    meets = F.expr(f"explode(if(component = main, {main}, concat({to_main}, {to_rest})))")
    out = rows.join(groups, "group").withColumn("own", own).select(*rows.columns, meets.alias("meet"))
    return out.select(F.xxhash64("group", "meet.kind", "meet.i", "meet.j").alias("deal"), F.col("meet.half").alias("half"), *rows.columns)


def list_values(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column in order, and where each list starts in them (one more offset than lists)."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].view(np.uint64), ends - ends[0]


class Sketches:
    """The least `most` values of each node's set, in order, and the sizes of the sets: exact for sets of up to that many values."""

    def __init__(self, values: np.ndarray, ends: np.ndarray, sizes: np.ndarray, share: float) -> None:
        self._values, self._ends, self._share = values, ends.astype(np.int64), share
        _, self._names = np.unique(self._values, return_inverse=True)
        self._mark = np.zeros(self._names.max(initial=-1) + 1, bool)
        self.whole = np.diff(self._ends) == sizes

    def _own(self, i: int) -> slice:
        return slice(self._ends[i], self._ends[i + 1])

    def alike(self, x: int, others: np.ndarray) -> np.ndarray:
        """Which of the others' sets may be as similar to that of `x` as the share asks; certain where all are whole."""
        known, whole = np.diff(self._ends), self.whole
        self._mark[self._names[self._own(x)]] = True
        lengths = known[others]
        starts = np.cumsum(lengths) - lengths
        places = np.repeat(self._ends[others] - starts, lengths) + np.arange(lengths.sum())
        common = np.add.reduceat(self._mark[self._names[places]].astype(np.int64), starts) if len(places) else np.zeros(len(others), np.int64)
        self._mark[self._names[self._own(x)]] = False
        good = common >= self._share * (known[x] + lengths - common) - 1e-9
        for j in np.flatnonzero(~(whole[others] & whole[x])):
            good[j] = self._sampled(x, others[j], whole)
        return good

    def _sampled(self, x: int, y: int, whole: np.ndarray) -> bool:
        """Both sets up to the least value from which one of them is not known; a chance of 10^-7 to miss."""
        a, b = self._values[self._own(x)], self._values[self._own(y)]
        last = min(v[-1] for v, i in ((a, x), (b, y)) if not whole[i])
        a, b = a[: np.searchsorted(a, last, "right")], b[: np.searchsorted(b, last, "right")]
        common = len(np.intersect1d(a, b, assume_unique=True))
        union = len(a) + len(b) - common
        return common >= self._share * union - 5.3 * math.sqrt(union * self._share * (1 - self._share)) - 1


#: Deals of up to so many rows are compared together, in tables of at most so many rows.
SMALL, TOGETHER = 4, 2000


def _deals(of_deals: Callable[[pa.Table, bool], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by `deal`: each larger deal by itself, and many small ones whose rows all meet each other at once."""

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        deal = table["deal"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(deal)) + 1, [len(deal)]])
        sizes = np.diff(cuts)
        few = np.repeat(sizes <= SMALL, sizes) & (table["half"].to_numpy() == 2)
        whole = np.logical_and.reduceat(few, cuts[:-1])
        for i in np.flatnonzero(~whole).tolist():
            yield from of_deals(table.slice(cuts[i], sizes[i]), False)
        small = table.filter(pa.array(np.repeat(whole, sizes)))
        deal = small["deal"].to_numpy()
        first = 0
        while first < len(deal):
            last = min(first + TOGETHER, len(deal))
            while last < len(deal) and deal[last] == deal[last - 1]:
                last += 1
            yield from of_deals(small.slice(first, last - first), True)
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            deal = table["deal"].to_numpy()
            last = len(deal) - int(np.argmax(deal[::-1] != deal[-1])) if (deal != deal[-1]).any() else 0
            if last:
                yield from out(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None:
            yield from out(rest)

    return run


def _hits(table: pa.Table, small: bool, matrix: Callable, least: int, new: Callable | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one deal, or of the same ones of many small deals, whose nodes agree in `least` places, across components."""
    node, component, half = (table[c].to_numpy() for c in ("node", "component", "half"))
    sig = matrix(table["signature"])
    if small:
        deal = table["deal"].to_numpy()
        for step in range(1, min(SMALL, len(deal))):
            x = np.flatnonzero((deal[step:] == deal[:-step]) & (component[step:] != component[:-step]))
            x = x[(sig[x] == sig[x + step]).sum(1) >= least]
            if new is not None and len(x):
                x = x[new(table, sig, x, x + step)]
            if len(x):
                yield x, x + step
        return
    left, right = np.flatnonzero(half != 1), np.flatnonzero(half != 0)
    other = sig[right]
    for at in range(0, len(left), 64):
        own = left[at : at + 64]
        equal = agreement(sig[own], other)
        equal[component[own][:, None] == component[right][None, :]] = -1
        x, y = np.nonzero(equal >= least)
        x, y = own[x], right[y]
        if new is not None and len(x):
            good = new(table, sig, x, y)
            x, y = x[good], y[good]
        if len(x):
            yield x, y


def meeting(matrix: Callable[[pa.ChunkedArray], np.ndarray], least: int, new: Callable | None = None):
    """(deal, node) of nodes that agree in `least` places with one of another component, in each deal: no pairs."""

    def of_deals(table: pa.Table, small: bool) -> Iterator[pa.RecordBatch]:
        met = np.zeros(table.num_rows, bool)
        for x, y in _hits(table, small, matrix, least, new):
            met[x] = met[y] = True
        if met.any():
            found = np.unique(np.stack([table["deal"].to_numpy()[met], table["node"].to_numpy()[met]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, i].copy()) for i in (0, 1)], ["deal", "node"])

    return _deals(of_deals)


def pairs_across(matrix: Callable[[pa.ChunkedArray], np.ndarray], least: int, share: float, sketched: Callable[[pa.Table], tuple], new: Callable | None = None):
    """Pairs (a, b) that agree in `least` places and whose sets are as similar as `share` by their sketches, of rows sorted by `deal`.

    Of the pairs that certainly join the same components in a deal one is given, fewer than the deal has nodes.
    `sketched` takes the rows of a deal and gives the least values of their sets, as lists, and the sizes of
    the sets. `new` takes rows, their signatures and pairs of places in them, and tells which pairs to give.
    """

    def of_deals(table: pa.Table, small: bool) -> Iterator[pa.RecordBatch]:
        node, sketches = table["node"].to_numpy(), None
        label = np.unique(table["component"].to_numpy(), return_inverse=True)[1]
        for x, y in _hits(table, small, matrix, least, new):
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            found = [np.zeros((0, 2), np.int64)]
            for i, j in pairwise([0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]):
                own, others = x[i], y[i:j][label[y[i:j]] != label[x[i]]]
                if not len(others):
                    continue
                sketches = sketches or Sketches(*sketched(table), share)
                others = others[sketches.alike(own, others)]
                # Where a set is not whole the pair may yet be refused, so it joins nothing here.
                sure = sketches.whole[own] & sketches.whole[others]
                joined, first = np.unique(label[others[sure]], return_index=True)
                given = np.concatenate([others[sure][first], others[~sure]])
                label[np.isin(label, joined)] = label[own]
                found.append(np.stack([np.full(len(given), node[own]), node[given]], 1))
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy()) for i in (0, 1)], ["a", "b"])

    return _deals(of_deals)
