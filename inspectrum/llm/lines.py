"""Fuzzy line deduplication by MinHash: one line of each group of similar lines stays.

A line counts in lower case without outer white space, as the set of its character
shingles. One pass of hashes is dealt into bins, and the least hash of each bin is a
signature; bands of it bring lines together. Most bands have one line alone, so a first pass sends
a few bytes of each band and finds those of several lines, and a second pass sends the lines of these. Within a band, lines whose signatures
agree in enough places are compared exactly, by the Jaccard similarity of their full
sets: first each with its most similar ones, then every such pair whose lines are
still in different components, in the first band that they share; a large band is cut into blocks, and every two of them meet. Components come from joins, and the first line of each, by
(doc_id, line number), is kept. Lines without a word do not count. A line shorter than
a shingle is one shingle, so it is similar to equal lines alone, which are one node from the start.

Null texts have no lines. A null doc_id comes first. Rows that repeat a doc_id share their line numbers,
and their lines are kept or dropped together. An empty table gives an empty result. Equal lines are
told by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectrum.llm.blocks import agreement, dealt, least_agreement, meeting, pairs_across
from inspectrum.llm.graph import components
from inspectrum.llm.arrays import write_arrays
from inspectrum.llm.language import Words, _file_of, _grouped, _packed, _unpacked, write_words
from inspectrum.llm.text import SPACES, binary_column, chained, chunks, field_of_row, hand_back, mixed, string_buffers, texts_of, whole_rows
from inspectrum.sources.workspace import delete_folder, discard, materialize, shuffles_deleted, work_path

SHINGLE, LEAST_CHARS, SIMILAR = 7, 1, 0.8
#: A pair at 0.8 shares no band with probability (1 - 0.8^3)^21 = 3 x 10^-7, if its bins agree independently.
BINS, BANDS, ROWS = 64, 21, 3
#: Lines of a band that are compared at once, larger bands are dealt into blocks; neighbours that each meets at first.
#: The second pass takes whole bands, by pairs of blocks if they are large, so this sets the order of work and not the result.
BLOCK, NEAREST = 512, 1
#: All pairs of a block of up to so many lines are compared in the first pass, so the second one takes larger blocks alone.
FEW = 4
#: The last bits of a block's name: the number of its band among those of a line, and whether it holds more than `FEW` lines.
_NUMBER, _MORE = 31, 32
#: Least shingle hashes of a line that are compared where lines meet: all of them in lines of up to so many characters.
SKETCH = 512
#: Bytes of lines that are signed at once: arrays over them are many times as large.
TOGETHER_BYTES = 250_000
#: Marks of bands that a task holds before it sends them in order.
MARKS = 1_000_000
#: A mark is these bits of a band's name and the others of a hash of the line: two different lines look the same with probability 2^-16.
_PLACE, _LINE = ~np.uint64(0xFFFF), np.uint64(0xFFFF)
_WEIGHTS = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: The order in which each empty bin asks all bins.
_ASKED = np.random.default_rng(10).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)


def signatures(texts: list[str]) -> np.ndarray:
    """One row of `BINS` least hashes for each text of at least `SHINGLE` characters; an empty bin borrows.

    Each bin asks the others in an order of its own and takes the first that is filled, so bins of a short line
    agree with those of another about as independently as those of long ones do.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    hashes = np.zeros(len(points) - SHINGLE + 1, np.uint64)
    for i, w in enumerate(_WEIGHTS):
        hashes += points[i : len(hashes) + i] * w
    hashes = mixed(hashes)
    line = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)[: len(hashes)]
    ends = np.cumsum(sizes)
    inside = np.ones(len(points), bool)
    inside[(ends[:, None] - np.arange(1, SHINGLE)).ravel()] = False
    inside = inside[: len(hashes)]
    # Line, bin and 38 bits of the hash in one number: the least of each bin comes first in order.
    keys = np.sort((line[inside] << np.uint64(44)) | (hashes[inside] >> np.uint64(20)))
    place = keys >> np.uint64(38)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    out = np.full(len(texts) * BINS, _EMPTY)
    out[place[first].astype(np.int64)] = keys[first] & np.uint64((1 << 38) - 1)
    out = out.reshape(-1, BINS)
    line_of, bin_of = np.nonzero(out == _EMPTY)
    filled = out.copy()
    for step in range(BINS):
        if not len(line_of):
            break
        lent = filled[line_of, _ASKED[bin_of, step]]
        out[line_of, bin_of] = lent
        left = lent == _EMPTY
        line_of, bin_of = line_of[left], bin_of[left]
    return out


def _bands_of(sig: np.ndarray) -> np.ndarray:
    """The names of all bands of each signature; the last bits of a name are the band's number."""
    named = np.stack([chained(*(sig[:, k * ROWS + r] for r in range(ROWS))) + np.uint64(k) for k in range(BANDS)], 1)
    return (named & ~np.uint64(_NUMBER)) | np.arange(BANDS, dtype=np.uint64)


def _signatures_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes and signatures of the distinct lines of each batch of (node, text)."""
    for batch in batches:
        _, once = np.unique(batch.column(0).to_numpy(), return_index=True)
        batch = batch.take(pa.array(np.sort(once)))
        _, offsets = string_buffers(batch.column(1))
        parts = [signatures(batch.column(1).slice(a, b - a).to_pylist()) for a, b in chunks(offsets, TOGETHER_BYTES)]
        if parts:
            yield batch.column(0).to_numpy(), np.concatenate(parts)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted; faster than `np.unique`, which hashes first."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _marks(shards: int):
    """(shard, n, block) of (node, text): sorted marks of all bands of the lines, by ranges of bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            marks = _distinct(np.concatenate(held))
            limits = np.searchsorted(_file_of(marks, shards), np.arange(shards + 1)).tolist()
            full = [i for i in range(shards) if limits[i] < limits[i + 1]]
            own = [marks[limits[i] : limits[i + 1]] for i in full]
            blocks = [_packed(m, np.zeros(len(m), np.int64)) for m in own]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([len(m) for m in own], pa.int64()), pa.array(blocks, pa.binary())], ["shard", "n", "block"])

        for nodes, sig in _signatures_of(batches):
            held.append(((_bands_of(sig) & _PLACE) | (mixed(nodes.view(np.uint64)) & _LINE)[:, None]).ravel())
            if sum(map(len, held)) >= MARKS:
                yield sent()
        if held:
            yield sent()
        hand_back()

    return run


def _write_repeated(folder: str):
    """Files of the bands of several lines, from marks sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in _grouped(batches, "shard"):
            blocks = zip(table["block"].to_pylist(), table["n"].to_pylist(), strict=True)
            places = _distinct(np.concatenate([_unpacked(block, n)[0] for block, n in blocks])) & _PLACE
            several = _distinct(places[1:][places[1:] == places[:-1]])
            write_arrays(f"{folder}/words-{shard}", [several, np.ones(len(several), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(several)], pa.int64())], ["shard", "n"])
        hand_back()

    return run


def _repeated_bands(long_lines: DataFrame, folder: str) -> Words:
    """Bands that two different lines have, as sorted arrays in files, and others whose names agree with one in their first 48 bits."""
    shards = int(long_lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = long_lines.mapInArrow(_marks(shards), "shard int, n long, block binary").repartition(shards, "shard").sortWithinPartitions("shard")
    sizes = dict(sent.mapInArrow(_write_repeated(folder), "shard int, n long").collect())
    return Words(folder, [sizes.get(i, 0) for i in range(shards)], sum(sizes.values()), 0)


def _short(sig: np.ndarray) -> np.ndarray:
    """Four bits a bin."""
    bits = (mixed(sig) & np.uint64(15)).astype(np.uint8)
    return (bits[:, ::2] << 4) | bits[:, 1::2]


def _rows_column(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix of bytes."""
    return binary_column(rows.ravel(), np.arange(len(rows) + 1) * rows.shape[1])


def _bands(repeated: Words):
    """(band, node, signature) of the bands of (node, text) that other lines have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated.open()
        for nodes, sig in _signatures_of(batches):
            bands = _bands_of(sig).ravel()
            hit = np.flatnonzero(repeated.find(bands & _PLACE)[1])
            line = hit // BANDS
            yield pa.RecordBatch.from_arrays([pa.array(bands[hit].view(np.int64)), pa.array(nodes[line]), _rows_column(_short(sig)[line])], ["band", "node", "signature"])
        hand_back()

    return run


def _blocks(batches: Iterator[pa.RecordBatch], named: bool = False, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """(block, node) of bands with two lines or more, from rows sorted by (band, node); equal rows count once. A signature stays beside its node.

    A band of more than `size` lines (`BLOCK` at first) is cut into blocks as it streams by; each also holds the band's least node.
    With `named`, a third column has the band of rows that were cut, and nulls for others.
    """
    size = size or BLOCK
    held = np.zeros((0, 2), np.int64)
    since, least = 0, held  # blocks of the held band that are out, and the row of its least node

    def out(rows: np.ndarray, number: np.ndarray, large: bool) -> pa.RecordBatch:
        names = chained(rows[:, 0].view(np.uint64), number.astype(np.uint64)).view(np.int64) & ~np.int64(_NUMBER | _MORE)
        sizes = np.diff(np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0], [True]])))
        names |= (rows[:, 0] & _NUMBER) | np.where(np.repeat(sizes, sizes) > FEW, _MORE, 0)
        found = pa.RecordBatch.from_arrays([pa.array(names), pa.array(rows[:, 1].copy())], ["block", "node"])
        if named:
            found = found.append_column("band", pa.array(rows[:, 0].copy()) if large else pa.nulls(len(rows), pa.int64()))
        return found.append_column("signature", _rows_column(np.ascontiguousarray(rows[:, 2:]).view(np.uint8))) if rows.shape[1] > 2 else found

    def cut(rows: np.ndarray, end: bool) -> Iterator[pa.RecordBatch]:
        """Blocks of one band; what may grow yet stays held."""
        nonlocal held, since, least
        while len(rows) >= (2 if end else 2 * size):
            now, rows = rows[:size], rows[size:]
            if since:
                now = np.concatenate([least, now])
            else:
                least = now[:1]
            yield out(now, np.full(len(now), since), bool(since or len(rows)))
            since += 1
        if end and len(rows) and since:
            yield out(np.concatenate([least, rows]), np.full(len(rows) + 1, since), True)
        held = rows

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
        if batch.num_columns > 2:
            rows = np.concatenate([rows, string_buffers(batch.column(2))[0].view(np.int64).reshape(len(rows), -1)], 1)
        rows = np.concatenate([held, rows]) if len(held) else rows
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])
        rows = rows[new]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        if since and len(starts) > 1:
            yield from cut(rows[: starts[1]], True)
            rows, starts, since = rows[starts[1] :], starts[1:] - starts[1], 0
        if len(starts) > 1:
            sizes = np.diff(starts)
            for i in np.flatnonzero(sizes > size).tolist():
                since = 0
                yield from cut(rows[starts[i] : starts[i + 1]], True)
            since = 0
            small = np.repeat((sizes > 1) & (sizes <= size), sizes)
            if small.any():
                yield out(rows[: len(small)][small], np.zeros(small.sum()), False)
        yield from cut(rows[starts[-1] :], False)
    yield from cut(held, True)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a signature of four bits a bin and four bytes of the name of each band to (node, text)."""
    for batch in batches:
        _, offsets = string_buffers(batch.column(1))
        for a, b in chunks(offsets, TOGETHER_BYTES):
            sig = signatures(batch.column(1).slice(a, b - a).to_pylist())
            bands = (_bands_of(sig) >> np.uint64(32)).astype("<u4")
            columns = [_rows_column(x) for x in (_short(sig), bands.view(np.uint8))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], ["node", "text", "signature", "bands"])


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line, node, text) of lines that have a word: `node` names equal lines."""
    split = texts_of(df, id_col, text_col).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    text = F.btrim(F.lower("raw"), F.lit(SPACES))
    return split.select("doc_id", "line", text.alias("text")).filter(F.length("text") >= LEAST_CHARS).select("doc_id", "line", F.xxhash64("text").alias("node"), "text")


def _short_signatures(column: pa.ChunkedArray) -> np.ndarray:
    pairs = string_buffers(column)[0].reshape(-1, BINS // 2)
    return np.stack([pairs >> 4, pairs & 15], 2).reshape(-1, BINS)


def _first_met(table: pa.Table, sig: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows have no band in common before that of their deal: two lines are compared in the first one that they share.

    Names of four bytes differ but for a chance of 2^-32, so a pair is lost with probability 5 x 10^-9 at most.
    """
    bands, number = string_buffers(table["bands"])[0].reshape(-1, 4 * BANDS), table["number"].to_numpy()
    first = [np.zeros(0, np.int64)]
    for at in range(0, len(x), 20_000):
        a, b = (bands[i[at : at + 20_000]].view("<u4") for i in (x, y))
        first.append((a == b).argmax(1))
    return np.concatenate(first) == number[x]


def _candidates(cut: int):
    """Each line of a block with the ones of most similar signature; rows come block by block."""

    def of_block(node: np.ndarray, sig: np.ndarray) -> np.ndarray:
        found = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(node), 64):
            own = slice(at, min(at + 64, len(node)))
            equal = agreement(sig[own], sig)
            equal[node[own][:, None] == node[None, :]] = -1
            best = np.argsort(-equal, axis=1, kind="stable")[:, :NEAREST]
            x, y = np.repeat(np.arange(len(equal)), best.shape[1]), best.ravel()
            good = equal[x, y] >= cut
            x, y = x[good], y[good]
            found.append(np.sort(np.stack([node[own][x], node[y]], 1), axis=1))
        return np.concatenate(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def pairs(table: pa.Table) -> pa.RecordBatch:
            block, node = (table[c].to_numpy() for c in ("block", "node"))
            sig = _short_signatures(table["signature"])
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            sizes = np.diff(cuts)
            both = [of_block(node[x:y], sig[x:y]) for x, y in pairwise(cuts) if y - x > FEW]
            # Pairs of all small blocks at once.
            left = np.repeat(sizes <= FEW, sizes)
            for step in range(1, FEW):
                x = np.flatnonzero(left[:-step] & (block[step:] == block[:-step])) if len(block) > step else np.zeros(0, np.int64)
                x = x[node[x] != node[x + step]]
                x = x[(sig[x] == sig[x + step]).sum(1) >= cut]
                both.append(np.sort(np.stack([node[x], node[x + step]], 1), axis=1))
            all_pairs = np.unique(np.concatenate([*both, np.zeros((0, 2), np.int64)]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(all_pairs[:, i].copy()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            block = table["block"].to_numpy()
            last = int(np.flatnonzero(block != block[-1]).max(initial=-1)) + 1
            if last:
                yield pairs(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None:
            yield pairs(rest)

    return run


def _only(wanted: Words):
    """Rows (node, text) of wanted nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted.open()
        for batch in batches:
            yield batch.filter(pa.array(wanted.find(batch.column(0).to_numpy().view(np.uint64))[1] > 0))

    return run


def _met(cut: int, size: int):
    """From rows (band, node, signature) sorted by band and node: pairs (a, b) of similar signatures in a block, and (block, node, band) of larger blocks."""
    names = ["block", "node", "band", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        larger: list[pa.RecordBatch] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            for b in _blocks(batches, named=True, size=size):
                more = (b.column(0).to_numpy() & _MORE != 0) | b.column(2).is_valid().to_numpy(zero_copy_only=False)
                if more.any():
                    larger.append(b.select([0, 1, 2]).filter(pa.array(more)))
                yield b

        def places() -> Iterator[pa.RecordBatch]:
            for b in larger:
                none = pa.nulls(len(b), pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns, none, none], names)
            larger.clear()

        for pairs in _candidates(cut)(blocks()):
            yield from places()
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, *pairs.columns], names)
        yield from places()

    return run


def _deals_across(places: DataFrame, labels: DataFrame) -> DataFrame:
    """(deal, half, node, component, number) of larger blocks of several components, and of whole bands that were cut; a line that met no similar one in its blocks is in these too.

    `number` is that of the band among those of a line.
    """
    number = f"cast({{}} & {_NUMBER} as int) as number"
    small = places.filter(f"band is null and block & {_MORE} <> 0").join(labels, "node").select(F.col("block").alias("deal"), "node", "component")
    mixed = small.groupBy("deal").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("deal")
    small = small.join(mixed, "deal", "left_semi").select("deal", F.lit(2).alias("half"), "node", "component", F.expr(number.format("deal")))
    large = places.filter("band is not null").select(F.col("band").alias("group"), "node").distinct().join(labels, "node", "left")
    large = dealt(large.select("group", "node", F.coalesce("component", "node").alias("component")), 4 * BLOCK)
    return small.unionByName(large.select("deal", "half", "node", "component", F.expr(number.format("`group`"))))


def _sketched(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least shingle hashes of each line, of all shingles for lines of up to `SKETCH` characters."""
    values, sizes = [], []
    for text in table["text"].to_pylist():
        own = np.unique(_shingle_hashes(text))
        values.append(own[:SKETCH])
        sizes.append(len(own))
    ends = np.cumsum([0, *map(len, values)])
    return np.concatenate([*values, np.zeros(0, np.uint64)]), ends, np.array(sizes)


def _shingle_hashes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - SHINGLE + 1
    hashes = np.zeros(n, np.uint64)
    for i, w in enumerate(_WEIGHTS):
        hashes += points[i : n + i] * w
    return mixed(hashes)


def _links_across(deals: DataFrame, texts: DataFrame, cut: int, similar: float) -> DataFrame:
    """Pairs across components whose shingles are similar by their sketches: only true links and a few more leave a deal.

    Signatures tell first which lines of a deal meet a candidate; only their texts are dealt out, once for a line and deal.
    """
    columns = ["deal", "half", "node", "component", "number", "signature", "bands"]
    signed = deals.join(texts.select("node", "signature", "bands"), "node").repartition("deal").sortWithinPartitions("deal")
    met = signed.select(columns).mapInArrow(meeting(_short_signatures, cut, _first_met), "deal long, node long")
    met = materialize(deals.join(met, ["deal", "node"], "left_semi"), "met-across")
    rows = met.join(texts, "node").select(*columns, "text").repartition("deal").sortWithinPartitions("deal")
    found = rows.mapInArrow(pairs_across(_short_signatures, cut, similar, _sketched, _first_met), "a long, b long").distinct()
    found._inputs = (met,)
    return found


def shingles(text: str) -> set[str]:
    return {text[i : i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1))}


def _compared(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Rows come sorted by one of the two lines, so its shingles are those of the row before.
            keep, last, own, before, other = [], None, set(), None, set()
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if x != last:
                    last, own = x, shingles(x)
                if y != before:
                    before, other = y, shingles(y)
                common = len(own & other)
                if common >= similar * (len(own) + len(other) - common):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(_compared(similar), "a long, b long")


def similar_lines(df: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, first_doc_id, first_line, kept) of every line that has a word; lines count from 0."""
    with shuffles_deleted(df.sparkSession):
        return _similar_lines(lines_of(df, id_col, text_col), similar)


def _similar_lines(lines: DataFrame, similar: float) -> DataFrame:
    spark = lines.sparkSession
    cut = least_agreement(BINS, similar)
    long_lines = lines.filter(F.length("text") >= SHINGLE).select("node", "text")
    repeated_folder = work_path(spark, "repeated-bands")
    repeated = _repeated_bands(long_lines, repeated_folder)
    bands = long_lines.mapInArrow(_bands(repeated), "band long, node long, signature binary").repartition("band").sortWithinPartitions("band", "node")
    met = materialize(bands.mapInArrow(_met(cut, BLOCK), "block long, node long, band long, a long, b long"), "met")
    delete_folder(spark, repeated_folder)
    places = met.filter("block is not null").select("block", "node", "band")
    first = materialize(met.filter("a is not null").select("a", "b").distinct(), "pairs")
    ends = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct()
    # Lines that met a similar one or are in a band that was cut, as a sorted array in files, so that their texts are found without dealing out all lines.
    asked = ends.unionByName(places.filter("band is not null").select("node")).distinct()
    asked = materialize(asked.select(F.col("node").alias("word"), F.lit(1).cast("long").alias("n")), "asked")
    folder = work_path(spark, "asked-lines")
    wanted = write_words(asked, folder)
    texts = lines.select("node", "text").mapInArrow(_only(wanted), "node long, text string").groupBy("node").agg(F.min("text").alias("text"))
    texts = materialize(texts.mapInArrow(_signed, "node long, text string, signature binary, bands binary"), "texts")
    links = materialize(_confirmed(first, texts, similar), "links")
    labels = ends.join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    labelled = materialize(labels, "labels")
    deals = materialize(_deals_across(places, labelled), "deals")
    across = _links_across(deals, texts, cut, similar)
    more = materialize(_confirmed(across, texts, similar), "links")
    discard(deals, *across._inputs)
    found = materialize(components(links.unionByName(more)), "components")
    named = lines.select("doc_id", "line", "node").join(found, "node", "left").select("doc_id", "line", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "named")
    firsts = named.groupBy("component").agg(F.min(F.struct("doc_id", "line")).alias("first"))
    result = named.join(firsts, "component").select(
        "doc_id", "line", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line").alias("first_line")
    )
    kept = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("line") == F.col("first_line"))
    out = materialize(result.withColumn("kept", kept), "similar-lines")
    delete_folder(spark, folder)
    discard(met, asked, first, texts, links, labelled, more, found, named)
    return out


def without_similar_lines(df: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with only the first line of each group in its texts; a text that so loses its last line goes."""
    found = similar_lines(df, similar, id_col, text_col)
    dropped = found.filter("not kept").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("line").alias("gone"))
    joined = whole_rows(df).withColumn("key", field_of_row(id_col).cast("long")).join(dropped, F.col("key").eqNullSafe(F.col("id")), "left")
    # A name that no column has, whatever its case.
    gone = "gone" + "_" * max(map(len, df.columns))
    joined = joined.select("row.*", F.col("gone").alias(gone))
    where = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for t, drop in zip(batch.column(where).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if t is not None and drop:
                    gone = set(drop)
                    rest = [x for i, x in enumerate(t.split("\n")) if i not in gone]
                    keep.append(any(x.strip(SPACES) for x in rest))
                    texts.append("\n".join(rest))
                else:
                    keep.append(True)
                    texts.append(t)
            out = batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.types[where]))
            yield out.select(range(batch.num_columns - 1)).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, df.schema)
