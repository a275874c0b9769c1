"""Merkle manifest of a table with a witness for every row, by incremental witnesses.

Rows become leaves; per language they stand in order of `doc_id`. Aligned blocks of leaves are appended one
leaf at a time: a leaf opens a subtree, two open subtrees of one height complete each other, and
each completion extends the partial witnesses of all leaves below with the other side's digest. What is left
open at the end of a language is lifted. The roots of blocks are nodes that are appended in the same way, block
by block over the cluster, until one node per language is left; these are appended once more. Witnesses
of blocks are extended by those of the blocks' own nodes, so a row meets one table, a thousandth of the leaves in length.

A null field is `-` in its leaf, an empty text `0:`. Null languages stand first, null ids first in their language. Rows with
equal ids go by leaf; equal rows are leaves of their own in any order, which gives the same set of rows. Texts
of any length are one leaf each and are read once; only digests are shuffled. Other columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from binascii import hexlify
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectrum.llm.sharding import CRC_TABLE_SQL, crc32_sql
from inspectrum.llm.text import binary_column
from inspectrum.sources.workspace import discard, materialize

#: Levels of the tree inside one block.
LEVELS = 10
#: Steps of a witness: which side the sibling stands on, or that the node was alone in its run.
LEFT, RIGHT, ALONE = 1, 2, 3
_INDEX_BITS = 33


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang_key, digest, changed): `changed` is the leaf of the row after tampering, null where nothing changes.

    `lang_key` orders null before every language.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")

    def leaf(n_chars: Column) -> Column:
        return F.unhex(F.sha2(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(n_chars), field(F.col("text"))), 256))

    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    return rows.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("lang_key"),
        leaf(F.col("n_chars")).alias("digest"),
        F.when(hit, leaf(F.col("n_chars") + 1)).alias("changed"),
    )


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """`rows` with `place` (dense from 0 in `order` inside the group) and `size` of the group.

    Rows are sorted over range partitions and written with their index there; what stands before a partition
    in each group comes from one count per group and partition. Equal rows are dealt over partitions.
    """
    keys = [group, *order, "row_id"]
    ranged = rows.withColumn("row_id", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.drop("row_id").withColumn("at", F.monotonically_increasing_id()), name)
    ranged = ranged.withColumn("part", F.shiftright("at", _INDEX_BITS))
    counts = ranged.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        group, "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(W.partitionBy(group)).alias("size")
    )
    starts = materialize(starts, f"{name}-starts")
    out = ranged.join(starts, [group, "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")
    out._inputs = (ranged, starts)
    return out


def node_digest(*parts: bytes) -> bytes:
    return hashlib.sha256(hexlify(b"".join(parts))).digest()


class OpenTree:
    """Appends nodes one by one; keeps for each of them the steps and siblings of its witness so far."""

    def __init__(self, capacity: int, levels: int) -> None:
        self._steps = np.zeros((capacity, levels), np.uint8)
        self._siblings = np.zeros((capacity, levels, 32), np.uint8)
        self._open: list[tuple[int, int, int, bytes]] = []  # height, first and last + 1 node, digest
        self._n = 0

    def _complete(self, left, right) -> tuple[int, int, int, bytes]:
        height, a, b, one = left
        _, _, c, other = right
        self._steps[a:b, height], self._steps[b:c, height] = RIGHT, LEFT
        self._siblings[a:b, height] = np.frombuffer(other, np.uint8)
        self._siblings[b:c, height] = np.frombuffer(one, np.uint8)
        return height + 1, a, c, node_digest(one, other)

    def append(self, digest: bytes) -> None:
        node = (0, self._n, self._n + 1, digest)
        self._n += 1
        while self._open and self._open[-1][0] == node[0]:
            node = self._complete(self._open.pop(), node)
        self._open.append(node)

    def close(self, height: int = 0) -> bytes:
        """Lift what is open until one node of at least `height` is left; its digest."""
        while len(self._open) > 1 or self._open[0][0] < height:
            node = self._open.pop()
            if self._open and self._open[-1][0] == node[0]:
                self._open.append(self._complete(self._open.pop(), node))
            else:
                level, a, b, digest = node
                self._steps[a:b, level] = ALONE
                self._open.append((level + 1, a, b, node_digest(digest)))
        return self._open[0][3]

    def witnesses(self) -> tuple[pa.Array, pa.Array]:
        """Steps, and siblings one after the other, of every node."""
        steps = self._steps[: self._n, : self._open[0][0]]
        given = (steps == LEFT) | (steps == RIGHT)
        siblings = self._siblings[: self._n, : steps.shape[1]][given]
        ends = np.concatenate([[0], np.cumsum(given.sum(1))]) * 32
        return binary_column(steps.ravel(), np.arange(self._n + 1) * steps.shape[1]), binary_column(siblings.ravel(), ends)


def _whole_blocks(batches: Iterable[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    """The rows of each block; a block starts where `place` is a multiple of its size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch["place"].to_numpy() % block == 0)
        first = 0
        for start in starts:
            if start > first:
                held.append(batch.slice(first, start - first))
            if held:
                yield pa.Table.from_batches(held)
            held, first = [], start
        if len(batch) > first:
            held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _append_blocks(batches: Iterable[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    for rows in _whole_blocks(batches, 1 << levels):
        tree = OpenTree(len(rows), levels)
        for digest in rows["digest"].to_pylist():
            tree.append(digest)
        root = tree.close(levels if rows["size"][0].as_py() > 1 << levels else 0)
        steps, siblings = tree.witnesses()
        out = rows.append_column("steps", steps).append_column("siblings", siblings)
        yield from out.append_column("block_root", pa.array([root] + [None] * (len(rows) - 1), pa.binary())).combine_chunks().to_batches()


def appended(nodes: DataFrame, group: str, name: str, levels: int) -> DataFrame:
    """Write `nodes` (group, place, size, digest, ...) with `block`, the witness inside it, and `block_root` on its first row."""
    ready = nodes.withColumn("block", F.shiftright("place", levels)).repartition(group, "block").sortWithinPartitions(group, "block", "place")
    schema = T.StructType([*ready.schema, *(T.StructField(c, T.BinaryType()) for c in ("steps", "siblings", "block_root"))])
    return materialize(ready.mapInArrow(functools.partial(_append_blocks, levels=levels), schema), name)


def _extended(nodes: DataFrame, more: DataFrame, on: list[str]) -> DataFrame:
    """The witnesses of `nodes`, followed by those of what they are part of."""
    extra = more.select(*on, F.col("steps").alias("more_steps"), F.col("siblings").alias("more_siblings"))
    joined = nodes.join(extra, on, "left")
    empty = F.lit(b"")
    return joined.withColumns(
        {
            "steps": F.concat("steps", F.coalesce("more_steps", empty)),
            "siblings": F.concat("siblings", F.coalesce("more_siblings", empty)),
        }
    ).drop("more_steps", "more_siblings")


def grown(nodes: DataFrame, group: str, name: str, levels: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bottom, above, roots) of the trees of all groups of `nodes` (group, place, size, digest, ...).

    `bottom` has the witness of each node inside its block, `above` (group, block) the witness of that block up to the
    root of its group, `roots` (group, root).
    """
    rounds, block = [appended(nodes, group, name, levels)], 1 << levels
    largest = rounds[0].agg(F.max("size")).first()[0] or 0
    while largest > block:
        last = rounds[-1].filter(F.col("block_root").isNotNull() & (F.col("size") > block))
        upper = last.select(group, F.col("block").alias("place"), F.shiftright(F.col("size") + (block - 1), levels).alias("size"), F.col("block_root").alias("digest"))
        rounds.append(appended(upper, group, name, levels))
        largest = -(-largest // block)
    blocks = [x.filter("block_root IS NOT NULL") for x in rounds]
    roots = blocks[0].filter(F.col("size") <= block).select(group, F.col("block_root").alias("root"))
    for x in blocks[1:]:
        roots = roots.unionByName(x.filter(F.col("size") <= block).select(group, F.col("block_root").alias("root")))
    witness = None
    for x in reversed(rounds[1:]):
        own = x.select(group, "place", "block", "steps", "siblings")
        witness = own if witness is None else _extended(own, witness.select(group, F.col("place").alias("block"), "steps", "siblings"), [group, "block"])
    above = blocks[0].select(group, "block", F.lit(b"").alias("steps"), F.lit(b"").alias("siblings"))
    if witness is not None:
        above = _extended(above, witness.select(group, F.col("place").alias("block"), "steps", "siblings"), [group, "block"])
    above = materialize(above, f"{name}-above")
    roots = materialize(roots, f"{name}-roots")
    discard(*rounds[1:])
    return rounds[0], above, roots


def folded(digest: bytes, steps: bytes, siblings: bytes) -> bytes:
    """The root that a node leads to by its witness."""
    at = 0
    for step in steps:
        if step == ALONE:
            digest = node_digest(digest)
            continue
        sibling = siblings[at : at + 32]
        at += 32
        digest = node_digest(sibling, digest) if step == LEFT else node_digest(digest, sibling)
    return digest


def _fold_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shown = [c if c is not None else d for c, d in zip(batch["changed"].to_pylist(), batch["digest"].to_pylist())]
        roots = [folded(*x) for x in zip(shown, batch["steps"].to_pylist(), batch["siblings"].to_pylist())]
        proofs = [hashlib.sha256(hexlify(s)).digest() for s in batch["siblings"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["digest"], batch["subroot"], pa.array(proofs, pa.binary()), pa.array(roots, pa.binary())],
            ["doc_id", "leaf", "subroot", "proof", "folded"],
        )


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaf, subroot and root, digest of the proof, and what a partly tampered copy folds to, for every row."""
    written = materialize(leaves(docs), "leaves")
    rows = placed(written, "lang_key", ["doc_id", "digest"], "leaves-placed")
    bottom, above, subroots = grown(rows, "lang_key", "manifest", levels)
    discard(written, *rows._inputs)

    langs = placed(subroots.select(F.lit(0).alias("all"), "lang_key", F.col("root").alias("digest")), "all", ["lang_key"], "langs-placed")
    top, top_above, top_root = grown(langs, "all", "manifest-langs", levels)
    found = top_root.first()
    root = found["root"] if found else b""
    lang_witness = _extended(top.select("all", "block", "lang_key", F.col("digest").alias("subroot"), "steps", "siblings"), top_above, ["all", "block"])
    outer = lang_witness.select("lang_key", "subroot", F.col("steps").alias("lang_steps"), F.col("siblings").alias("lang_siblings"))
    joined = above.join(outer, "lang_key")
    complete = materialize(
        joined.select(
            "lang_key", "block", "subroot", F.concat("steps", "lang_steps").alias("steps"), F.concat("siblings", "lang_siblings").alias("siblings")
        ),
        "witnesses",
    )
    inner = bottom.select("doc_id", "lang_key", "block", "digest", "changed", "steps", "siblings").join(complete.select("lang_key", "block", "subroot"), ["lang_key", "block"])
    whole = _extended(inner, complete, ["lang_key", "block"])
    done = whole.select("doc_id", "digest", "changed", "subroot", "steps", "siblings").mapInArrow(
        _fold_rows, "doc_id long, leaf binary, subroot binary, proof binary, folded binary"
    )

    def hexed(name: str) -> Column:
        return F.lower(F.hex(name))

    return done.select(
        "doc_id",
        hexed("leaf").alias("leaf"),
        hexed("subroot").alias("subroot"),
        F.lit(root.hex()).alias("root"),
        hexed("proof").alias("proof_sha256"),
        hexed("folded").alias("folded_root"),
        (F.col("folded") == F.lit(root)).alias("verified"),
    )


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs of all nodes of the trees over `leaves` (k, i, n, digest)."""
    return f"""
{name}(k, level, i, n, digest) AS (
    SELECT k, 0, i, n, digest FROM {leaves}
    UNION ALL
    SELECT k, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY k, level, i // 2, n
)"""


def _fold_sql(name: str, starts: str, tree: str) -> str:
    """CTE that follows `starts` (k, at, value, proof and the rest) up the tree; the last level holds the root."""
    sibling = f"LEFT JOIN {tree} s ON s.k = f.k AND s.level = f.level AND s.i = xor(f.i, 1)"
    step = "CASE WHEN f.i % 2 = 1 THEN s.digest || f.value WHEN s.digest IS NOT NULL THEN f.value || s.digest ELSE f.value END"
    return f"""
{name}(k, row_no, level, i, n, value, proof) AS (
    SELECT k, row_no, 0, i, n, value, proof FROM {starts}
    UNION ALL
    SELECT f.k, row_no, f.level + 1, f.i // 2, (f.n + 1) // 2, sha256({step}), proof || coalesce(s.digest, '')
    FROM {name} f {sibling} WHERE f.n > 1
)"""


def _leaf_sql(n_chars: str) -> str:
    def field_sql(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    return f"sha256({' || '.join(map(field_sql, ['doc_id', 'source', 'lang', n_chars, 'text']))})"


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
rows AS (
    SELECT *, coalesce('=' || lang, '') AS k, row_number() OVER () AS row_no, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(n_chars + 1)")} AS changed,
           doc_id IS NOT NULL AND n_chars IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % 7 = 0 AS hit
    FROM documents, crc_table
),
leaves AS (
    SELECT k, row_no, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n,
           leaf AS digest, CASE WHEN hit THEN changed ELSE leaf END AS value, '' AS proof
    FROM rows
),
{_tree_sql("tree", "leaves")},
{_fold_sql("fold", "leaves", "tree")},
langs AS (SELECT 0 AS k, t.k AS lang, row_number() OVER (ORDER BY t.k) - 1 AS i, count(*) OVER () AS n, digest FROM tree t WHERE t.n = 1),
{_tree_sql("top", "langs")},
outer_starts AS (SELECT 0 AS k, f.row_no, l.i, l.n, f.value, f.proof FROM fold f JOIN langs l ON l.lang = f.k WHERE f.n = 1),
{_fold_sql("outer_fold", "outer_starts", "top")}
SELECT r.doc_id, r.leaf, l.digest AS subroot, t.digest AS root, sha256(f.proof) AS proof_sha256, f.value AS folded_root, f.value = t.digest AS verified
FROM outer_fold f JOIN rows r USING (row_no) JOIN langs l ON l.lang = r.k JOIN top t ON t.n = 1
WHERE f.n = 1
"""
