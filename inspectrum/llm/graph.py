"""Connected components of a large graph, by joins and minima alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectrum.sources.workspace import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of star contraction: neighbours are linked to the smallest one instead.

    The large step moves larger neighbours, the small step smaller ones. Minima are
    aggregated before the join, so a node with very many edges meets one row.
    """
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges
    least = sides.groupBy("a").agg(F.min("b").alias("m"))
    joined = sides.join(least, "a").select("a", "b", F.least("a", "m").alias("m"))
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.filter("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge between two nodes.

    Stars are contracted until no edge moves, which takes rounds in the logarithm of the longest
    path. Each round is written to the shared folder, so a lost executor costs one
    round. Loops, repeated edges and edges with a null end add nothing.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    current = materialize(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = current.agg(mark).first()[0]
    while before[0]:
        large = materialize(_star(current, True), "edges")
        after = materialize(_star(large, False), "edges")
        discard(current, large)
        current = after
        now = current.agg(mark).first()[0]
        if now == before:
            break
        before = now
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
