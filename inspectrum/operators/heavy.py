"""The most frequent values of keys with very many values, exactly and without shuffling them all.

Each task keeps a bounded number of counters. When they are full, all go down by the same
amount and those at zero leave; what was taken bounds the error of every count. The sums of
the counters and of the bounds tell which keys can be among the first k; these are then
counted exactly in a second scan. Where the bounds prove nothing, tasks keep more
counters, and beyond `MOST` all keys are grouped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectrum.sources.workspace import discard, materialize

#: Counters of a task at first, how many times as many it has next, and from where on all keys are grouped.
COUNTERS, WIDER, MOST = 4096, 16, 1_000_000


def _counted(keys: list[str], counters: int):
    """Rows (keys, n, lost): at most `counters` keys of a task, with at least `n` and at most `n` + all `lost` of its rows."""

    def summed(table: pa.Table) -> pa.Table:
        return table.group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lost = None, 0
        for batch in batches:
            own = pa.Table.from_batches([batch]).append_column("n", pa.array([1] * batch.num_rows, pa.int64()))
            held = summed(own if held is None else pa.concat_tables([held, own]))
            if held.num_rows > counters:
                descending = pc.array_sort_indices(held["n"].combine_chunks(), order="descending")
                least = held["n"][descending[counters].as_py()].as_py()
                held = held.set_column(len(keys), "n", pc.subtract(held["n"], least))
                held = held.filter(pc.greater(held["n"], 0))
                lost += least
        if held is None:
            return
        if not held.num_rows:
            held = pa.table({**{k: pa.nulls(1, held.schema.field(k).type) for k in keys}, "n": pa.array([0], pa.int64())})
        yield from held.append_column("lost", pa.array([lost] + [0] * (held.num_rows - 1), pa.int64())).to_batches()

    return run


def top_counts(df: DataFrame, keys: list[str], k: int, counters: int = COUNTERS) -> DataFrame:
    """(keys, n) of the `k` most frequent keys; ties go by the keys, nulls first. A null key counts like any other."""
    rows = df.select(*keys)
    order = [F.desc("n"), *keys]
    form = T.StructType([*rows.schema.fields, T.StructField("n", T.LongType()), T.StructField("lost", T.LongType())])
    while counters <= MOST:
        kept = rows.mapInArrow(_counted(keys, counters), form)
        least = materialize(kept.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("lost").alias("lost")), "counters")
        lost = least.agg(F.coalesce(F.sum("lost"), F.lit(0))).first()[0]
        first = least.drop("lost").orderBy(*order).limit(k)
        if lost == 0:
            out = materialize(first, "top-counts")
            discard(least)
            return out.orderBy(*order)
        last = first.agg(F.min("n").alias("n"), F.count("*").alias("found")).first()
        if last["found"] == k and last["n"] > lost:
            # A key with fewer rows than this cannot reach the k-th one, and one without counters has at most `lost`.
            able = least.filter(F.col("n") + lost >= last["n"]).select(*[F.col(c).alias(f"{c}_able") for c in keys])
            same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(able[f"{c}_able"]) for c in keys])
            exact = rows.join(able, same, "left_semi").groupBy(*keys).agg(F.count("*").alias("n"))
            out = materialize(exact.orderBy(*order).limit(k), "top-counts")
            discard(least)
            return out.orderBy(*order)
        discard(least)
        counters *= WIDER
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*order).limit(k)
