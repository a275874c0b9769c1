"""Running totals, ranks and values at given ranks.

Rows are aggregated to one row per order key first, written range-partitioned, and
summed in two levels: totals per range partition (a table with one row per
partition), then inside each partition. No step sorts the whole table in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from inspectrum.sources.workspace import materialize

PART = "__part"


def range_partitioned(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`df`, sorted by `keys` over the cluster and written with its partition number.

    Writing pins the partition number, so that every later use sees the same ranges.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys])
    return materialize(ranged.withColumn(PART, F.spark_partition_id()), name)


def running_totals(
    ranged: DataFrame, order: str, sums: dict[str, str], by: list[str] | None = None, descending: bool = False
) -> DataFrame:
    """Add `sums` (new column → summed column), each including the current row.

    `ranged` comes from `range_partitioned` with keys `by + [order]` and has one row
    per key.
    """
    by = by or []
    direction = F.desc if descending else F.asc
    totals = ranged.groupBy(*by, PART).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    earlier = W.partitionBy(*by).orderBy(direction(PART)).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, PART, *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in sums]
    )
    inside = W.partitionBy(*by, PART).orderBy(direction(order)).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(inside).alias(f"__l_{n}") for n, c in sums.items()])
    joined = local.join(offsets, [*by, PART])
    kept = [c for c in ranged.columns if c != PART]
    return joined.select(*kept, *[(F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums])


def value_counts(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(name, value, n) of the non-null values of several columns, in one scan."""
    cast = df.select(*[F.col(c).cast(kind).alias(c) for c in columns])
    long = cast.unpivot([], columns, "name", "value").filter(F.col("value").isNotNull())
    return long.groupBy("name", "value").agg(F.count("*").alias("n"))


#: Buckets that an interval is cut into by one scan.
BUCKETS = 4096


@dataclass
class _Interval:
    """Values from `low` to `high` of one column, with `before` values below them, that hold some wanted ranks."""

    name: str
    low: float
    high: float
    before: int
    ranks: list[int]

    def bucket(self):
        """Number of the bucket of a value in the interval: rounding keeps the order, halves keep large differences finite."""
        part = 0.5 if max(abs(self.low), abs(self.high)) > 1e300 else 1.0
        value = F.col(f"`{self.name}`") * part
        share = (value - self.low * part) / (self.high * part - self.low * part)
        return F.least(F.floor(share * BUCKETS).cast("int"), F.lit(BUCKETS - 1))


def _start(name: str, row, ranks: list[int], found: dict) -> list[_Interval]:
    """Infinite values are known at once; the finite ones make the first interval."""
    inside = []
    for rank in ranks:
        if rank <= row["below"]:
            found[name, rank] = float("-inf")
        elif rank > row["n"] - row["above"]:
            found[name, rank] = float("inf")
        elif row["low"] == row["high"]:
            found[name, rank] = row["low"]
        else:
            inside.append(rank)
    return [_Interval(name, row["low"], row["high"], row["below"], inside)] if inside else []


def selected(df: DataFrame, wanted: dict[str, Callable[[int], list[int]]]) -> dict[str, dict[int, float]]:
    """For each numeric column the values at the ranks that `wanted` gives for its number of values (from 1).

    Selection by histograms: one scan counts the values of every column in buckets between the least and
    the largest one; the next looks into the buckets that hold wanted ranks, between their own extremes, until a bucket
    has one value. All columns share each scan, and what leaves the tasks is at most `BUCKETS` counts for each interval. NaN and
    null do not count.
    """
    columns = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in wanted]
    values = df.select(*columns)

    def profile(c: str):
        v = F.col(f"`{c}`")
        finite = F.when(F.abs(v) < float("inf"), v)
        parts = [F.count(v).alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high"), F.count_if(v == float("-inf")).alias("below"), F.count_if(v == float("inf")).alias("above")]
        return F.struct(*parts).alias(c)

    first = values.agg(*[profile(c) for c in wanted]).first()
    found: dict[tuple[str, int], float] = {}
    open_intervals = [i for c, ranks in wanted.items() for i in _start(c, first[c], ranks(first[c]["n"]), found)]
    while open_intervals:
        asked = [
            F.when(F.col(f"`{i.name}`").between(i.low, i.high), F.struct(F.lit(at).alias("at"), i.bucket().alias("bucket"), F.col(f"`{i.name}`").alias("value")))
            for at, i in enumerate(open_intervals)
        ]
        placed = values.select(F.inline(F.filter(F.array(*asked), lambda x: x.isNotNull())))
        counts = placed.groupBy("at", "bucket").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        buckets: dict[int, list] = {}
        for r in sorted(counts.collect(), key=lambda r: (r["at"], r["bucket"])):
            buckets.setdefault(r["at"], []).append(r)
        following = []
        for at, interval in enumerate(open_intervals):
            upto, ranks = interval.before, sorted(interval.ranks)
            for r in buckets[at]:
                inside = [k for k in ranks if upto < k <= upto + r["n"]]
                if inside and r["low"] == r["high"]:
                    found.update({(interval.name, k): r["low"] for k in inside})
                elif inside:
                    following.append(_Interval(interval.name, r["low"], r["high"], upto, inside))
                upto += r["n"]
        open_intervals = following
    out: dict[str, dict[int, float]] = {c: {} for c in wanted}
    for (name, rank), value in found.items():
        out[name][rank] = value
    return out


def exact_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, median) with the mean of the two middle values; columns without values are absent."""

    def middle(n: int) -> list[int]:
        return sorted({(n + 1) // 2, n // 2 + 1}) if n else []

    values = selected(df, {c: middle for c in columns})
    rows = [(c, (min(v.values()) + max(v.values())) / 2) for c, v in values.items() if v]
    return df.sparkSession.createDataFrame(rows, "name string, median double")


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, mode) per text column; the lowest of equally frequent values."""
    counts = value_counts(df, columns, "string")
    return counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))


def group_modes(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Mode of each column per group, the lowest of equally frequent values."""
    cast = df.select(key, *[F.col(c).cast("string").alias(c) for c in columns])
    long = cast.unpivot([key], columns, "name", "value").filter(F.col("value").isNotNull())
    counts = long.groupBy(key, "name", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy(key, "name").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))
    picked = [F.max(F.when(F.col("name") == c, F.col("mode"))).alias(c) for c in columns]
    return best.groupBy(key).agg(*picked)
