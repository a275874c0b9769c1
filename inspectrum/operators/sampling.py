"""Samples of an exact size, chosen by hash.

`xxhash64` of one 64-bit number is a bijection, so unique row numbers have unique
hashes and a single cut-off value selects an exact number of rows. Membership is then
a plain filter: no sort, no shuffle of rows, the same answer after a task is retried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectrum.sources.schema import ROW_NO

_DIGIT_BITS = 12


def row_hash(row_no: str = ROW_NO, seed: int = 42) -> Column:
    """Unsigned order is not needed: any fixed order of the hashes will do."""
    return F.xxhash64(F.col(row_no).bitwiseXOR(F.lit(seed).cast("bigint")))


def hash_cutoff(df: DataFrame, n: int, row_no: str = ROW_NO, seed: int = 42) -> int | None:
    """Value v for which exactly `n` rows have hash <= v; None when every row is needed.

    Counts the rows per leading bits and keeps the bucket that holds the n-th row, at most
    until a bucket is one hash. A step brings at most 4096 counts to the driver.
    """
    hashes = df.select(row_hash(row_no, seed).alias("h"))
    wanted, shift = n, 64
    while True:
        shift = max(0, shift - _DIGIT_BITS)
        buckets = hashes.groupBy(F.shiftright("h", shift).alias("b")).agg(F.count("*").alias("n"))
        for bucket, size in sorted((r["b"], r["n"]) for r in buckets.collect()):
            if wanted <= size:
                break
            wanted -= size
        else:
            return None
        if wanted == size:
            # Every row of this bucket and of the buckets before it.
            return ((bucket + 1) << shift) - 1
        hashes = hashes.filter(F.shiftright("h", shift) == bucket)


def exact_sample(df: DataFrame, n: int, row_no: str = ROW_NO, seed: int = 42) -> DataFrame:
    """`n` rows chosen by hash, or all rows when there are no more than `n`."""
    if n <= 0:
        return df.limit(0)
    cutoff = hash_cutoff(df, n, row_no, seed)
    return df if cutoff is None else df.filter(row_hash(row_no, seed) <= F.lit(cutoff))
