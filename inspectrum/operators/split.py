"""Train and test splits."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectrum.operators.cleaning import TARGET
from inspectrum.operators.sampling import hash_cutoff, row_hash
from inspectrum.sources.schema import ROW_NO


@dataclass
class Split:
    train: DataFrame
    test: DataFrame
    info: dict = field(default_factory=dict)


def _year_counts(df: DataFrame, target: str) -> list[tuple[int, int, int]]:
    """(year, rows, passes): one row per inspection year reaches the driver."""
    rows = df.filter(F.col("YV_AASTA").isNotNull()).groupBy("YV_AASTA")
    counts = rows.agg(F.count("*").alias("n"), F.sum(target).alias("p")).collect()
    return sorted((int(r["YV_AASTA"]), int(r["n"]), int(r["p"])) for r in counts)


def _has_both_classes(counts: list[tuple[int, int, int]]) -> bool:
    n, passes = sum(c[1] for c in counts), sum(c[2] for c in counts)
    return 0 < passes < n


def temporal_split(df: DataFrame, holdout_years: int = 1, target: str = TARGET) -> Split | None:
    """Hold out the latest years; None unless both sides have both classes."""
    counts = _year_counts(df, target)
    if len(counts) <= holdout_years:
        return None
    before, after = counts[:-holdout_years], counts[-holdout_years:]
    if not (_has_both_classes(before) and _has_both_classes(after)):
        return None
    years = ([c[0] for c in before], [c[0] for c in after])
    info = {
        "type": "temporal",
        "train_years": years[0],
        "test_years": years[1],
        "train_rows": sum(c[1] for c in before),
        "test_rows": sum(c[1] for c in after),
    }
    in_years = [F.col("YV_AASTA").isin(y) for y in years]
    return Split(df.filter(in_years[0]), df.filter(in_years[1]), info)


def _allocate(sizes: dict[int, int], total: int) -> dict[int, int]:
    """Share `total` in proportion to the class sizes, largest remainders rounded up."""
    n = sum(sizes.values())
    exact = {c: total * s / n for c, s in sizes.items()}
    given = {c: math.floor(v) for c, v in exact.items()}
    spare = total - sum(given.values())
    for c in sorted(exact, key=lambda c: (given[c] - exact[c], c))[:spare]:
        given[c] += 1
    return given


def stratified_split(
    df: DataFrame, test_share: float = 0.2, target: str = TARGET, row_no: str = ROW_NO, seed: int = 42
) -> Split:
    """Exact-size split: ceil(share · n) test rows, shared over the classes."""
    sizes = {int(r[target]): int(r["n"]) for r in df.groupBy(target).agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    share = _allocate(sizes, math.ceil(test_share * n)) if n else {}
    in_test = F.lit(False)
    for label, wanted in share.items():
        if wanted:
            cutoff = hash_cutoff(df.filter(F.col(target) == label), wanted, row_no, seed)
            below = F.lit(True) if cutoff is None else row_hash(row_no, seed) <= F.lit(cutoff)
            in_test = in_test | ((F.col(target) == label) & below)
    info = {
        "type": "stratified_random",
        "train_rows": n - sum(share.values()),
        "test_rows": sum(share.values()),
    }
    return Split(df.filter(~in_test), df.filter(in_test), info)


def prepare_data(model_frame: DataFrame, holdout_years: int = 1) -> Split:
    """Temporal split when the years allow it, otherwise the stratified one."""
    labelled = model_frame.dropna(subset=[TARGET])
    return temporal_split(labelled, holdout_years) or stratified_split(labelled)
