"""Documented research questions, answered from aggregated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from inspectrum.functions import defects as D
from inspectrum.functions.bands import half_even
from inspectrum.operators.cleaning import TARGET, is_decided, is_fail, is_pass, is_regular
from inspectrum.operators.ordered import range_partitioned, running_totals
from inspectrum.operators.scalars import beside


def age_chi_square(cleaned: DataFrame, limit: int = 10) -> DataFrame:
    """Chi-square of (age <= limit, age > limit) × (pass, fail), without continuity correction."""
    rows = cleaned.dropna(subset=[TARGET, "VANUS"])
    young, passed = F.col("VANUS") <= limit, F.col(TARGET) == 1
    counts = rows.agg(
        F.count_if(young & passed).alias("a"),
        F.count_if(young & ~passed).alias("b"),
        F.count_if(~young & passed).alias("c"),
        F.count_if(~young & ~passed).alias("d"),
    )
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n, gap = a + b + c + d, a * d - b * c
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return counts.withColumn("chi2", F.when(margins != 0, n * gap * gap / margins))


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """U of the rows with `group` = 1 against `group` = 0, ties counted half.

    Computed on counts per distinct value, so no task sorts the rows.
    """
    counts = df.dropna(subset=[group, value]).groupBy(F.col(value).cast("double").alias("value")).agg(
        F.count_if(F.col(group) == 1).alias("n1"), F.count_if(F.col(group) == 0).alias("n0")
    )
    ranged = range_partitioned(counts, ["value"], "mann-whitney")
    running = running_totals(ranged, "value", {"n0_upto": "n0"})
    wins = F.col("n1") * (F.col("n0_upto") - F.col("n0") + F.col("n0") / 2.0)
    return running.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum(wins).alias("u"))


def premium_against_budget(
    cleaned: DataFrame, premium: list[str], budget: list[str], ages: tuple[int, int] = (5, 15)
) -> DataFrame:
    """Mann–Whitney U of the pass flag between two lists of makes inside an age range."""
    group = F.when(F.col("MARK").isin(premium), 1).when(F.col("MARK").isin(budget), 0)
    rows = cleaned.filter(F.col("VANUS").between(*ages)).select(group.alias("group"), TARGET)
    return mann_whitney(rows, "group", TARGET)


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rank with ties sharing their mean rank; `df` is an aggregated report."""
    counts = df.groupBy(column).agg(F.count("*").alias("__n"))
    running = running_totals(range_partitioned(counts, [column], "ranks"), column, {"__upto": "__n"})
    ranks = running.select(column, (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(name))
    return df.join(ranks, column)


def station_volume_correlation(df: DataFrame, min_rows: int = 1) -> DataFrame:
    """Pearson and Spearman correlation of station volume and fail percentage."""
    rows = df.filter(is_regular() & is_decided() & F.col("PUNKTI_KOOD").isNotNull())
    stations = rows.groupBy("PUNKTI_KOOD").agg(
        F.count("*").cast("double").alias("maht"), (F.count_if(is_fail()) * 100.0 / F.count("*")).alias("kukkumine")
    )
    stations = stations.filter(F.col("maht") >= min_rows)
    ranked = average_rank(average_rank(stations, "maht", "maht_aste"), "kukkumine", "kukkumine_aste")
    return ranked.agg(
        F.count("*").alias("jaamu"),
        F.corr("maht", "kukkumine").alias("pearson"),
        F.corr("maht_aste", "kukkumine_aste").alias("spearman"),
    )


def outcome_by_type_and_year(cleaned: DataFrame) -> DataFrame:
    """Passed and failed regular inspections per category and year."""
    rows = cleaned.dropna(subset=[TARGET, "KATEGOORIA", "YV_AASTA"])
    counts = rows.groupBy("KATEGOORIA", "YV_AASTA").agg(
        F.count_if(F.col(TARGET) == 1).alias("labis"), F.count_if(F.col(TARGET) == 0).alias("kukkus")
    )
    return counts.withColumn(
        "labimise_protsent", half_even(F.lit(100.0) * F.col("labis") / (F.col("labis") + F.col("kukkus")), 1)
    )


def station_type_mix(df: DataFrame) -> DataFrame:
    """Share of each vehicle category at each station."""
    counts = (
        df.filter(F.col("PUNKTI_KOOD").isNotNull() & F.col("KATEGOORIA").isNotNull())
        .groupBy("PUNKTI_KOOD", "KATEGOORIA")
        .agg(F.count("*").alias("arv"))
    )
    station = W.partitionBy("PUNKTI_KOOD")
    share = F.lit(100.0) * F.col("arv") / F.sum("arv").over(station)
    return counts.withColumn("osakaal_protsent", half_even(share, 2))


def similar_failure_patterns(df: DataFrame, n: int = 10) -> DataFrame:
    """Jaccard similarity of the top-n defect lists of vehicle categories.

    Categories share a pair only when they share a defect: the join is on the defect
    id and sees at most n rows per category.
    """
    rows = df.filter(is_regular() & F.col("KATEGOORIA").isNotNull())
    counts = (
        rows.select("KATEGOORIA", F.explode(D.loose_defects(F.col("RIKKED"))["rike_id"]).alias("rike_id"))
        .groupBy("KATEGOORIA", "rike_id")
        .agg(F.count("*").alias("arv"))
    )
    order = W.partitionBy("KATEGOORIA").orderBy(F.desc("arv"), "rike_id")
    top = counts.withColumn("aste", F.row_number().over(order)).filter(F.col("aste") <= n)
    sized = top.withColumn("suurus", F.count("*").over(W.partitionBy("KATEGOORIA")))
    left = sized.select("rike_id", F.col("KATEGOORIA").alias("a"), F.col("suurus").alias("size_a"))
    right = sized.select("rike_id", F.col("KATEGOORIA").alias("b"), F.col("suurus").alias("size_b"))
    pairs = left.join(right, "rike_id").filter(F.col("a") < F.col("b"))
    shared = pairs.groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("uhiseid"))
    union = F.col("size_a") + F.col("size_b") - F.col("uhiseid")
    return shared.select("a", "b", "uhiseid", F.round(F.col("uhiseid") / union, 6).alias("jaccard"))
