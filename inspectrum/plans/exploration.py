"""Exploratory summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectrum.functions.bands import exploratory_age_band, half_even
from inspectrum.functions.defects import SEVERITIES
from inspectrum.operators.cleaning import TARGET, is_fail, is_pass, is_regular
from inspectrum.sources.schema import YEAR


def raw_summary(df: DataFrame, year: str = YEAR) -> DataFrame:
    """Rows and decisions per source year, over all inspection types."""
    counts = df.groupBy(year).agg(
        F.count("*").alias("ridu"),
        F.count_if(is_regular()).alias("korralisi"),
        F.count_if(is_pass()).alias("otsus_korras"),
        F.count_if(is_fail()).alias("otsus_korduvale"),
        F.count("RIKKED").alias("rikked_taidetud"),
    )
    return counts.withColumn("korraliste_osakaal", half_even(F.lit(100.0) * F.col("korralisi") / F.col("ridu"), 1))


def clean_summary(cleaned: DataFrame) -> DataFrame:
    """Six measures as (name, value) rows."""
    measures = {
        "toorandmete ridu": F.count("*"),
        "mudeli sihttunnusega ridu": F.count(TARGET),
        "puudulike kriitiliste andmetega ridu": F.sum("ANDMED_PUUDULIKUD"),
        "ebapuuduva vanusega ridu": F.count("VANUS"),
        "vähemalt ühe rikkega ridu": F.count_if(F.col("RIKETE_ARV") > 0),
        "keskmine esimese korraga läbimise määr": half_even(F.avg(TARGET), 3),
    }
    one = cleaned.agg(*[value.cast("double").alias(name) for name, value in measures.items()])
    return one.unpivot([], list(measures), "mootdik", "vaartus")


def pass_rate_by_year_and_age(cleaned: DataFrame) -> DataFrame:
    rows = cleaned.dropna(subset=[TARGET, "VANUS", "YV_AASTA"])
    grouped = rows.groupBy("YV_AASTA", exploratory_age_band(F.col("VANUS")).alias("vanusegrupp"))
    return grouped.agg(F.count("*").alias("kokku"), F.avg(TARGET).alias("labimise_maar"))


def common_marks(cleaned: DataFrame, min_rows: int = 300, n: int = 20) -> DataFrame:
    """Largest makes with enough rows and their pass rate."""
    rows = cleaned.dropna(subset=[TARGET, "MARK"])
    counts = rows.groupBy("MARK").agg(F.count("*").alias("kokku"), F.avg(TARGET).alias("labimise_maar"))
    return counts.filter(F.col("kokku") >= min_rows).orderBy(F.desc("kokku"), "MARK").limit(n)


def severity_by_year(cleaned: DataFrame) -> DataFrame:
    """Defect entries per year and severity in long form; rows without a year are left out."""
    names = [f"{s}_ARV" for s in SEVERITIES]
    sums = cleaned.filter(F.col("YV_AASTA").isNotNull()).groupBy("YV_AASTA").agg(*[F.sum(c).alias(c) for c in names])
    long = sums.unpivot(["YV_AASTA"], names, "raskusaste", "rikkeid")
    return long.withColumn("raskusaste", F.regexp_replace("raskusaste", "_ARV$", ""))
