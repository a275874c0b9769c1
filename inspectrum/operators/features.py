"""Model frames and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectrum.functions.bands import body_code, category_group, month_cos, month_sin, smoothed
from inspectrum.operators.cleaning import TARGET, clean_for_model
from inspectrum.operators.encoder import RATE_SPECS
from inspectrum.operators.history import add_frequencies, add_previous_count, frequencies
from inspectrum.operators.ordered import exact_medians
from inspectrum.operators.scalars import beside
from inspectrum.sources.schema import ROW_NO
from inspectrum.sources.workspace import materialize

# Feature lists of the pass/fail model.
NUMERIC_FEATURES = [
    "VANUS",
    "VANUS_RUUT",
    "ON_VANA",
    "KUU_SIN",
    "KUU_COS",
    "MARK_SAGEDUS",
    "MUDEL_SAGEDUS",
    "EELMISED_YV",
]
RATE_FEATURES = list(RATE_SPECS)
CATEGORICAL_FEATURES = ["MARK", "KATEGOORIA", "KERETYYP", "PUNKTI_KOOD"]
RATE_SOURCES = ["MARK", "MUDEL", "KATEGOORIA", "KERETYYP", "PUNKTI_KOOD"]
FEATURES = NUMERIC_FEATURES + RATE_SOURCES

# Features computed from the target over all rows, never model inputs.
LEAKAGE_PRONE_FEATURES = ["MARK_LABIMISE_MAAR", "MUDEL_LABIMISE_MAAR", "PUNKTI_RANGUS"]


def add_age_and_season(df: DataFrame) -> DataFrame:
    age, month = F.col("VANUS"), F.col("YV_KUU")
    return df.withColumns(
        {
            "VANUS_RUUT": age * age,
            "ON_VANA": (age > 10).cast("int"),
            "KUU_SIN": month_sin(month),
            "KUU_COS": month_cos(month),
        }
    )


def create_model_frame(df: DataFrame, row_no: str = ROW_NO) -> DataFrame:
    """Target-free features over all labelled rows; raw rows are cleaned first."""
    cleaned = df if TARGET in df.columns else clean_for_model(df)
    rows = cleaned.dropna(subset=[TARGET, "VANUS", "YV_KUU", "YV_AASTA"])
    rows = add_age_and_season(rows.drop("MARK_SAGEDUS", "MUDEL_SAGEDUS", "EELMISED_YV"))
    for name in RATE_SOURCES:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    # Three scans follow: the text is parsed once, before them.
    rows = materialize(rows, "model-rows")
    # Counted before the previous inspections, which neither drop nor repeat a row: this scan needs no ranks.
    counts = frequencies(rows)
    if "SOIDUK_ID" in rows.columns:
        rows = add_previous_count(rows, row_no=row_no)
    else:
        rows = rows.withColumn("EELMISED_YV", F.lit(0))
    rows = add_frequencies(rows, counts)
    if "MUDEL" not in cleaned.columns:
        rows = rows.withColumn("MUDEL_SAGEDUS", F.lit(0))
    return rows.withColumns({c: F.col(c).cast("double") for c in NUMERIC_FEATURES})


def create_exploratory_features(df: DataFrame, row_no: str = ROW_NO, smoothing: float = 100.0) -> DataFrame:
    """Older feature matrix with pass rates over all rows: for exploration, not for the model."""
    rows = df.dropna(subset=[TARGET, "VANUS", "MARK", "KATEGOORIA", "KERETYYP"])
    counts = rows.groupBy("MARK", "MUDEL").agg(F.count("*").alias("n"), F.sum(TARGET).alias("p"))
    pairs = materialize(counts, "pair-stats")
    total = pairs.agg(F.sum("n").alias("n"), F.sum("p").alias("p")).first()
    overall = F.lit(total["p"] / total["n"] if total["n"] else None).cast("double")

    def stats(key: str, freq: str, rate: str) -> DataFrame:
        sums = pairs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
        table = sums.select(
            key, F.col("n").alias(freq), smoothed(F.col("p"), F.col("n"), overall, smoothing).alias(rate)
        )
        return materialize(table, "key-stats")

    rows = add_previous_count(rows, order=(), row_no=row_no)
    rows = rows.join(stats("MARK", "MARK_SAGEDUS", "MARK_LABIMISE_MAAR"), "MARK", "left")
    rows = rows.join(stats("MUDEL", "MUDEL_SAGEDUS", "MUDEL_LABIMISE_MAAR"), "MUDEL", "left")
    return add_age_and_season(rows).withColumns(
        {
            "MUDEL_SAGEDUS": F.coalesce("MUDEL_SAGEDUS", F.lit(0)),
            "KERETYYP_KOOD": body_code(F.col("KERETYYP")),
            "KAT_GRUPP": category_group(F.col("KATEGOORIA")),
        }
    )


def make_lookup(model_frame: DataFrame) -> DataFrame:
    """Rows per make."""
    return model_frame.filter(F.col("MARK").isNotNull()).groupBy("MARK").agg(F.count("*").alias("sagedus"))


def model_lookup(model_frame: DataFrame) -> DataFrame:
    """Rows per (make, model)."""
    named = model_frame.dropna(subset=["MARK", "MUDEL"])
    return named.groupBy("MARK", "MUDEL").agg(F.count("*").alias("sagedus"))


def options(model_frame: DataFrame) -> DataFrame:
    """(name, value): distinct categories, body types and station codes."""
    columns = ["KATEGOORIA", "KERETYYP", "PUNKTI_KOOD"]
    long = model_frame.select(*columns).unpivot([], columns, "name", "value")
    return long.filter(F.col("value").isNotNull()).distinct()


def lookup_defaults(model_frame: DataFrame) -> DataFrame:
    """One row: median make and model frequency (truncated) and the latest year."""
    medians = exact_medians(model_frame, ["MARK_SAGEDUS", "MUDEL_SAGEDUS"])

    def median_of(name: str):
        return F.max(F.when(F.col("name") == name, F.col("median"))).cast("bigint")

    latest = model_frame.agg(F.max("YV_AASTA").alias("latest_training_year"))
    picked = medians.agg(
        median_of("MARK_SAGEDUS").alias("default_mark_frequency"),
        median_of("MUDEL_SAGEDUS").alias("default_model_frequency"),
    )
    return beside(picked, latest)
