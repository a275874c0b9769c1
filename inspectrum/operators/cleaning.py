"""Cleaning steps and the two documented cleaning flavours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectrum.functions import defects as D
from inspectrum.functions.bands import half_even
from inspectrum.functions.text import month_of, repair_mojibake, strip, to_whole_number, year_of
from inspectrum.sources.workspace import materialize

TARGET = "LABIS_ESIMESEL"

# Columns stripped by the model flavour and by the exploratory flavour.
MODEL_TEXT_COLUMNS = [
    "TEHNOYLEVAATUSPUNKT",
    "PUNKTI_KOOD",
    "YV_KUUPAEV",
    "YLEVAATUSLIIK",
    "YLEVAATUSOTSUS",
    "MARK",
    "MUDEL",
    "KATEGOORIA",
    "KERETYYP",
]
EXPLORATORY_TEXT_COLUMNS = [*MODEL_TEXT_COLUMNS, "TOOTAJA", "RIKKED", "SOIDUK_ID"]

# Columns whose encoding is repaired by the batch flavour.
REPAIRED_COLUMNS = [
    "TEHNOYLEVAATUSPUNKT",
    "TOOTAJA",
    "MARK",
    "MUDEL",
    "KERETYYP",
    "YLEVAATUSLIIK",
    "YLEVAATUSOTSUS",
    "RIKKED",
]

# Columns whose absence marks a row as incomplete.
BATCH_CRITICAL = ["SOIDUK_ID", "MARK", "ESMANE_REG_AASTA"]
MODEL_CRITICAL = [*BATCH_CRITICAL, "VANUS"]


def is_regular() -> Column:
    return F.col("YLEVAATUSLIIK") == "KORRALINE"


def is_pass() -> Column:
    return F.col("YLEVAATUSOTSUS") == "KORRAS"


def is_fail() -> Column:
    return F.col("YLEVAATUSOTSUS") == "KORDUVALE"


def is_decided() -> Column:
    return F.col("YLEVAATUSOTSUS").isin("KORRAS", "KORDUVALE")


def _on_present(df: DataFrame, columns: list[str], fn) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in columns if c in df.columns})


def strip_text(df: DataFrame, columns: list[str] = MODEL_TEXT_COLUMNS) -> DataFrame:
    return _on_present(df, columns, strip)


def repair_encoding(df: DataFrame, columns: list[str] = REPAIRED_COLUMNS) -> DataFrame:
    return _on_present(df, columns, repair_mojibake)


def coerce_types(df: DataFrame) -> DataFrame:
    """Numeric vehicle id and registration year; inspection year and month."""
    typed = _on_present(df, ["SOIDUK_ID", "ESMANE_REG_AASTA"], to_whole_number)
    return typed.withColumns(
        {"YV_AASTA": year_of(F.col("YV_KUUPAEV")), "YV_KUU": month_of(F.col("YV_KUUPAEV"))}
    )


def add_age(df: DataFrame) -> DataFrame:
    """Inspection year minus registration year, NULL outside 0 to 100."""
    age = (F.col("YV_AASTA") - F.col("ESMANE_REG_AASTA")).cast("int")
    return df.withColumn("VANUS", F.when(age.between(0, 100), age))


def add_target(df: DataFrame) -> DataFrame:
    """1 for a passed and 0 for a failed regular inspection, NULL otherwise."""
    return df.withColumn(TARGET, F.when(is_regular() & is_pass(), 1).when(is_regular() & is_fail(), 0))


def flag_incomplete(df: DataFrame, critical: list[str]) -> DataFrame:
    missing = F.lit(False)
    for name in critical:
        if name in df.columns:
            missing = missing | F.col(name).isNull()
    return df.withColumn("ANDMED_PUUDULIKUD", missing.cast("int"))


def expand_defects(df: DataFrame) -> DataFrame:
    """Counts by severity and the id list, parsed once per row."""
    parsed = df.withColumn("__parsed", D.parse_strict(F.col("RIKKED")))
    p = F.col("__parsed")
    return parsed.withColumns(
        {
            "RIKETE_ARV": F.size(p),
            **{f"{s}_ARV": D.count_severity(p, s) for s in D.SEVERITIES},
            "RIKE_IDS": D.defect_ids(p),
        }
    ).drop("__parsed")


def station_strictness(df: DataFrame, min_rows: int = 50) -> DataFrame:
    """Fail percentage per station code over regular rows with a decision."""
    return (
        df.filter(is_regular())
        .groupBy("PUNKTI_KOOD")
        .agg(F.count("YLEVAATUSOTSUS").alias("kokku"), F.count_if(is_fail()).alias("kukkus_labi"))
        .filter(F.col("kokku") >= min_rows)
        .withColumn("PUNKTI_RANGUS", half_even(F.col("kukkus_labi") / F.col("kokku") * 100.0, 2))
    )


def add_station_strictness(df: DataFrame, min_rows: int = 50) -> DataFrame:
    """PUNKTI_RANGUS joined back by station code.

    The statistics are written first: their size is then known and the rows are not
    shuffled by station.
    """
    stats = station_strictness(df, min_rows).select("PUNKTI_KOOD", "PUNKTI_RANGUS")
    return df.join(materialize(stats, "station-strictness"), "PUNKTI_KOOD", "left")


def clean_for_model(df: DataFrame) -> DataFrame:
    """Model flavour: strip, coerce, age, target, flag over four columns."""
    return (
        df.transform(strip_text)
        .transform(coerce_types)
        .transform(add_age)
        .transform(add_target)
        .transform(flag_incomplete, MODEL_CRITICAL)
    )


def clean_for_exploration(df: DataFrame) -> DataFrame:
    """Model flavour over more text columns, with the defect columns added."""
    return (
        df.transform(strip_text, EXPLORATORY_TEXT_COLUMNS)
        .transform(coerce_types)
        .transform(add_age)
        .transform(expand_defects)
        .transform(add_target)
        .transform(flag_incomplete, MODEL_CRITICAL)
    )


def clean_batch(df: DataFrame) -> DataFrame:
    """Batch flavour: repair encoding, no stripping, flag over three columns, strictness joined."""
    return (
        df.transform(repair_encoding)
        .transform(coerce_types)
        .transform(add_age)
        .transform(expand_defects)
        .transform(add_target)
        .transform(flag_incomplete, BATCH_CRITICAL)
        .transform(add_station_strictness)
    )
