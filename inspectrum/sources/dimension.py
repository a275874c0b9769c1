"""Defect-code dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectrum.functions.text import repair_mojibake, to_whole_number
from inspectrum.sources.inspections import scan_csv
from inspectrum.sources.schema import DIMENSION_COLUMNS, ROW_NO


def read_dimension(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All-string scan by header names; the row number goes by file and position. A column that no file has is null."""
    rows = scan_csv(spark, *([path] if isinstance(path, str) else path))
    missing = {c: F.lit(None).cast("string") for c in DIMENSION_COLUMNS if c not in rows.columns}
    return rows.withColumns(missing).select(*DIMENSION_COLUMNS, ROW_NO)


def defect_names(dimension: DataFrame) -> DataFrame:
    """id text → name of the specific defects; the last row of a repeated id wins."""
    rows = dimension.filter((F.col("TYYP") == "NIMETUS") & F.col("ID").isNotNull())
    named = rows.filter(F.col("NIMETUS").isNotNull())
    return named.groupBy(F.col("ID").cast("string").alias("rike_id")).agg(
        F.max_by(repair_mojibake(F.col("NIMETUS")), F.col(ROW_NO)).alias("nimetus")
    )


def typed_dimension(dimension: DataFrame) -> DataFrame:
    """Repaired names and a numeric id, all entry types kept."""
    return dimension.withColumns(
        {"NIMETUS": repair_mojibake(F.col("NIMETUS")), "ID": to_whole_number(F.col("ID"))}
    )


def known_ids(dimension: DataFrame) -> DataFrame:
    """Distinct numeric ids of every entry type."""
    ids = dimension.select(to_whole_number(F.col("ID").cast("string")).alias("defect_id"))
    return ids.dropna().distinct()
