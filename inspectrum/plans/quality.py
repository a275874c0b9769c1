"""Validation reports, one row per source year, all years in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectrum.functions import defects as D
from inspectrum.functions.text import has_text, to_int, year_of
from inspectrum.operators.cleaning import TARGET, is_decided, is_regular
from inspectrum.sources.schema import YEAR


def _blank(name: str):
    return ~has_text(F.col(name))


def scalar_profile(df: DataFrame, year: str = YEAR) -> DataFrame:
    """Row counts by kind, missing and invalid values, and the unbounded age range."""
    reg = to_int(F.col("ESMANE_REG_AASTA"))
    age = year_of(F.col("YV_KUUPAEV")) - reg
    rows = df.withColumns({"__reg": reg, "__age": age})
    age = F.col("__age")
    return rows.groupBy(F.col(year).alias("year")).agg(
        F.count("*").alias("rows_total"),
        F.count_if(is_regular()).alias("regular_rows"),
        F.count_if(is_regular() & is_decided()).alias("target_rows"),
        F.count_if(is_regular() & ~is_decided()).alias("regular_other_decision_rows"),
        F.count_if(_blank("SOIDUK_ID")).alias("missing_vehicle_id_rows"),
        F.count_if(_blank("MARK")).alias("missing_mark_rows"),
        F.count_if(F.col("__reg").isNull()).alias("invalid_reg_year_rows"),
        F.count_if((age < 0) | (age > 100)).alias("invalid_age_rows"),
        F.min(age).alias("min_vehicle_age"),
        F.max(age).alias("max_vehicle_age"),
        F.count_if(has_text(F.col("RIKKED"))).alias("rikked_nonempty_rows"),
    )


def entry_counts(df: DataFrame, year: str = YEAR) -> DataFrame:
    """(year, class, defect_id, n): every entry of the defect column, classified and counted.

    Ids are kept for parsed entries only, so the result has one row per distinct id.
    """
    e = F.col("e")
    entries = df.select(F.col(year).alias("year"), F.explode(D.strict_entries(F.col("RIKKED"))).alias("e"))
    fields = entries.select(
        "year", D.has_colon(e).alias("colon"), D.strict_severity(e).alias("severity"), D.strict_id(e).alias("id")
    )
    kind = D.entry_class(F.col("colon"), F.col("severity"), F.col("id"))
    classified = fields.select("year", kind.alias("class"), "id")
    defect_id = F.when(F.col("class") == "parsed", F.col("id"))
    return classified.groupBy("year", "class", defect_id.alias("defect_id")).agg(F.count("*").alias("n"))


def missing_ids(counts: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (year, id) of parsed entries that the dimension does not have."""
    parsed = counts.filter(F.col("class") == "parsed").select("year", "defect_id")
    return parsed.distinct().join(known, "defect_id", "left_anti")


def _has_rows(known: DataFrame | None) -> bool:
    return known is not None and not known.isEmpty()


def defect_profile(df: DataFrame, known: DataFrame | None, year: str = YEAR) -> DataFrame:
    """Parsed, malformed and unknown entries, distinct ids and ids absent from the dimension.

    The last figure is NULL when there is no dimension or it is empty.
    """
    return _defect_profile(df, known if _has_rows(known) else None, year)


def _defect_profile(df: DataFrame, known: DataFrame | None, year: str) -> DataFrame:
    counts = entry_counts(df, year)
    has_known = known is not None
    if has_known:
        flagged = counts.join(known.select("defect_id", F.lit(1).alias("known")), "defect_id", "left")
    else:
        flagged = counts.withColumn("known", F.lit(1))

    def entries(kind: str):
        return F.sum(F.when(F.col("class") == kind, F.col("n")).otherwise(0))

    parsed = F.col("class") == "parsed"
    absent = F.count_if(parsed & F.col("known").isNull()) if has_known else F.lit(None).cast("bigint")
    return flagged.groupBy("year").agg(
        entries("parsed").alias("parsed_defects"),
        entries("malformed").alias("malformed_defect_entries"),
        entries("unknown").alias("unknown_severity_entries"),
        F.count_if(parsed).alias("unique_defect_ids"),
        absent.alias("defect_ids_missing_from_rike"),
    )


def validation_report(df: DataFrame, known: DataFrame | None, year: str = YEAR) -> DataFrame:
    """Both profiles per year, in year order; a year without entries has zero counts."""
    known = known if _has_rows(known) else None
    profile, found = scalar_profile(df, year), _defect_profile(df, known, year)
    joined = profile.join(found, profile["year"].eqNullSafe(found["year"]), "left").drop(found["year"])
    zero = [c for c in found.columns if c not in ("year", "defect_ids_missing_from_rike")]
    report = joined.fillna(0, subset=zero)
    if known is not None:
        report = report.fillna(0, subset=["defect_ids_missing_from_rike"])
    return report.orderBy("year")


def cleaning_summary(cleaned: DataFrame) -> DataFrame:
    """Rows, age range, pass percentage, rows with defects and percentage of incomplete rows."""
    return cleaned.agg(
        F.count("*").alias("ridu"),
        F.min("VANUS").alias("vanus_min"),
        F.max("VANUS").alias("vanus_max"),
        F.round(F.avg(TARGET) * 100.0, 1).alias("labimise_protsent"),
        F.count_if(F.col("RIKETE_ARV") > 0).alias("riketega_ridu"),
        F.round(F.avg("ANDMED_PUUDULIKUD") * 100.0, 1).alias("puudulike_protsent"),
    )
