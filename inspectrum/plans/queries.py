"""The named analytic queries. Each takes raw inspections and returns a small report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from inspectrum.functions import defects as D
from inspectrum.functions.bands import age_band, age_band_rank, percent
from inspectrum.functions.text import has_text, is_present, month_of, same_name, to_int, year_of
from inspectrum.operators.cleaning import is_decided, is_fail, is_pass, is_regular
from inspectrum.operators.heavy import top_counts
from inspectrum.sources.schema import YEAR


def top_marks(df: DataFrame, k: int = 3) -> DataFrame:
    """Most inspected makes, all inspection types."""
    counts = df.filter(is_present(F.col("MARK"))).groupBy("MARK").agg(F.count("*").alias("arv"))
    return counts.orderBy(F.desc("arv"), "MARK").limit(k)


def top_vehicles(df: DataFrame, k: int = 20) -> DataFrame:
    """Most inspected vehicles, all inspection types: nearly as many keys as rows, so tasks keep bounded counters."""
    return top_counts(df.filter(is_present(F.col("SOIDUK_ID"))), ["SOIDUK_ID"], k).withColumnRenamed("n", "arv")


def top_entries(df: DataFrame, k: int = 20) -> DataFrame:
    """Most frequent whole defect lists of a make and model, regular inspections alone."""
    rows = df.filter(is_regular() & is_present(F.col("RIKKED")))
    return top_counts(rows, ["MARK", "MUDEL", "RIKKED"], k).withColumnRenamed("n", "arv")


def top_models(df: DataFrame, marks: int = 3, models: int = 5) -> DataFrame:
    """Most inspected models inside each of the top makes."""
    # The broadcast side has `marks` rows.
    wanted = F.broadcast(top_marks(df, marks).select("MARK"))
    rows = df.filter(is_present(F.col("MUDEL"))).join(wanted, "MARK", "left_semi")
    counts = rows.groupBy("MARK", "MUDEL").agg(F.count("*").alias("arv"))
    best_first = W.partitionBy("MARK").orderBy(F.desc("arv"), "MUDEL")
    ranked = counts.withColumn("rnk", F.row_number().over(best_first)).filter(F.col("rnk") <= models)
    return ranked.orderBy("MARK", "rnk").select("MARK", "MUDEL", "arv")


def _strictness(df: DataFrame, keys: dict[str, str], present: str, min_rows: int) -> DataFrame:
    rows = df.filter(is_regular() & is_decided() & is_present(F.col(present)))
    return (
        rows.groupBy(*[F.col(c).alias(name) for name, c in keys.items()])
        .agg(
            F.count("*").alias("kokku"),
            F.count_if(is_pass()).alias("labis_esimesel"),
            F.count_if(is_fail()).alias("kukkus_esimesel"),
        )
        .filter(F.col("kokku") >= min_rows)
        .withColumn("labimise_protsent", percent(F.col("labis_esimesel"), F.col("kokku"), 1))
        .orderBy("labimise_protsent", *keys)
    )


def station_strictness(df: DataFrame, min_rows: int = 100) -> DataFrame:
    """Pass percentage per station, strictest first."""
    keys = {"jaam": "TEHNOYLEVAATUSPUNKT", "jaama_kood": "PUNKTI_KOOD"}
    return _strictness(df, keys, "TEHNOYLEVAATUSPUNKT", min_rows)


def inspector_strictness(df: DataFrame, min_rows: int = 50) -> DataFrame:
    """Pass percentage per inspector and station, strictest first."""
    keys = {"inspektori_kood": "TOOTAJA", "jaam": "TEHNOYLEVAATUSPUNKT", "jaama_kood": "PUNKTI_KOOD"}
    return _strictness(df, keys, "TOOTAJA", min_rows)


def with_registration_year(df: DataFrame) -> DataFrame:
    """Registration year as a number above 1900, and the unbounded age."""
    typed = df.withColumn("reg_aasta", to_int(F.col("ESMANE_REG_AASTA"))).filter(F.col("reg_aasta") > 1900)
    return typed.withColumn("vanus", year_of(F.col("YV_KUUPAEV")) - F.col("reg_aasta"))


def oldest_per_month(df: DataFrame, by_year: bool = False, passed: bool = True) -> DataFrame:
    """Oldest passed (or failed) regular vehicle of each month; ages are not bounded here.

    An ordered minimum per group: each task keeps one candidate per month.
    """
    rows = with_registration_year(df.filter(is_regular() & (is_pass() if passed else is_fail())))
    rows = rows.withColumns({"kuu": month_of(F.col("YV_KUUPAEV")), "aasta": year_of(F.col("YV_KUUPAEV"))})
    keys = ["aasta", "kuu"] if by_year else ["kuu"]
    fields = ["MARK", "MUDEL", "KERETYYP", "reg_aasta", "vanus"]
    order = F.struct(
        "reg_aasta", *[part for c in ("MARK", "MUDEL", "KERETYYP") for part in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))], "vanus"
    )
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("best"))
    return best.select(*keys, "best.*").orderBy(*keys)


def age_effect(df: DataFrame, mark: str | None = None) -> DataFrame:
    """Pass percentage by age band, for all makes or one make."""
    wanted = is_regular() & is_decided()
    if mark is not None:
        wanted = wanted & same_name(F.col("MARK"), mark)
    age = F.col("vanus")
    rows = with_registration_year(df.filter(wanted)).filter(age.between(0, 100))
    return (
        rows.groupBy(age_band(age).alias("vanusegrupp"), age_band_rank(age).alias("sorteering"))
        .agg(F.count("*").alias("kokku"), F.count_if(is_pass()).alias("labis_arv"))
        .withColumn("labimise_protsent", F.round(F.lit(100.0) * (F.col("labis_arv") / F.col("kokku")), 1))
        .orderBy("sorteering")
    )


def mark_pass_by_age(df: DataFrame, mark: str) -> DataFrame:
    return age_effect(df, mark)


def available_marks(df: DataFrame) -> DataFrame:
    marks = df.filter(is_present(F.col("MARK"))).select(F.upper("MARK").alias("mark"))
    return marks.distinct().orderBy("mark")


def defect_overview(df: DataFrame) -> DataFrame:
    """Regular inspections per year and how many had each severity; a flag per row, no regrouping."""
    rows = df.filter(is_regular()).select(
        year_of(F.col("YV_KUUPAEV")).alias("aasta"), "RIKKED", D.loose_entries(F.col("RIKKED")).alias("entries")
    )
    flags = [F.sum(D.has_severity(F.col("entries"), s)).alias(f"{s.lower()}_arv") for s in D.SEVERITIES]
    return (
        rows.groupBy("aasta")
        .agg(
            F.count("*").alias("kokku_ylevaatusi"),
            F.count_if(has_text(F.col("RIKKED"))).alias("riketega_ylevaatusi"),
            *flags,
        )
        .orderBy("aasta")
    )


def regular_defects(df: DataFrame, *keep: Column) -> DataFrame:
    """One row per counted defect of a regular inspection, plus `keep`."""
    rows = df.filter(is_regular() & is_present(F.col("RIKKED")))
    exploded = rows.select(*keep, F.explode(D.loose_defects(F.col("RIKKED"))).alias("d"))
    kept = [c for c in exploded.columns if c != "d"]
    return exploded.select(*kept, F.col("d.rike_id").alias("rike_id"), F.col("d.severity").alias("raskusaste"))


def _top_defect_counts(df: DataFrame, n: int) -> DataFrame:
    counts = regular_defects(df).groupBy("rike_id", "raskusaste").agg(F.count("*").alias("esinemisi"))
    return counts.orderBy(F.desc("esinemisi"), "rike_id", "raskusaste").limit(n)


def with_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """Add the defect name, '' when unknown; the planner broadcasts `names` only below its threshold."""
    return df.join(names, "rike_id", "left").withColumn("nimetus", F.coalesce("nimetus", F.lit("")))


def top_defects(df: DataFrame, names: DataFrame, n: int = 15) -> DataFrame:
    """Most frequent (defect, severity) pairs with names."""
    named = with_names(_top_defect_counts(df, n), names)
    return named.select("rike_id", "raskusaste", "esinemisi", "nimetus").orderBy(
        F.desc("esinemisi"), "rike_id", "raskusaste"
    )


def defects_by_mark_model_year(
    df: DataFrame,
    names: DataFrame,
    ids: DataFrame | None = None,
    n: int = 15,
    mark: str | None = None,
    model: str | None = None,
    reg_year: int | None = None,
) -> DataFrame:
    """How often the given defects (default: the top `n`) occur per make, model and registration year.

    `ids` has the column `rike_id`.
    """
    wanted = is_present(F.col("MARK"))
    if mark:
        wanted = wanted & same_name(F.col("MARK"), mark)
    if model:
        wanted = wanted & same_name(F.col("MUDEL"), model)
    reg = to_int(F.col("ESMANE_REG_AASTA"))
    if reg_year:
        wanted = wanted & (reg == int(reg_year))
    if ids is None:
        # At most n rows.
        ids = F.broadcast(_top_defect_counts(df, n).select("rike_id").distinct())
    else:
        ids = ids.select("rike_id").distinct()
    rows = regular_defects(df.filter(wanted), F.col("MARK"), F.col("MUDEL"), reg.alias("reg_aasta"))
    keys = ["MARK", "MUDEL", "reg_aasta", "rike_id", "raskusaste"]
    counts = rows.join(ids, "rike_id", "left_semi").groupBy(*keys).agg(F.count("*").alias("esinemisi"))
    named = with_names(counts, names)
    return named.select(*keys, "esinemisi", "nimetus").orderBy(F.desc("esinemisi"), *keys)


def mark_defect_totals(df: DataFrame) -> DataFrame:
    """Regular inspections and their defects per make, from one scan and one aggregation."""
    rows = df.filter(is_regular() & is_present(F.col("MARK")))
    found = rows.select("MARK", F.coalesce(D.loose_defects(F.col("RIKKED")), F.array()).alias("d"))
    by_severity = [F.sum(D.count_severity(F.col("d"), s)).alias(s.lower()) for s in D.SEVERITIES]
    return found.groupBy("MARK").agg(
        F.sum(F.size("d")).alias("rikeid_kokku"), F.count("*").alias("kokku_ylevaatusi"), *by_severity
    )


def defects_summary_by_mark(df: DataFrame, top_n: int = 20, min_per_year: int = 100, year: str = YEAR) -> DataFrame:
    """Makes with the most defects per 100 inspections; makes without any defect are left out.

    A make needs `min_per_year` inspections for each year that `df` holds.
    """
    n_years = df.agg(F.count_distinct(year)).scalar()
    totals = mark_defect_totals(df)
    enough = totals.filter((F.col("kokku_ylevaatusi") >= n_years * min_per_year) & (F.col("rikeid_kokku") > 0))
    rate = F.round(F.col("rikeid_kokku") * F.lit(100.0) / F.col("kokku_ylevaatusi"), 2)
    return (
        enough.withColumn("rikeid_protsent", rate)
        .select("MARK", "rikeid_kokku", "kokku_ylevaatusi", "rikeid_protsent", "vo", "ov", "eov")
        .orderBy(F.desc("rikeid_protsent"), "MARK")
        .limit(top_n)
    )


def extremes(strictness: DataFrame, n: int, strictest: bool = True, station: str | None = None) -> DataFrame:
    """Strictest or most lenient rows of a strictness report, optionally of one station."""
    rows = strictness if station is None else strictness.filter(F.col("jaam") == station)
    keys = [c for c in ("inspektori_kood", "jaam", "jaama_kood") if c in rows.columns]
    direction = F.asc if strictest else F.desc
    return rows.orderBy(direction("labimise_protsent"), *keys).limit(n)


def inspector_summary(inspectors: DataFrame) -> DataFrame:
    """Count and unweighted mean, minimum and maximum of the pass percentage."""
    p = F.col("labimise_protsent")
    return inspectors.agg(
        F.count("*").alias("inspektoreid"),
        F.round(F.avg(p), 1).alias("keskmine"),
        F.min(p).alias("madalaim"),
        F.max(p).alias("korgeim"),
    )


def defect_totals(overview: DataFrame) -> DataFrame:
    names = ["kokku_ylevaatusi", "riketega_ylevaatusi", "vo_arv", "ov_arv", "eov_arv"]
    return overview.agg(*[F.sum(c).alias(c) for c in names])


def age_gap(bands: DataFrame) -> DataFrame:
    """Pass percentage of the youngest and oldest band and their difference."""
    p = F.col("labimise_protsent")
    ends = bands.agg(
        F.min_by(p, "sorteering").alias("uusim"), F.max_by(p, "sorteering").alias("vanim")
    )
    return ends.withColumn("erinevus", F.round(F.col("uusim") - F.col("vanim"), 1))


def weighted_pass_rate(bands: DataFrame) -> DataFrame:
    """Pass percentage over all bands, weighted by their size; 0 without rows."""
    n = F.sum("kokku")
    mean = F.sum(F.col("kokku") * F.col("labimise_protsent")) / F.nullif(n, F.lit(0))
    return bands.agg(
        F.coalesce(n, F.lit(0)).alias("kokku"), F.coalesce(F.round(mean, 1), F.lit(0.0)).alias("keskmine_protsent")
    )


def similar_marks(df: DataFrame, wanted: str, n: int = 8) -> DataFrame:
    """First makes that contain the first three letters of the search term."""
    return available_marks(df).filter(F.col("mark").contains(wanted.strip().upper()[:3])).orderBy("mark").limit(n)


def defect_labels(report: DataFrame) -> DataFrame:
    """Add `SEV: name`, or `SEV:id` when no row of the report has a name. The report is a top-k list."""
    any_name = F.coalesce(F.max(F.col("nimetus") != "").over(W.partitionBy()), F.lit(False))
    with_name = F.concat(F.col("raskusaste"), F.lit(": "), F.col("nimetus"))
    with_id = F.concat(F.col("raskusaste"), F.lit(":"), F.col("rike_id"))
    return report.withColumn("label", F.when(any_name, with_name).otherwise(with_id))
