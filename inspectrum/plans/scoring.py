"""Batch scoring of request rows, and the category / body-type rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectrum.functions.bands import month_cos, month_sin, risk_band

# Body types offered for each vehicle category. The misspelling in N3 is part
# of the published list and never matches.
BODY_TYPES = {
    "M1": [
        "SEDAAN", "UNIVERSAAL", "LUUKPÄRA", "MAHTUNIVERSAAL", "KUPEE", "PIKAP", "LAHTINE", "LIMUSIIN", "KOMBI",
        "MITMEOTSTARBELINE SÕIDUK",
    ],
    "M1G": [
        "SEDAAN", "UNIVERSAAL", "LUUKPÄRA", "MAHTUNIVERSAAL", "KUPEE", "PIKAP", "LAHTINE", "LIMUSIIN", "KOMBI",
        "MITMEOTSTARBELINE SÕIDUK",
    ],
    "M2": ["BUSS", "LIIGENDBUSS", "KORRUSBUSS", "KIIRABI", "KOMBI", "MITMEOTSTARBELINE SÕIDUK"],
    "M3": ["BUSS", "LIIGENDBUSS", "KORRUSBUSS", "KIIRABI", "MITMEOTSTARBELINE SÕIDUK"],
    "M3G": ["BUSS", "LIIGENDBUSS", "KORRUSBUSS", "MITMEOTSTARBELINE SÕIDUK"],
    "N1": ["KAUBIK", "FURGOON", "PIKAP", "KÜLMIK", "ISOTERMILINE", "PAAK", "KOMBI", "MITMEOTSTARBELINE SÕIDUK"],
    "N1G": ["KAUBIK", "FURGOON", "PIKAP", "KÜLMIK", "ISOTERMILINE", "PAAK", "MITMEOTSTARBELINE SÕIDUK"],
    "N2": [
        "KALLUR", "KAUBIK", "FURGOON", "KONTEINERIVEOK", "KÜLMIK", "ISOTERMILINE", "PAAK", "SADUL", "VEDUR",
        "METSAVEOK", "SÕIDUKIVEOK", "PRÜGIVEOK", "PUKSIIRAUTO", "REDELAUTO", "PÄÄSTESÕIDUK", "BETOONIPUMP",
        "BETOONISEGISTI", "KRAANA", "PUITMATERJALI VEDU", "ELUSLOOMADE VEOK", "KLAASIVEOK",
        "MITMEOTSTARBELINE SÕIDUK",
    ],
    "N2G": ["KALLUR", "KAUBIK", "KONTEINERIVEOK", "PAAK", "MITMEOTSTARBELINE SÕIDUK"],
    "N3": [
        "KALLUR", "KAUBIK", "FURGOON", "KONTEINERIVEOK", "KÜLMIK", "ISOTERMILINE", "PAAK", "SADUL", "VEDUR",
        "METSAVEOK", "SÕIDUKIVEOK", "PRÜGIVEOK", "PUKSIIRAUTO", "REDELAUTO", "PÄÄSTESÕIDUK", "BETOONIPUMP",
        "BETOONISEGISTI", "KRAANA", "PUITMATERJALI VEDU", "ELUSLOOMADE VEOK", "KLAASIVEOK",
        "MITMOOTSTARBELINE SÕIDUK",
    ],
    "N3G": ["KALLUR", "KAUBIK", "KONTEINERIVEOK", "PAAK", "SADUL", "MITMEOTSTARBELINE SÕIDUK"],
    "L3e": ["MOOTORRATAS", "REISIMOOTORRATAS", "SPORTMOOTORRATAS", "ENDUURO"],
    "L4e": ["KÜLGHAAGISEGA MOOTORRATAS"],
    "L5e": ["TRAIK"],
    "L6e": ["KVADRIK", "MOTOROLLER", "VEOMOTOROLLER"],
    "L7e": ["KVADRIK", "VEOKVADRIK", "MOTOROLLER"],
    "O1": ["HAAGIS", "JÄIGA RAAMIGA", "LIIGENDRAAMIGA", "KALLUR", "KÜLMIK", "ISOTERMILINE", "PAAK", "RUNG", "MUU"],
    "O2": ["HAAGIS", "JÄIGA RAAMIGA", "LIIGENDRAAMIGA", "KALLUR", "KÜLMIK", "ISOTERMILINE", "PAAK", "RUNG", "MUU"],
    "O3": [
        "HAAGIS", "JÄIGA RAAMIGA", "LIIGENDRAAMIGA", "KALLUR", "KÜLMIK", "ISOTERMILINE", "PAAK", "RUNG", "MUU",
        "ELUSLOOMADE VEOK",
    ],
    "O4": [
        "HAAGIS", "JÄIGA RAAMIGA", "LIIGENDRAAMIGA", "KALLUR", "KÜLMIK", "ISOTERMILINE", "PAAK", "RUNG", "MUU",
        "ELUSLOOMADE VEOK",
    ],
}


def body_type_rules(spark: SparkSession, rules: dict[str, list[str]] = BODY_TYPES) -> DataFrame:
    """One row per allowed pair, as literals of the plan: the planner knows how small they are."""
    pairs = [
        F.struct(F.lit(category).alias("KATEGOORIA"), F.lit(body).alias("KERETYYP"))
        for category, bodies in rules.items()
        for body in bodies
    ]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def flag_body_types(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Add 1 or 0: is the (category, body type) pair allowed."""
    allowed = rules.select("KATEGOORIA", "KERETYYP").distinct().withColumn("lubatud", F.lit(1))
    return df.join(allowed, ["KATEGOORIA", "KERETYYP"], "left").withColumn("lubatud", F.coalesce("lubatud", F.lit(0)))


def keep_allowed(df: DataFrame, rules: DataFrame) -> DataFrame:
    return df.join(rules, ["KATEGOORIA", "KERETYYP"], "left_semi")


def keep_disallowed(df: DataFrame, rules: DataFrame) -> DataFrame:
    return df.join(rules, ["KATEGOORIA", "KERETYYP"], "left_anti")


def body_type_options(trained: DataFrame, rules: DataFrame) -> DataFrame:
    """Per trained category: its allowed body types seen in training, or every trained one when none was seen.

    `trained` has the distinct trained pairs of columns KATEGOORIA and KERETYYP.
    """
    bodies = trained.select("KERETYYP").dropna().distinct()
    categories = trained.select("KATEGOORIA").dropna().distinct()
    matched = rules.join(bodies, "KERETYYP", "left_semi").join(categories, "KATEGOORIA", "left_semi")
    unmatched = categories.join(matched, "KATEGOORIA", "left_anti")
    # The list of trained body types is one short array: no row-by-row pairing.
    every = bodies.agg(F.sort_array(F.collect_set("KERETYYP")).alias("all")).select("all").scalar()
    fallback = unmatched.select("KATEGOORIA", F.explode(every).alias("KERETYYP"))
    return matched.select("KATEGOORIA", "KERETYYP").unionByName(fallback)


def request_features(
    requests: DataFrame, makes: DataFrame, models: DataFrame, default_make: int, default_model: int
) -> DataFrame:
    """Model inputs for request rows; an unknown make or model gets the median frequency.

    Requests have inspection year and month, registration year, previous inspections and
    the categorical columns. `makes` and `models` are the trained lookups.
    """
    age = F.greatest(F.col("YV_AASTA") - F.col("ESMANE_REG_AASTA"), F.lit(0))
    rows = requests.withColumn("VANUS", age.cast("double"))
    rows = rows.join(makes.select("MARK", F.col("sagedus").alias("MARK_SAGEDUS")), "MARK", "left")
    rows = rows.join(models.select("MARK", "MUDEL", F.col("sagedus").alias("MUDEL_SAGEDUS")), ["MARK", "MUDEL"], "left")
    return rows.withColumns(
        {
            "VANUS_RUUT": F.col("VANUS") * F.col("VANUS"),
            "ON_VANA": (F.col("VANUS") > 10).cast("double"),
            "KUU_SIN": month_sin(F.col("YV_KUU")),
            "KUU_COS": month_cos(F.col("YV_KUU")),
            "MARK_SAGEDUS": F.coalesce("MARK_SAGEDUS", F.lit(default_make)).cast("double"),
            "MUDEL_SAGEDUS": F.coalesce("MUDEL_SAGEDUS", F.lit(default_model)).cast("double"),
            "EELMISED_YV": F.col("EELMISED_YV").cast("double"),
        }
    )


def with_risk_band(scored: DataFrame, fail_threshold: float | None) -> DataFrame:
    """Pass score and fail risk in percent, and the band; the threshold is the 0.80-recall one."""
    threshold = F.lit(fail_threshold).cast("double")
    return scored.withColumns(
        {
            "labimise_skoor": F.col("score") * 100.0,
            "kukkumise_risk": 100.0 - F.col("score") * 100.0,
            "riskiaste": risk_band(F.col("score"), threshold),
        }
    )
