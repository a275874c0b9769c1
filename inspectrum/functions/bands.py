"""Bands, codes and rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (first age, last age, label); the list position is the sort key.
AGE_BANDS = [
    (0, 1, "0–1 (uus)"),
    (2, 5, "2–5"),
    (6, 10, "6–10"),
    (11, 15, "11–15"),
    (16, 20, "16–20"),
    (21, 30, "21–30"),
    (31, 40, "31–40"),
    (41, None, "41+"),
]

# Right-closed upper edges and labels of the exploratory bands.
EXPLORATORY_BANDS = [
    (1, "0-1"),
    (5, "2-5"),
    (10, "6-10"),
    (15, "11-15"),
    (20, "16-20"),
    (30, "21-30"),
    (100, "31+"),
]

# Ordinal code of each body type.
BODY_CODES = {
    "SEDAAN": 0,
    "UNIVERSAAL": 1,
    "LUUKPÄRA": 2,
    "MAHTUNIVERSAAL": 3,
    "KAUBIK": 4,
    "KUPEE": 5,
    "LAHTINE": 6,
    "PIKAP": 7,
    "MOOTORRATAS": 8,
    "MITMEOTSTARBELINE SÕIDUK": 9,
    "MADEL": 10,
    "ELAMU": 11,
    "SADUL": 12,
    "PAADIVEOK": 13,
    "KVADRIK": 14,
}

# Estonian month names, January first.
MONTH_NAMES = [
    "Jaanuar",
    "Veebruar",
    "Märts",
    "Aprill",
    "Mai",
    "Juuni",
    "Juuli",
    "August",
    "September",
    "Oktoober",
    "November",
    "Detsember",
]

# Lower bounds, in percent, of the score bands below the risk group.
SCORE_BANDS = [(75.0, "kõrge"), (50.0, "keskmine")]
RISK_GROUP = "riskirühm"
LOW_SCORE = "madal"


def _pick(cases: list[tuple[Column, object]]) -> Column:
    return reduce(lambda acc, case: acc.when(*case), cases[1:], F.when(*cases[0]))


def _in_band(age: Column, first: int, last: int | None) -> Column:
    return age >= first if last is None else age.between(first, last)


def age_band(age: Column) -> Column:
    return _pick([(_in_band(age, a, b), label) for a, b, label in AGE_BANDS])


def age_band_rank(age: Column) -> Column:
    return _pick([(_in_band(age, a, b), i) for i, (a, b, _) in enumerate(AGE_BANDS, 1)])


def exploratory_age_band(age: Column) -> Column:
    """Right-closed bands over (-1, 100]; NULL outside."""
    inside = F.when((age > -1) & (age <= EXPLORATORY_BANDS[-1][0]), age)
    return _pick([(inside <= edge, label) for edge, label in EXPLORATORY_BANDS])


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def body_code(c: Column) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(BODY_CODES), c), F.lit(-1))


def category_group(c: Column) -> Column:
    """Leading capitals of a category, NULL when there are none."""
    return F.nullif(F.regexp_extract(c, r"^([A-Z]+)", 1), F.lit(""))


def month_name(month: Column) -> Column:
    return F.try_element_at(_literal_map(dict(enumerate(MONTH_NAMES, 1))), month)


def percent(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.lit(100.0) * part / whole, digits)


def half_even(c: Column, digits: int) -> Column:
    """Scale, round half to even, unscale."""
    scale = F.lit(float(10**digits))
    return F.rint(c * scale) / scale


def month_sin(month: Column) -> Column:
    return F.sin(F.lit(2.0) * F.pi() * month / F.lit(12.0))


def month_cos(month: Column) -> Column:
    return F.cos(F.lit(2.0) * F.pi() * month / F.lit(12.0))


def smoothed(total: Column, n: Column, overall: Column, weight: float) -> Column:
    """Blend a group total with the overall mean, `weight` rows strong."""
    return (total + F.lit(float(weight)) * overall) / (n + F.lit(float(weight)))


def clip_probability(p: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def risk_band(pass_probability: Column, fail_threshold: Column) -> Column:
    """Risk group from the fail threshold first, then bands of the pass score."""
    score = pass_probability * 100.0
    in_risk = fail_threshold.isNotNull() & (100.0 - score >= fail_threshold * 100.0)
    bands = F.when(in_risk, RISK_GROUP)
    for lower, label in SCORE_BANDS:
        bands = bands.when(score >= lower, label)
    return bands.otherwise(LOW_SCORE)
