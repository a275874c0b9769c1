"""Text repair and coercion."""

from pyspark.sql import functions as F

from inspectrum.functions import bands as B
from inspectrum.functions import text as T


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


def python_repair(text):
    try:
        return text.encode("latin-1").decode("utf-8")
    except (UnicodeDecodeError, UnicodeEncodeError):
        return text


def test_repair_mojibake(spark):
    values = ["TÃ¤hva", "Tähva", "abc", None, "Ãœlevaatus", "Ã\x9clevaatus", "", "Ã", "a\nTÃ¤"]
    expected = [None if v is None else python_repair(v) for v in values]
    assert column(spark, values, T.repair_mojibake) == expected


def test_strip_matches_python(spark):
    values = [" a b ", "\t\r\nx\x0b", "  y　", "\x1cz\x1f", "", None, "   "]
    assert column(spark, values, T.strip) == [None if v is None else v.strip() for v in values]


def test_whole_numbers(spark):
    values = ["2005", " 2005 ", "2005.0", "2005.5", "1e3", "x", "", None, "-7", "9007199254740993", "1d", "1e400"]
    expected = [2005, 2005, 2005, None, 1000, None, None, None, -7, 9007199254740993, None, None]
    assert column(spark, values, T.to_whole_number) == expected


def test_int_guard(spark):
    values = ["1.5", "1e2", "1_000", "12", "+3", "99999999999", None]
    assert column(spark, values, T.to_int) == [None, None, None, 12, 3, None, None]


def test_age_bands_cover_every_age(spark):
    ages = list(range(-2, 103))
    labels = column(spark, ages, B.age_band, "int")
    assert labels[0] is None and labels[ages.index(0)] == "0–1 (uus)" and labels[ages.index(41)] == "41+"
    assert all(label is not None for age, label in zip(ages, labels) if age >= 0)
    explore = column(spark, ages, B.exploratory_age_band, "int")
    assert explore[ages.index(-1)] is None and explore[ages.index(0)] == "0-1"
    assert explore[ages.index(100)] == "31+" and explore[ages.index(101)] is None


def test_body_code_group_and_month(spark):
    assert column(spark, ["SEDAAN", "KVADRIK", "???", None], B.body_code) == [0, 14, -1, -1]
    assert column(spark, ["M1G", "L3e", "e", None], B.category_group) == ["M", "L", None, None]
    assert column(spark, [1, 12, 13, None], B.month_name, "int") == ["Jaanuar", "Detsember", None, None]


def test_risk_band(spark):
    got = column(spark, [0.9, 0.6, 0.4, 0.1], lambda c: B.risk_band(c, F.lit(0.55)), "double")
    assert got == ["kõrge", "keskmine", B.RISK_GROUP, B.RISK_GROUP]
    assert column(spark, [0.1], lambda c: B.risk_band(c, F.lit(None).cast("double")), "double") == [B.LOW_SCORE]
