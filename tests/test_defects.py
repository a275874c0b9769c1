"""Defect strings in both dialects."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inspectrum.functions import defects as D

PARSED = [
    ("VO:100101460;OV:100103882;EOV:100104012", [("VO", 100101460), ("OV", 100103882), ("EOV", 100104012)]),
    ("VO:1, OV:2\nEOV:3", [("VO", 1), ("OV", 2), ("EOV", 3)]),
    ("VO:1;BAD:2;OV:not-number;EOV:3", [("VO", 1), ("EOV", 3)]),
    ("", []),
    (None, []),
    ("   ", []),
    ("vo:5", [("VO", 5)]),
    ("VO:1:2", []),
    ("EOV:\t9 ", [("EOV", 9)]),
    ("VO:+5", [("VO", 5)]),
    ("OV:1.5;VO;OV:", []),
    (" VO:7 ", [("VO", 7)]),
]


@pytest.mark.parametrize("text,expected", PARSED)
def test_strict_parse(spark, text, expected):
    df = spark.createDataFrame([(text,)], "r string")
    got = df.select(D.parse_strict(F.col("r")).alias("d")).first()["d"]
    assert [(x["severity"], x["defect_id"]) for x in got] == expected


def python_parse(text):
    """The dialect in plain Python, as the yardstick for random strings."""
    out = []
    for part in re.split(r"[;,\r\n]+", text):
        severity, colon, rest = part.partition(":")
        rest = rest.strip()
        if colon and severity.strip().upper() in D.SEVERITIES and re.fullmatch(r"[+-]?[0-9]+", rest):
            out.append((severity.strip().upper(), int(rest)))
    return out


def test_strict_parse_of_random_strings(spark):
    rng = random.Random(11)
    pieces = ["VO", "ov", "EOV", "BAD", ":", ":", ";", ",", "\n", "\r", " ", "\t", "\xa0", "\u2003", "\x1c", "1", "42", "+7", "-", "x"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, r string")
    rows = df.select("i", D.parse_strict(F.col("r")).alias("d"), D.strict_entries(F.col("r")).alias("e")).collect()
    for r in rows:
        text = texts[r["i"]]
        assert [(x["severity"], x["defect_id"]) for x in r["d"]] == python_parse(text), repr(text)
        assert r["e"] == [p.strip() for p in re.split(r"[;,\r\n]+", text) if p.strip()], repr(text)


def test_raw_entries(spark):
    df = spark.createDataFrame([(" VO:1 ;\nOV:2,,EOV:3 ",)], "r string")
    assert df.select(D.strict_entries(F.col("r"))).first()[0] == ["VO:1", "OV:2", "EOV:3"]


def test_severity_counts_and_ids(spark):
    df = spark.createDataFrame([("OV:1;EOV:2;VO:3;VO:10",)], "r string")
    parsed = D.parse_strict(F.col("r"))
    row = df.select(*[D.count_severity(parsed, s).alias(s) for s in D.SEVERITIES], D.defect_ids(parsed).alias("ids")).first()
    assert (row["VO"], row["OV"], row["EOV"], row["ids"]) == (2, 1, 1, [1, 2, 3, 10])


def test_dialects_differ(spark):
    """`VO:1:2` counts only in the loose dialect, `vo:5` only in the strict one."""
    df = spark.createDataFrame([("VO:1:2",), ("vo:5",)], "r string")
    rows = df.select(F.size(D.loose_defects(F.col("r"))).alias("l"), F.size(D.parse_strict(F.col("r"))).alias("s")).collect()
    assert [(r["l"], r["s"]) for r in rows] == [(1, 0), (0, 1)]


def test_severity_flag_ignores_ids(spark):
    df = spark.createDataFrame([("VO:x\rOV",), ("  ",), (None,)], "r string")
    entries = df.select(D.loose_entries(F.col("r")).alias("e"))
    rows = entries.select(*[D.has_severity(F.col("e"), s).alias(s) for s in D.SEVERITIES]).collect()
    assert [tuple(r) for r in rows] == [(1, 1, 0), (0, 0, 0), (0, 0, 0)]
