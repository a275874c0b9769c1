"""Operators against brute force, with hot keys and large groups of copies."""

import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inspectrum.operators import ordered
from inspectrum.operators.history import add_frequencies, add_previous_count
from inspectrum.operators.ordered import exact_medians, group_modes, modes, range_partitioned, running_totals
from inspectrum.operators.sampling import exact_sample, hash_cutoff, row_hash
from inspectrum.sources.schema import ROW_NO


def hot_rows(n=4000, seed=1):
    """One vehicle has a third of the rows, most of them copies of one row; some have no id."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        vehicle = 7 if kind < 0.34 else (None if kind < 0.38 else rng.randrange(50))
        copy = vehicle == 7 and rng.random() < 0.7
        year, month = (2023, 5) if copy else (rng.randrange(2020, 2025), rng.randrange(1, 13))
        rows.append((vehicle, year, month, "A" if copy else rng.choice("ABC"), rng.choice([None, "x", "y"])))
    return rows


@pytest.fixture(scope="module")
def hot(spark):
    """Row numbers as a scan of five partitions would give them."""
    rows = [(*r, (i % 5 << 33) + i // 5) for i, r in enumerate(hot_rows())]
    schema = f"SOIDUK_ID long, YV_AASTA int, YV_KUU int, MARK string, MUDEL string, {ROW_NO} long"
    pdf = pd.DataFrame(rows, columns=["SOIDUK_ID", "YV_AASTA", "YV_KUU", "MARK", "MUDEL", ROW_NO])
    return spark.createDataFrame(rows, schema), pdf


@pytest.mark.parametrize("order", [("YV_AASTA", "YV_KUU"), ()])
def test_previous_count_with_hot_key(hot, order):
    df, pdf = hot
    assert (pdf[ROW_NO] // 2**33).nunique() > 1
    pdf = pdf.sort_values([*order, ROW_NO], kind="stable")
    expected = pdf.groupby("SOIDUK_ID").cumcount().where(pdf["SOIDUK_ID"].notna())
    expected = dict(zip(pdf[ROW_NO], expected))
    got = {r[ROW_NO]: r["EELMISED_YV"] for r in add_previous_count(df, order=order).collect()}
    assert len(got) == len(expected)
    assert all((got[k] is None and pd.isna(v)) or got[k] == v for k, v in expected.items())


def test_frequencies(hot):
    df, pdf = hot
    got = {r[ROW_NO]: (r["MARK_SAGEDUS"], r["MUDEL_SAGEDUS"]) for r in add_frequencies(df).collect()}
    marks = pdf.groupby("MARK")["MARK"].transform("size")
    models = pdf.groupby(["MARK", "MUDEL"])["MARK"].transform("size")
    for row_no, mark, model, name in zip(pdf[ROW_NO], marks, models, pdf["MUDEL"]):
        assert got[row_no] == (mark, None if name is None else model)


@pytest.mark.parametrize("n", [0, 1, 2, 17, 999, 1999, 2000, 2001, 5000])
def test_exact_sample_size(spark, n):
    df = spark.range(2000).withColumnRenamed("id", ROW_NO)
    rows = [r[0] for r in exact_sample(df, n).collect()]
    assert len(rows) == len(set(rows)) == min(n, 2000)


def test_samples_are_repeatable_and_nested(spark):
    df = spark.range(3000).withColumnRenamed("id", ROW_NO)
    small, large = ({r[0] for r in exact_sample(df.repartition(k), n).collect()} for k, n in ((3, 100), (7, 900)))
    assert small < large
    assert small != {r[0] for r in exact_sample(df, 100, seed=7).collect()}
    cut = hash_cutoff(df, 100)
    assert df.filter(row_hash() <= F.lit(cut)).count() == 100


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(g, v, rng.randrange(5)) for g in ("a", "b") for v in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, v int, n long")
    ranged = range_partitioned(df, ["g", "v"], "t")
    up = running_totals(ranged, "v", {"upto": "n"}, by=["g"]).collect()
    down = running_totals(ranged, "v", {"from": "n"}, by=["g"], descending=True).collect()
    for r in up:
        assert r["upto"] == sum(n for g, v, n in rows if g == r["g"] and v <= r["v"])
    for r in down:
        assert r["from"] == sum(n for g, v, n in rows if g == r["g"] and v >= r["v"])


def test_medians_and_modes(spark):
    rng = random.Random(5)
    pdf = pd.DataFrame(
        {
            "a": [rng.choice([1.0, 2.0, 3.5, None]) for _ in range(501)],
            "b": [float(i) for i in range(501)],
            "c": [None] * 501,
            "s": [rng.choice(["p", "q", "r", None]) for _ in range(501)],
            "g": [rng.randrange(3) for _ in range(501)],
        }
    )
    rows = pdf.astype(object).where(pdf.notna(), None).values.tolist()
    df = spark.createDataFrame(rows, "a double, b double, c double, s string, g int")
    got = {r["name"]: r["median"] for r in exact_medians(df, ["a", "b", "c"]).collect()}
    assert got == {"a": pdf["a"].median(), "b": 250.0}
    assert {r["name"]: r["mode"] for r in modes(df, ["s"]).collect()} == {"s": pdf["s"].mode()[0]}
    by_group = {r["g"]: r["s"] for r in group_modes(df, "g", ["s"]).collect()}
    assert by_group == {g: part["s"].mode()[0] for g, part in pdf.groupby("g")}


def test_even_median_is_the_midpoint(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (9.0,), (4.0,), (5.0,)], "a double")
    assert exact_medians(df, ["a"]).first()["median"] == 3.0


@pytest.mark.parametrize("buckets", [256, 4096])
def test_values_at_ranks(spark, buckets):
    """Any number of buckets finds the same values: ties, wide exponents, signed zero, infinities, one value, none."""
    rng = random.Random(buckets)
    columns = {
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 308) for _ in range(301)],
        "ties": [float(rng.randrange(4)) for _ in range(300)],
        "ends": [1.7e308, -1.7e308, 0.0, -0.0, 5e-324, -5e-324] * 20,
        "infinite": [float("inf")] * 40 + [float("-inf")] * 41 + [1.0] * 3,
        "one": [7.25],
        "none": [],
        "nan": [float("nan")] * 50 + [1.0, 2.0, 4.0],
    }
    n = max(map(len, columns.values()))
    rows = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)
    before, ordered.BUCKETS = ordered.BUCKETS, buckets
    try:
        got = {r["name"]: r["median"] for r in ordered.exact_medians(df, list(columns)).collect()}
        thirds = ordered.selected(df, {"wide": lambda n: [1, n // 3, n], "ties": lambda n: [1, 2, n]})
    finally:
        ordered.BUCKETS = before
    want = {c: statistics.median([x for x in v if x == x]) for c, v in columns.items() if v}
    assert got == want
    wide, ties = sorted(columns["wide"]), sorted(columns["ties"])
    assert thirds["wide"] == {1: wide[0], 100: wide[99], 301: wide[300]} and thirds["ties"] == {1: ties[0], 2: ties[1], 300: ties[-1]}
