"""Exact top-k with bounded counters against grouping in plain Python."""

import random
from collections import Counter

import pytest

from inspectrum.operators import heavy


def _rows(name):
    rng = random.Random(3)
    if name == "heavy":
        return [(rng.choice("abcd") if rng.random() < 0.6 else f"x{rng.randrange(3000)}", rng.randrange(2)) for _ in range(6000)]
    if name == "even":
        return [(f"x{i % 700}", i % 700 % 3) for i in range(2100)]
    if name == "nulls":
        return [(None, 1)] * 50 + [(None, None)] * 40 + [(f"x{i}", None) for i in range(900)]
    return []


@pytest.mark.parametrize("name", ["heavy", "even", "nulls", "empty"])
def test_top_counts_are_exact(spark, name):
    rows = _rows(name)
    df = spark.createDataFrame(rows, "name string, kind int").repartition(4)
    low = lambda key: tuple((x is not None, x if x is not None else 0) for x in key)
    want = sorted(Counter(rows).items(), key=lambda c: (-c[1], low(c[0])))[:8]
    got = [((r["name"], r["kind"]), r["n"]) for r in heavy.top_counts(df, ["name", "kind"], 8, counters=16).collect()]
    assert got == want


def test_counters_widen_only_where_the_bound_fails(spark, monkeypatch):
    """Heavy keys are proved by the first scan; even ones need wider ones, and all keys are grouped beyond the limit."""
    written = []
    real = heavy.materialize

    def noted(df, name):
        table = real(df, name)
        written.append((name, table.count()))
        return table

    monkeypatch.setattr(heavy, "materialize", noted)
    # Batches of a task hold all its rows, so counters and not batches bound what is shuffled.
    for name, scans in (("heavy", 1), ("even", 2)):
        written.clear()
        df = spark.createDataFrame(_rows(name), "name string, kind int").repartition(4)
        heavy.top_counts(df, ["name", "kind"], 4, counters=64).collect()
        counters = [n for kind, n in written if kind == "counters"]
        assert len(counters) == scans and counters[0] <= 4 * 64
    monkeypatch.setattr(heavy, "MOST", 64)
    written.clear()
    df = spark.createDataFrame(_rows("even"), "name string, kind int").repartition(4)
    got = [(r["name"], r["n"]) for r in heavy.top_counts(df, ["name"], 3, counters=64).collect()]
    assert got == [("x0", 3), ("x1", 3), ("x10", 3)] and [kind for kind, _ in written] == ["counters"]
