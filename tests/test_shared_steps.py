"""Steps that many queries share: what they join first, how often they parse, how they deal rows to tasks."""

import datetime
import time

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from inspectrum.checks.adapter import numbered, reshape
from inspectrum.operators import features as M
from inspectrum.operators import kmeans
from inspectrum.plans import risk_model as R
from inspectrum.sources.schema import RAW_COLUMNS, ROW_NO, YEAR
from inspectrum.sources.workspace import materialize


def _raw(spark, n=40):
    values = {c: F.lit("x") for c in RAW_COLUMNS}
    values |= {
        "YV_KUUPAEV": F.format_string("%d-%02d", F.lit(2020) + F.col("id") % 2, F.col("id") % 12 + 1),
        "YLEVAATUSLIIK": F.lit("KORRALINE"),
        "YLEVAATUSOTSUS": F.when(F.col("id") % 3 == 0, "KORDUVALE").otherwise("KORRAS"),
        "SOIDUK_ID": (F.col("id") % 5).cast("string"),
        "ESMANE_REG_AASTA": F.lit("2010"),
        "MARK": F.when(F.col("id") % 7 != 0, F.format_string("M%d", F.col("id") % 3)),
        "MUDEL": F.format_string("T%d", F.col("id") % 2),
    }
    return spark.range(n).select(*[values[c].alias(c) for c in RAW_COLUMNS], F.col("id").alias(ROW_NO))


TABLES = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey long, c_mktsegment string",
}


def test_customers_join_orders_before_line_items(spark, tmp_path):
    """Line items are not shuffled by customer."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    plan = reshape(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    # A join stands above the ones that feed it.
    orders = next(i for i, line in enumerate(joins) if "l_orderkey" in line)
    customers = next(i for i, line in enumerate(joins) if "o_custkey" in line)
    assert customers > orders


def test_frame_parses_text_once(spark):
    """The scans of the frame read parsed rows, and counts and ranks are those of plain Python."""
    frame = M.create_model_frame(_raw(spark))
    assert "RLIKE" not in frame._jdf.queryExecution().optimizedPlan().toString()
    got = {r[ROW_NO]: r for r in frame.collect()}
    raw = sorted(_raw(spark).collect(), key=lambda r: (r["YV_KUUPAEV"], r[ROW_NO]))
    assert len(got) == len(raw)
    for i, r in enumerate(raw):
        row = got[r[ROW_NO]]
        assert row["EELMISED_YV"] == sum(e["SOIDUK_ID"] == r["SOIDUK_ID"] for e in raw[:i])
        same = [e for e in raw if e["MARK"] == r["MARK"]]
        assert row["MARK_SAGEDUS"] == (len(same) if r["MARK"] else None)
        assert row["MUDEL_SAGEDUS"] == (sum(e["MUDEL"] == r["MUDEL"] for e in same) if r["MARK"] else None)


@pytest.mark.parametrize("block", [7, 1024])
def test_sums_of_centres_in_blocks(spark, monkeypatch, block):
    """Sums of models of several sizes over blocks of rows, equally near centres included, against plain loops."""
    monkeypatch.setattr(kmeans, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(0, 3, (90, 2)).astype(float), rng.normal(size=(60, 2))])
    models = [np.array([[0.0, 1.0], [2.0, 1.0]]), np.array([[1.0, 1.0], [1.0, 1.0]]), rng.normal(size=(3, 2)), np.array([[0.5, 0.5]])]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(3)
    for centres, sums in zip(models, kmeans.centre_sums(rows, models), strict=True):
        distances = ((x[:, None] - centres) ** 2).sum(2)
        label = distances.argmin(1)
        for j in range(len(centres)):
            own = x[label == j]
            want = [len(own), distances[label == j, j].sum(), (own * own).sum(), *own.sum(0)]
            assert sums[j] == pytest.approx(want, abs=1e-9)


def test_packed_blocks_hold_the_rows(spark, monkeypatch):
    """Sums and silhouettes over packed blocks are those over the rows."""
    monkeypatch.setattr(kmeans, "PACKED", 16)
    x = np.random.default_rng(6).normal(size=(100, 3))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(3)
    packed = kmeans.blocks(rows)
    held = packed.toArrow()
    assert set(held["n"].to_pylist()) > {16} and sum(held["n"].to_pylist()) == 100
    back = np.concatenate(list(kmeans._matrices(held.to_batches())))
    assert sorted(map(tuple, back)) == sorted(map(tuple, x))
    models = [x[:2], x[5:9]]
    for got, want in zip(kmeans.centre_sums(packed, models), kmeans.centre_sums(rows, models), strict=True):
        assert got == pytest.approx(want)
    assert kmeans.silhouettes(packed, models) == pytest.approx(kmeans.silhouettes(rows, models))
    assert kmeans.blocks(rows.limit(0)).count() == 0


def test_forest_keeps_the_nodes_of_rows(spark):
    """Rows are not walked down every tree anew for each level; the trees are the same."""
    columns = [F.rand(1).alias("a"), F.rand(2).alias("b"), F.floor(F.rand(3) * 4).alias("c"), F.lit(1.0).alias("__weight")]
    rows = spark.range(400).select(*columns).withColumn(R.TARGET, (F.col("a") + F.col("b") > 1).cast("int"))
    ready = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows).coalesce(1)
    forest = R.forest(trees=5, depth=6)
    assert forest.getCacheNodeIds()
    walked = forest.copy({forest.cacheNodeIds: False})
    trees = [model.fit(ready).toDebugString.split("\n", 1)[1] for model in (forest, walked)]
    assert trees[0] == trees[1] and trees[0].count("Predict") > 20


def test_shuffle_files_of_written_tables_are_deleted(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {n for n in names if n.startswith("shuffle_")}

    before, counts = shuffled(), spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    table = materialize(counts, "counts")
    deadline = time.time() + 20
    while shuffled() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled() - before
    assert table.count() == 100 and counts.count() == 100


def test_landing_shuffles_joined_rows(spark, tmp_path):
    """Text is made after the shuffle, and rows are numbered in order of all their columns."""
    day = datetime.datetime(2001, 3, 4)
    rows = {
        "lineitem": [(i % 6, i % 4, i % 3, i % 7 + 1, float(15 + i), 0.01 * (i % 9), 0.01 * (i % 10), "ARN"[i % 3], day + datetime.timedelta(40 * (i % 20))) for i in range(60)] * 2,
        "orders": [(i, i % 5, datetime.datetime(1999 + i % 2, 1, 1)) for i in range(6)],
        "part": [(i, f"part {i}", f"Brand{i}", ["STANDARD", "PROMO", "ODD", None][i], 10 * i) for i in range(4)],
        "supplier": [(i, f"Supplier{i}", i) for i in range(3)],
        "nation": [(i, f"N{i}") for i in range(3)],
        "customer": [(i, f"S{i % 2}") for i in range(5)],
    }
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = numbered(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("AS RIKKED") < plan.index("RepartitionByExpression") and plan.count("AS RIKKED") == 1
    got = out.orderBy(ROW_NO).collect()
    order = [YEAR, "YV_KUUPAEV", *[c for c in RAW_COLUMNS if c != "YV_KUUPAEV"]]
    keys = [[(r[c] is not None, r[c]) for c in order] for r in got]
    assert len(got) == 120 and keys == sorted(keys)
    assert sorted(r.asDict()[c] or "" for r in reshape(spark, str(tmp_path)).collect() for c in RAW_COLUMNS) == sorted(r[c] or "" for r in got for c in RAW_COLUMNS)
