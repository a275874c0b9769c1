"""Whole runs on the smallest driver tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inspectrum.checks.adapter import dimension, inspections
from inspectrum.plans import risk_model as R
from inspectrum.plans import scoring as P
from inspectrum.plans import workflows
from inspectrum.sources.dimension import known_ids
from inspectrum.sources.versions import current_version

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are not here")


def test_validate(spark, tmp_path):
    rows = inspections(spark, SF_DIR)
    report = workflows.validate(rows, known_ids(dimension(spark, SF_DIR)), str(tmp_path)).collect()
    assert [r["year"] for r in report] == sorted(r["year"] for r in report)
    assert sum(r["rows_total"] for r in report) == rows.count()
    assert spark.read.json(f"{tmp_path}/data_validation_json").count() == len(report)


def test_clean_and_describe(spark, tmp_path):
    summary = workflows.clean_and_describe(inspections(spark, SF_DIR), str(tmp_path)).first()
    features = spark.read.parquet(f"{tmp_path}/features")
    assert 0 < features.count() < summary["ridu"]
    assert features.filter(~F.col("MARK_LABIMISE_MAAR").between(0, 1)).isEmpty()


def test_train_save_and_score_requests(spark, tmp_path):
    rows, out = inspections(spark, SF_DIR), str(tmp_path)
    record = workflows.train_risk_model(rows, out, trees=5, depth=4).first()
    assert record["roc_auc"] > 0.6 and len(record["calibration_bins"]) > 1
    out = current_version(spark, out)
    assert spark.read.json(f"{out}/calibration").count() == 1
    defaults = spark.read.json(f"{out}/lookups/defaults").first()
    request = spark.createDataFrame(
        [(2001, 6, 1990, "Brand#1", None, "M1", "BUILDING", None, 0), (2001, 6, 2005, None, None, "M1", "BUILDING", "NATION_1", 2)],
        "YV_AASTA int, YV_KUU int, ESMANE_REG_AASTA int, MARK string, MUDEL string, KATEGOORIA string, KERETYYP string,"
        " PUNKTI_KOOD string, EELMISED_YV int",
    )
    makes, models = (spark.read.parquet(f"{out}/lookups/{n}") for n in ("makes", "models"))
    ready = P.request_features(request, makes, models, defaults["default_mark_frequency"], defaults["default_model_frequency"])
    scored = P.with_risk_band(R.RiskModel.load(spark, f"{out}/model").score(ready), 0.5).collect()
    assert len(scored) == 2 and all(0 <= r["labimise_skoor"] <= 100 for r in scored)
    assert {r["VANUS"] for r in scored} == {11.0, 0.0}


def test_cluster(spark, tmp_path):
    run = workflows.cluster(inspections(spark, SF_DIR), str(tmp_path), k_max=2, n_init=1)
    n = run.labelled.count()
    assert n > 1000
    assert spark.read.csv(f"{tmp_path}/clustered", header=True).count() == n
    assert spark.read.json(f"{tmp_path}/cluster_profiles").count() == 2
