"""Whole runs from landed inspections to written results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectrum.operators import features as M
from inspectrum.operators.cleaning import clean_batch, clean_for_model, is_regular
from inspectrum.operators.split import prepare_data
from inspectrum.plans import clustering as K
from inspectrum.plans import risk_model as R
from inspectrum.plans.quality import cleaning_summary, validation_report
from inspectrum.sources import sinks
from inspectrum.sources.schema import ROW_NO
from inspectrum.sources.versions import write_version
from inspectrum.sources.workspace import materialize


def validate(rows: DataFrame, known: DataFrame | None, out: str) -> DataFrame:
    """Validation report per source year, as CSV and JSON."""
    report = materialize(validation_report(rows, known), "validation").orderBy("year")
    sinks.write_csv(report, f"{out}/data_validation_csv")
    sinks.write_json(report, f"{out}/data_validation_json")
    return report


def clean_and_describe(rows: DataFrame, out: str) -> DataFrame:
    """Cleaned regular inspections and their exploratory features as Parquet; returns the summary."""
    spark = rows.sparkSession
    sinks.write_parquet(clean_batch(rows.filter(is_regular())), f"{out}/cleaned")
    cleaned = spark.read.parquet(f"{out}/cleaned")
    sinks.write_parquet(M.create_exploratory_features(cleaned), f"{out}/features")
    return cleaning_summary(cleaned)


def train_risk_model(rows: DataFrame, out: str, **forest_params) -> DataFrame:
    """Train, evaluate, calibrate and save the risk model with its lookups; returns the evaluation record.

    All parts are one version of the folder `out`: readers see all of them or those of the run before.
    """
    spark = rows.sparkSession
    frame = materialize(M.create_model_frame(clean_for_model(rows)), "model-frame")
    parts = prepare_data(frame)
    model = R.train_model(parts.train, **forest_params)
    record, _, _ = R.evaluate(model, parts.test)
    calibration = R.temporal_calibration(frame, **forest_params)

    def write(folder: str) -> None:
        model.save(f"{folder}/model")
        sinks.write_json(record, f"{folder}/metrics")
        sinks.write_json(R.model_metadata(model, parts.info, spark), f"{folder}/metadata")
        if calibration is not None:
            sinks.write_json(calibration, f"{folder}/calibration")
        sinks.write_parquet(M.make_lookup(frame), f"{folder}/lookups/makes")
        sinks.write_parquet(M.model_lookup(frame), f"{folder}/lookups/models")
        sinks.write_parquet(M.options(frame), f"{folder}/lookups/options")
        sinks.write_json(M.lookup_defaults(frame), f"{folder}/lookups/defaults")

    folder = write_version(spark, out, write)
    return spark.read.schema(record.schema).json(f"{folder}/metrics")


def cluster(rows: DataFrame, out: str, **params) -> K.Clustering:
    """Cluster every row and write profiles, the run record and the assignments."""
    run = K.run_clustering(clean_for_model(rows), **params)
    sinks.write_json(run.profiles, f"{out}/cluster_profiles")
    sinks.write_json(run.record, f"{out}/cluster_metadata")
    sinks.write_csv(run.labelled.select(ROW_NO, F.col(K.CLUSTER)), f"{out}/clustered")
    return run
