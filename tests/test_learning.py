"""Splits, encoder, evaluation, model and clusters."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from inspectrum.operators import features as M
from inspectrum.operators import isotonic, kmeans
from inspectrum.operators.categories import CategoryIndex
from inspectrum.operators.encoder import HistoricalRateEncoder
from inspectrum.operators.evaluation import ScoreTable, class_report, classification_metrics, confusion_matrix
from inspectrum.operators.split import prepare_data, stratified_split, temporal_split
from inspectrum.plans import clustering as K
from inspectrum.plans import risk_model as R
from inspectrum.plans.quality import defect_profile
from inspectrum.sources import versions
from inspectrum.sources.schema import ROW_NO, YEAR


def model_rows(spark, years, count):
    rows = [
        (y, i % 12 + 1, "HA" if i % 2 else "MM", i % 2, 5 + i, "TESTMARK", f"MODEL-{i % 2}", "M1", "SEDAAN", 0.9, 0.8, 20.0)
        for y in years
        for i in range(count)
    ]
    schema = (
        "YV_AASTA int, YV_KUU int, PUNKTI_KOOD string, LABIS_ESIMESEL int, VANUS int, MARK string, MUDEL string,"
        " KATEGOORIA string, KERETYYP string, MARK_LABIMISE_MAAR double, MUDEL_LABIMISE_MAAR double, PUNKTI_RANGUS double"
    )
    return spark.createDataFrame(rows, schema).withColumn(ROW_NO, F.monotonically_increasing_id())


def test_latest_year_is_held_out(spark):
    split = prepare_data(M.create_model_frame(model_rows(spark, [2023, 2024, 2025], 6)))
    assert split.info["type"] == "temporal"
    assert split.info["train_years"] == [2023, 2024] and split.info["test_years"] == [2025]
    assert (split.train.count(), split.test.count()) == (12, 6)
    assert (split.info["train_rows"], split.info["test_rows"]) == (12, 6)
    assert not set(M.LEAKAGE_PRONE_FEATURES) & set(M.FEATURES)


def test_one_year_falls_back_to_stratified(spark):
    split = prepare_data(M.create_model_frame(model_rows(spark, [2025], 20)))
    assert split.info["type"] == "stratified_random"
    assert (split.info["train_rows"], split.info["test_rows"]) == (16, 4)
    assert (split.train.count(), split.test.count()) == (16, 4)
    assert split.test.agg(F.sum("LABIS_ESIMESEL")).first()[0] == 2
    assert split.train.select(ROW_NO).intersect(split.test.select(ROW_NO)).isEmpty()


def test_one_class_year_falls_back(spark):
    rows = model_rows(spark, [2024, 2025], 6).filter((F.col("YV_AASTA") == 2024) | (F.col("LABIS_ESIMESEL") == 1))
    assert temporal_split(rows) is None
    assert prepare_data(rows).info["type"] == "stratified_random"


@pytest.mark.parametrize("n,ones", [(7, 3), (23, 1), (101, 50)])
def test_stratified_sizes(spark, n, ones):
    df = spark.range(n).select(F.col("id").alias(ROW_NO), (F.col("id") < ones).cast("int").alias("LABIS_ESIMESEL"))
    split = stratified_split(df)
    assert split.test.count() == math.ceil(0.2 * n) and split.train.count() == n - math.ceil(0.2 * n)


def test_frame_without_vehicle_id(spark):
    frame = M.create_model_frame(model_rows(spark, [2025], 6)).collect()
    assert {r["EELMISED_YV"] for r in frame} == {0.0}
    assert {r["MARK_SAGEDUS"] for r in frame} == {6.0} and {r["MUDEL_SAGEDUS"] for r in frame} == {3.0}


def test_rate_encoder_uses_training_rows_only(spark):
    columns = "MARK string, MUDEL string, KATEGOORIA string, KERETYYP string, PUNKTI_KOOD string"
    train = spark.createDataFrame(
        [("A", "X", "M1", "SEDAAN", "P1", 1)] * 2 + [("B", "Y", "N1", "KAUBIK", "P2", 0)] * 2, columns + ", LABIS_ESIMESEL int"
    )
    test = spark.createDataFrame(
        [("A", "X", "M1", "SEDAAN", "P1"), ("B", "Y", "N1", "KAUBIK", "P2"), ("C", "Z", "M1", "SEDAAN", "P3")], columns
    )
    rates = HistoricalRateEncoder(smoothing=0.0).fit(train)
    out = rates.transform(test)
    assert [r["HIST_MARK_FAIL_RATE"] for r in out.orderBy("MARK").collect()] == [0.0, 1.0, 0.5]
    assert set(M.RATE_FEATURES) <= set(out.columns) and out.columns[: len(test.columns)] == test.columns


def test_encoder_nulls_separators_and_missing_columns(spark):
    """NULL is a key of its own; keys that only differ in where a part ends stay apart."""
    rows = [("a||b", "c", 1), ("a", "b||c", 0), (None, "c", 0), (None, "c", 1), (None, None, 0)]
    train = spark.createDataFrame(rows, "MARK string, MUDEL string, LABIS_ESIMESEL int")
    out = HistoricalRateEncoder(smoothing=0.0).fit(train).transform(train).collect()
    got = {(r["MARK"], r["MUDEL"]): r["HIST_MUDEL_FAIL_RATE"] for r in out}
    assert got == {("a||b", "c"): 0.0, ("a", "b||c"): 1.0, (None, "c"): 0.5, (None, None): 1.0}
    assert {r["HIST_PUNKT_FAIL_RATE"] for r in out} == {0.6}


def test_defect_profile_flags_bad_entries(spark):
    df = spark.createDataFrame([("VO:1;OV:2;EOV:3",), ("BAD:4;VO:not-number;OV:99",)], "RIKKED string")
    df = df.withColumn(YEAR, F.lit(2025))
    known = spark.createDataFrame([(1,), (2,), (3,)], "defect_id long")
    row = defect_profile(df, known).first()
    assert (row["parsed_defects"], row["unknown_severity_entries"], row["malformed_defect_entries"]) == (4, 1, 1)
    assert (row["unique_defect_ids"], row["defect_ids_missing_from_rike"]) == (4, 1)
    assert defect_profile(df, None).first()["defect_ids_missing_from_rike"] is None
    assert defect_profile(df, known.limit(0)).first()["defect_ids_missing_from_rike"] is None


def scores(spark, labels, values):
    return ScoreTable.build(spark.createDataFrame(list(zip(labels, values)), "label int, score double"))


def test_fail_thresholds(spark):
    rows = scores(spark, [0, 0, 1, 1], [0.1, 0.4, 0.8, 0.9]).fail_thresholds((1.0,)).collect()
    assert len(rows) == 1 and rows[0]["min_fail_recall"] == 1.0
    assert rows[0]["fail_recall"] >= 1.0 and rows[0]["fail_precision"] == 1.0
    assert scores(spark, [1, 1], [0.2, 0.3]).fail_thresholds().isEmpty()


def test_probability_quality(spark):
    table = scores(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    assert table.calibration_bins(2).count() == 2
    quality = table.probability_quality(2).first()
    assert quality["brier_score"] < 0.1
    assert quality["brier_score"] == pytest.approx((0.01 + 0.04 + 0.04 + 0.01) / 4)
    assert quality["log_loss"] == pytest.approx(-np.mean(np.log([0.9, 0.8, 0.8, 0.9])))


def test_calibration_bins_match_digitize(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(400), 2)
    p[:3] = [0.0, 1.0, 0.3]
    edges = np.linspace(0, 1, 11)
    expected = np.clip(np.digitize(np.clip(p, 1e-6, 1 - 1e-6), edges, right=True) - 1, 0, 9)
    rows = scores(spark, [1] * 400, p.tolist()).calibration_bins().collect()
    assert {r["bin"]: r["count"] for r in rows} == dict(zip(*np.unique(expected, return_counts=True)))


def test_auc_and_curves_match_pairs(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    s = np.round(np.clip(rng.normal(0.5 + 0.1 * y, 0.2), 0, 1), 2)
    table = scores(spark, y.tolist(), s.tolist())
    gap = s[y == 1][:, None] - s[y == 0][None, :]
    assert table.roc_auc().first()[0] == pytest.approx(((gap > 0) + 0.5 * (gap == 0)).mean())
    for r in table.fail_precision_recall().collect():
        flagged = 1 - s >= r["threshold"]
        assert r["fail_precision"] == pytest.approx((y[flagged] == 0).mean())
        assert r["fail_recall"] == pytest.approx((y[flagged] == 0).sum() / (y == 0).sum())
        assert r["predicted_risk_share"] == pytest.approx(flagged.mean())
    for r in table.roc_curve().collect():
        assert r["tpr"] == pytest.approx((s[y == 1] >= r["threshold"]).mean())
        assert r["fpr"] == pytest.approx((s[y == 0] >= r["threshold"]).mean())


def test_metrics_with_an_empty_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, 1)], "label int, prediction int")
    matrix = confusion_matrix(df)
    assert matrix.count() == 4
    row = classification_metrics(matrix).first()
    assert row["balanced_accuracy"] == pytest.approx(2 / 3) and row["baseline_always_pass_accuracy"] == 1.0
    assert row["precision"] == 1.0
    report = {r["klass"]: r for r in class_report(matrix).collect()}
    assert report["Failed"]["recall"] == 0.0 and report["weighted avg"]["support"] == 3


def test_category_slots(spark):
    """Slots by frequency, then by name; rare values share the last one; values not seen become the zero vector."""
    values = ["b"] * 5 + ["a"] * 5 + ["c"] * 7 + ["x", "y", "y", None]
    df = spark.createDataFrame([(v, "only" if i % 2 else None) for i, v in enumerate(values)], "k string, o string").repartition(4)
    index = CategoryIndex.fit(df, ["k", "o"], least=3)
    assert index.kept == {"k": 3, "o": 1} and index.sizes == {"k": 4, "o": 1}
    slots = {(r["name"], r["value"]): r["slot"] for r in index.table.collect()}
    assert slots == {("k", "c"): 0, ("k", "a"): 1, ("k", "b"): 2, ("k", "x"): 3, ("k", "y"): 3, ("o", "only"): 0}
    asked = spark.createDataFrame([("c", "only"), ("y", "new"), ("new", None), (None, "only")], "k string, o string")
    rows = index.encoder().transform(index.transform(asked)).collect()
    got = {(r["k"], r["o"]): (r["k_vec"].toArray().tolist(), r["o_vec"].toArray().tolist()) for r in rows}
    assert got["c", "only"] == ([1, 0, 0, 0], [1]) and got["y", "new"] == ([0, 0, 0, 1], [0])
    assert got["new", None] == ([0, 0, 0, 0], [0]) and got[None, "only"] == ([0, 0, 0, 0], [1])
    names = {r["position"]: r["feature"] for r in index.names(2).collect()}
    assert names == {2: "k_c", 3: "k_a", 4: "k_b", 5: "k_(muu)", 6: "o_only"}


def test_a_version_that_is_not_finished_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        versions.current_version(spark, path)

    def part(text):
        return lambda folder: spark.createDataFrame([(text,)], "t string").write.text(f"{folder}/part")

    def stops(folder):
        part("half")(folder)
        raise RuntimeError("stopped between parts")

    def read():
        return spark.read.text(f"{versions.current_version(spark, path)}/part").first()["value"]

    first = versions.write_version(spark, path, part("one"))
    with pytest.raises(RuntimeError):
        versions.write_version(spark, path, stops)
    assert read() == "one"
    versions.write_version(spark, path, part("two"))
    assert read() == "two" and spark.read.text(f"{first}/part").count() == 1
    versions.write_version(spark, path, part("three"))
    assert read() == "three" and not (tmp_path / "v" / "versions" / first.rsplit("/", 1)[1]).exists()


def test_isotonic_is_monotone_and_clips(spark):
    table = scores(spark, [0, 1, 0, 1, 1], [0.2, 0.3, 0.4, 0.6, 0.8])
    fitted = R.fit_isotonic(table)
    probe = spark.createDataFrame([(0.0,), (0.2,), (0.35,), (0.8,), (1.0,)], "features double")
    got = [r["prediction"] for r in fitted.transform(probe, "features").orderBy("features").collect()]
    assert got == sorted(got) and got[0] == 0.0 and got[-1] == 1.0 and got[2] == pytest.approx(0.5)


def _pooled_means(points):
    """Least-squares increasing fit of (passes, n) in order, by the min-max formula."""
    sums = np.cumsum([[0, 0], *points], axis=0).astype(float)
    mean = lambda j, k: (sums[k + 1, 0] - sums[j, 0]) / (sums[k + 1, 1] - sums[j, 1])
    size = range(len(points))
    return [max(min(mean(j, k) for k in size if k >= i) for j in size if j <= i) for i in size]


@pytest.mark.parametrize("trend", ["rising", "falling", "noise", "steps"])
def test_isotonic_over_parts(spark, trend):
    """Parts that pool in themselves, over one seam, over all seams, or nowhere; fan-in of three needs several rounds."""
    rng = np.random.default_rng(len(trend))
    n = 60
    x = np.sort(rng.choice(1000, n, replace=False)) / 1000
    p = {"rising": x, "falling": 1 - x, "noise": np.full(n, 0.5), "steps": np.floor(x * 4) / 4}[trend]
    size = rng.integers(1, 40, n)
    good = rng.binomial(size, p)
    rows = [(float(a), int(g), int(s - g), i // 4) for i, (a, g, s) in enumerate(zip(x, good, size))]
    counts = spark.createDataFrame(rows, "score double, passes long, fails long, __part int").repartition(5)
    before, isotonic.FAN = isotonic.FAN, 3
    try:
        fit = isotonic.IsotonicFit.of(counts)
    finally:
        isotonic.FAN = before
    got = {r["score"]: r["prediction"] for r in fit.transform(counts.select("score"), "score").collect()}
    assert [got[a] for a in sorted(got)] == pytest.approx(_pooled_means(list(zip(good, size))))
    corners = sorted(tuple(r) for r in fit.corners.collect())
    between = spark.createDataFrame([(float(v),) for v in rng.random(50)] + [(-1.0,), (2.0,), (None,)], "v double")
    for row in fit.transform(between, "v").collect():
        want = None if row["v"] is None else np.interp(row["v"], *zip(*corners))
        assert row["prediction"] == (pytest.approx(want) if want is not None else None)


def test_isotonic_of_many_scores_that_never_pool(spark):
    """Every score is a block of its own: nothing moves at the seams, and no task or driver holds the curve."""
    n = 400_000
    counts = spark.range(n).select((F.col("id") / n).alias("score"), (F.col("id") + 1).alias("passes"), (n - F.col("id")).alias("fails"))
    table = ScoreTable.from_counts(counts)
    fit = R.fit_isotonic(table)
    assert fit.corners.count() == n
    assert isotonic._merged(isotonic._pool_parts(table.counts.select(F.col("__part").cast("long").alias("part"), F.col("score").alias("low"), F.col("score").alias("high"), F.col("passes").alias("good"), F.lit(n + 1).cast("long").alias("n")))).count() == n
    off = fit.transform(table.counts.select("score", "passes"), "score").filter(F.abs(F.col("prediction") - F.col("passes") / (n + 1)) > 1e-12)
    assert off.count() == 0


def test_isotonic_of_nothing(spark):
    table = scores(spark, [], [])
    got = R.fit_isotonic(table).transform(spark.createDataFrame([(0.5,)], "v double"), "v").first()
    assert got["prediction"] is None


@pytest.fixture(scope="module")
def learned(spark):
    """A small problem in which age decides the outcome."""
    rows = []
    rng = np.random.default_rng(2)
    for i in range(1500):
        age = int(rng.integers(0, 30))
        passed = int(rng.random() > age / 35)
        rows.append((i % 200, 2021 + i % 4, i % 12 + 1, passed, age, f"M{i % 5}", f"T{i % 9}", "M1", "SEDAAN", f"P{i % 3}", i))
    schema = (
        "SOIDUK_ID long, YV_AASTA int, YV_KUU int, LABIS_ESIMESEL int, VANUS int, MARK string, MUDEL string,"
        f" KATEGOORIA string, KERETYYP string, PUNKTI_KOOD string, {ROW_NO} long"
    )
    frame = M.create_model_frame(spark.createDataFrame(rows, schema)).cache()
    split = prepare_data(frame)
    return frame, split, R.train_model(split.train, trees=8, depth=5)


def test_model_learns_and_repeats(spark, learned, tmp_path):
    frame, split, model = learned
    record, table, matrix = R.evaluate(model, split.test)
    row = record.first()
    assert row["roc_auc"] > 0.7 and 0 < row["brier_score"] < 0.25
    assert matrix.agg(F.sum("n")).first()[0] == split.info["test_rows"] == table.rows
    importance = model.feature_importance(spark)
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert importance.orderBy(F.desc("importance")).first()["feature"] in ("VANUS", "VANUS_RUUT")
    model.save(str(tmp_path / "m"))
    again = R.RiskModel.load(spark, str(tmp_path / "m"))
    a, b = (m.score(split.test).orderBy(ROW_NO).select("score").toPandas() for m in (model, again))
    assert a.equals(b)
    twin = R.train_model(split.train, trees=8, depth=5).score(split.test).orderBy(ROW_NO).select("score").toPandas()
    assert np.allclose(a, twin)


def test_unseen_categories_score(spark, learned):
    _, split, model = learned
    odd = split.test.limit(5).withColumns({"MARK": F.lit("UUS"), "PUNKTI_KOOD": F.lit(None).cast("string")})
    assert model.score(odd).filter(F.col("score").between(0, 1)).count() == 5


def test_temporal_calibration(spark, learned):
    frame, _, _ = learned
    row = R.temporal_calibration(frame, trees=8, depth=5).first()
    assert row["train_years"] == [2021, 2022] and (row["calibration_year"], row["test_year"]) == (2023, 2024)
    assert row["brier_improvement"] == pytest.approx(row["raw_brier_score"] - row["calibrated_brier_score"])
    for side in ("raw", "calibrated"):
        bins = row[f"{side}_calibration_bins"]
        assert sum(b["count"] for b in bins) == frame.filter(F.col("YV_AASTA") == 2024).count()
        assert sum(b["count"] * b["absolute_error"] for b in bins) / sum(b["count"] for b in bins) == pytest.approx(row[f"{side}_expected_calibration_error"])
    assert R.temporal_calibration(frame.filter(F.col("YV_AASTA") > 2022)) is None


def test_encoder_without_training_rows(spark):
    rows = spark.createDataFrame([("A", "X", "M1", "SEDAAN", "P1", 1)], "MARK string, MUDEL string, KATEGOORIA string, KERETYYP string, PUNKTI_KOOD string, LABIS_ESIMESEL int")
    got = HistoricalRateEncoder().fit(rows.limit(0)).transform(rows).first()
    assert got["HIST_MARK_FAIL_RATE"] == 0.0 and got["HIST_PUNKT_KATEGOORIA_FAIL_RATE"] == 0.0


def _lloyd(x, centres, tolerance, max_iter=300):
    for _ in range(max_iter):
        label = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else c for j, c in enumerate(centres)])
        moved, centres = ((new - centres) ** 2).sum(), new
        if moved <= tolerance:
            break
    return centres, ((x[:, None] - centres) ** 2).sum(2).min(1).sum()


def test_all_fits_share_their_scans(spark):
    """Every fit of the batch ends where a fit by itself ends, in as many scans as the slowest one takes."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 1.0, (150, 3)) for c in (0, 4, 9)])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(5).cache()
    pool, weights = kmeans.candidates(rows, 4, 42)
    assert weights.sum() == len(x) and 1 < len(pool) <= 1 + kmeans.ROUNDS * kmeans.DRAWN * 4
    found = kmeans.sweep(rows, [2, 3, 4], n_init=4)
    tolerance, longest = kmeans.TOLERANCE * x.var(0).mean(), 0
    for i, fit in enumerate(found.fits):
        start = kmeans.seeded(pool, weights, fit.k, np.random.default_rng([42, fit.k, i % 4]))
        centres, inertia = _lloyd(x, start, tolerance)
        assert fit.centres == pytest.approx(centres) and fit.inertia == pytest.approx(inertia)
    assert len(found.fits) == 12 and found.scans < 60
    assert found.best[3].inertia == min(f.inertia for f in found.fits if f.k == 3) < found.best[2].inertia
    labels = {r["id"]: r["c"] for r in kmeans.labelled(rows, found.best[3].centres, "c").collect()}
    pairs = [(Vectors.dense(r), labels[i]) for i, r in enumerate(x)]
    assert kmeans.silhouettes(rows, [found.best[3].centres])[0] == pytest.approx(K.silhouette(spark.createDataFrame(pairs, ["features", "KLASTER"])))
    assert kmeans.sweep(rows.limit(0), [2]).best == {}
    same = rows.select("id", F.array(F.lit(1.0)).alias("x"))
    only = kmeans.sweep(same, [2], n_init=2)
    assert only.best[2].inertia == 0 and np.isnan(kmeans.silhouettes(same, [only.best[2].centres])[0])


def test_clustering(spark, learned):
    frame, _, _ = learned
    run = K.run_clustering(frame, k_max=3, n_init=2)
    n = K.make_cluster_frame(frame).count()
    assert run.labelled.count() == n and [s["k"] for s in run.scores] == [2, 3]
    assert run.scores[1]["inertia"] < run.scores[0]["inertia"]
    assert run.profiles.agg(F.sum("size")).first()[0] == n
    assert run.record.first()["n_rows"] == n
    assert not set(K.EXCLUDED) & set(K.CLUSTER_NUMERIC + K.CLUSTER_CATEGORICAL)


def test_silhouette_on_squared_distances(spark):
    rng = np.random.default_rng(4)
    x, labels = rng.normal(size=(120, 4)), rng.integers(0, 3, size=120)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    values = []
    for i in range(120):
        a = d[i, (labels == labels[i]) & (np.arange(120) != i)].mean()
        b = min(d[i, labels == k].mean() for k in set(labels) - {labels[i]})
        values.append((b - a) / max(a, b))
    rows = [(Vectors.dense(v), int(k)) for v, k in zip(x, labels)]
    assert K.silhouette(spark.createDataFrame(rows, ["features", "KLASTER"])) == pytest.approx(np.mean(values))
    assert np.isnan(K.silhouette(spark.createDataFrame([(r[0], 0) for r in rows], ["features", "KLASTER"])))


def test_standardized_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    rows = K.standardize(df, ["a", "b"]).orderBy("a").collect()
    z = np.array([1.0, 2.0, 4.0])
    assert np.allclose([r["a_z"] for r in rows], (z - z.mean()) / z.std()) and {r["b_z"] for r in rows} == {0.0}
