"""Features, encoders, splits, evaluation, risk model and clusters."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectrum.checks import sql as S
from inspectrum.checks.adapter import inspections
from inspectrum.checks.registry import check, once
from inspectrum.checks.rows import RANGUS, SCORE_SQL, counted, model_rows, score
from inspectrum.operators import cleaning as C
from inspectrum.operators import evaluation as E
from inspectrum.operators import features as M
from inspectrum.operators import kmeans
from inspectrum.operators import split as X
from inspectrum.operators.categories import CategoryIndex, vector_column
from inspectrum.operators.encoder import RATE_SPECS, HistoricalRateEncoder
from inspectrum.operators.ordered import exact_medians, modes
from inspectrum.operators.sampling import exact_sample
from inspectrum.plans import clustering as K
from inspectrum.plans import risk_model as R
from inspectrum.plans import scoring as P
from inspectrum.sources import sinks
from inspectrum.sources.schema import ROW_NO
from inspectrum.sources.workspace import materialize, work_path

WAVES = {c: f"round({c}, 9) + 0.0 AS {c}" for c in ("KUU_SIN", "KUU_COS")}


def smooth_waves(df: DataFrame) -> DataFrame:
    """Round sine and cosine for comparison; adding 0.0 removes a negative zero."""
    return df.withColumns({c: F.round(c, 9) + 0.0 for c in WAVES})


#: Cleaned columns that the frame is made of: the other raw text is neither shuffled nor written with them.
FRAME_SOURCES = [ROW_NO, "SOIDUK_ID", "YV_AASTA", "YV_KUU", "VANUS", C.TARGET, *M.RATE_SOURCES]


def frame(spark, sf) -> DataFrame:
    """The model frame, written once."""
    return once(spark, sf, "frame", lambda: materialize(M.create_model_frame(model_rows(spark, sf).select(*FRAME_SOURCES)), "frame"))


def split(spark, sf) -> X.Split:
    return once(spark, sf, "split", lambda: X.prepare_data(frame(spark, sf)))


def model(spark, sf) -> R.RiskModel:
    return once(spark, sf, "model", lambda: R.train_model(split(spark, sf).train))


def evaluated(spark, sf):
    return once(spark, sf, "evaluated", lambda: R.evaluate(model(spark, sf), split(spark, sf).test))


_FEATURES = ", ".join(
    WAVES.get(c, f"{c}::DOUBLE AS {c}") if c in M.NUMERIC_FEATURES else c for c in M.FEATURES
)


@check(
    "m3_model_frame",
    S.with_(S.MODEL_FRAME) + f"SELECT SOIDUK_ID, YV_AASTA, YV_KUU, LABIS_ESIMESEL, {_FEATURES} FROM frame",
)
def m3(spark, sf):
    rows = M.create_model_frame(model_rows(spark, sf).select(*FRAME_SOURCES))
    return smooth_waves(rows.select("SOIDUK_ID", "YV_AASTA", "YV_KUU", C.TARGET, *M.FEATURES))


@check(
    "m5_exploratory_features",
    S.with_(
        S.NUMBERED.replace("ylev AS", "all_rows AS", 1), f"ylev AS (SELECT * FROM all_rows WHERE {S.REG})", S.CLEAN_BATCH, RANGUS
    )
    + """, f AS (SELECT *, count(*) OVER (PARTITION BY MARK) AS nm, sum(LABIS_ESIMESEL) OVER (PARTITION BY MARK) AS pm,
 CASE WHEN MUDEL IS NOT NULL THEN count(*) OVER (PARTITION BY MUDEL) END AS nd, sum(LABIS_ESIMESEL) OVER (PARTITION BY MUDEL) AS pd,
 avg(LABIS_ESIMESEL) OVER () AS g, row_number() OVER (PARTITION BY SOIDUK_ID ORDER BY RIDA_NR) - 1 AS prev FROM clean LEFT JOIN rangus USING (PUNKTI_KOOD)
 WHERE LABIS_ESIMESEL IS NOT NULL AND VANUS IS NOT NULL AND MARK IS NOT NULL AND KATEGOORIA IS NOT NULL AND KERETYYP IS NOT NULL)
 SELECT SOIDUK_ID, YV_KUUPAEV, VANUS, VANUS * VANUS AS VANUS_RUUT, (VANUS > 10)::INTEGER AS ON_VANA,
 round(sin(2.0::DOUBLE * pi() * YV_KUU / 12), 9) + 0.0 AS KUU_SIN, round(cos(2.0::DOUBLE * pi() * YV_KUU / 12), 9) + 0.0 AS KUU_COS,
 nm AS MARK_SAGEDUS, round((pm + 100 * g) / (nm + 100), 9) AS MARK_LABIMISE_MAAR, COALESCE(nd, 0) AS MUDEL_SAGEDUS,
 CASE WHEN MUDEL IS NOT NULL THEN round((pd + 100 * g) / (nd + 100), 9) END AS MUDEL_LABIMISE_MAAR, -1 AS KERETYYP_KOOD,
 nullif(regexp_extract(KATEGOORIA, '^([A-Z]+)', 1), '') AS KAT_GRUPP, PUNKTI_RANGUS, prev AS EELMISED_YV FROM f""",
)
def m5(spark, sf):
    rows = M.create_exploratory_features(C.clean_batch(inspections(spark, sf).filter(C.is_regular())))
    rates = {c: F.round(c, 9) for c in ("MARK_LABIMISE_MAAR", "MUDEL_LABIMISE_MAAR")}
    kept = [
        "SOIDUK_ID", "YV_KUUPAEV", "VANUS", "VANUS_RUUT", "ON_VANA", "KUU_SIN", "KUU_COS", "MARK_SAGEDUS",
        "MARK_LABIMISE_MAAR", "MUDEL_SAGEDUS", "MUDEL_LABIMISE_MAAR", "KERETYYP_KOOD", "KAT_GRUPP", "PUNKTI_RANGUS", "EELMISED_YV",
    ]
    return smooth_waves(rows.withColumns(rates)).select(*kept)


@check(
    "e6_mark_stats_joined",
    S.with_(S.MODEL_FRAME)
    + "SELECT MARK, count(*) OVER (PARTITION BY MARK) AS mark_kokku, round(avg(LABIS_ESIMESEL) OVER (PARTITION BY MARK), 9) AS mark_labis, KATEGOORIA FROM frame",
)
def e6(spark, sf):
    rows = frame(spark, sf)
    stats = rows.groupBy("MARK").agg(F.count(C.TARGET).alias("mark_kokku"), F.round(F.avg(C.TARGET), 9).alias("mark_labis"))
    return rows.join(materialize(stats, "mark-stats"), "MARK", "left").select("MARK", "mark_kokku", "mark_labis", "KATEGOORIA")


TRAIN = "train AS (SELECT * FROM frame WHERE YV_AASTA < (SELECT max(YV_AASTA) FROM frame)), test AS (SELECT * FROM frame WHERE YV_AASTA = (SELECT max(YV_AASTA) FROM frame))"


def _rate_ctes() -> str:
    parts = ["g AS (SELECT avg(1 - LABIS_ESIMESEL) AS g FROM train)"]
    for i, cols in enumerate(RATE_SPECS.values()):
        keys = ", ".join(f"COALESCE({c}, '__MISSING__') AS k{j}" for j, c in enumerate(cols))
        group = ", ".join(str(j + 1) for j in range(len(cols)))
        parts.append(
            f"r{i} AS (SELECT {keys}, sum(1 - LABIS_ESIMESEL)::BIGINT AS fails, count(*) AS n,"
            f" (sum(1 - LABIS_ESIMESEL) + 100 * (SELECT g FROM g)) / (count(*) + 100) AS rate FROM train GROUP BY {group})"
        )
    return ", ".join(parts)


def _rate_joins() -> str:
    out = []
    for i, cols in enumerate(RATE_SPECS.values()):
        on = " AND ".join(f"COALESCE(t.{c}, '__MISSING__') = r{i}.k{j}" for j, c in enumerate(cols))
        out.append(f"LEFT JOIN r{i} ON {on}")
    return " ".join(out)


_RATES = ", ".join(f"round(COALESCE(r{i}.rate, (SELECT g FROM g)), 9) AS {name}" for i, name in enumerate(RATE_SPECS))
_SOURCES = ", ".join(M.RATE_SOURCES)


@check(
    "m6_rate_encoder",
    S.with_(S.MODEL_FRAME, TRAIN, _rate_ctes())
    + f"SELECT {', '.join(f't.{c}' for c in M.RATE_SOURCES)}, {_RATES} FROM test t {_rate_joins()}",
)
def m6(spark, sf):
    """Fitted on the training years, applied to the held-out year."""
    rates = HistoricalRateEncoder().fit(split(spark, sf).train)
    out = rates.transform(split(spark, sf).test)
    return out.select(*M.RATE_SOURCES, *[F.round(c, 9).alias(c) for c in RATE_SPECS])


@check(
    "e7_rates_joined_with_unseen",
    S.with_(S.MODEL_FRAME, TRAIN, _rate_ctes())
    + f"SELECT {', '.join(f't.{c}' for c in M.RATE_SOURCES)}, {_RATES}, count(*) AS n FROM (SELECT * REPLACE (CASE WHEN YV_KUU = 1 THEN 'UUS' WHEN YV_KUU = 2 THEN NULL ELSE MARK END AS MARK) FROM test) t {_rate_joins()} GROUP BY ALL",
)
def e7(spark, sf):
    """Makes are replaced by an unseen one in January and removed in February."""
    rates = HistoricalRateEncoder().fit(split(spark, sf).train)
    month = F.col("YV_KUU")
    make = F.when(month == 1, "UUS").when(month != 2, F.col("MARK"))
    out = rates.transform(split(spark, sf).test.withColumn("MARK", make))
    return counted(out, *M.RATE_SOURCES, *[F.round(c, 9).alias(c) for c in RATE_SPECS])


@check("f6_group_stats", S.with_(S.MODEL_FRAME) + "SELECT MUDEL, count(*) AS n, round(avg(LABIS_ESIMESEL), 9) AS maar FROM frame WHERE MUDEL IS NOT NULL GROUP BY 1")
def f6(spark, sf):
    rows = frame(spark, sf).dropna(subset=["MUDEL"])
    return rows.groupBy("MUDEL").agg(F.count(C.TARGET).alias("n"), F.round(F.avg(C.TARGET), 9).alias("maar"))


@check("f7_fail_sums_by_key", S.with_(S.MODEL_FRAME, TRAIN, _rate_ctes()) + "SELECT k0 AS MARK, k1 AS MUDEL, fails, n, round(rate, 9) AS rate FROM r1")
def f7(spark, sf):
    rates = HistoricalRateEncoder().fit(split(spark, sf).train)
    table = rates.table(spark, "HIST_MUDEL_FAIL_RATE")
    return table.select(F.col("__key_MARK").alias("MARK"), F.col("__key_MUDEL").alias("MUDEL"), "fails", "n", F.round("rate", 9).alias("rate"))


_NUMERIC = [c for c in M.NUMERIC_FEATURES if c not in WAVES]


@check(
    "m7_median_imputation",
    S.with_(S.MODEL_FRAME)
    + f"""SELECT name, median(v) AS median, round(avg(COALESCE(v, m)), 6) AS keskmine FROM (SELECT *, median(v) OVER (PARTITION BY name) AS m FROM (
 SELECT unnest([{', '.join(f"'{c}'" for c in _NUMERIC)}]) AS name, unnest([{', '.join(_NUMERIC)}]::DOUBLE[]) AS v FROM frame)) GROUP BY name""",
)
def m7(spark, sf):
    rows, medians = frame(spark, sf), exact_medians(frame(spark, sf), _NUMERIC)
    filled = rows.fillna({r["name"]: r["median"] for r in medians.collect()})
    means = filled.agg(*[F.round(F.avg(c), 6).alias(c) for c in _NUMERIC]).unpivot([], _NUMERIC, "name", "keskmine")
    return medians.join(means, "name")


@check(
    "m8_mode_imputation",
    S.with_(S.MODEL_FRAME)
    + f"""SELECT name, v AS mode FROM (SELECT name, v, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, v) AS r FROM (
 SELECT unnest([{', '.join(f"'{c}'" for c in M.CATEGORICAL_FEATURES)}]) AS name, unnest([{', '.join(M.CATEGORICAL_FEATURES)}]) AS v FROM frame)
 WHERE v IS NOT NULL GROUP BY 1, 2) WHERE r = 1""",
)
def m8(spark, sf):
    return modes(frame(spark, sf), M.CATEGORICAL_FEATURES)


@check(
    "m8_one_hot_slots",
    S.with_(S.MODEL_FRAME, TRAIN)
    + """, sizes AS (SELECT name, value, count(*) AS n FROM (SELECT unnest(['KATEGOORIA', 'MARK', 'MUDEL']) AS name, unnest([KATEGOORIA, MARK, MUDEL]) AS value
  FROM train WHERE KATEGOORIA <> 'N2') WHERE value IS NOT NULL GROUP BY 1, 2),
 kept AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) - 1 AS slot FROM sizes WHERE n >= 10),
 slots AS (SELECT * FROM kept UNION ALL SELECT s.name, s.value, (SELECT count(*) FROM kept k WHERE k.name = s.name) FROM sizes s WHERE n < 10),
 rows AS (SELECT unnest(['KATEGOORIA', 'MARK', 'MUDEL']) AS name, unnest([KATEGOORIA, MARK, MUDEL]) AS value FROM test)
 SELECT name, value, COALESCE(slot, -1) AS slot, count(*) AS n FROM rows LEFT JOIN slots USING (name, value) WHERE value IS NOT NULL GROUP BY 1, 2, 3""",
)
def m8_one_hot(spark, sf):
    """One category is withheld from fitting: it must become the all-zero vector. Rare models share a slot."""
    parts, columns = split(spark, sf), ["KATEGOORIA", "MARK", "MUDEL"]
    train = parts.train.filter(F.col("KATEGOORIA") != "N2")
    index = CategoryIndex.fit(train, columns)
    rows = index.encoder().transform(index.transform(parts.test))
    slots = [F.struct(F.lit(c).alias("name"), F.col(c).alias("value"), (F.array_position(vector_to_array(vector_column(c)), 1.0) - 1).alias("slot")) for c in columns]
    return counted(rows.select(F.inline(F.array(*slots))).filter("value IS NOT NULL"), "name", "value", "slot")


@check(
    "m11_temporal_split",
    S.with_(S.MODEL_FRAME)
    + "SELECT CASE WHEN YV_AASTA >= 2000 THEN 'test' ELSE 'train' END AS osa, YV_AASTA, count(*) AS ridu, sum(LABIS_ESIMESEL)::BIGINT AS labis FROM frame GROUP BY 1, 2",
)
def m11(spark, sf):
    """The two latest years are held out."""
    s = X.temporal_split(frame(spark, sf), holdout_years=2)
    both = s.train.withColumn("osa", F.lit("train")).unionByName(s.test.withColumn("osa", F.lit("test")))
    return both.groupBy("osa", "YV_AASTA").agg(F.count("*").alias("ridu"), F.sum(C.TARGET).alias("labis"))


@check(
    "m12_stratified_split",
    S.with_(S.MODEL_FRAME)
    + """, c AS (SELECT LABIS_ESIMESEL AS y, count(*) AS n FROM frame GROUP BY 1),
 t AS (SELECT *, ceil(0.2 * sum(n) OVER ()) AS total, ceil(0.2 * sum(n) OVER ()) * n / sum(n) OVER ()::DOUBLE AS e FROM c),
 a AS (SELECT *, floor(e) + CASE WHEN row_number() OVER (ORDER BY floor(e) - e, y) <= total - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS k FROM t)
 SELECT 'test' AS osa, y AS LABIS_ESIMESEL, k::BIGINT AS ridu FROM a UNION ALL SELECT 'train', y, (n - k)::BIGINT FROM a""",
)
def m12(spark, sf):
    s = X.stratified_split(frame(spark, sf))
    both = s.train.withColumn("osa", F.lit("train")).unionByName(s.test.withColumn("osa", F.lit("test")))
    return both.groupBy("osa", C.TARGET).agg(F.count("*").alias("ridu"))


@check(
    "m13_prepared_data",
    S.with_(S.MODEL_FRAME, TRAIN)
    + "SELECT 'temporal' AS tyyp, (SELECT count(*) FROM train) AS train_rows, (SELECT count(*) FROM test) AS test_rows, count(*) AS kokku FROM frame",
)
def m13(spark, sf):
    rows = frame(spark, sf)
    info = X.prepare_data(rows).info
    return rows.agg(F.count("*").alias("kokku")).withColumns(
        {
            "tyyp": F.lit(info["type"]),
            "train_rows": F.lit(info["train_rows"]).cast("bigint"),
            "test_rows": F.lit(info["test_rows"]).cast("bigint"),
        }
    )


@check("m14_make_lookup", S.with_(S.MODEL_FRAME) + "SELECT MARK, count(*) AS sagedus FROM frame WHERE MARK IS NOT NULL GROUP BY 1")
def m14(spark, sf):
    return M.make_lookup(frame(spark, sf))


@check("m14_model_lookup", S.with_(S.MODEL_FRAME) + "SELECT MARK, MUDEL, count(*) AS sagedus FROM frame WHERE MARK IS NOT NULL AND MUDEL IS NOT NULL GROUP BY 1, 2")
def m14_models(spark, sf):
    return M.model_lookup(frame(spark, sf))


@check(
    "m14_options",
    S.with_(S.MODEL_FRAME)
    + "SELECT DISTINCT name, value FROM (SELECT unnest(['KATEGOORIA', 'KERETYYP', 'PUNKTI_KOOD']) AS name, unnest([KATEGOORIA, KERETYYP, PUNKTI_KOOD]) AS value FROM frame) WHERE value IS NOT NULL",
)
def m14_options(spark, sf):
    return M.options(frame(spark, sf))


DEFAULTS = "defaults AS (SELECT trunc(median(MARK_SAGEDUS))::BIGINT AS dm, trunc(median(MUDEL_SAGEDUS))::BIGINT AS dd, max(YV_AASTA) AS latest FROM frame)"


@check(
    "m14_defaults",
    S.with_(S.MODEL_FRAME, DEFAULTS) + "SELECT dm AS default_mark_frequency, dd AS default_model_frequency, latest AS latest_training_year FROM defaults",
)
def m14_defaults(spark, sf):
    return M.lookup_defaults(frame(spark, sf))


def requests(spark, sf) -> DataFrame:
    """Every cleaned row as a request; makes are unknown in January and missing in February."""
    month = F.col("YV_KUU")
    make = F.when(month == 1, "UUS").when(month != 2, F.col("MARK"))
    rows = model_rows(spark, sf).dropna(subset=["ESMANE_REG_AASTA", "YV_AASTA", "YV_KUU"]).withColumn("MARK", make)
    columns = ["SOIDUK_ID", "YV_AASTA", "YV_KUU", "ESMANE_REG_AASTA", *M.RATE_SOURCES]
    return rows.select(*columns, F.lit(0).alias("EELMISED_YV"))


def request_rows(spark, sf) -> DataFrame:
    rows = frame(spark, sf)
    defaults = once(spark, sf, "defaults", lambda: M.lookup_defaults(rows).first())
    makes = once(spark, sf, "makes", lambda: materialize(M.make_lookup(rows), "makes"))
    models = once(spark, sf, "models", lambda: materialize(M.model_lookup(rows), "models"))
    return P.request_features(
        requests(spark, sf), makes, models, defaults["default_mark_frequency"], defaults["default_model_frequency"]
    )


@check(
    "m15_request_features",
    S.with_(S.MODEL_FRAME, DEFAULTS)
    + f""", req AS (SELECT * REPLACE (CASE WHEN YV_KUU = 1 THEN 'UUS' WHEN YV_KUU <> 2 THEN MARK END AS MARK) FROM clean
  WHERE ESMANE_REG_AASTA IS NOT NULL AND YV_AASTA IS NOT NULL AND YV_KUU IS NOT NULL),
 mk AS (SELECT MARK, count(*) AS n FROM frame WHERE MARK IS NOT NULL GROUP BY 1),
 md AS (SELECT MARK, MUDEL, count(*) AS n FROM frame WHERE MARK IS NOT NULL AND MUDEL IS NOT NULL GROUP BY 1, 2)
 SELECT r.MARK, r.MUDEL, r.YV_KUU, greatest(YV_AASTA - ESMANE_REG_AASTA, 0)::DOUBLE AS VANUS,
 (greatest(YV_AASTA - ESMANE_REG_AASTA, 0) * greatest(YV_AASTA - ESMANE_REG_AASTA, 0))::DOUBLE AS VANUS_RUUT,
 (YV_AASTA - ESMANE_REG_AASTA > 10)::INTEGER::DOUBLE AS ON_VANA, COALESCE(mk.n, (SELECT dm FROM defaults))::DOUBLE AS MARK_SAGEDUS,
 COALESCE(md.n, (SELECT dd FROM defaults))::DOUBLE AS MUDEL_SAGEDUS, count(*) AS n
 FROM req r LEFT JOIN mk ON mk.MARK = r.MARK LEFT JOIN md ON md.MARK = r.MARK AND md.MUDEL = r.MUDEL GROUP BY ALL""",
)
def m15_features(spark, sf):
    return counted(request_rows(spark, sf), "MARK", "MUDEL", "YV_KUU", "VANUS", "VANUS_RUUT", "ON_VANA", "MARK_SAGEDUS", "MUDEL_SAGEDUS")


def risk_threshold(spark, sf) -> float | None:
    """The 0.80-recall threshold of the held-out year."""
    row = evaluated(spark, sf)[1].fail_thresholds((0.80,)).first()
    return row["threshold"] if row else None


@check("m15_batch_scores")
def m15(spark, sf):
    scored = P.with_risk_band(model(spark, sf).score(request_rows(spark, sf)), risk_threshold(spark, sf))
    return scored.select("SOIDUK_ID", "YV_AASTA", "YV_KUU", "labimise_skoor", "kukkumise_risk", "riskiaste")


@check("m9_pipeline_scores")
def m9(spark, sf):
    return model(spark, sf).score(split(spark, sf).test).select("SOIDUK_ID", "YV_KUU", C.TARGET, "score", "prediction")


LATEST = "FROM frame WHERE YV_AASTA = (SELECT max(YV_AASTA) FROM frame)"


@check("m9_scored_rows", S.with_(S.MODEL_FRAME) + f"SELECT count(*) AS ridu, sum(LABIS_ESIMESEL)::BIGINT AS labis, true AS vahemikus, true AS vastab {LATEST}")
def m9_rows(spark, sf):
    """Every row of the test year has a score from 0 to 1, and its prediction follows from it."""
    rows = model(spark, sf).score(split(spark, sf).test)
    return rows.agg(
        F.count("*").alias("ridu"), F.sum(C.TARGET).alias("labis"), F.bool_and(F.col("score").between(0, 1)).alias("vahemikus"),
        F.bool_and((F.col("score") > 0.5) == (F.col("prediction") == 1)).alias("vastab"),
    )


@check("a12_saved_equals_loaded", S.with_(S.MODEL_FRAME) + f"SELECT count(*) AS ridu, 0::BIGINT AS erinevaid {LATEST}")
def a12_equal(spark, sf):
    """Rows whose score changes when the model is saved and loaded: none."""
    path = work_path(spark, "model")
    model(spark, sf).save(path)
    test = split(spark, sf).test
    first = model(spark, sf).score(test).select(ROW_NO, F.col("score").alias("a"))
    again = R.RiskModel.load(spark, path).score(test).select(ROW_NO, F.col("score").alias("b"))
    return first.join(again, ROW_NO).agg(F.count("*").alias("ridu"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-12).alias("erinevaid"))


@check("m10_forest")
def m10(spark, sf):
    """One row per fitted tree."""
    trees = model(spark, sf).pipeline.stages[-1].trees
    rows = [(i, t.depth, t.numNodes) for i, t in enumerate(trees)]
    return spark.createDataFrame(rows, "puu int, sygavus int, solmi int")


@check("h5_feature_importance")
def h5(spark, sf):
    return model(spark, sf).feature_importance(spark).orderBy(F.desc("importance"), "feature")


@check("a12_saved_model_scores")
def a12(spark, sf):
    """Scores of the model after a save and a load."""
    path = work_path(spark, "model")
    model(spark, sf).save(path)
    again = R.RiskModel.load(spark, path)
    return again.score(split(spark, sf).test).groupBy("prediction").agg(F.count("*").alias("n"), F.avg("score").alias("keskmine"))


@check("a12_model_metadata")
def a12_meta(spark, sf):
    path = work_path(spark, "metadata")
    record = R.model_metadata(model(spark, sf), split(spark, sf).info, spark)
    sinks.write_json(record, path)
    return flat(spark.read.schema(record.schema).json(path))


# --- evaluation of a fixed score

LABELLED = f"labelled AS (SELECT LABIS_ESIMESEL AS label, {SCORE_SQL} AS score, ({SCORE_SQL} >= 0.7)::INTEGER AS prediction FROM clean WHERE LABIS_ESIMESEL IS NOT NULL AND VANUS IS NOT NULL)"
SCORED = S.with_(S.YLEV, S.CLEAN_MODEL, LABELLED)


def labelled(spark, sf) -> DataFrame:
    rows = model_rows(spark, sf).dropna(subset=[C.TARGET, "VANUS"]).select(F.col(C.TARGET).alias("label"), score().alias("score"))
    return rows.withColumn("prediction", (F.col("score") >= 0.7).cast("int"))


def scores(spark, sf) -> E.ScoreTable:
    return E.ScoreTable.build(labelled(spark, sf))


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct")]
    return df.withColumns({c: F.to_json(c) for c in nested})


def rounded(df: DataFrame, digits: int = 9, keep: tuple[str, ...] = ()) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double" and f.name not in keep]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


@check("p1_confusion_matrix", SCORED + "SELECT label, prediction, count(*) AS n FROM labelled GROUP BY 1, 2")
def p1(spark, sf):
    return E.confusion_matrix(labelled(spark, sf))


CELLS = """m AS (SELECT count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS tp, count(*) FILTER (label = 0 AND prediction = 1)::DOUBLE AS fp,
 count(*) FILTER (label = 1 AND prediction = 0)::DOUBLE AS fn, count(*) FILTER (label = 0 AND prediction = 0)::DOUBLE AS tn FROM labelled)"""


@check(
    "p2_classification_metrics",
    SCORED
    + f""", {CELLS} SELECT round((tp + fn) / (tp + fp + fn + tn), 9) AS baseline_always_pass_accuracy, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy,
 round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall,
 round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM m""",
)
def p2(spark, sf):
    return rounded(E.classification_metrics(E.confusion_matrix(labelled(spark, sf))))


@check(
    "p3_class_report",
    SCORED
    + f""", {CELLS}, k AS (SELECT 'Passed' AS klass, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1_score, tp + fn AS support FROM m
 UNION ALL SELECT 'Failed', tn / (tn + fn), tn / (tn + fp), 2 * tn / (2 * tn + fp + fn), tn + fp FROM m)
 SELECT klass, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1_score, 9) AS f1_score, support::BIGINT AS support FROM (
 SELECT * FROM k UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM k
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1_score * support) / sum(support), sum(support) FROM k)""",
)
def p3(spark, sf):
    return rounded(E.class_report(E.confusion_matrix(labelled(spark, sf))))


@check(
    "p4_roc_auc",
    SCORED
    + """SELECT round((sum(r) FILTER (label = 1) - p * (p + 1) / 2) / (p * q), 9) AS roc_auc FROM (
 SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM labelled),
 (SELECT count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS q FROM labelled) GROUP BY p, q""",
)
def p4(spark, sf):
    return rounded(scores(spark, sf).roc_auc())


CURVE = """by_score AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS f FROM labelled GROUP BY 1),
 total AS (SELECT sum(p)::DOUBLE AS p, sum(f)::DOUBLE AS f FROM by_score)"""


@check(
    "p5_roc_curve",
    SCORED
    + f""", {CURVE} SELECT score AS threshold, round(sum(f) OVER w / (SELECT f FROM total), 9) AS fpr, round(sum(p) OVER w / (SELECT p FROM total), 9) AS tpr
 FROM by_score WINDOW w AS (ORDER BY score DESC) UNION ALL SELECT 'Infinity'::DOUBLE, 0, 0""",
)
def p5(spark, sf):
    return rounded(scores(spark, sf).roc_curve(), keep=("threshold",))


FAIL_CURVE = CURVE + """, curve AS (SELECT 1 - score AS threshold, sum(f) OVER w / (sum(f) OVER w + sum(p) OVER w)::DOUBLE AS pr, sum(f) OVER w / (SELECT f FROM total) AS re,
 (sum(f) OVER w + sum(p) OVER w) / (SELECT p + f FROM total) AS share FROM by_score WINDOW w AS (ORDER BY score))"""
_POINT = "round(threshold, 9) AS threshold, round(pr, 9) AS fail_precision, round(re, 9) AS fail_recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 9) AS fail_f1, round(share, 9) AS predicted_risk_share"


@check("p6_fail_precision_recall", SCORED + f", {FAIL_CURVE} SELECT {_POINT} FROM curve")
def p6(spark, sf):
    return rounded(scores(spark, sf).fail_precision_recall())


@check(
    "p7_fail_thresholds",
    SCORED
    + f""", {FAIL_CURVE} SELECT min_fail_recall::DOUBLE AS min_fail_recall, {_POINT} FROM (SELECT *, row_number() OVER (PARTITION BY min_fail_recall ORDER BY pr DESC, threshold DESC) AS r
 FROM curve JOIN (SELECT unnest([0.6::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE]) AS min_fail_recall) ON re >= min_fail_recall) WHERE r = 1""",
)
def p7(spark, sf):
    return rounded(scores(spark, sf).fail_thresholds(), keep=("min_fail_recall",))


_EDGES = [f"({i} * 0.1::DOUBLE)" for i in range(10)] + ["1.0::DOUBLE"]
BINS = f"""clipped AS (SELECT label, least(greatest(score, 1e-6), 1 - 1e-6) AS p FROM labelled),
 binned AS (SELECT least(greatest({' + '.join(f'({e} < p)::INTEGER' for e in _EDGES)} - 1, 0), 9) AS bin, label, p FROM clipped),
 bins AS (SELECT bin, count(*) AS n, avg(p) AS pp, avg(label) AS ap FROM binned GROUP BY 1)"""


@check(
    "p8_calibration_bins",
    SCORED
    + f""", {BINS} SELECT bin, round(bin * 0.1, 9)::DOUBLE AS lower, round((bin + 1) * 0.1, 9)::DOUBLE AS upper, n AS count, round(pp, 9) AS predicted_pass_rate,
 round(ap, 9) AS actual_pass_rate, round(abs(pp - ap), 9) AS absolute_error FROM bins""",
)
def p8(spark, sf):
    return rounded(scores(spark, sf).calibration_bins())


@check(
    "p9_probability_quality",
    SCORED
    + f""", {BINS} SELECT (SELECT round(avg((label - p) * (label - p)), 9) FROM clipped) AS brier_score,
 (SELECT round(avg(-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 9) FROM clipped) AS log_loss,
 (SELECT round(sum(n * abs(pp - ap)) / sum(n), 9) FROM bins) AS expected_calibration_error""",
)
def p9(spark, sf):
    return rounded(scores(spark, sf).probability_quality())


# The isotonic fit at i is the largest, over starts j up to i, of the least mean of j to k, over ends k from i on.
ISOTONIC = """, pts AS (SELECT score, count(*) FILTER (label = 1) AS passes, count(*) FILTER (label = 0) AS fails FROM labelled GROUP BY score),
 cum AS (SELECT *, row_number() OVER w AS i, sum(passes) OVER w AS p, sum(passes + fails) OVER w AS n FROM pts WINDOW w AS (ORDER BY score)),
 seg AS (SELECT a.i AS j, b.i AS k, (b.p - a.p + a.passes)::DOUBLE / (b.n - a.n + a.passes + a.fails) AS mean FROM cum a JOIN cum b ON b.i >= a.i),
 low AS (SELECT j, k AS i, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS least FROM seg)
 SELECT score, round(max(least), 6) AS calibrated, any_value(passes) AS passes, any_value(fails) AS fails FROM low JOIN cum USING (i) GROUP BY score"""


@check("p10_isotonic_calibration", SCORED + ISOTONIC)
def p10(spark, sf):
    table = scores(spark, sf)
    mapped = R.fit_isotonic(table).transform(table.counts.select("score", "passes", "fails"), "score")
    return mapped.select("score", F.round("prediction", 6).alias("calibrated"), "passes", "fails")


@check("p11_temporal_calibration")
def p11(spark, sf):
    return flat(once(spark, sf, "calibration", lambda: R.temporal_calibration(frame(spark, sf))))


@check("p12_evaluation_record")
def p12(spark, sf):
    return flat(evaluated(spark, sf)[0])


# --- clusters


@check("k1_cluster_sample", S.with_(S.MODEL_FRAME) + "SELECT count(*) AS ridu, count(DISTINCT RIDA_NR) AS erinevaid FROM frame WHERE KATEGOORIA IS NOT NULL AND KERETYYP IS NOT NULL AND PUNKTI_KOOD IS NOT NULL")
def k1(spark, sf):
    sample = K.make_cluster_frame(model_rows(spark, sf))
    return sample.agg(F.count("*").alias("ridu"), F.countDistinct(ROW_NO).alias("erinevaid"))


@check(
    "k1_exact_sample_size",
    S.with_(S.MODEL_FRAME) + "SELECT least(count(*), 4321) AS ridu, count(*) AS koigist FROM frame",
)
def k1_exact(spark, sf):
    rows = frame(spark, sf)
    sample = exact_sample(rows, 4321).agg(F.count("*").alias("ridu"))
    return sample.withColumn("koigist", rows.agg(F.count("*")).scalar())


@check(
    "k2_standardized_inputs",
    S.with_(S.MODEL_FRAME)
    + """SELECT VANUS::DOUBLE AS VANUS, round((VANUS - (SELECT avg(VANUS) FROM frame)) / (SELECT stddev_pop(VANUS) FROM frame), 6) AS vanus_z,
 EELMISED_YV::DOUBLE AS EELMISED_YV, round((EELMISED_YV - (SELECT avg(EELMISED_YV) FROM frame)) / (SELECT stddev_pop(EELMISED_YV) FROM frame), 6) AS eelmised_z,
 count(*) AS n FROM frame GROUP BY ALL""",
)
def k2(spark, sf):
    scaled = K.standardize(frame(spark, sf), ["VANUS", "EELMISED_YV"])
    return counted(scaled, "VANUS", F.round("VANUS_z", 6).alias("vanus_z"), "EELMISED_YV", F.round("EELMISED_YV_z", 6).alias("eelmised_z"))


def clustering(spark, sf) -> K.Clustering:
    return once(spark, sf, "clustering", lambda: K.run_clustering(model_rows(spark, sf)))


KEYED = "KATEGOORIA IS NOT NULL AND KERETYYP IS NOT NULL AND PUNKTI_KOOD IS NOT NULL"


@check(
    "k3_k_sweep",
    S.with_(S.MODEL_FRAME) + f"SELECT k::INTEGER AS k, ridu, true AS inertsus, true AS langeb, true AS siluett FROM range(2, 7) r(k), (SELECT count(*) AS ridu FROM frame WHERE {KEYED})",
)
def k3(spark, sf):
    """For each k: all rows are counted, the inertia is that of the rows and their nearest centres, falls with k, and the silhouette lies between -1 and 1."""
    run = clustering(spark, sf)
    best = [run.found.best[s["k"]] for s in run.scores]
    anew = kmeans.centre_sums(run.rows, [f.centres for f in best])
    rows = []
    for s, sums in zip(run.scores, anew):
        same = abs(float(sums[:, 1].sum()) - s["inertia"]) <= 1e-6 * s["inertia"]
        falls = all(s["inertia"] <= 1.001 * t["inertia"] for t in run.scores if t["k"] < s["k"])
        rows.append((s["k"], int(sums[:, 0].sum()), same, falls, -1 <= s["silhouette"] <= 1))
    return spark.createDataFrame(rows, "k int, ridu bigint, inertsus boolean, langeb boolean, siluett boolean")


# Two models with fixed centres (age, month).
_FIXED = {0: [(5.0, 3.0), (20.0, 9.0)], 1: [(2.0, 6.0), (12.0, 1.0), (30.0, 11.0)]}
_FIXED_SQL = ", ".join(f"({m}, {c}, {x}::DOUBLE, {y}::DOUBLE)" for m, cs in _FIXED.items() for c, (x, y) in enumerate(cs))
LLOYD = f"""
, c(mudel, keskus, cx, cy) AS (VALUES {_FIXED_SQL}),
 l AS (SELECT RIDA_NR, VANUS::DOUBLE AS x, YV_KUU::DOUBLE AS y FROM frame),
 d AS (SELECT l.*, mudel, keskus, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS dist FROM l CROSS JOIN c),
 near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY RIDA_NR, mudel ORDER BY dist, keskus) = 1)
 SELECT mudel, keskus, count(*) AS ridu, round(sum(dist), 4) AS inertsus, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM near GROUP BY ALL"""


@check("k3_lloyd_step", S.with_(S.MODEL_FRAME) + LLOYD)
def k3_step(spark, sf):
    """One scan moves the centres of both models."""
    rows = frame(spark, sf).select(F.array(F.col("VANUS").cast("double"), F.col("YV_KUU").cast("double")).alias("x"))
    found = kmeans.centre_sums(rows, [np.array(c) for c in _FIXED.values()])
    out = [
        (m, c, int(s[0]), float(s[1]), float(s[3] / s[0]), float(s[4] / s[0])) for m, sums in enumerate(found) for c, s in enumerate(sums) if s[0]
    ]
    moved = spark.createDataFrame(out, "mudel int, keskus int, ridu bigint, inertsus double, x double, y double")
    return moved.withColumns({"inertsus": F.round("inertsus", 4), "x": F.round("x", 6), "y": F.round("y", 6)})


@check("k4_assigned_clusters", S.with_(S.MODEL_FRAME) + f"SELECT count(*) AS ridu, count(DISTINCT RIDA_NR) AS erinevaid, 2 AS klastreid, 0::BIGINT AS kaugemal FROM frame WHERE {KEYED}")
def k4(spark, sf):
    """Every row is in one of the two clusters, and in none that has a nearer centre."""
    run = clustering(spark, sf)
    centres = [F.array(*[F.lit(float(v)) for v in c]) for c in run.found.best[2].centres]

    def distance(c):
        return F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    distances = F.array(*[distance(c) for c in centres])
    rows = run.labelled.join(run.rows.select(ROW_NO, distances.alias("d")), ROW_NO)
    farther = F.get("d", F.col(K.CLUSTER)) > F.array_min("d") + 1e-9
    return rows.agg(
        F.count("*").alias("ridu"), F.count_distinct(ROW_NO).alias("erinevaid"), F.count_distinct(K.CLUSTER).cast("int").alias("klastreid"), F.count_if(farther).alias("kaugemal")
    )


# Mean squared distance of a row to a cluster, from the cluster's sums; to its own cluster without itself.
SILHOUETTE = """
, l AS (SELECT RIDA_NR, VANUS::DOUBLE AS x, YV_KUU::DOUBLE AS y, (SOIDUK_ID % 3)::INTEGER AS c FROM frame),
 s AS (SELECT c, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS q FROM l GROUP BY c),
 d AS (SELECT RIDA_NR, l.c, s.c AS other, s.n, x * x + y * y + s.q / s.n - 2 * (x * sx + y * sy) / s.n AS mean FROM l CROSS JOIN s),
 p AS (SELECT RIDA_NR, max(mean * n / greatest(n - 1, 1)) FILTER (other = c) AS a, min(mean) FILTER (other <> c) AS b, max(n) FILTER (other = c) AS n FROM d GROUP BY RIDA_NR)
 SELECT round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS siluett FROM p"""


@check("k3_silhouette", S.with_(S.MODEL_FRAME) + SILHOUETTE)
def k3_silhouette(spark, sf):
    """Silhouette of a fixed assignment."""
    rows = frame(spark, sf).withColumn(K.CLUSTER, (F.col("SOIDUK_ID") % 3).cast("int"))
    vectors = VectorAssembler(inputCols=["VANUS", "YV_KUU"], outputCol="features").transform(rows)
    return spark.createDataFrame([(round(K.silhouette(vectors), 6),)], "siluett double")


@check(
    "k5_cluster_profiles",
    S.with_(S.MODEL_FRAME)
    + """, l AS (SELECT *, (SOIDUK_ID % 3)::INTEGER AS KLASTER FROM frame),
 tops AS (SELECT KLASTER, name, v FROM (SELECT KLASTER, name, v, row_number() OVER (PARTITION BY KLASTER, name ORDER BY count(*) DESC, v) AS r FROM (
  SELECT KLASTER, unnest(['KATEGOORIA', 'KERETYYP', 'PUNKTI_KOOD', 'MARK']) AS name, unnest([KATEGOORIA, KERETYYP, PUNKTI_KOOD, MARK]) AS v FROM l) WHERE v IS NOT NULL GROUP BY 1, 2, 3) WHERE r = 1)
 SELECT KLASTER AS cluster, count(*) AS size, round_even(count(*) / (SELECT count(*) FROM l)::DOUBLE * 100, 1) AS pct, round_even(avg(VANUS), 1) AS avg_age,
 round_even(avg(LABIS_ESIMESEL) * 100.0::DOUBLE, 1) AS pass_rate, (SELECT v FROM tops t WHERE t.KLASTER = l.KLASTER AND name = 'KATEGOORIA') AS top_category,
 (SELECT v FROM tops t WHERE t.KLASTER = l.KLASTER AND name = 'KERETYYP') AS top_body_type, (SELECT v FROM tops t WHERE t.KLASTER = l.KLASTER AND name = 'PUNKTI_KOOD') AS top_station_code,
 (SELECT v FROM tops t WHERE t.KLASTER = l.KLASTER AND name = 'MARK') AS top_make FROM l GROUP BY KLASTER""",
)
def k5(spark, sf):
    """Profiles of a fixed assignment."""
    rows = frame(spark, sf).withColumn(K.CLUSTER, (F.col("SOIDUK_ID") % 3).cast("int"))
    return K.profile_clusters(rows)


@check("k5_found_cluster_profiles")
def k5_found(spark, sf):
    return clustering(spark, sf).profiles


@check("k6_run_record")
def k6(spark, sf):
    path = work_path(spark, "cluster-record")
    record = clustering(spark, sf).record
    sinks.write_json(record, path)
    return flat(spark.read.schema(record.schema).json(path))
