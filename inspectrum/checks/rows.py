"""Sources, sinks and single operators. Row-level results are grouped with their counts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inspectrum.checks import sql as S
from inspectrum.checks.adapter import dimension, inspections
from inspectrum.checks.registry import check, once
from inspectrum.checks.reports import AGED, ENTRIES, SCALAR, TOP_DEFECTS, TOP_MARKS, V3, explored
from inspectrum.functions import bands as B
from inspectrum.functions import defects as D
from inspectrum.functions import text as T
from inspectrum.operators import cleaning as C
from inspectrum.operators.history import add_previous_count, frequencies
from inspectrum.operators.ordered import exact_medians, group_modes
from inspectrum.plans import quality as V
from inspectrum.plans import queries as Q
from inspectrum.plans import scoring as P
from inspectrum.sources import inspections as src
from inspectrum.sources import sinks
from inspectrum.sources.dimension import defect_names, known_ids, read_dimension, typed_dimension
from inspectrum.sources.schema import RAW_COLUMNS, ROW_NO, YEAR
from inspectrum.sources.workspace import work_path

ALL = ", ".join(RAW_COLUMNS)
# Columns of the model's projected scan.
PROJECTED = [c for c in RAW_COLUMNS if c not in ("TOOTAJA", "RIKKED")]


def counted(df, *cols):
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def yearly_csv(spark, sf) -> str:
    """The inspections written once as one CSV folder per year."""

    def write():
        folder = work_path(spark, "yearly-csv")
        rows = inspections(spark, sf)
        sinks.write_yearly_csv(rows.drop(ROW_NO), folder, YEAR)
        return folder

    return once(spark, sf, "yearly-csv", write)


# --- sources and sinks


@check("a1_multi_file_scan", S.with_(S.YLEV) + f"SELECT {ALL} FROM ylev")
def a1(spark, sf):
    return src.load_years(spark, src.yearly_paths(spark, yearly_csv(spark, sf))).select(*RAW_COLUMNS)


@check(
    "a1_quoted_breaks_in_splits",
    S.with_(S.NUMBERED)
    + "SELECT * REPLACE (replace(RIKKED, ';', chr(10)) AS RIKKED, row_number() OVER (ORDER BY ALLIKA_AASTA, RIDA_NR) - 1 AS RIDA_NR) FROM ylev",
)
def a1_splits(spark, sf):
    """Files of each year with defect lists broken over lines, each file read in splits of 64 KB."""

    def write():
        folder = work_path(spark, "broken-csv")
        rows = inspections(spark, sf).withColumn("RIKKED", F.replace("RIKKED", F.lit(";"), F.lit("\n")))
        sinks.write_yearly_csv(rows.repartitionByRange(YEAR, ROW_NO).sortWithinPartitions(YEAR, ROW_NO).drop(ROW_NO), folder, YEAR)
        return folder

    return src.load_folder(spark, once(spark, sf, "broken-csv", write), regular_only=False, split_bytes="64k")


@check("a2_single_file_scan", S.with_(S.YLEV) + f"SELECT {ALL} FROM ylev WHERE ALLIKA_AASTA = 1998")
def a2(spark, sf):
    return src.scan_csv(spark, src.yearly_paths(spark, yearly_csv(spark, sf))[1998]).select(*RAW_COLUMNS)


@check(
    "a3_all_text_scan",
    S.with_(S.YLEV)
    + f"SELECT name, count(*) AS n, min(value) AS low, max(value) AS high FROM (UNPIVOT (SELECT {ALL} FROM ylev) ON {ALL} INTO NAME name VALUE value) GROUP BY name",
)
def a3(spark, sf):
    rows = src.load_folder(spark, yearly_csv(spark, sf), regular_only=False).select(*RAW_COLUMNS)
    # One row for each task and not one for each value: values as rows would be sorted by name.
    totals = rows.agg(*[F.struct(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in RAW_COLUMNS])
    return totals.unpivot([], RAW_COLUMNS, "name", "total").select("name", "total.*").filter("n > 0")


@check("a4_projected_year", S.with_(S.YLEV) + f"SELECT {', '.join(PROJECTED)}, ALLIKA_AASTA FROM ylev WHERE ALLIKA_AASTA = 2001")
def a4(spark, sf):
    return src.load_year(spark, src.yearly_paths(spark, yearly_csv(spark, sf))[2001], 2001, PROJECTED).drop(ROW_NO)


@check("a5_multi_year_load", S.with_(S.YLEV) + f"SELECT {', '.join(PROJECTED)}, ALLIKA_AASTA FROM ylev")
def a5(spark, sf):
    return src.load_years(spark, src.yearly_paths(spark, yearly_csv(spark, sf)), PROJECTED).drop(ROW_NO)


@check("a6_regular_only_folder", S.with_(S.YLEV) + f"SELECT {ALL} FROM ylev WHERE {S.REG}")
def a6(spark, sf):
    return src.load_folder(spark, yearly_csv(spark, sf)).select(*RAW_COLUMNS)


@check("a7_available_years", S.with_(S.YLEV) + "SELECT ALLIKA_AASTA, count(*) AS n FROM ylev GROUP BY 1")
def a7(spark, sf):
    """Years resolved to paths, each path read through the resolver."""
    sources = src.yearly_paths(spark, yearly_csv(spark, sf))
    resolved = {y: src.source_for_year(spark, y, sources) for y in src.available_years(sources)}
    return counted(src.load_years(spark, resolved), YEAR)


@check("a8_defect_names", "SELECT CAST(p_partkey AS VARCHAR) AS rike_id, p_name AS nimetus FROM part WHERE p_name IS NOT NULL")
def a8(spark, sf):
    """From two written files: the second has the names, the first an older name for each id."""

    def write():
        path, rows = work_path(spark, "dimension-csv"), dimension(spark, sf).drop(ROW_NO)
        older = rows.withColumn("NIMETUS", F.concat(F.lit("vana "), "NIMETUS")).withColumn("osa", F.lit(1))
        both = older.unionByName(rows.withColumn("osa", F.lit(2)))
        sinks.write_yearly_csv(both, path, "osa")
        return path

    folder = once(spark, sf, "dimension-csv", write)
    return defect_names(read_dimension(spark, [f"{folder}/1.csv", f"{folder}/2.csv"]))


@check("a8_typed_dimension", "SELECT p_partkey AS ID, p_name AS NIMETUS, 'NIMETUS' AS TYYP FROM part")
def a8_typed(spark, sf):
    return typed_dimension(dimension(spark, sf)).select("ID", "NIMETUS", "TYYP")


@check("a9_known_ids", "SELECT DISTINCT p_partkey AS defect_id FROM part")
def a9(spark, sf):
    return known_ids(dimension(spark, sf))


def _report(spark, sf):
    return V.validation_report(inspections(spark, sf), known_ids(dimension(spark, sf)))


@check("a10_csv_sink", V3)
def a10(spark, sf):
    report, path = _report(spark, sf), work_path(spark, "report-csv")
    sinks.write_csv(report, path)
    return spark.read.schema(report.schema).csv(path, header=True)


@check("a11_json_sink", V3)
def a11(spark, sf):
    report, path = _report(spark, sf), work_path(spark, "report-json")
    sinks.write_json(report, path)
    return spark.read.schema(report.schema).json(path)


# --- scalar expressions


@check(
    "b1_strip_text",
    S.with_(S.YLEV) + f"SELECT {S.strip('RIKKED')} = '' AS tyhi, {S.strip("chr(9) || ' ' || MARK || ' ' || chr(10)")} AS puhas, count(*) AS n FROM ylev GROUP BY 1, 2",
)
def b1(spark, sf):
    padded = T.strip(F.concat(F.lit("\t "), "MARK", F.lit(" \n")))
    return counted(inspections(spark, sf), (T.strip(F.col("RIKKED")) == "").alias("tyhi"), padded.alias("puhas"))


@check("b2_repair_mojibake", S.with_(S.YLEV) + "SELECT MUDEL || ' Tähva Õ' AS parandatud, count(*) AS n FROM ylev GROUP BY 1")
def b2(spark, sf):
    """Good text is damaged on purpose; the repair must restore it."""
    good = F.concat("MUDEL", F.lit(" Tähva Õ"))
    damaged = F.decode(F.encode(good, "UTF-8"), "ISO-8859-1")
    return counted(inspections(spark, sf), T.repair_mojibake(damaged).alias("parandatud"))


@check("b3_repair_columns", S.with_(S.YLEV) + "SELECT TEHNOYLEVAATUSPUNKT, MARK || ' é' AS MARK, KERETYYP, count(*) AS n FROM ylev GROUP BY ALL")
def b3(spark, sf):
    damaged = F.decode(F.encode(F.concat("MARK", F.lit(" é")), "UTF-8"), "ISO-8859-1")
    rows = C.repair_encoding(inspections(spark, sf).withColumn("MARK", damaged))
    return counted(rows, "TEHNOYLEVAATUSPUNKT", "MARK", "KERETYYP")


@check(
    "b4_numeric_coercion",
    S.with_(S.YLEV)
    + f"""SELECT {S.whole_number('ESMANE_REG_AASTA')} AS aasta, {S.whole_number("(ESMANE_REG_AASTA || '.0')")} AS kumnend,
 {S.whole_number("(ESMANE_REG_AASTA || '.5')")} AS murd, {S.whole_number('MARK')} AS tekst, count(*) AS n FROM ylev GROUP BY 1, 2, 3, 4""",
)
def b4(spark, sf):
    year = F.col("ESMANE_REG_AASTA")
    return counted(
        inspections(spark, sf),
        T.to_whole_number(year).alias("aasta"),
        T.to_whole_number(F.concat(year, F.lit(".0"))).alias("kumnend"),
        T.to_whole_number(F.concat(year, F.lit(".5"))).alias("murd"),
        T.to_whole_number(F.col("MARK")).alias("tekst"),
    )


@check(
    "b5_year_and_month",
    S.with_(S.YLEV) + f"SELECT YV_KUUPAEV, {S.integer('substr(YV_KUUPAEV, 1, 4)')} AS aasta, {S.integer('substr(YV_KUUPAEV, 6, 2)')} AS kuu, count(*) AS n FROM ylev GROUP BY 1, 2, 3",
)
def b5(spark, sf):
    date = F.col("YV_KUUPAEV")
    return counted(inspections(spark, sf), date, T.year_of(date).alias("aasta"), T.month_of(date).alias("kuu"))


def model_rows(spark, sf):
    return C.clean_for_model(inspections(spark, sf))


@check("b6_vehicle_age", S.with_(S.YLEV, S.CLEAN_MODEL) + "SELECT YV_AASTA, ESMANE_REG_AASTA, VANUS, count(*) AS n FROM clean GROUP BY 1, 2, 3")
def b6(spark, sf):
    return counted(model_rows(spark, sf), "YV_AASTA", "ESMANE_REG_AASTA", "VANUS")


@check("b7_target", S.with_(S.YLEV, S.CLEAN_MODEL) + "SELECT YLEVAATUSLIIK, YLEVAATUSOTSUS, LABIS_ESIMESEL, count(*) AS n FROM clean GROUP BY 1, 2, 3")
def b7(spark, sf):
    return counted(model_rows(spark, sf), "YLEVAATUSLIIK", "YLEVAATUSOTSUS", "LABIS_ESIMESEL")


@check(
    "b8_incomplete_flags",
    S.with_(S.YLEV, S.CLEAN_MODEL)
    + """SELECT ANDMED_PUUDULIKUD AS neli, CASE WHEN SOIDUK_ID IS NULL OR MARK IS NULL OR ESMANE_REG_AASTA IS NULL THEN 1 ELSE 0 END AS kolm,
 count(*) AS n FROM clean GROUP BY 1, 2""",
)
def b8(spark, sf):
    four = model_rows(spark, sf).withColumnRenamed("ANDMED_PUUDULIKUD", "neli")
    return counted(C.flag_incomplete(four, C.BATCH_CRITICAL), "neli", F.col("ANDMED_PUUDULIKUD").alias("kolm"))


@check(
    "b9_age_bands",
    S.with_(S.YLEV, AGED)
    + """SELECT vanus, CASE WHEN vanus < 0 THEN NULL WHEN vanus <= 1 THEN '0–1 (uus)' WHEN vanus <= 5 THEN '2–5' WHEN vanus <= 10 THEN '6–10'
 WHEN vanus <= 15 THEN '11–15' WHEN vanus <= 20 THEN '16–20' WHEN vanus <= 30 THEN '21–30' WHEN vanus <= 40 THEN '31–40' ELSE '41+' END AS grupp,
 CASE WHEN vanus < 0 THEN NULL WHEN vanus <= 1 THEN 1 WHEN vanus <= 5 THEN 2 WHEN vanus <= 10 THEN 3 WHEN vanus <= 15 THEN 4
 WHEN vanus <= 20 THEN 5 WHEN vanus <= 30 THEN 6 WHEN vanus <= 40 THEN 7 ELSE 8 END AS sorteering, count(*) AS n FROM aged GROUP BY 1, 2, 3""",
)
def b9(spark, sf):
    age = F.col("vanus")
    rows = Q.with_registration_year(inspections(spark, sf))
    return counted(rows, age, B.age_band(age).alias("grupp"), B.age_band_rank(age).alias("sorteering"))


@check(
    "b10_exploratory_bands",
    S.with_(S.YLEV, AGED)
    + """SELECT vanus, CASE WHEN vanus < 0 OR vanus > 100 THEN NULL WHEN vanus <= 1 THEN '0-1' WHEN vanus <= 5 THEN '2-5' WHEN vanus <= 10 THEN '6-10'
 WHEN vanus <= 15 THEN '11-15' WHEN vanus <= 20 THEN '16-20' WHEN vanus <= 30 THEN '21-30' ELSE '31+' END AS grupp, count(*) AS n FROM aged GROUP BY 1, 2""",
)
def b10(spark, sf):
    age = F.col("vanus")
    return counted(Q.with_registration_year(inspections(spark, sf)), age, B.exploratory_age_band(age).alias("grupp"))


@check(
    "b11_seasonality",
    S.with_(S.YLEV, S.CLEAN_MODEL)
    + "SELECT YV_KUU, round(sin(2.0::DOUBLE * pi() * YV_KUU / 12), 9) + 0.0 AS s, round(cos(2.0::DOUBLE * pi() * YV_KUU / 12), 9) + 0.0 AS c, count(*) AS n FROM clean GROUP BY 1, 2, 3",
)
def b11(spark, sf):
    m = F.col("YV_KUU")
    # Adding 0.0 turns a rounded -0.0 into 0.0.
    s, c = F.round(B.month_sin(m), 9) + 0.0, F.round(B.month_cos(m), 9) + 0.0
    return counted(model_rows(spark, sf), m, s.alias("s"), c.alias("c"))


@check(
    "b12_age_squared_and_old",
    S.with_(S.YLEV, S.CLEAN_MODEL) + "SELECT VANUS, VANUS * VANUS AS VANUS_RUUT, (VANUS > 10)::INTEGER AS ON_VANA, count(*) AS n FROM clean WHERE VANUS IS NOT NULL GROUP BY 1, 2, 3",
)
def b12(spark, sf):
    from inspectrum.operators.features import add_age_and_season

    rows = add_age_and_season(model_rows(spark, sf).dropna(subset=["VANUS"]))
    return counted(rows, "VANUS", "VANUS_RUUT", "ON_VANA")


# Body types of the real domain, derived from the adapter's market segments.
BODY_SQL = """CASE KERETYYP WHEN 'AUTOMOBILE' THEN 'SEDAAN' WHEN 'BUILDING' THEN 'KAUBIK' WHEN 'FURNITURE' THEN 'LUUKPÄRA'
 WHEN 'MACHINERY' THEN 'MOOTORRATAS' ELSE 'HAAGIS' END"""


def with_body(df):
    k = F.col("KERETYYP")
    body = (
        F.when(k == "AUTOMOBILE", "SEDAAN")
        .when(k == "BUILDING", "KAUBIK")
        .when(k == "FURNITURE", "LUUKPÄRA")
        .when(k == "MACHINERY", "MOOTORRATAS")
        .otherwise("HAAGIS")
    )
    return df.withColumn("KERETYYP", body)


@check(
    "b13_body_code",
    S.with_(S.YLEV)
    + f"SELECT kere, CASE kere WHEN 'SEDAAN' THEN 0 WHEN 'KAUBIK' THEN 4 WHEN 'LUUKPÄRA' THEN 2 WHEN 'MOOTORRATAS' THEN 8 ELSE -1 END AS kood, count(*) AS n FROM (SELECT {BODY_SQL} AS kere FROM ylev) GROUP BY 1, 2",
)
def b13(spark, sf):
    kere = F.col("KERETYYP")
    return counted(with_body(inspections(spark, sf)), kere.alias("kere"), B.body_code(kere).alias("kood"))


@check(
    "b14_category_group",
    S.with_(S.YLEV)
    + "SELECT KATEGOORIA, nullif(regexp_extract(KATEGOORIA, '^([A-Z]+)', 1), '') AS grupp, nullif(regexp_extract(lower(KATEGOORIA), '^([A-Z]+)', 1), '') AS puudu, count(*) AS n FROM ylev GROUP BY 1, 2, 3",
)
def b14(spark, sf):
    k = F.col("KATEGOORIA")
    return counted(inspections(spark, sf), k, B.category_group(k).alias("grupp"), B.category_group(F.lower(k)).alias("puudu"))


@check("b15_same_name", S.with_(S.YLEV) + "SELECT MARK, count(*) AS n FROM ylev WHERE upper(MARK) = 'BRAND#7' GROUP BY 1")
def b15(spark, sf):
    return counted(inspections(spark, sf).filter(T.same_name(F.col("MARK"), "  bRaNd#7 ")), "MARK")


@check(
    "b16_pass_fail_indicator",
    S.with_(S.YLEV)
    + "SELECT YLEVAATUSOTSUS, CASE WHEN YLEVAATUSOTSUS = 'KORRAS' THEN 1 ELSE 0 END AS labis, CASE WHEN YLEVAATUSOTSUS = 'KORDUVALE' THEN 1 ELSE 0 END AS kukkus, count(*) AS n FROM ylev GROUP BY 1, 2, 3",
)
def b16(spark, sf):
    flags = [F.when(C.is_pass(), 1).otherwise(0).alias("labis"), F.when(C.is_fail(), 1).otherwise(0).alias("kukkus")]
    return counted(inspections(spark, sf), "YLEVAATUSOTSUS", *flags)


@check(
    "b17_rounded_percent",
    S.with_(S.YLEV)
    + """SELECT MARK, round(100.0::DOUBLE * count(*) FILTER (YLEVAATUSOTSUS = 'KORRAS') / count(*), 1) AS p1,
 round(100.0::DOUBLE * count(*) FILTER (YLEVAATUSOTSUS = 'KORRAS') / count(*), 2) AS p2 FROM ylev GROUP BY MARK""",
)
def b17(spark, sf):
    passed, n = F.count_if(C.is_pass()), F.count("*")
    return inspections(spark, sf).groupBy("MARK").agg(
        B.percent(passed, n, 1).alias("p1"), B.percent(passed, n, 2).alias("p2")
    )


@check(
    "b20_smoothed_rate",
    S.with_(S.YLEV, S.CLEAN_MODEL)
    + """SELECT MARK, round((avg(LABIS_ESIMESEL) * count(*) + (SELECT avg(LABIS_ESIMESEL) FROM clean) * 100) / (count(*) + 100), 9) AS maar
 FROM clean WHERE LABIS_ESIMESEL IS NOT NULL GROUP BY MARK""",
)
def b20(spark, sf):
    rows = model_rows(spark, sf).dropna(subset=[C.TARGET])
    overall = rows.agg(F.avg(C.TARGET)).scalar()
    sums = rows.groupBy("MARK").agg(F.sum(C.TARGET).alias("p"), F.count("*").alias("n"))
    return sums.select("MARK", F.round(B.smoothed(F.col("p"), F.col("n"), overall, 100.0), 9).alias("maar"))


SCORE_SQL = "(950 - 9 * VANUS + 2 * YV_KUU) / 1000.0::DOUBLE"


def score():
    """A fixed score of age and month: many ties, the same double in both engines."""
    return (F.lit(950) - F.col("VANUS") * 9 + F.col("YV_KUU") * 2) / F.lit(1000.0)


@check(
    "b21_clip_probability",
    S.with_(S.YLEV, S.CLEAN_MODEL)
    + f"SELECT least(greatest({SCORE_SQL} * 2.0::DOUBLE - 0.5::DOUBLE, 1e-6), 1 - 1e-6) AS p, count(*) AS n FROM clean WHERE VANUS IS NOT NULL GROUP BY 1",
)
def b21(spark, sf):
    rows = model_rows(spark, sf).dropna(subset=["VANUS"])
    return counted(rows, B.clip_probability(score() * 2.0 - 0.5).alias("p"))


@check(
    "b22_risk_band",
    S.with_(S.YLEV, S.CLEAN_MODEL)
    + f"""SELECT s AS score, CASE WHEN 100.0::DOUBLE - s * 100.0::DOUBLE >= 0.7::DOUBLE * 100.0::DOUBLE THEN 'riskirühm' WHEN s * 100.0::DOUBLE >= 75 THEN 'kõrge' WHEN s * 100.0::DOUBLE >= 50 THEN 'keskmine' ELSE 'madal' END AS riskiaste,
 count(*) AS n FROM (SELECT {SCORE_SQL} AS s FROM clean WHERE VANUS IS NOT NULL) GROUP BY 1, 2""",
)
def b22(spark, sf):
    rows = model_rows(spark, sf).dropna(subset=["VANUS"]).select(score().alias("score"))
    return counted(P.with_risk_band(rows, 0.7), "score", "riskiaste")


# --- defect column


@check("c1_normalized_delimiters", S.with_(S.YLEV) + r"SELECT regexp_replace(RIKKED, '[;\n\r]', ',', 'g') AS r, count(*) AS n FROM ylev GROUP BY 1")
def c1(spark, sf):
    return counted(inspections(spark, sf), D.normalize_delimiters(F.col("RIKKED")).alias("r"))


@check("c2_unnested_entries", S.with_(S.YLEV, S.LOOSE) + "SELECT raskusaste, rike_id, count(*) AS n FROM loose GROUP BY 1, 2")
def c2(spark, sf):
    rows = inspections(spark, sf).filter(C.is_regular())
    entries = rows.select(F.explode(D.loose_entries(F.col("RIKKED"))).alias("e"))
    return counted(entries, F.col("e.severity").alias("raskusaste"), F.col("e.rike_id").alias("rike_id"))


@check("c3_counted_defects", S.with_(S.YLEV, S.LOOSE) + "SELECT raskusaste, rike_id, count(*) AS n FROM counted GROUP BY 1, 2")
def c3(spark, sf):
    return counted(Q.regular_defects(inspections(spark, sf)), "raskusaste", "rike_id")


@check("c4_strict_entries", S.with_(S.YLEV) + f"SELECT e, count(*) AS n FROM (SELECT unnest({S.strict_entries('RIKKED')}) AS e FROM ylev) GROUP BY 1")
def c4(spark, sf):
    return counted(inspections(spark, sf).select(F.explode(D.strict_entries(F.col("RIKKED"))).alias("e")), "e")


@check(
    "c5_strict_parse",
    S.with_(S.YLEV)
    + f"SELECT severity, defect_id, count(*) AS n FROM (SELECT {S.STRICT_SEVERITY} AS severity, {S.STRICT_ID} AS defect_id, {S.STRICT_CLASS} AS kind FROM (SELECT unnest({S.strict_entries('lower(RIKKED)')}) AS e FROM ylev)) WHERE kind = 'parsed' GROUP BY 1, 2",
)
def c5(spark, sf):
    """Lower-cased text: severities are read in any case."""
    parsed = D.parse_strict(F.lower("RIKKED"))
    return counted(inspections(spark, sf).select(F.inline(parsed)), "severity", "defect_id")


@check(
    "c6_severity_counts",
    S.with_(S.YLEV, S.CLEAN_EXPLORE) + "SELECT VO_ARV, OV_ARV, EOV_ARV, count(*) AS n FROM clean GROUP BY 1, 2, 3",
)
def c6(spark, sf):
    return counted(explored(spark, sf), "VO_ARV", "OV_ARV", "EOV_ARV")


@check(
    "c7_expanded_defects",
    S.with_(S.YLEV, S.CLEAN_EXPLORE) + "SELECT RIKKED, RIKETE_ARV, VO_ARV, OV_ARV, EOV_ARV, RIKE_IDS, count(*) AS n FROM clean GROUP BY ALL",
)
def c7(spark, sf):
    ids = F.array_join(F.col("RIKE_IDS").cast("array<string>"), ",")
    return counted(explored(spark, sf), "RIKKED", "RIKETE_ARV", "VO_ARV", "OV_ARV", "EOV_ARV", ids.alias("RIKE_IDS"))


@check(
    "c8_severity_flags",
    S.with_(S.YLEV)
    + f"""SELECT (coalesce(list_contains(k, 'VO'), false))::INTEGER AS vo, (coalesce(list_contains(k, 'OV'), false))::INTEGER AS ov,
 (coalesce(list_contains(k, 'EOV'), false))::INTEGER AS eov, count(*) AS n
 FROM (SELECT list_transform({S.ENTRY_LIST}, lambda entry: trim(string_split(entry, ':')[1])) AS k FROM ylev) GROUP BY ALL""",
)
def c8(spark, sf):
    entries = inspections(spark, sf).select(D.loose_entries(F.col("RIKKED")).alias("e"))
    return counted(entries, *[D.has_severity(F.col("e"), s).alias(s.lower()) for s in D.SEVERITIES])


@check("c9_entry_classes", S.with_(S.YLEV, ENTRIES) + "SELECT year, kind, count(*) AS n FROM entries GROUP BY 1, 2")
def c9(spark, sf):
    counts = V.entry_counts(inspections(spark, sf))
    return counts.groupBy("year", F.col("class").alias("kind")).agg(F.sum("n").alias("n"))


@check(
    "c10_ids_absent_from_dimension",
    S.with_(S.YLEV, ENTRIES) + "SELECT DISTINCT year, defect_id FROM entries WHERE kind = 'parsed' AND defect_id NOT IN (SELECT defect_id FROM known)",
)
def c10(spark, sf):
    return V.missing_ids(V.entry_counts(inspections(spark, sf)), known_ids(dimension(spark, sf)))


# --- filters


@check("d1_regular_decided", S.with_(S.YLEV) + f"SELECT YLEVAATUSLIIK, YLEVAATUSOTSUS, count(*) AS n FROM ylev WHERE {S.REG} AND {S.DEC} GROUP BY 1, 2")
def d1(spark, sf):
    return counted(inspections(spark, sf).filter(C.is_regular() & C.is_decided()), "YLEVAATUSLIIK", "YLEVAATUSOTSUS")


@check(
    "d2_present_text",
    S.with_(S.YLEV) + "SELECT count(*) FILTER (RIKKED IS NOT NULL AND RIKKED <> '') AS pole_tyhi, count(*) FILTER (RIKKED IS NOT NULL AND trim(RIKKED) <> '') AS tekstiga FROM ylev",
)
def d2(spark, sf):
    r = F.col("RIKKED")
    return inspections(spark, sf).agg(F.count_if(T.is_present(r)).alias("pole_tyhi"), F.count_if(T.has_text(r)).alias("tekstiga"))


@check("d3_safe_range", S.with_(S.YLEV, AGED) + "SELECT reg_aasta, count(*) AS n FROM aged GROUP BY 1")
def d3(spark, sf):
    return counted(Q.with_registration_year(inspections(spark, sf)), "reg_aasta")


@check("d4_between", S.with_(S.YLEV, AGED) + "SELECT vanus, count(*) AS n FROM aged WHERE vanus BETWEEN 0 AND 100 GROUP BY 1")
def d4(spark, sf):
    return counted(Q.with_registration_year(inspections(spark, sf)).filter(F.col("vanus").between(0, 100)), "vanus")


@check("d6_in_computed_ids", S.with_(S.YLEV, S.LOOSE, TOP_DEFECTS) + "SELECT raskusaste, rike_id, count(*) AS n FROM counted WHERE rike_id IN (SELECT rike_id FROM top_defects) GROUP BY 1, 2")
def d6(spark, sf):
    rows = inspections(spark, sf)
    ids = Q.top_defects(rows, defect_names(dimension(spark, sf))).select("rike_id").distinct()
    return counted(Q.regular_defects(rows).join(F.broadcast(ids), "rike_id", "left_semi"), "raskusaste", "rike_id")


@check("d7_having", S.with_(S.YLEV) + "SELECT MUDEL, count(*) AS n FROM ylev GROUP BY 1 HAVING count(*) >= 700")
def d7(spark, sf):
    return counted(inspections(spark, sf), "MUDEL").filter(F.col("n") >= 700)


@check(
    "d8_drop_rows_with_nulls",
    S.with_(S.YLEV, S.CLEAN_MODEL) + "SELECT LABIS_ESIMESEL, count(*) AS n FROM clean WHERE LABIS_ESIMESEL IS NOT NULL AND VANUS IS NOT NULL AND MUDEL IS NOT NULL GROUP BY 1",
)
def d8(spark, sf):
    return counted(model_rows(spark, sf).dropna(subset=[C.TARGET, "VANUS", "MUDEL"]), C.TARGET)


RULES = [(k, b) for k, bodies in P.BODY_TYPES.items() for b in bodies]
RULES_SQL = f"rules(k, b) AS (VALUES {', '.join(f"('{k}', '{b}')" for k, b in RULES)})"
BODIES = f"bodies AS (SELECT KATEGOORIA, {BODY_SQL} AS KERETYYP FROM ylev)"


@check(
    "d10_allowed_body_types",
    S.with_(S.YLEV, BODIES, RULES_SQL)
    + "SELECT KATEGOORIA, KERETYYP, CASE WHEN (KATEGOORIA, KERETYYP) IN (SELECT k, b FROM rules) THEN 1 ELSE 0 END AS lubatud, count(*) AS n FROM bodies GROUP BY 1, 2, 3",
)
def d10(spark, sf):
    rows = P.flag_body_types(with_body(inspections(spark, sf)), P.body_type_rules(spark))
    return counted(rows, "KATEGOORIA", "KERETYYP", "lubatud")


@check(
    "d10_keep_allowed_and_disallowed",
    S.with_(S.YLEV, BODIES, RULES_SQL)
    + "SELECT CASE WHEN (KATEGOORIA, KERETYYP) IN (SELECT k, b FROM rules) THEN 'jaab' ELSE 'valja' END AS osa, count(*) AS n FROM bodies GROUP BY 1",
)
def d10_split(spark, sf):
    rows, rules = with_body(inspections(spark, sf)), P.body_type_rules(spark)
    kept = P.keep_allowed(rows, rules).select(F.lit("jaab").alias("osa"))
    return counted(kept.union(P.keep_disallowed(rows, rules).select(F.lit("valja").alias("osa"))), "osa")


@check(
    "d10_body_type_options",
    S.with_(S.YLEV, BODIES, RULES_SQL)
    + """, m AS (SELECT DISTINCT k AS KATEGOORIA, b AS KERETYYP FROM rules WHERE b IN (SELECT KERETYYP FROM bodies) AND k IN (SELECT KATEGOORIA FROM bodies))
 SELECT * FROM m UNION ALL SELECT DISTINCT x.KATEGOORIA, y.KERETYYP FROM bodies x, (SELECT DISTINCT KERETYYP FROM bodies) y
 WHERE x.KATEGOORIA NOT IN (SELECT KATEGOORIA FROM m)""",
)
def d10_options(spark, sf):
    trained = with_body(inspections(spark, sf)).select("KATEGOORIA", "KERETYYP").distinct()
    return P.body_type_options(trained, P.body_type_rules(spark))


# --- joins


@check("e1_rows_of_top_marks", S.with_(S.YLEV, TOP_MARKS) + "SELECT MARK, KATEGOORIA, count(*) AS n FROM ylev WHERE MARK IN (SELECT MARK FROM top_marks) GROUP BY 1, 2")
def e1(spark, sf):
    rows = inspections(spark, sf)
    return counted(rows.join(F.broadcast(Q.top_marks(rows).select("MARK")), "MARK", "left_semi"), "MARK", "KATEGOORIA")


@check(
    "e3_mark_totals_with_defects",
    S.with_(S.YLEV, S.LOOSE)
    + f"""SELECT MARK, rikeid_kokku, kokku_ylevaatusi FROM (SELECT MARK, count(*) AS rikeid_kokku FROM counted WHERE MARK <> '' GROUP BY 1)
 JOIN (SELECT MARK, count(*) AS kokku_ylevaatusi FROM ylev WHERE {S.REG} AND MARK <> '' GROUP BY 1) USING (MARK)""",
)
def e3(spark, sf):
    totals = Q.mark_defect_totals(inspections(spark, sf)).filter(F.col("rikeid_kokku") > 0)
    return totals.select("MARK", "rikeid_kokku", "kokku_ylevaatusi")


@check(
    "e4_defects_with_names",
    S.with_(S.YLEV, S.LOOSE, S.NAMES)
    + "SELECT rike_id, raskusaste, COALESCE(nimetus, '') AS nimetus, count(*) AS esinemisi FROM counted LEFT JOIN names USING (rike_id) GROUP BY 1, 2, 3",
)
def e4(spark, sf):
    counts = Q.regular_defects(inspections(spark, sf)).groupBy("rike_id", "raskusaste").agg(F.count("*").alias("esinemisi"))
    return Q.with_names(counts, defect_names(dimension(spark, sf)))


RANGUS = f"""rangus AS (SELECT PUNKTI_KOOD, round_even(count(*) FILTER (YLEVAATUSOTSUS = 'KORDUVALE') / count(YLEVAATUSOTSUS)::DOUBLE * 100.0::DOUBLE, 2) AS PUNKTI_RANGUS
 FROM ylev WHERE {S.REG} GROUP BY 1 HAVING count(YLEVAATUSOTSUS) >= 50)"""


@check("e5_station_strictness_joined", S.with_(S.YLEV, RANGUS) + "SELECT PUNKTI_KOOD, PUNKTI_RANGUS, count(*) AS n FROM ylev LEFT JOIN rangus USING (PUNKTI_KOOD) GROUP BY 1, 2")
def e5(spark, sf):
    return counted(C.add_station_strictness(inspections(spark, sf)), "PUNKTI_KOOD", "PUNKTI_RANGUS")


# --- aggregations, windows, order, sets


@check("f1_model_counts", S.with_(S.YLEV) + "SELECT MARK, MUDEL, count(*) AS n FROM ylev GROUP BY 1, 2")
def f1(spark, sf):
    return counted(inspections(spark, sf), "MARK", "MUDEL")


@check(
    "f2_conditional_counts",
    S.with_(S.YLEV) + f"SELECT KATEGOORIA, count(*) FILTER ({S.REG}) AS korralisi, count(*) FILTER ({S.REG} AND YLEVAATUSOTSUS = 'KORDUVALE') AS kukkus FROM ylev GROUP BY 1",
)
def f2(spark, sf):
    return inspections(spark, sf).groupBy("KATEGOORIA").agg(
        F.count_if(C.is_regular()).alias("korralisi"), F.count_if(C.is_regular() & C.is_fail()).alias("kukkus")
    )


@check("f3_mean_of_flag", S.with_(S.YLEV, S.CLEAN_MODEL) + "SELECT KATEGOORIA, round(avg(LABIS_ESIMESEL), 9) AS maar FROM clean GROUP BY 1")
def f3(spark, sf):
    return model_rows(spark, sf).groupBy("KATEGOORIA").agg(F.round(F.avg(C.TARGET), 9).alias("maar"))


_WHOLE = SCALAR.replace("ALLIKA_AASTA AS year, ", "", 1).replace("GROUP BY ALLIKA_AASTA", "", 1)


@check("f4_global_profile", S.with_(S.YLEV, _WHOLE) + "SELECT * FROM profile")
def f4(spark, sf):
    return V.scalar_profile(inspections(spark, sf).withColumn("koik", F.lit(0)), "koik").drop("year")


@check("f8_distinct_counts", S.with_(S.YLEV) + "SELECT count(DISTINCT MARK) AS marke, count(DISTINCT PUNKTI_KOOD) AS punkte, count(DISTINCT SOIDUK_ID) AS soidukeid FROM ylev")
def f8(spark, sf):
    return inspections(spark, sf).agg(
        F.countDistinct("MARK").alias("marke"),
        F.countDistinct("PUNKTI_KOOD").alias("punkte"),
        F.countDistinct("SOIDUK_ID").alias("soidukeid"),
    )


@check(
    "f9_exact_medians",
    S.with_(S.YLEV, S.CLEAN_MODEL)
    + "SELECT name, median(value) AS median FROM (SELECT unnest(['VANUS', 'SOIDUK_ID', 'YV_KUU']) AS name, unnest([VANUS, SOIDUK_ID, YV_KUU]::DOUBLE[]) AS value FROM clean) GROUP BY 1",
)
def f9(spark, sf):
    return exact_medians(model_rows(spark, sf), ["VANUS", "SOIDUK_ID", "YV_KUU"])


@check(
    "f10_group_modes",
    S.with_(S.YLEV)
    + """SELECT KATEGOORIA, max(v) FILTER (name = 'MARK') AS MARK, max(v) FILTER (name = 'PUNKTI_KOOD') AS PUNKTI_KOOD FROM (
 SELECT KATEGOORIA, name, v, row_number() OVER (PARTITION BY KATEGOORIA, name ORDER BY count(*) DESC, v) AS r FROM (
 SELECT KATEGOORIA, unnest(['MARK', 'PUNKTI_KOOD']) AS name, unnest([MARK, PUNKTI_KOOD]) AS v FROM ylev) WHERE v IS NOT NULL GROUP BY 1, 2, 3) WHERE r = 1 GROUP BY 1""",
)
def f10(spark, sf):
    return group_modes(inspections(spark, sf), "KATEGOORIA", ["MARK", "PUNKTI_KOOD"])


@check("f11_value_counts", S.with_(S.YLEV) + "SELECT MUDEL AS vaartus, count(*) AS n FROM ylev WHERE MUDEL IS NOT NULL GROUP BY 1")
def f11(spark, sf):
    return counted(inspections(spark, sf).dropna(subset=["MUDEL"]), F.col("MUDEL").alias("vaartus"))


@check(
    "g1_ranked_models",
    S.with_(S.YLEV) + "SELECT * FROM (SELECT MARK, MUDEL, count(*) AS arv, row_number() OVER (PARTITION BY MARK ORDER BY count(*) DESC, MUDEL) AS rnk FROM ylev WHERE MUDEL IS NOT NULL GROUP BY 1, 2) WHERE rnk <= 5",
)
def g1(spark, sf):
    counts = inspections(spark, sf).dropna(subset=["MUDEL"]).groupBy("MARK", "MUDEL").agg(F.count("*").alias("arv"))
    order = W.partitionBy("MARK").orderBy(F.desc("arv"), "MUDEL")
    return counts.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= 5)


@check("g4_frequencies", S.with_(S.YLEV) + "SELECT MARK, MUDEL, sum(count(*)) OVER (PARTITION BY MARK)::BIGINT AS MARK_SAGEDUS, CASE WHEN MUDEL IS NOT NULL THEN count(*) END AS MUDEL_SAGEDUS, count(*) AS n FROM ylev GROUP BY 1, 2")
def g4(spark, sf):
    rows = inspections(spark, sf)
    makes, models = frequencies(rows)
    joined = rows.join(makes, "MARK", "left").join(models, ["MARK", "MUDEL"], "left")
    return counted(joined, "MARK", "MUDEL", "MARK_SAGEDUS", "MUDEL_SAGEDUS")


@check(
    "g5_previous_inspections",
    S.with_(S.NUMBERED, S.CLEAN_MODEL)
    + """SELECT SOIDUK_ID, YV_KUUPAEV, MARK, MUDEL, row_number() OVER (PARTITION BY SOIDUK_ID ORDER BY YV_AASTA, YV_KUU, RIDA_NR) - 1 AS EELMISED_YV
 FROM clean WHERE YV_AASTA IS NOT NULL AND YV_KUU IS NOT NULL""",
)
def g5(spark, sf):
    rows = model_rows(spark, sf).dropna(subset=["YV_AASTA", "YV_KUU"])
    return add_previous_count(rows).select("SOIDUK_ID", "YV_KUUPAEV", "MARK", "MUDEL", "EELMISED_YV")


@check(
    "g6_previous_in_file_order",
    S.with_(S.NUMBERED) + "SELECT KATEGOORIA, YV_KUUPAEV, row_number() OVER (PARTITION BY KATEGOORIA ORDER BY RIDA_NR) - 1 AS EELMISED_YV FROM ylev",
)
def g6(spark, sf):
    """Few keys with very many rows each: the hot-key case."""
    rows = add_previous_count(inspections(spark, sf), key="KATEGOORIA", order=())
    return rows.select("KATEGOORIA", "YV_KUUPAEV", "EELMISED_YV")


@check("h1_order_and_limit", S.with_(S.YLEV) + "SELECT SOIDUK_ID, count(*) AS n FROM ylev GROUP BY 1 ORDER BY n DESC, SOIDUK_ID LIMIT 10")
def h1(spark, sf):
    return counted(inspections(spark, sf), "SOIDUK_ID").orderBy(F.desc("n"), "SOIDUK_ID").limit(10)


def year_in_parts(spark, sf) -> str:
    """1998 as a folder of two parts: few rows first, other column order, quoted line breaks."""

    def write():
        rows = inspections(spark, sf).filter(F.col(YEAR) == 1998).select(*RAW_COLUMNS)
        rows = rows.withColumn("RIKKED", F.translate("RIKKED", ";", "\n"))
        first = F.col("SOIDUK_ID").cast("bigint") % 10 == 0
        folder = work_path(spark, "year-in-parts")
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path(f"{folder}/1998.csv"))
        for name, part in (("a", rows.filter(first).select(*reversed(RAW_COLUMNS))), ("b", rows.filter(~first))):
            sinks.write_csv(part.coalesce(1), f"{folder}/{name}")
            for file in fs.globStatus(path(f"{folder}/{name}/part-*")):
                fs.rename(file.getPath(), path(f"{folder}/1998.csv/{name}.csv"))
        return f"{folder}/1998.csv"

    return once(spark, sf, "year-in-parts", write)


@check(
    "a5_year_folder_of_parts",
    S.with_(S.YLEV)
    + """SELECT esimene, n, CASE WHEN esimene THEN 0 ELSE koik - n END AS algus, CASE WHEN esimene THEN n ELSE koik END - 1 AS lopp, murtud, marke
 FROM (SELECT esimene, count(*) AS n, (SELECT count(*) FROM ylev WHERE ALLIKA_AASTA = 1998) AS koik, count(*) FILTER (contains(RIKKED, ';')) AS murtud,
  count(DISTINCT MARK) AS marke FROM (SELECT *, SOIDUK_ID::BIGINT % 10 = 0 AS esimene FROM ylev WHERE ALLIKA_AASTA = 1998) GROUP BY esimene)""",
)
def a5_parts(spark, sf):
    """Columns by each part's header and numbers in file order."""
    rows = src.load_year(spark, year_in_parts(spark, sf), 1998)
    return rows.groupBy((F.col("SOIDUK_ID").cast("bigint") % 10 == 0).alias("esimene")).agg(
        F.count("*").alias("n"), F.min(ROW_NO).alias("algus"), F.max(ROW_NO).alias("lopp"),
        F.count_if(F.col("RIKKED").contains("\n")).alias("murtud"), F.count_distinct("MARK").alias("marke"),
    )


@check("i1_union_all", S.with_(S.YLEV) + "SELECT ALLIKA_AASTA, MARK, count(*) AS n FROM ylev GROUP BY 1, 2")
def i1(spark, sf):
    """The years' own files, read together."""
    return counted(src.load_folder(spark, yearly_csv(spark, sf), regular_only=False), YEAR, "MARK")


@check("i2_distinct", S.with_(S.YLEV) + "SELECT DISTINCT KATEGOORIA, KERETYYP FROM ylev")
def i2(spark, sf):
    return inspections(spark, sf).select("KATEGOORIA", "KERETYYP").distinct()


@check("i3_set_difference", S.with_(S.YLEV, ENTRIES) + "SELECT DISTINCT defect_id FROM entries WHERE kind = 'parsed' EXCEPT SELECT defect_id FROM known")
def i3(spark, sf):
    return V.missing_ids(V.entry_counts(inspections(spark, sf)), known_ids(dimension(spark, sf))).select("defect_id").distinct()


@check("i4_intersection", S.with_(S.YLEV, BODIES, RULES_SQL) + "SELECT k AS KATEGOORIA, b AS KERETYYP FROM rules INTERSECT SELECT KATEGOORIA, KERETYYP FROM bodies")
def i4(spark, sf):
    trained = with_body(inspections(spark, sf)).select("KATEGOORIA", "KERETYYP")
    return P.body_type_rules(spark).intersect(trained)


_ROW = ", ".join(c for c in RAW_COLUMNS if c not in ("ESMANE_REG_AASTA", "SOIDUK_ID"))


@check(
    "m1_clean_for_model",
    S.with_(S.YLEV, S.CLEAN_MODEL) + f"SELECT {_ROW}, ESMANE_REG_AASTA, SOIDUK_ID, YV_AASTA, YV_KUU, VANUS, LABIS_ESIMESEL, ANDMED_PUUDULIKUD FROM clean",
)
def m1(spark, sf):
    return model_rows(spark, sf).drop(ROW_NO, YEAR)


@check(
    "m2_clean_batch",
    S.with_(f"all_rows AS ({S.ADAPTER})", f"ylev AS (SELECT * FROM all_rows WHERE {S.REG})", S.CLEAN_BATCH, RANGUS)
    + f"""SELECT {_ROW}, ESMANE_REG_AASTA, SOIDUK_ID, YV_AASTA, YV_KUU, VANUS, RIKETE_ARV, VO_ARV, OV_ARV, EOV_ARV, RIKE_IDS,
 LABIS_ESIMESEL, ANDMED_PUUDULIKUD, PUNKTI_RANGUS FROM clean LEFT JOIN rangus USING (PUNKTI_KOOD)""",
)
def m2(spark, sf):
    rows = C.clean_batch(inspections(spark, sf).filter(C.is_regular())).drop(ROW_NO, YEAR)
    return rows.withColumn("RIKE_IDS", F.array_join(F.col("RIKE_IDS").cast("array<string>"), ","))


@check("m4_station_strictness", S.with_(S.YLEV, RANGUS) + "SELECT PUNKTI_KOOD, PUNKTI_RANGUS FROM rangus")
def m4(spark, sf):
    return C.station_strictness(inspections(spark, sf)).select("PUNKTI_KOOD", "PUNKTI_RANGUS")
