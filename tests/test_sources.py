"""Scans, resolver, landing and sinks."""

import json
import random
import re

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from inspectrum.checks import rows as checked

from inspectrum.operators.cleaning import clean_batch, clean_for_model
from inspectrum.plans.quality import scalar_profile
from inspectrum.sources import inspections as src
from inspectrum.sources import quoted, sinks
from inspectrum.sources.dimension import defect_names, known_ids, read_dimension
from inspectrum.sources.schema import RAW_COLUMNS, ROW_NO, YEAR
from inspectrum.streaming.landing import land_new_files, landed

HEADER = ",".join(RAW_COLUMNS)


def line(**values):
    return ",".join(values.get(c, "") for c in RAW_COLUMNS)


def row(i, year, **values):
    base = {
        "TEHNOYLEVAATUSPUNKT": "Jaam",
        "PUNKTI_KOOD": "AA",
        "YV_KUUPAEV": f"{year}-0{i % 9 + 1}",
        "YLEVAATUSLIIK": "KORRALINE",
        "YLEVAATUSOTSUS": "KORRAS",
        "SOIDUK_ID": str(i),
        "ESMANE_REG_AASTA": "2010",
        "MARK": "BMW",
    }
    return line(**{**base, **values})


@pytest.fixture
def folder(tmp_path):
    first = [HEADER, row(1, 2023, RIKKED='"VO:1\nOV:2"'), row(2, 2023, YLEVAATUSLIIK="KORDUV"), row(3, 2023)]
    (tmp_path / "2023.csv").write_text("\n".join(first) + "\n", encoding="utf-8")
    # The same columns in reverse order.
    second = [",".join(reversed(RAW_COLUMNS)), ",".join(reversed(row(4, 2024).split(",")))]
    (tmp_path / "2024.csv").write_text("\n".join(second) + "\n", encoding="utf-8")
    return tmp_path


def test_folder_scan_by_header_and_quoted_newline(spark, folder):
    rows = src.load_folder(spark, str(folder), regular_only=False).orderBy(ROW_NO).collect()
    assert [(r["SOIDUK_ID"], r[YEAR], r["MARK"]) for r in rows] == [
        ("1", 2023, "BMW"), ("2", 2023, "BMW"), ("3", 2023, "BMW"), ("4", 2024, "BMW"),
    ]
    assert rows[0]["RIKKED"] == "VO:1\nOV:2" and rows[1]["RIKKED"] is None
    assert src.load_folder(spark, str(folder)).count() == 3


def test_missing_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        src.load_folder(spark, str(tmp_path))


def test_missing_columns_are_left_out(spark, folder):
    got = src.load_year(spark, str(folder / "2023.csv"), 2023, ["SOIDUK_ID", "NO_SUCH"]).orderBy(ROW_NO)
    assert [r["SOIDUK_ID"] for r in got.collect()] == ["1", "2", "3"] and "NO_SUCH" not in got.columns


def test_year_folder_goes_by_each_header_and_by_file_order(spark, tmp_path):
    """Parts of different size, header order and columns; a larger later part does not come first."""
    year = tmp_path / "2023.csv"
    year.mkdir()
    (year / "part-00000.csv").write_text('SOIDUK_ID,MARK,RIKKED\n1,BMW,"VO:1\nOV:2"\n2,AUDI,\n', encoding="utf-8")
    (year / "part-00001.csv").write_text("MARK,SOIDUK_ID\n" + "".join(f"OPEL,{i}\n" for i in range(3, 303)), encoding="utf-8")
    (year / "_SUCCESS").write_text("x")
    for rows in (src.load_year(spark, str(year), 2023), src.load_years(spark, {2023: str(year)})):
        got = rows.orderBy(ROW_NO).collect()
        assert [int(r["SOIDUK_ID"]) for r in got] == list(range(1, 303))
        assert [r[ROW_NO] for r in got] == list(range(302))
        assert got[0]["MARK"] == "BMW" and got[0]["RIKKED"] == "VO:1\nOV:2" and got[2]["MARK"] == "OPEL" and got[2]["RIKKED"] is None


def test_cached_source_is_preferred(spark, folder):
    sources = {2023: str(folder / "2023.csv")}
    (folder / "yv_2023.csv").write_text(HEADER + "\n", encoding="utf-8")
    cached = src.source_for_year(spark, 2023, sources, cache_dir=str(folder))
    assert cached.endswith("yv_2023.csv")
    assert src.source_for_year(spark, 2023, sources, str(folder), prefer_cache=False) == sources[2023]
    assert src.source_for_year(spark, 2023, sources) == sources[2023]


def test_empty_cache_and_unknown_year(spark, folder):
    (folder / "yv_2023.csv").write_text("", encoding="utf-8")
    sources = {2023: str(folder / "2023.csv"), 2022: "x"}
    assert src.source_for_year(spark, 2023, sources, str(folder)) == sources[2023]
    assert src.available_years(sources) == [2022, 2023]
    with pytest.raises(ValueError):
        src.source_for_year(spark, 1999, sources)


def test_landed_years_are_partitions(spark, folder, tmp_path):
    path = str(tmp_path / "landed")
    src.land(src.load_folder(spark, str(folder), regular_only=False), path)
    one = src.read_landed(spark, path, [2024])
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "ALLIKA_AASTA" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert src.landed_years(spark, path) == [2023, 2024]
    with pytest.raises(ValueError):
        src.read_landed(spark, path, [1999])


def test_incremental_landing(spark, folder, tmp_path):
    arriving = tmp_path / "arriving"
    arriving.mkdir()
    (arriving / "yv_2023.csv").write_text((folder / "2023.csv").read_text(encoding="utf-8"), encoding="utf-8")
    path, log = str(tmp_path / "stream"), str(tmp_path / "log")
    land_new_files(spark, str(arriving), path, log)
    assert landed(spark, path).count() == 3
    land_new_files(spark, str(arriving), path, log)
    assert landed(spark, path).count() == 3
    (arriving / "yv_2025.csv").write_text("\n".join([HEADER, row(9, 2025)]) + "\n", encoding="utf-8")
    land_new_files(spark, str(arriving), path, log)
    rows = landed(spark, path)
    assert rows.count() == 4 and rows.select(ROW_NO).distinct().count() == 4
    assert {r[0] for r in rows.select(YEAR).distinct().collect()} == {2023, 2025}


def test_dimension_last_row_wins(spark, tmp_path):
    text = "ID,NIMETUS,TYYP\n1,vana,NIMETUS\n1,TÃ¤hva,NIMETUS\n2,,NIMETUS\n3,grupp,GRUPP\nx,y,GRUPP\n"
    (tmp_path / "rike.csv").write_text(text, encoding="utf-8")
    dim = spark.read.csv(str(tmp_path / "rike.csv"), header=True).withColumn(ROW_NO, F.monotonically_increasing_id())
    assert {(r["rike_id"], r["nimetus"]) for r in defect_names(dim).collect()} == {("1", "Tähva")}
    assert {r[0] for r in known_ids(dim).collect()} == {1, 2, 3}
    assert "KOOD" in read_dimension(spark, str(tmp_path / "rike.csv")).columns


def test_edge_rows(spark):
    """Ages at both limits, odd registration years, blank text and a NULL decision."""
    fields = ["YV_KUUPAEV", "YLEVAATUSLIIK", "YLEVAATUSOTSUS", "RIKKED", "SOIDUK_ID", "ESMANE_REG_AASTA", "MARK"]
    rows = [
        ("2020-01", "KORRALINE", "KORRAS", None, "1", "2021", "A"),
        ("2020-01", "KORRALINE", "KORDUVALE", "  ", "2", "2020", " "),
        ("2020-01", "KORRALINE", None, "VO:1", None, "1920", None),
        ("2020-01", "KORRALINE", "VASTAB_NOUETELE", "VO:1", "x", "1919", "A"),
        ("2020-01", "KORDUV", "KORRAS", "VO:1", "5", "abc", "A"),
        ("bad", "KORRALINE", "KORRAS", "VO:1", "6", "2000.0", "A"),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields)).withColumn("PUNKTI_KOOD", F.lit("AA"))
    model = clean_for_model(df).orderBy(F.col("SOIDUK_ID").asc_nulls_last()).collect()
    by_reg = {r["ESMANE_REG_AASTA"]: r for r in model}
    assert by_reg[2021]["VANUS"] is None and by_reg[2020]["VANUS"] == 0
    assert by_reg[1920]["VANUS"] == 100 and by_reg[1919]["VANUS"] is None
    assert by_reg[2021]["LABIS_ESIMESEL"] == 1 and by_reg[2020]["LABIS_ESIMESEL"] == 0
    assert by_reg[1920]["LABIS_ESIMESEL"] is None and by_reg[1919]["LABIS_ESIMESEL"] is None
    assert by_reg[2000]["YV_AASTA"] is None and by_reg[2000]["ANDMED_PUUDULIKUD"] == 1
    assert by_reg[2020]["ANDMED_PUUDULIKUD"] == 0 and by_reg[2020]["MARK"] == ""
    batch = {r["ESMANE_REG_AASTA"]: r["ANDMED_PUUDULIKUD"] for r in clean_batch(df).collect()}
    assert batch[2021] == 0 and batch[1920] == 1
    profile = scalar_profile(df.withColumn(YEAR, F.lit(2020))).first()
    assert profile["regular_other_decision_rows"] == 1 and profile["missing_mark_rows"] == 2
    assert profile["invalid_age_rows"] == 2 and (profile["min_vehicle_age"], profile["max_vehicle_age"]) == (-1, 101)
    assert profile["invalid_reg_year_rows"] == 2 and profile["missing_vehicle_id_rows"] == 1


def test_json_sink_writes_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None, [1, 2])], "a int, b double, c string, d array<int>")
    sinks.write_json(df, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert json.loads(text) == {"a": 1, "b": None, "c": None, "d": [1, 2]}


def test_csv_sink_keeps_spaces_and_arrays(spark, tmp_path):
    df = spark.createDataFrame([("  x ", None, "a\"b,c\nd", [1, 2])], "a string, b string, c string, d array<int>")
    sinks.write_csv(df, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, escape='"', multiLine=True).first()
    assert (back["a"], back["b"], back["c"], back["d"]) == ("  x ", None, "a\"b,c\nd", "[1,2]")


def _broken_text(rng, n):
    """Rows with quoted breaks of many kinds, and what a whole-file reader makes of them."""
    out = []
    for i in range(n):
        fields = [str(i)]
        for _ in range(3):
            kind = rng.randrange(8)
            if kind == 0:
                fields.append('"' + "\n".join("line %d" % rng.randrange(9) for _ in range(rng.randint(1, 6))) + '"')
            elif kind == 1:
                fields.append('"a, ""b"" \n ""c"", d"')
            elif kind == 2:
                fields.append('5" pipe')
            elif kind == 3:
                fields.append('"\n\n"')
            elif kind == 4:
                fields.append('""')
            else:
                fields.append("plain" * rng.randint(0, 4))
        out.append(",".join(fields))
        if rng.random() < 0.1:
            out.append("")
    return "\n".join(["id,a,b,c", *out]) + rng.choice(["", "\n"])


@pytest.mark.parametrize("split", [150, 701, 10**7])
def test_quoted_breaks_across_splits(spark, tmp_path, split):
    """One file of many splits, some of them wholly inside quotes, gives the rows of a reader of whole files."""
    rng = random.Random(split)
    path = str(tmp_path / "broken.csv")
    text = _broken_text(rng, 250) + '\nlast,"' + "far\n" * 300 + '",y,z\nend,,,'
    (tmp_path / "broken.csv").write_text(text, encoding="utf-8")
    whole = spark.read.csv(path, header=True, multiLine=True, escape='"').collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        rows = src.scan_csv(spark, path)
        got = rows.orderBy(ROW_NO).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r)[:4] for r in got] == [tuple(r) for r in whole]
    assert [r[ROW_NO] for r in got] == list(range(len(whole)))


def test_line_ends_and_files_that_end_inside_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,t\r\n1,"x\r\ny"\r\n\r\n2,z\r\n3,"open\r\n')
    (tmp_path / "b.csv").write_bytes(b"id,t\n")
    (tmp_path / "c.csv").write_bytes(b"t,id\nlast,4\n")
    rows = src.scan_csv(spark, str(tmp_path)).orderBy(ROW_NO).collect()
    assert [(r["id"], r["t"], r[ROW_NO]) for r in rows[:2]] == [("1", "x\ny", 0), ("2", "z", 1)]
    assert [(r["id"], r[ROW_NO]) for r in rows[2:]] == [("3", 2), ("4", 3)] and rows[2]["t"].startswith("open")


def test_states_of_lines():
    assert not quoted.ends_inside('1,"a",2', False) and not quoted.ends_inside('1,"a",2', True)
    assert quoted.ends_inside('1,"a', False) and quoted.ends_inside('x""y', True) and not quoted.ends_inside('x"', True)
    assert not quoted.ends_inside('5" pipe', False) and quoted.ends_inside("", True) and not quoted.ends_inside("", False)
    assert not quoted.ends_inside('"a"b",c', False) and quoted.ends_inside('a,"', False)


def test_small_splits_share_tasks(spark, tmp_path, monkeypatch):
    """Broken records over hundreds of splits are put together by a few tasks, from files in order of their names."""
    written = []

    def materialize(df, name):
        written.append((name, df.rdd.getNumPartitions()))
        return kept(df, name)

    kept = quoted.materialize
    monkeypatch.setattr(quoted, "materialize", materialize)
    year = tmp_path / "2023.csv"
    year.mkdir()
    for part in (0, 1):
        lines = [f'{part * 500 + i},"VO:1\nOV:{i}\n"' for i in range(500)]
        (year / f"part-0000{part}.csv").write_text("\n".join(["id,t", *lines]) + "\n", encoding="utf-8")
    rows = src.load_years(spark, {2023: str(year)}, ["id", "t"], split_bytes="64").orderBy(ROW_NO).collect()
    assert [(r["id"], r["t"], r[ROW_NO]) for r in rows] == [(str(i), f"VO:1\nOV:{i % 500}\n", i) for i in range(1000)]
    assert dict(written)["lines"] <= spark.sparkContext.defaultParallelism


def test_values_of_a_text_scan_are_not_sorted(spark, folder, monkeypatch):
    monkeypatch.setattr(checked, "yearly_csv", lambda spark, sf: str(folder))
    found = checked.a3(spark, "")
    assert not re.search(r"\bSort \[", found._jdf.queryExecution().executedPlan().toString())
    got = {r["name"]: (r["n"], r["low"], r["high"]) for r in found.collect()}
    assert got["SOIDUK_ID"] == (4, "1", "4") and got["RIKKED"] == (1, "VO:1\nOV:2", "VO:1\nOV:2")
    # No row for a column without values.
    assert "MUDEL" not in got and len(got) == 9


def test_years_are_written_side_by_side(spark, tmp_path):
    """A task writes the years of its rows as they come, without sorting all of them first."""

    def told(batches):
        for b in batches:
            told = TaskContext.get().getLocalProperty("spark.sql.maxConcurrentOutputFileWriters")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([told] * b.num_rows)], ["aasta", "t"])

    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    rows = spark.range(0, 40, 1, 1).select((F.col("id") % 4 + 2000).alias("aasta")).mapInArrow(told, "aasta long, t string")
    paths = sinks.write_yearly_csv(rows, str(tmp_path / "out"), "aasta")
    assert sorted(paths) == [2000, 2001, 2002, 2003]
    texts = [r["t"] for p in paths.values() for r in spark.read.csv(p, header=True).collect()]
    assert len(texts) == 40 and all(int(t) >= 4 for t in texts)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_landing_numbers_go_on_after_one_row(spark, folder, tmp_path):
    arriving = tmp_path / "arriving"
    arriving.mkdir()
    (arriving / "yv_2022.csv").write_text("\n".join([HEADER, row(1, 2022)]) + "\n", encoding="utf-8")
    path, log = str(tmp_path / "stream"), str(tmp_path / "log")
    land_new_files(spark, str(arriving), path, log)
    (arriving / "yv_2024.csv").write_text("\n".join([HEADER, row(5, 2024), row(6, 2024)]) + "\n", encoding="utf-8")
    (arriving / "yv_2023.csv").write_text("\n".join([HEADER, row(7, 2023, RIKKED='"VO:1\nOV:2"'), *[row(8, 2023)] * 3]) + "\n", encoding="utf-8")
    land_new_files(spark, str(arriving), path, log)
    rows = landed(spark, path).orderBy(ROW_NO).collect()
    assert [(r[ROW_NO], r["SOIDUK_ID"]) for r in rows] == [(0, "1"), (1, "7"), (2, "8"), (3, "8"), (4, "8"), (5, "5"), (6, "6")]


def test_dimension_of_several_files(spark, tmp_path):
    """The last row of a repeated id is the last one in order of files, whatever their size."""
    (tmp_path / "a.csv").write_text("ID,NIMETUS,TYYP\n" + "1,vana,NIMETUS\n" * 500, encoding="utf-8")
    (tmp_path / "b.csv").write_text("TYYP,ID,NIMETUS\nNIMETUS,1,uus\n", encoding="utf-8")
    assert [tuple(r) for r in defect_names(read_dimension(spark, str(tmp_path))).collect()] == [("1", "uus")]
