"""Every registered query that has SQL, on the smallest driver tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["jaam", "jaama_kood", "kokku", "labis_esimesel", "kukkus_esimesel", "labimise_protsent"]
    assert df.count() == 10


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    problem = compare(spark, con, name, SF_DIR)
    assert problem in (None, "equal but empty")


def test_rule_table_is_broadcast(spark):
    """Rows are not shuffled to meet the rule table."""
    from inspectrum.checks.adapter import inspections
    from inspectrum.plans import scoring

    rows = scoring.flag_body_types(inspections(spark, SF_DIR), scoring.body_type_rules(spark))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_year_and_column_pruning(spark):
    """Filters and the columns of a query reach the scan of the landed table."""
    from pyspark.sql import functions as F

    from inspectrum.checks.adapter import inspections
    from inspectrum.plans import queries
    from inspectrum.sources.schema import YEAR

    df = queries.station_strictness(inspections(spark, SF_DIR).filter(F.col(YEAR) == 1999))
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan parquet") :].splitlines()[0]
    assert "SOIDUK_ID" not in scan and "RIKKED" not in scan
    assert "ALLIKA_AASTA" in scan.split("PartitionFilters:")[1].split("]")[0]
    assert "EqualTo(YLEVAATUSLIIK,KORRALINE)" in scan
