"""Inspection-shaped data derived from the driver tables.

The driver ships no inspections, so its tables are reshaped into them once per
application and landed as Parquet by year, like real yearly files. Queries then scan
that table with partition and column pruning and do not repeat the five-way join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectrum.functions.text import year_of
from inspectrum.sources.schema import LANDED_SCHEMA, RAW_COLUMNS, ROW_NO, YEAR
from inspectrum.sources.workspace import shuffles_deleted, work_path

# Category given to each part type; any other type is O2.
CATEGORY_OF_TYPE = {"STANDARD": "M1", "MEDIUM": "M1G", "LARGE": "N1", "PROMO": "N2", "SMALL": "L3e"}

_landed: dict[tuple[str, str], str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _text(c: str):
    return F.col(c).cast("string")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with what its raw columns are made of."""
    line = F.col("l_linenumber")
    lines = _table(spark, sf_dir, "lineitem").select(
        *["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"],
        (F.col("l_discount") >= 0.05).alias("discounted"),
        (F.col("l_tax") >= 0.08).alias("taxed"),
        ((F.col("l_returnflag") == "A") & (line == 1)).alias("returned"),
        F.concat(
            F.year("l_shipdate").cast("string"), F.lit("-"), F.lpad(F.month("l_shipdate").cast("string"), 2, "0")
        ).alias("shipped"),
    )
    # What belongs to an order or a supplier is joined to it first: line items meet each large side once, narrow.
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("ordered"))
    orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")
    nations = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    suppliers = _table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    )


def _raw_columns() -> dict[str, Column]:
    """The thirteen raw string columns of a joined row."""
    quantity, line = F.col("l_quantity"), F.col("l_linenumber")
    defects = F.concat(
        F.lit("VO:"),
        _text("l_partkey"),
        F.when(F.col("discounted"), F.concat(F.lit(";OV:"), _text("l_suppkey"))).otherwise(""),
        F.when(F.col("taxed"), F.concat(F.lit(", EOV:"), _text("l_orderkey"))).otherwise(""),
        F.when(line == 5, ";BAD:4;VO:not-number").otherwise(""),
    )
    category = F.lit("O2")
    for part_type, name in CATEGORY_OF_TYPE.items():
        category = F.when(F.col("p_type") == part_type, name).otherwise(category)
    return {
        "TEHNOYLEVAATUSPUNKT": F.col("s_name"),
        "PUNKTI_KOOD": F.col("n_name"),
        "TOOTAJA": (F.col("l_suppkey") * 10 + F.col("l_orderkey") % 3).cast("string"),
        "YV_KUUPAEV": F.col("shipped"),
        "YLEVAATUSLIIK": F.when(line == 7, "RAHVUSVAHELINE").when(line == 6, "KORDUV").otherwise("KORRALINE"),
        "YLEVAATUSOTSUS": F.when(F.col("returned"), "VASTAB_NOUETELE")
        .when(quantity + F.col("p_size") > 70, "KORDUVALE")
        .otherwise("KORRAS"),
        "RIKKED": F.when(quantity < 20, None).when(quantity < 22, "  ").otherwise(defects),
        "SOIDUK_ID": _text("c_custkey"),
        "ESMANE_REG_AASTA": F.when(F.col("l_partkey") % 97 != 0, (F.col("ordered") - F.col("p_size")).cast("string")),
        "MARK": F.col("p_brand"),
        "MUDEL": F.when(F.col("l_partkey") % 89 != 0, F.col("p_name")),
        "KATEGOORIA": category,
        "KERETYYP": F.col("c_mktsegment"),
    }


def reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen raw string columns, one row per line item."""
    return _joined(spark, sf_dir).select(*[value.alias(c) for c, value in _raw_columns().items()])


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows with their source year, range-sorted so that the row number follows a total order of the rows.

    The last sort key differs between copies of a row: a large group of copies is
    spread over several range partitions. Joined rows are shuffled, which are narrower than
    the text made of them.
    """
    raw = _raw_columns()
    raw[YEAR] = year_of(raw["YV_KUUPAEV"])
    raw["__copy"] = F.col("__copy")
    order = [YEAR, "YV_KUUPAEV", *[c for c in RAW_COLUMNS if c != "YV_KUUPAEV"], "__copy"]
    rows = (
        _joined(spark, sf_dir)
        .withColumn("__copy", F.monotonically_increasing_id())
        .repartitionByRange(*[raw[c] for c in order])
        .select(*[raw[c].alias(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn(ROW_NO, F.monotonically_increasing_id())
    )
    return rows.select(*RAW_COLUMNS, ROW_NO, YEAR)


def _land(spark: SparkSession, sf_dir: str) -> str:
    path = work_path(spark, "inspections")
    with shuffles_deleted(spark):
        numbered(spark, sf_dir).write.partitionBy(YEAR).parquet(path, compression="zstd")
    return path


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan of the landed inspections of one driver folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _landed:
        _landed[key] = _land(spark, sf_dir)
    return spark.read.schema(LANDED_SCHEMA).parquet(_landed[key])


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defect codes made from the parts."""
    return _table(spark, sf_dir, "part").select(
        _text("p_partkey").alias("ID"),
        F.col("p_name").alias("NIMETUS"),
        F.lit("NIMETUS").alias("TYYP"),
        F.col("p_partkey").alias(ROW_NO),
    )
