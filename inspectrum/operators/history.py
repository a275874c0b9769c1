"""Group sizes and ordered counts joined back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from inspectrum.sources.schema import ROW_NO
from inspectrum.sources.workspace import materialize

# Rows whose numbers agree above this bit are one chunk of the file: at most about a million rows.
_CHUNK_BITS = 20


def frequencies(df: DataFrame, mark: str = "MARK", model: str = "MUDEL") -> tuple[DataFrame, DataFrame]:
    """Row counts per make and per (make, model) from one scan of `df`.

    Both tables are written, so the planner knows their size and broadcasts them only
    below its threshold.
    """
    counts = df.filter(F.col(mark).isNotNull()).groupBy(mark, model).agg(F.count("*").alias("n"))
    pairs = materialize(counts, "model-counts")
    makes = materialize(pairs.groupBy(mark).agg(F.sum("n").alias("MARK_SAGEDUS")), "make-counts")
    models = pairs.filter(F.col(model).isNotNull()).withColumnRenamed("n", "MUDEL_SAGEDUS")
    return makes, models


def add_frequencies(df: DataFrame, counts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """MARK_SAGEDUS and MUDEL_SAGEDUS; NULL where a key is NULL. `counts` are the `frequencies` when they are known already."""
    makes, models = counts or frequencies(df)
    return df.join(makes, "MARK", "left").join(models, ["MARK", "MUDEL"], "left")


def add_previous_count(
    df: DataFrame,
    key: str = "SOIDUK_ID",
    order: tuple[str, ...] = ("YV_AASTA", "YV_KUU"),
    row_no: str = ROW_NO,
    name: str = "EELMISED_YV",
) -> DataFrame:
    """Number of earlier rows of the same key; ties of `order` are taken in file order.

    A key that holds a large part of all rows is split into cells (key, order values,
    file chunk): rows are ranked inside their cell and the sizes of the earlier cells
    are added. Only the cell sizes are ever ordered per key. `order` columns must not
    be NULL; rows without a key get NULL.
    """
    chunked = df.withColumn("__chunk", F.shiftright(F.col(row_no), _CHUNK_BITS))
    cell = [key, *order, "__chunk"]
    sizes = chunked.filter(F.col(key).isNotNull()).groupBy(*cell).agg(F.count("*").alias("__size"))
    earlier = W.partitionBy(key).orderBy(*order, "__chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*cell, F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    inside = W.partitionBy(*cell).orderBy(row_no)
    ranked = chunked.withColumn("__rank", F.row_number().over(inside) - 1)
    return (
        ranked.join(offsets, cell, "left")
        .withColumn(name, (F.col("__before") + F.col("__rank")).cast("bigint"))
        .drop("__chunk", "__rank", "__before")
    )
