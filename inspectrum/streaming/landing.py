"""Incremental landing: only files that have not been landed yet are read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectrum.sources.inspections import _exists, scan_files
from inspectrum.sources.schema import RAW_COLUMNS, ROW_NO, YEAR

_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def land_new_files(spark: SparkSession, folder: str, path: str, checkpoint: str) -> None:
    """Read the yearly CSV files that arrived in `folder` since the last run and append them.

    The file log under `checkpoint` makes a repeated run a no-op. Each run writes its own
    folder and overwrites it when it is repeated, so an interrupted run leaves no copies. The stream brings the names of new
    files alone; a batch is scanned like any other files, so its rows are numbered by year, file and position.
    """
    options = {"pathGlobFilter": "*[0-9][0-9][0-9][0-9].csv"}
    arriving = spark.readStream.format("binaryFile").schema(_FILE_SCHEMA).options(**options).load(folder).select("path", "length")

    def append(batch: DataFrame, batch_id: int) -> None:
        names = [r["path"] for r in batch.filter("length > 0").select("path").collect()]
        if not names:
            return
        files = sorted((int(re.search(r"([0-9]{4})\.csv$", name)[1]), name) for name in names)
        first = 0
        if _exists(spark, path):
            earlier = spark.read.parquet(path).filter(F.col("saabumine") < batch_id)
            last = earlier.agg(F.max(ROW_NO)).first()[0]
            first = 0 if last is None else last + 1
        rows = scan_files(spark, [(name, year) for year, name in files], RAW_COLUMNS)
        missing = {c: F.lit(None).cast("string") for c in RAW_COLUMNS if c not in rows.columns}
        numbered = rows.withColumns({**missing, ROW_NO: F.col(ROW_NO) + first})
        numbered.select(*RAW_COLUMNS, ROW_NO, YEAR).write.mode("overwrite").partitionBy(YEAR).parquet(f"{path}/saabumine={batch_id}")

    query = (
        arriving.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Everything landed so far, with row numbers in order of arrival."""
    return spark.read.parquet(path).drop("saabumine")
