"""Report sinks. Row-level results go to Parquet, reports to CSV or JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


CSV_WRITE = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

#: Years that a task writes side by side as their rows come; rows of more years are sorted by year first.
_WRITERS, YEARS_AT_ONCE = "spark.sql.maxConcurrentOutputFileWriters", 200


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are written as JSON text, surrounding spaces are kept."""
    _flat(df).write.mode("overwrite").options(**CSV_WRITE).csv(path)


def write_yearly_csv(df: DataFrame, folder: str, year_column: str) -> dict[int, str]:
    """One CSV folder `YYYY.csv` per year, for readers of the yearly layout.

    All years are written in one job, then their folders are renamed.
    """
    spark, folder = df.sparkSession, folder.rstrip("/")
    before = spark.conf.get(_WRITERS)
    try:
        spark.conf.set(_WRITERS, YEARS_AT_ONCE)
        _flat(df).write.mode("overwrite").partitionBy(year_column).options(**CSV_WRITE).csv(folder)
    finally:
        spark.conf.set(_WRITERS, before)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    paths: dict[int, str] = {}
    for status in fs.globStatus(hadoop_path(f"{folder}/{year_column}=[0-9]*")) or []:
        year = int(status.getPath().getName().rsplit("=", 1)[1])
        paths[year] = f"{folder}/{year}.csv"
        fs.rename(status.getPath(), hadoop_path(paths[year]))
    return paths


def _without_nan(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else df


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; NaN becomes null and nulls are written out."""
    _without_nan(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
