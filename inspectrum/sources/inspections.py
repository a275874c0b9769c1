"""Yearly inspection files: resolve, scan, land."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectrum.sources.quoted import quoted_records
from inspectrum.sources.schema import RAW_COLUMNS, ROW_NO, YEAR

# File name forms of a yearly source, the cached form first.
CACHED_NAME = "yv_{year}.csv"
RAW_NAME = "{year}.csv"
RAW_GLOB = "[0-9][0-9][0-9][0-9].csv"

CSV_OPTIONS = {"sep": ",", "quote": '"', "escape": '"'}


def _exists(spark: SparkSession, path: str) -> bool:
    """True for a non-empty file or folder on any Hadoop file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path) and fs.getContentSummary(hadoop_path).getLength() > 0


def source_for_year(
    spark: SparkSession,
    year: int,
    sources: dict[int, str],
    cache_dir: str | None = None,
    prefer_cache: bool = True,
) -> str:
    """Cached file when present and wanted, otherwise the registered source."""
    if prefer_cache and cache_dir:
        cached = f"{cache_dir.rstrip('/')}/{CACHED_NAME.format(year=int(year))}"
        if _exists(spark, cached):
            return cached
    if int(year) not in sources:
        raise ValueError(f"no source for year {year}")
    return sources[int(year)]


def available_years(sources: dict[int, str]) -> list[int]:
    return sorted(sources)


def _part_files(spark: SparkSession, path: str) -> list[str]:
    """The file itself, or the files of a folder in order of their names; hidden ones do not count."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(hadoop_path) if f.isFile() and f.getLen() > 0]
    return sorted(p.toString() for p in found if p.getName()[0] not in "._")


def _header(spark: SparkSession, file: str) -> str:
    """First line of a file, compressed or not."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(conf).open(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    text = jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
    reader = jvm.java.io.BufferedReader(text)
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def _column_names(header: str) -> list[str]:
    names = next(csv.reader([header.removeprefix("\ufeff")]), [])
    return [name or f"_c{i}" for i, name in enumerate(names)]


def scan_files(spark: SparkSession, files: list[tuple[str, int]], columns: list[str] | None = None, split_bytes: str | None = None) -> DataFrame:
    """All-string scan of the files (path, year), with row numbers dense in the given order and the year.

    Columns are taken by the names in each file's own header, in any order; a column that only some files
    have is null elsewhere. Of `columns` those are kept that some file has.
    """
    headers = {path: tuple(_column_names(_header(spark, path))) for path, _ in files}
    kinds = {names: i for i, names in enumerate(dict.fromkeys(headers.values()))}
    # One scan of all files: the tag carries the year and the kind of header.
    records = quoted_records(spark, [(path, int(year) * len(kinds) + kinds[headers[path]]) for path, year in files], split_bytes)
    parts = []
    for names, kind in kinds.items():
        own = records.filter(F.col("tag") % len(kinds) == kind) if len(kinds) > 1 else records
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
        parsed = own.select(F.from_csv("record", schema, CSV_OPTIONS).alias("row"), "number", "tag")
        kept = [c for c in names if columns is None or c in columns]
        year = F.floor(F.col("tag") / len(kinds)).cast("int")
        parts.append(parsed.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("number").alias(ROW_NO), year.alias(YEAR)))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    wanted = columns if columns is not None else [c for c in rows.columns if c not in (ROW_NO, YEAR)]
    return rows.select(*[c for c in wanted if c in rows.columns], ROW_NO, YEAR)


def scan_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """All columns of files and folders of part files, and the row number in order of path, file and position."""
    files = [file for path in paths for file in _part_files(spark, path)]
    if not files:
        raise FileNotFoundError(f"no rows in {', '.join(paths)}")
    return scan_files(spark, [(file, 0) for file in files]).drop(YEAR)


def load_year(spark: SparkSession, path: str, year: int, columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """The wanted columns that the year has, with a row number in file order and the source tag."""
    return load_years(spark, {year: path}, columns)


def load_years(spark: SparkSession, paths: dict[int, str], columns: list[str] = RAW_COLUMNS, split_bytes: str | None = None) -> DataFrame:
    """The yearly files in one scan; row numbers go by year, file and position. `split_bytes` may set the size of splits."""
    files = [(file, year) for year in sorted(paths) for file in _part_files(spark, paths[year])]
    if not files:
        raise FileNotFoundError(f"no rows in {sorted(paths.values())}")
    return scan_files(spark, files, columns, split_bytes)


def _matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob on any Hadoop file system."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    return [f.getPath().toString() for f in found]


def yearly_paths(spark: SparkSession, folder: str) -> dict[int, str]:
    """Year → path of every `YYYY.csv` in a folder."""
    paths = _matching(spark, f"{folder.rstrip('/')}/{RAW_GLOB}")
    return {int(p.rsplit("/", 1)[1][:4]): p for p in paths}


def load_folder(spark: SparkSession, folder: str, regular_only: bool = True, split_bytes: str | None = None) -> DataFrame:
    """Every `YYYY.csv` of a folder; other inspection types are dropped at the scan."""
    paths = yearly_paths(spark, folder)
    if not paths:
        raise FileNotFoundError(f"no yearly CSV files in {folder}")
    rows = load_years(spark, paths, split_bytes=split_bytes)
    return rows.filter(F.col("YLEVAATUSLIIK") == "KORRALINE") if regular_only else rows


def land(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write inspections as Parquet, one partition folder per source year.

    `rebalance` merges small writes and splits a year that holds most of the rows.
    """
    df.hint("rebalance", YEAR).write.mode(mode).partitionBy(YEAR).parquet(path)


def landed_years(spark: SparkSession, path: str) -> list[int]:
    """Years that have been landed, from the partition folders."""
    found = _matching(spark, f"{path.rstrip('/')}/{YEAR}=[0-9]*")
    return sorted(int(p.rsplit("=", 1)[1]) for p in found)


def read_landed(spark: SparkSession, path: str, years: Iterable[int] | None = None) -> DataFrame:
    """Landed inspections; `years` becomes a partition filter and every one must exist."""
    df = spark.read.parquet(path)
    if years is None:
        return df
    wanted = sorted({int(y) for y in years})
    unknown = sorted(set(wanted) - set(landed_years(spark, path)))
    if unknown:
        raise ValueError(f"no source for years {unknown}")
    return df.filter(F.col(YEAR).isin(wanted))
