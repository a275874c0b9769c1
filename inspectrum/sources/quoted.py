"""Records of comma-separated files whose quoted fields may hold line breaks, read in splits.

A file is read line by line in as many tasks as it has splits. Whether a split begins inside quotes is
not known when it is read, so every line gets its state and the number of its record for both cases. One row for each
split, with what it does to either case and how many records begin in it, is then composed along the file;
from it follow the right case of every split and dense record numbers in order of file and position. A
line that is a record of its own stays where it is; only lines of broken records are shuffled,
by record, also across the ends of splits.

A quote opens a field only at its beginning; in a quoted field two quotes stand for one; after the closing quote
anything up to the next comma belongs to the field. A file that ends inside quotes ends its last record. Empty lines outside
quotes are no records. Lines end in LF or CR LF, also inside quotes, where they are kept as LF. The first record
of a file is its header.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from inspectrum.sources.workspace import materialize

# Tasks get the functions below by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that one task reads at least, in as many splits as it takes.
TASK_BYTES = 32 << 20
_SPLIT_BYTES, _CODEC = "spark.sql.files.maxPartitionBytes", "spark.sql.parquet.compression.codec"
_CONTENT = re.compile(r'[^"]*+(?:""[^"]*+)*+')
_LINE_SCHEMA = "file long, block long, value string, seq long, out_record long, in_record long, out_before boolean, out_after boolean, in_before boolean, in_after boolean"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of a line is inside quotes, if its beginning is or not."""
    at = 0
    while True:
        if inside or line[at : at + 1] == '"':
            at = _CONTENT.match(line, at if inside else at + 1).end()
            if at == len(line):
                return True
            inside = False
        at = line.find(",", at) + 1
        if not at:
            return False


class _Split:
    """Where a split stands, if it began outside quotes and if it began inside."""

    def __init__(self) -> None:
        self.seq, self.inside, self.records = 0, [False, True], [0, 0]

    def lines(self, values: pa.Array) -> list:
        """Number of each line and, for both cases, the number of its record and the states around the line."""
        n = len(values)
        blank = pc.is_in(values, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        before = np.empty((2, n), bool)
        done = 0
        for i in np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)):
            before[0, done : i + 1], before[1, done : i + 1] = self.inside
            text = values[i].as_py()
            out = ends_inside(text, self.inside[0])
            self.inside = [out, out if self.inside[1] == self.inside[0] else ends_inside(text, self.inside[1])]
            done = i + 1
        before[0, done:], before[1, done:] = self.inside
        after = np.concatenate([before[:, 1:], np.array(self.inside)[:, None]], axis=1)
        records = np.cumsum(~before & ~blank, axis=1) + np.array(self.records)[:, None]
        self.records = [int(r[-1]) for r in records]
        seq = np.arange(self.seq, self.seq + n)
        self.seq += n
        return [pa.array(x) for x in (seq, records[0], records[1], before[0], after[0], before[1], after[1])]


def _with_states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "block", "value", "seq", "out_record", "in_record", "out_before", "out_after", "in_before", "in_after"]
    key, split = None, _Split()
    for batch in batches:
        file, block = batch["file"].to_numpy(), batch["block"].to_numpy()
        edges = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(file)]):
            if a == b:
                continue
            if (file[a], block[a]) != key:
                key, split = (file[a], block[a]), _Split()
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*(part[c] for c in names[:3]), *split.lines(part["value"])], names)


def _lines(spark: SparkSession, files: list[str], tasks: int, split_bytes: str | None) -> DataFrame:
    """All lines with their states, read in splits of up to `split_bytes` by at most so many tasks."""
    before, codec = spark.conf.get(_SPLIT_BYTES), spark.conf.get(_CODEC)
    try:
        spark.conf.set(_SPLIT_BYTES, split_bytes or before)
        # All text of the files is written once more: as small as it gets.
        spark.conf.set(_CODEC, "zstd")
        text = spark.read.text(files, lineSep="\n")
        keyed = text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
        # Written, so that the splits that the states belong to are those that are read later.
        return materialize(keyed.coalesce(tasks).mapInArrow(_with_states, _LINE_SCHEMA), "lines")
    finally:
        spark.conf.set(_SPLIT_BYTES, before)
        spark.conf.set(_CODEC, codec)


def _split_starts(lines: DataFrame, order: DataFrame) -> DataFrame:
    """(file, block, inside, first, broken): how each split begins, the number of records before it, lines of broken records in it.

    A split sends both cases to one state, keeps them or swaps them. The state after some splits is the
    last fixed one, swapped as often as splits since then swap.
    """

    def broken(case: str):
        return F.count_if(F.col(f"{case}_before") | F.col(f"{case}_after")).alias(f"{case}_broken")

    splits = lines.groupBy("file", "block").agg(
        F.max("out_record").alias("out_n"),
        F.max("in_record").alias("in_n"),
        F.max_by("out_after", "seq").cast("int").alias("out_end"),
        F.max_by("in_after", "seq").cast("int").alias("in_end"),
        broken("out"),
        broken("in"),
    )
    in_file = W.partitionBy("file").orderBy("block")
    upto, earlier = in_file.rowsBetween(W.unboundedPreceding, 0), in_file.rowsBetween(W.unboundedPreceding, -1)
    swaps = F.sum(F.when((F.col("out_end") == 1) & (F.col("in_end") == 0), 1).otherwise(0)).over(upto)
    counted = splits.withColumn("swaps", swaps)
    fixed = F.when(F.col("out_end") == F.col("in_end"), F.struct(F.col("out_end").alias("state"), "swaps"))
    placed = counted.withColumn("fixed", F.last(fixed, ignorenulls=True).over(earlier)).withColumn("past", F.lag("swaps", 1, 0).over(in_file))
    inside = F.coalesce((F.col("fixed.state") + F.col("past") - F.col("fixed.swaps")) % 2, F.col("past") % 2) == 1
    known = placed.withColumn("inside", inside)
    known = known.select(
        "file",
        "block",
        "inside",
        F.when(inside, F.col("in_n")).otherwise(F.col("out_n")).alias("n"),
        F.when(inside, F.col("in_broken")).otherwise(F.col("out_broken")).alias("broken"),
    )
    in_file_n = known.withColumn("upto", F.sum("n").over(upto))
    # One row for each file: the driver lists the files itself.
    totals = known.groupBy("file").agg(F.sum("n").alias("n")).join(F.broadcast(order), "file")
    headers = F.sum(F.greatest(F.col("n") - 1, F.lit(0))).over(W.orderBy("nth").rowsBetween(W.unboundedPreceding, -1))
    starts = totals.select("file", "tag", F.coalesce(headers, F.lit(0)).alias("file_first"))
    joined = in_file_n.join(F.broadcast(starts), "file")
    # Records of a split count from 1. The header is the first of its file and gets the number before the first row's.
    return joined.select("file", "tag", "block", "inside", (F.col("file_first") + F.col("upto") - F.col("n") - 2).alias("first"), "broken", "file_first")


def quoted_records(spark: SparkSession, files: list[tuple[str, int]], split_bytes: str | None = None) -> DataFrame:
    """(tag, number, record) of all rows of the files (path, tag), numbered from 0 without gaps in the given order.

    `record` is the text of a row with its quotes; headers are left out. `split_bytes` is the size of splits
    if it is not to be that of the session; small splits share tasks.
    """
    paths = [p for p, _ in files]
    # The listing names files as the scan does; it reads no contents.
    listed = spark.read.format("binaryFile").load(paths).select("path", "length", F.xxhash64("_metadata.file_path").alias("file")).collect()
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(r["length"] for r in listed) // TASK_BYTES))
    lines = _lines(spark, paths, tasks, split_bytes)
    given = {_plain(p): (i, tag) for i, (p, tag) in enumerate(files)}
    order = [(r["file"], *given[_plain(r["path"])]) for r in listed]
    starts = materialize(_split_starts(lines, spark.createDataFrame(order, "file long, nth int, tag int")), "splits")
    # One row for each split, a few ten bytes for 100 MB and more of text.
    stated = lines.join(F.broadcast(starts), ["file", "block"])

    def case(name: str):
        return F.when(F.col("inside"), F.col(f"in_{name}")).otherwise(F.col(f"out_{name}"))

    stated = stated.select(
        "file",
        "tag",
        "block",
        "seq",
        (F.col("first") + case("record")).alias("number"),
        F.col("file_first").alias("least"),
        F.regexp_replace("value", "\r$", "").alias("text"),
        case("before").alias("before"),
        (case("before") | case("after")).alias("broken"),
    ).filter(F.col("number") >= F.col("least"))
    records = stated.filter(~F.col("broken") & (F.col("text") != "")).select("tag", "number", F.col("text").alias("record"))
    if starts.filter(F.col("broken") > 0).isEmpty():
        return records
    pieces = stated.filter("broken").groupBy("tag", "file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "text"))).alias("pieces"))
    joined = F.array_join(F.transform("pieces", lambda p: p["text"]), "\n")
    return records.unionByName(pieces.select("tag", "number", joined.alias("record")))


def _plain(path: str) -> str:
    """A path without its scheme, as listings of one store may or may not name it."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", "", path)
