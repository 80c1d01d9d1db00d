"""Source row numbers without a global sort.

A file scan knows for each row its file, the start of its split and an increasing number
within the task. Counting rows per split gives the number of rows before every split; a row's
number is then that count plus its place in its split. The count table has one row per split.
It is written to the shared scratch folder, so no later job repeats the scan for it, and Spark
knows its size when it chooses the join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltgate.operators.tracked import ROW_INDEX
from siltgate.session import scratch_table

FILE, START, SEQ = "__file", "__start", "__seq"
POSITION = (FILE, START, SEQ)
RANGE = "__range"


def position_columns(*, row_in_file: Column | None = None) -> list[Column]:
    """The position of a row of a file scan. Must be selected directly above the scan."""
    path = F.col("_metadata.file_path").alias(FILE)
    if row_in_file is not None:
        return [path, F.lit(0).cast("bigint").alias(START), row_in_file.cast("bigint").alias(SEQ)]
    start = F.col("_metadata.file_block_start").alias(START)
    return [path, start, F.monotonically_increasing_id().alias(SEQ)]


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """The rows sorted into ranges, each stored with the number of its range."""
    return scratch_table(df.orderBy(*order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def running_before(table: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of a row's group, in order.

    A prefix sum in two levels over a :func:`ranged` table that is sorted by group, then order.
    Within a range the sums run on their own. A group that began in an earlier range is the first
    one of its range and gets what earlier ranges hold of it: one row per range, from partial
    sums. No task holds a group, however large.
    """
    parts = table.groupBy(RANGE, *group).agg(F.sum(value).alias("part"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(RANGE, *group, F.sum("part").over(earlier).alias("carried")).where("carried <> 0")
    inner = Window.partitionBy(RANGE, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = table.withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    # at most one row per range, of which there are as many as shuffle partitions
    joined = own.join(F.broadcast(carried), [RANGE, *group], "left")
    return joined.withColumn(name, F.col(name) + F.coalesce("carried", F.lit(0))).drop("carried")


def split_offsets(splits: DataFrame, skip: int = 0) -> DataFrame:
    """Per split: rows before it in its file, and kept rows before it in the whole source.

    ``splits`` has one row per split with its row count ``n`` and first number ``first``. The
    first ``skip`` rows of every file are not kept; without any, places in files are not counted.
    """
    counted, n = ranged(splits, FILE, START), F.col("n")
    if skip:
        counted = running_before(counted, [FILE], [START], n, "in_file")
        before = F.col("in_file")
        kept = F.greatest(before + n - skip, F.lit(0)) - F.greatest(before - skip, F.lit(0))
    else:
        counted, kept = counted.withColumn("in_file", F.lit(0).cast("bigint")), n
    offsets = running_before(counted.withColumn("kept", kept), [], [FILE, START], F.col("kept"), "before")
    return scratch_table(offsets.select(FILE, START, "n", "first", "in_file", "before"), "offsets")


@dataclass
class FileOrderNumbering:
    """Numbers rows by file path, then place in the file. The count job runs on first use."""

    scan: DataFrame
    skip: int = 0
    _offsets: DataFrame | None = field(default=None, repr=False)

    def offsets(self) -> DataFrame:
        if self._offsets is None:
            splits = self.scan.groupBy(FILE, START).agg(F.count(F.lit(1)).alias("n"), F.min(SEQ).alias("first"))
            self._offsets = split_offsets(splits, self.skip)
        return self._offsets

    def number(self, df: DataFrame, place_in_file: str | None = None) -> DataFrame:
        """Add the row number; rows among the skipped ones get none (null).

        ``place_in_file`` names a column for the place in the file, counted from 0 with the
        skipped rows, of which there are some.
        """
        place = F.col(SEQ) - F.col("first")
        known = F.coalesce((place >= 0) & (place < F.col("n")), F.lit(False))
        in_file = F.col("in_file") + place
        number = F.col("before") + in_file - F.greatest(F.col("in_file"), F.lit(self.skip)) + 1
        moved = F.raise_error(F.lit("File splits changed between jobs; keep spark.sql.files settings fixed."))
        joined = df.join(self.offsets(), [FILE, START], "left").withColumn(
            ROW_INDEX, F.when(known, F.when(in_file >= self.skip, number)).otherwise(moved.cast("bigint"))
        )
        if place_in_file:
            joined = joined.withColumn(place_in_file, in_file)
        return joined.drop("n", "first", "in_file", "before")
