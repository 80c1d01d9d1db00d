"""Reject rows: one per finding, with the original row, as text."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltgate.functions.text import plain_text
from siltgate.operators.tracked import ROW_INDEX, Finding, TrackedFrame

# Metadata columns of a reject row, in order.
METADATA_COLUMNS = ("__stage", ROW_INDEX, "__column", "__check", "__value", "__reason")
# Position of the finding in the plan; reject rows sort by it, then by row number.
FINDING_ORDER = "__finding"

# Text is written as it is: no trimming, empty cells empty, quotes doubled.
CSV_OUTPUT = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
# A text that no cell is, so that none is read as null.
_NO_CELL = "\u0000"
# A folder beside the files, which readers of the folder skip.
MANIFEST = "_manifest"
MANIFEST_SCHEMA = "part string, rows bigint, first_row bigint, last_row bigint"


def found_rejects(frame: TrackedFrame) -> DataFrame:
    """One row per finding: original slots, position, number of the finding, value; unnumbered.

    The filter comes first, so findings are listed for failing rows only. Texts that depend on
    the finding alone are left out until the rows are shown.
    """
    found = frame.rows_where(frame.failed()).withColumn("__r", F.explode(listed_findings(frame))).where(F.col("__r").isNotNull())
    computed = {slot for slot in frame.df.columns if slot.startswith("e") and slot[1:].isdigit()}
    return found.drop(*computed)


def listed_findings(frame: TrackedFrame) -> Column:
    """An array with number and value of each finding of a row, null for those it does not have."""
    if not frame.findings:
        return F.array(F.struct(F.lit(0).alias("finding"), F.lit("").alias("value")))
    return F.array(
        *[
            F.when(_found(frame, finding), F.struct(F.lit(number).alias("finding"), _value(frame, finding).alias("value")))
            for number, finding in enumerate(frame.findings)
        ]
    )


def numbered_rejects(frame: TrackedFrame, found: DataFrame, *, with_order: bool = False) -> DataFrame:
    """Found rejects as they are shown: numbered, original columns as text, then the metadata."""
    columns = [
        F.coalesce(plain_text(F.col(slot), frame.df.schema[slot].dataType), F.lit("")).alias(name)
        for name, slot in frame.original.items()
    ]
    finding = F.col("__r.finding")
    return frame.numbering.number(found).select(
        *columns,
        _label(frame, finding, "stage").alias("__stage"),
        F.col(ROW_INDEX),
        _label(frame, finding, "column").alias("__column"),
        _label(frame, finding, "check").alias("__check"),
        F.coalesce(F.col("__r.value"), F.lit("")).alias("__value"),
        _label(frame, finding, "reason").alias("__reason"),
        *([finding.alias(FINDING_ORDER)] if with_order else []),
    )


def reject_rows(frame: TrackedFrame) -> DataFrame:
    """Original columns and metadata for each finding of each failing row."""
    return numbered_rejects(frame, found_rejects(frame))


def ordered_rejects(frame: TrackedFrame, found: DataFrame | None = None) -> DataFrame:
    """Reject rows sorted by finding, then row number: the order a reject file is read in.

    A range sort of the reject rows alone. The key is unique, so no range grows hot.
    """
    rows = numbered_rejects(frame, found_rejects(frame) if found is None else found, with_order=True)
    return rows.orderBy(FINDING_ORDER, ROW_INDEX).drop(FINDING_ORDER)


def write_rejects(frame: TrackedFrame, folder: str, found: DataFrame | None = None) -> str:
    """Write the reject rows as a folder of CSV files with headers, and a manifest of the files.

    Rejects are written by the tasks that find them, without a shuffle. Each file is in row
    order; the manifest tells which rows it spans.
    """
    found = found_rejects(frame) if found is None else found
    rows = numbered_rejects(frame, found, with_order=True).sortWithinPartitions(ROW_INDEX, FINDING_ORDER).drop(FINDING_ORDER)
    with _names_by_case(found.sparkSession, frame):
        rows.write.mode("errorifexists").options(**CSV_OUTPUT).csv(folder)
        _list_parts(_parts(found.sparkSession, folder)).write.json(f"{folder}/{MANIFEST}")
    return folder


def read_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The reject rows of a written folder, as text, in no order; empty cells are empty text."""
    return _parts(spark, folder).na.fill("")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file with rejects: its name, how many it holds, its first and last row number."""
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{folder}/{MANIFEST}")


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.options(**CSV_OUTPUT, multiLine=True, nullValue=_NO_CELL).csv(folder)


def _list_parts(rejects: DataFrame) -> DataFrame:
    number = F.col(ROW_INDEX).cast("bigint")
    return rejects.groupBy(F.col("_metadata.file_name").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(number).alias("first_row"), F.max(number).alias("last_row")
    )


@contextmanager
def _names_by_case(spark: SparkSession, frame: TrackedFrame) -> Iterator[None]:
    """Let an output have columns whose names differ by case alone, where it has such."""
    before = spark.conf.get("spark.sql.caseSensitive")
    if len({name.lower() for name in frame.original}) < len(frame.original):
        spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def reject_report(frame: TrackedFrame) -> DataFrame:
    """Rejects per stage, column and check, counted without building any reject row.

    One aggregate over the frame, whose partial results are one number per finding.
    """
    counts = frame.unlocated().df.agg(F.count(F.lit(1)), *[F.count_if(_found(frame, f)).alias(f"n{i}") for i, f in enumerate(frame.findings)])
    per_finding = F.array(
        *[
            F.struct(*[F.lit(getattr(f, part)).alias(f"__{part}") for part in ("stage", "column", "check")], F.col(f"n{i}").alias("rejects"))
            for i, f in enumerate(frame.findings)
        ]
    ) if frame.findings else F.expr("cast(array() as array<struct<__stage:string,__column:string,__check:string,rejects:bigint>>)")
    found = counts.select(F.inline(per_finding)).where("rejects > 0")
    return found.groupBy("__stage", "__column", "__check").agg(F.sum("rejects").alias("rejects"))


def _found(frame: TrackedFrame, finding: Finding) -> Column:
    return finding.failed & ~frame.failed_before(finding)


def _value(frame: TrackedFrame, finding: Finding) -> Column:
    return plain_text(F.col(finding.slot), frame.df.schema[finding.slot].dataType)


def _label(frame: TrackedFrame, finding: Column, part: str) -> Column:
    return F.get(F.array(*[F.lit(getattr(f, part)) for f in frame.findings] or [F.lit("")]), finding)
