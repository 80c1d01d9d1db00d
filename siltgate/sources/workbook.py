"""Workbooks as a Spark job: one workbook per task, its rows as arrays, typed natively."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltgate.errors import fail
from siltgate.session import scratch_table
from siltgate.sources.base import Source, slots
from siltgate.sources.delimited import check_header, check_row_options
from siltgate.sources.files import readable
from siltgate.sources.position import FILE, SEQ, START, FileOrderNumbering
from siltgate.sources.xlsx_cells import Workbook

ROWS = "path string, position int, sheet string, row_no bigint, first_col int, kinds array<string>, texts array<string>, fault string"
SHEETS = "path string, position int, sheet string, fault string"
_BATCH = 2000


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """Workbooks below a path as (path, content)."""
    return spark.read.format("binaryFile").load(readable(spark, path)).select("path", "content")


def list_sheets(spark: SparkSession, path: str) -> list[str]:
    """Sheet names of one workbook, in order."""
    if not path.lower().endswith(".xlsx"):
        raise fail("source.unsupported_type", "Only workbooks have sheets.", path=path)
    listed = workbook_sheets(workbook_files(spark, path)).orderBy("position").collect()
    _raise_fault(listed[0].fault if listed else "source.empty", path)
    return [row.sheet for row in listed]


def _raise_fault(fault: str | None, path: str) -> None:
    if fault == "source.empty":
        raise fail("source.empty", "The workbook has no sheets.", path=path)
    if fault:
        raise fail("source.read_failed", "The workbook cannot be read.", path=path, reason=fault)


def workbook_rows(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """Every row of every sheet, or of the named sheets, of (path, content) workbooks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in _workbooks(batches):
            yield from _batched(_rows_of(path, content, sheet), _ROW_SCHEMA)

    return files.select("path", "content").mapInArrow(read, ROWS)


def workbook_sheets(files: DataFrame) -> DataFrame:
    """Sheet names in workbook order, without reading any sheet."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in _workbooks(batches):
            yield from _batched(_sheets_of(path, content), _SHEET_SCHEMA)

    return files.select("path", "content").mapInArrow(read, SHEETS)


def _workbooks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.column(0)[row].as_py(), batch.column(1)[row].as_py()


def _sheets_of(path: str, content: bytes) -> Iterator[tuple]:
    try:
        names = [name for name, _ in Workbook(io.BytesIO(content)).sheets]
    except Exception as error:  # a broken workbook is a finding, not a failed job
        yield path, None, None, f"{type(error).__name__}: {error}"
        return
    if not names:
        yield path, None, None, "source.empty"
    yield from ((path, place, name, None) for place, name in enumerate(names, start=1))


def _rows_of(path: str, content: bytes, sheet: str | None) -> Iterator[tuple]:
    try:
        book = Workbook(io.BytesIO(content))
        for place, (name, part) in enumerate(book.sheets, start=1):
            if sheet in (None, name):
                for number, cells in book.rows(part):
                    first = next((i for i, (kind, _) in enumerate(cells, start=1) if kind != "empty"), None)
                    yield path, place, name, number, first, [k for k, _ in cells], [t for _, t in cells], None
    except Exception as error:
        yield path, None, None, None, None, None, None, f"{type(error).__name__}: {error}"


_SHEET_SCHEMA = pa.schema([("path", pa.string()), ("position", pa.int32()), ("sheet", pa.string()), ("fault", pa.string())])
_ROW_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("position", pa.int32()),
        ("sheet", pa.string()),
        ("row_no", pa.int64()),
        ("first_col", pa.int32()),
        ("kinds", pa.list_(pa.string())),
        ("texts", pa.list_(pa.string())),
        ("fault", pa.string()),
    ]
)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pending: list[tuple] = []
    for row in rows:
        pending.append(row)
        if len(pending) == _BATCH:
            yield _batch(pending, schema)
            pending = []
    if pending:
        yield _batch(pending, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def sheet_extents(rows: DataFrame, *keys: str) -> DataFrame:
    """Per sheet: the first and last row and column that hold a value."""
    return rows.groupBy(*keys).agg(
        F.min("row_no").alias("top"), F.min("first_col").alias("left"), F.max(F.size("kinds")).alias("right")
    )


def column_type(kinds: Column) -> Column:
    """Spark type of a column from the set of its cell kinds. Mixed kinds are text."""
    def only(*allowed: str) -> Column:
        return (F.size(kinds) > 0) & (F.size(F.array_except(kinds, F.array(*[F.lit(kind) for kind in allowed]))) == 0)

    return (
        F.when(only("number"), "double")
        .when(only("bool"), "boolean")
        .when(only("date"), "date")
        .when(only("date", "datetime"), "timestamp_ntz")
        .otherwise("string")
    )


def read_workbook(
    spark: SparkSession,
    path: str,
    *,
    sheet: str | None = None,
    header_row: int = 1,
    skip_rows: int = 0,
    files: DataFrame | None = None,
) -> Source:
    """One sheet of a workbook, or of each workbook of a folder, as a table.

    Workbooks are parsed once, in Python, into rows of a scratch table; extents, headers, column
    types and values then come from that table.
    """
    check_row_options(header_row, skip_rows)
    if files is None:
        files = workbook_files(spark, path)
    names = _check_sheets(files, sheet, path)
    chosen = sheet or names[0]

    parsed = scratch_table(workbook_rows(files, sheet), "workbook")
    fault = parsed.where(F.col("fault").isNotNull()).select("fault").first()
    if fault:
        raise fail("source.read_failed", "A workbook cannot be read.", path=path, reason=fault[0])
    above = skip_rows + header_row
    placed = parsed.join(sheet_extents(parsed, "path"), "path").withColumn("place", F.col("row_no") - F.col("top") - (above - 1))
    dense = placed.select(
        "path", "place", *[_window_of(F.col(column), filler).alias(column) for column, filler in (("kinds", "empty"), ("texts", ""))]
    )
    heads = dense.where(F.col("place") == 0).select("texts").distinct().limit(2).collect()
    if not heads:
        raise fail("source.empty", "The source has no readable header.", path=path)
    header = check_header([head.texts for head in heads], 1, path)
    if len(heads) > 1:
        raise fail("source.read_failed", "Workbooks of one source must share one header.", path=path, header=header)

    body, names_of = dense.where(F.col("place") > 0), slots(len(header))
    kinds = body.agg(
        *[F.array_sort(F.collect_set(F.coalesce(F.get("kinds", i), F.lit("empty")))).alias(slot) for i, slot in enumerate(names_of)]
    )
    types = kinds.select(*[column_type(F.col(slot)).alias(slot) for slot in names_of]).first()
    cells = [F.coalesce(F.get("texts", i), F.lit("")).cast(types[slot]).alias(slot) for i, slot in enumerate(names_of)]
    position = [F.col("path").alias(FILE), F.lit(0).cast("bigint").alias(START), F.col("place").alias(SEQ)]
    return Source(
        df=body.select(*cells, *position),
        columns=header,
        numbering=FileOrderNumbering(body.select(*position)),
        file_type="xlsx",
        path=path,
        sheet=chosen,
        sheets=names,
    )


def _check_sheets(files: DataFrame, sheet: str | None, path: str) -> list[str]:
    """Sheet names of the first workbook, once every workbook is known to have the wanted one."""
    listed = workbook_sheets(files)
    per_book = listed.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("position", "sheet"))).alias("sheets"), F.max("fault").alias("fault")
    )
    wanted = F.exists("sheets", lambda s: s["sheet"] == sheet) if sheet is not None else F.size("sheets") == 1
    worst = per_book.orderBy(F.col("fault").isNull(), wanted, "path").first()
    if worst is None:
        raise fail("source.not_found", "The source path has no workbook.", path=path)
    names = [s["sheet"] for s in worst.sheets]
    _raise_fault(worst.fault, worst.path)
    if sheet is None and len(names) > 1:
        raise fail("source.sheet_required", "The workbook has several sheets; name one.", path=worst.path, sheets=names)
    if sheet is not None and sheet not in names:
        raise fail("source.sheet_not_found", f"The workbook has no sheet `{sheet}`.", path=worst.path, sheet=sheet, sheets=names)
    return names


def _window_of(cells: Column, filler: str) -> Column:
    """The cells of the sheet's own columns, filled up to its full width."""
    width = F.col("right") - F.col("left") + 1
    inner = F.slice(cells, F.col("left"), F.greatest(F.size(cells) - F.col("left") + 1, F.lit(0)))
    return F.concat(inner, F.array_repeat(F.lit(filler), width - F.size(inner)))
