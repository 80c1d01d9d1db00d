"""Format dispatch: which reader a recipe's source section asks for."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

from siltgate.errors import fail
from siltgate.sources.base import Source
from siltgate.sources.delimited import read_delimited
from siltgate.sources.tables import read_parquet
from siltgate.sources.workbook import read_workbook

# File suffixes and the format each stands for.
SUFFIX_FORMATS = {".csv": "csv", ".xlsx": "xlsx", ".parquet": "parquet"}


def source_format(path: str, declared: str | None = None) -> str:
    """The declared format, or the one the lower-cased suffix names."""
    if declared in SUFFIX_FORMATS.values():
        return declared
    base = path.rstrip("/").rpartition("/")[2].lower()
    suffix = base[base.rindex(".") :] if "." in base else ""
    if declared is not None or suffix not in SUFFIX_FORMATS:
        raise fail("source.unsupported_type", "The source is neither delimited text, a workbook nor Parquet.", path=path, suffix=suffix)
    return SUFFIX_FORMATS[suffix]


def open_source(spark: SparkSession, section: Mapping[str, Any]) -> Source:
    path, kind = section["path"], source_format(section["path"], section.get("format"))
    rows = {"header_row": section.get("header_row", 1), "skip_rows": section.get("skip_rows", 0)}
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind == "xlsx":
        return read_workbook(spark, path, sheet=section.get("sheet"), **rows)
    return read_delimited(
        spark,
        path,
        encoding=section.get("encoding"),
        delimiter=section.get("delimiter"),
        multi_line=section.get("multi_line"),
        **rows,
    )
