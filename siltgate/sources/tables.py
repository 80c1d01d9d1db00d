"""Columnar sources: Parquet files, catalog tables and DataFrames at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltgate.operators.tracked import ColumnNumbering
from siltgate.sources.base import Source, slots
from siltgate.sources.files import readable
from siltgate.sources.position import POSITION, FileOrderNumbering, position_columns


def read_parquet(spark: SparkSession, path: str) -> Source:
    """Row numbers come from the reader's own row positions plus the rows of earlier files."""
    pattern = readable(spark, path)
    df = spark.read.parquet(pattern)
    position = position_columns(row_in_file=F.col("_metadata.row_index"))
    renamed = [df[f"`{name}`"].alias(slot) for name, slot in zip(df.columns, slots(len(df.columns)))]
    return Source(
        df=df.select(*renamed, *position),
        bare=spark.read.schema(df.schema).parquet(pattern).toDF(*slots(len(df.columns))),
        columns=df.columns,
        numbering=FileOrderNumbering(df.select(*position).select(*POSITION)),
        file_type="parquet",
        path=path,
    )


def from_dataframe(df: DataFrame, *, row_index: str, name: str = "dataframe") -> Source:
    """A DataFrame whose 1-based row numbers are in ``row_index`` (not one of its data columns)."""
    columns = [column for column in df.columns if column != row_index]
    renamed = [df[f"`{column}`"].alias(slot) for column, slot in zip(columns, slots(len(columns)))]
    return Source(
        df=df.select(*renamed, df[f"`{row_index}`"].alias("__n")),
        columns=columns,
        numbering=ColumnNumbering("__n"),
        file_type="dataframe",
        path=name,
    )
