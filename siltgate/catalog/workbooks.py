"""Workbooks: built in tasks from the customer table, read back by the engine."""

from __future__ import annotations

import html
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltgate.catalog.registry import query, table
from siltgate.operators.profile import described_sheets, preview_rows
from siltgate.operators.tracked import ROW_INDEX
from siltgate.session import scratch_table
from siltgate.sources.base import Source
from siltgate.sources.workbook import read_workbook, workbook_rows, workbook_sheets

# Customers per workbook: a workbook holds a bounded number of rows whatever the data.
BOOK_ROWS = 250

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def workbook_bytes(sheets: dict[str, list[list[object]]]) -> bytes:
    """A minimal workbook. Floats become numbers, bools booleans; a pair is (serial day, style)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        names = "".join(
            f'<sheet name="{html.escape(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, start=1)
        )
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        archive.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{names}</sheets></workbook>')
        archive.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}">{links}</Relationships>')
        styles = '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="22"/></cellXfs>'
        archive.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}">{styles}</styleSheet>')
        for i, rows in enumerate(sheets.values(), start=1):
            body = "".join(f'<row r="{n}">{"".join(map(_cell, row))}</row>' for n, row in enumerate(rows, start=1))
            archive.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, tuple):
        return f'<c s="{value[1]}"><v>{value[0]}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{html.escape(str(value))}</t></is></c>'


def customer_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): one workbook per :data:`BOOK_ROWS` customers, with two sheets."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c_custkey")
        book = {
            "Customers": [["Cust Key", "Name", "Segment", "Balance", "Debtor", "Since", "Seen"]]
            + [
                [int(r.c_custkey), r.c_name, r.c_mktsegment, float(r.c_acctbal), bool(r.c_acctbal < 0),
                 (30000 + int(r.c_custkey) % 10000, 1), (40000 + int(r.c_custkey) % 1000 + 0.25, 2)]
                for r in rows.itertuples()
            ],
            "Notes": [["Name", "Note"]] + [[r.c_name, None if r.c_custkey % 2 else f" nation {r.c_nationkey}"] for r in rows.itertuples()],
        }
        return pd.DataFrame({"path": [f"book_{int(rows.book.iloc[0]):09d}.xlsx"], "content": [workbook_bytes(book)]})

    customers = table(spark, sf_dir, "customer").withColumn("book", F.floor(F.col("c_custkey") / BOOK_ROWS))
    return customers.groupBy("book").applyInPandas(build, "path string, content binary")


def customers(spark: SparkSession, sf_dir: str) -> Source:
    return read_workbook(spark, "customers", sheet="Customers", files=scratch_table(customer_books(spark, sf_dir), "books"))


SINCE = "DATE '1899-12-30' + CAST(30000 + c_custkey % 10000 AS INTEGER)"
SEEN = "CAST(DATE '1899-12-30' + CAST(40000 + c_custkey % 1000 AS INTEGER) AS TIMESTAMP) + INTERVAL 6 HOUR"


@query(
    "workbook_scan",
    f"""SELECT row_number() OVER (ORDER BY c_custkey) AS row_index, CAST(c_custkey AS DOUBLE) AS cust_key, c_name AS name,
          c_mktsegment AS segment, c_acctbal AS balance, c_acctbal < 0 AS debtor, CAST({SINCE} AS DATE) AS since, {SEEN} AS seen
        FROM customer""",
)
def workbook_scan(spark, sf_dir):
    """One sheet of every workbook as one table, numbered, each column of its cells' type."""
    source = customers(spark, sf_dir)
    frame = source.tracked()
    names = ["cust_key", "name", "segment", "balance", "debtor", "since", "seen"]
    return frame.numbering.number(frame.df).select(
        F.col(ROW_INDEX).alias("row_index"), *[frame.value(old).alias(new) for old, new in zip(source.columns, names)]
    )


@query("workbook_mixed_column", "SELECT c_name AS \"Name\", CASE WHEN c_custkey % 2 = 1 THEN '' ELSE ' nation ' || c_nationkey END AS \"Note\" FROM customer")
def workbook_mixed_column(spark, sf_dir):
    """Cells left empty make a column text, and read as empty text."""
    books = scratch_table(customer_books(spark, sf_dir), "books")
    return read_workbook(spark, "customers", sheet="Notes", files=books).rows()


@query(
    "workbook_preview",
    f"""SELECT c_custkey + 1 AS row_index, c_name AS name, strftime({SINCE}, '%Y-%m-%d') AS since,
          strftime({SEEN}, '%Y-%m-%dT%H:%M:%S') AS seen FROM customer ORDER BY c_custkey LIMIT 5""",
)
def workbook_preview(spark, sf_dir):
    """The first five rows, dates and times as ISO text."""
    shown = preview_rows(customers(spark, sf_dir))
    return shown.select(F.col(ROW_INDEX).alias("row_index"), F.col("Name").alias("name"), F.col("Since").alias("since"), F.col("Seen").alias("seen"))


@query(
    "workbook_sheets",
    f"""SELECT 'book_' || lpad(CAST(b AS VARCHAR), 9, '0') || '.xlsx' AS path, position, sheet
        FROM (SELECT DISTINCT c_custkey // {BOOK_ROWS} AS b FROM customer), (VALUES (1, 'Customers'), (2, 'Notes')) s(position, sheet)""",
)
def sheets(spark, sf_dir):
    return workbook_sheets(customer_books(spark, sf_dir)).drop("fault")


@query(
    "workbook_profile",
    f"""WITH books AS (SELECT 'book_' || lpad(CAST(c_custkey // {BOOK_ROWS} AS VARCHAR), 9, '0') || '.xlsx' AS path, * FROM customer)
        SELECT path, 'Customers' AS sheet, 'DOUBLE, VARCHAR(' || max(length(c_name)) || '), VARCHAR(' || max(length(c_mktsegment))
               || '), DOUBLE, BOOLEAN, DATE, DATETIME' AS types FROM books GROUP BY path
        UNION ALL SELECT path, 'Notes', 'VARCHAR(' || max(length(c_name)) || '), VARCHAR('
               || greatest(1, max(CASE WHEN c_custkey % 2 = 1 THEN 0 ELSE length(' nation ' || c_nationkey) END)) || ')' FROM books GROUP BY path""",
)
def workbook_profile(spark, sf_dir):
    """Proposed types of every sheet of every workbook, in one job."""
    books = scratch_table(customer_books(spark, sf_dir), "books")
    described = described_sheets(workbook_sheets(books), scratch_table(workbook_rows(books), "sheet_rows"))
    return described.select(F.col("source_path").alias("path"), "sheet", F.concat_ws(", ", "types").alias("types"))
