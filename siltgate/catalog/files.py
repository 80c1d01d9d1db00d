"""Delimited text: tables written out as files by Spark, then read back by the engine."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltgate.catalog.raw import ORDERS_RAW_SQL, orders_raw
from siltgate.catalog.registry import query, table
from siltgate.operators.profile import header_findings
from siltgate.operators.rejects import CSV_OUTPUT
from siltgate.operators.tracked import ROW_INDEX
from siltgate.session import scratch_path
from siltgate.sources.base import Source
from siltgate.sources.delimited import faulty_files, list_files, read_delimited, record_faults
from siltgate.sources.open import open_source
from siltgate.sources.tables import read_parquet

# Rows per written file: small enough for several files in a test, and bounded at any scale.
FILE_ROWS = 5_000


def written_csv(df: DataFrame, suffix: str = "", **options) -> str:
    folder = scratch_path(df.sparkSession, "csv") + suffix
    df.write.options(**{**CSV_OUTPUT, **options}).csv(folder)
    return folder


# One column written as it is, under a .csv name: no quoting, and a delimiter no line holds.
RAW_CSV = {**CSV_OUTPUT, "header": False, "sep": "\u0001", "quote": "", "escapeQuotes": False}


def written_lines(df: DataFrame, file: Column, place: Column, line: Column, *, as_csv: bool = False) -> str:
    """Text files of given lines: one folder per ``file`` value, lines ordered by ``place``."""
    folder = scratch_path(df.sparkSession, "lines")
    lines = df.select(file.alias("file"), place.alias("place"), line.alias("value"))
    ordered = lines.repartition("file").sortWithinPartitions("file", "place").drop("place")
    writer = ordered.write.partitionBy("file")
    writer.options(**RAW_CSV).csv(folder) if as_csv else writer.text(folder)
    return folder


def with_lines_above(df: DataFrame, key: str, line: Column, above: list[str]) -> tuple[DataFrame, Column, Column, Column]:
    """Rows cut into files of :data:`FILE_ROWS` keys, each led by the given lines."""
    file = F.lpad(F.floor(F.col(key) / FILE_ROWS).cast("string"), 12, "0")
    rows = df.select(file.alias("f"), F.col(key).cast("bigint").alias("p"), line.alias("l"))
    heads = rows.groupBy("f").agg(F.count(F.lit(1)).alias("n")).select(
        "f", F.posexplode(F.array(*map(F.lit, above))).alias("p", "l")
    ).select("f", (F.col("p") - len(above)).cast("bigint").alias("p"), "l")
    return rows.union(heads), F.col("f"), F.col("p"), F.col("l")


def numbered(source: Source) -> DataFrame:
    frame = source.tracked()
    return frame.numbering.number(frame.df).select(
        F.col(ROW_INDEX).alias("row_index"), *[frame.value(name).alias(name) for name in source.columns]
    )


@query(
    "csv_scan_lossless",
    f"WITH {ORDERS_RAW_SQL} SELECT order_id, cust, order_date, status, priority, price, active, small FROM raw",
)
def csv_scan_lossless(spark, sf_dir):
    """Every value comes back as the text it was: blanks, tabs and empty cells included."""
    raw = orders_raw(spark, sf_dir).drop("row_index").withColumnRenamed("Order ID", "order_id")
    return read_delimited(spark, written_csv(raw), encoding="utf-8", delimiter=",").rows()


@query(
    "csv_multi_line",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents",
)
def csv_multi_line(spark, sf_dir):
    """Whole document texts, line breaks and quotes within them, through quoted cells."""
    folder = written_csv(table(spark, sf_dir, "documents"), sep=";")
    return read_delimited(spark, folder, encoding="utf-8", delimiter=";").rows()


@query(
    "csv_row_index",
    """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS row_index,
         CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM lineitem""",
)
def csv_row_index(spark, sf_dir):
    """Row numbers over several files, in file order."""
    ordered = table(spark, sf_dir, "lineitem").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    folder = written_csv(ordered.select("l_orderkey", "l_linenumber"), maxRecordsPerFile=FILE_ROWS)
    return numbered(read_delimited(spark, folder, encoding="utf-8", delimiter=","))


@query("parquet_row_index", "SELECT o_orderkey + 1 AS row_index, o_orderkey, o_custkey FROM orders")
def parquet_row_index(spark, sf_dir):
    """The same numbers for Parquet, from the reader's own row positions."""
    return numbered(read_parquet(spark, f"{sf_dir}/orders.parquet")).select("row_index", "o_orderkey", "o_custkey")


@query(
    "csv_header_skip",
    "SELECT o_orderkey + 1 AS row_index, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders",
)
def csv_header_skip(spark, sf_dir):
    """Files with a title, an empty line and a note above the header."""
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    above = ["Orders export", "", '"a note, with a comma"', "o_orderkey,o_orderstatus,o_orderpriority"]
    folder = written_lines(*with_lines_above(table(spark, sf_dir, "orders"), "o_orderkey", line, above))
    source = read_delimited(
        spark, folder, encoding="utf-8", delimiter=",", skip_rows=2, header_row=2, files=list_files(spark, f"{folder}/*")
    )
    return numbered(source)


@query("csv_utf16_scan", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents")
def csv_utf16_scan(spark, sf_dir):
    """Whole document texts, line breaks within them, through files of 2-byte characters in either byte order."""
    documents, parts = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), []
    for order, charset in enumerate(("UTF-16LE", "UTF-16")):  # the second is written big-endian, with a mark
        folder = written_csv(documents.where(F.col("doc_id") % 2 == order), encoding=charset)
        parts.append(read_delimited(spark, folder, encoding="utf-16-le" if order == 0 else "utf-16", delimiter=",").rows())
    return parts[0].union(parts[1])


LATIN_TEXT = r"regexp_replace(text, '[^\x{1}-\x{ff}]', '?', 'g')"


@query("csv_latin1_scan", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {LATIN_TEXT} AS text FROM documents")
def csv_latin1_scan(spark, sf_dir):
    """Accented document texts through ISO-8859-1 bytes."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x01-\xff]", "?").alias("text"))
    folder = written_csv(documents, encoding="ISO-8859-1")
    return read_delimited(spark, folder, encoding="latin-1", delimiter=",").rows()


@query(
    "csv_record_width",
    """SELECT (SELECT count(*) FROM orders) AS records, (SELECT count(*) FROM orders WHERE o_orderkey % 41 = 0) AS too_long,
         (SELECT count(*) FROM orders WHERE o_orderkey % 41 <> 0 AND o_orderkey % 43 = 0) AS too_short""",
)
def csv_record_width(spark, sf_dir):
    """Records with more and with fewer fields than the header, told apart."""
    return record_faults(read_delimited(spark, _uneven_records(spark, sf_dir), encoding="utf-8", delimiter=","))


@query(
    "csv_short_records",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
         CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE o_orderpriority END AS o_orderpriority FROM orders""",
)
def csv_short_records(spark, sf_dir):
    """Missing trailing fields read as empty text."""
    return read_delimited(spark, _uneven_records(spark, sf_dir, over_long=False), encoding="utf-8", delimiter=",").rows()


@query(
    "csv_read_faults",
    f"""SELECT lpad(CAST(o_orderkey // {FILE_ROWS} AS VARCHAR), 12, '0') AS file, 'source.read_failed' AS code, count(*) AS records
        FROM orders WHERE o_orderkey % 41 = 0 GROUP BY ALL""",
)
def csv_read_faults(spark, sf_dir):
    """Files that no run may read, because records have more fields than the header."""
    found = faulty_files(read_delimited(spark, _uneven_records(spark, sf_dir), encoding="utf-8", delimiter=","))
    return found.select(F.regexp_extract("path", "file=([^/]+)/", 1).alias("file"), "code", "records")


def _uneven_records(spark: SparkSession, sf_dir: str, *, over_long: bool = True) -> str:
    key, fields = F.col("o_orderkey"), [F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"]
    line = (
        F.when(F.lit(over_long) & (key % 41 == 0), F.concat_ws(",", *fields, F.lit('"one, more"')))
        .when(key % 43 == 0, F.concat_ws(",", *fields[:2]))
        .otherwise(F.concat_ws(",", *fields))
    )
    orders = table(spark, sf_dir, "orders")
    return written_lines(*with_lines_above(orders, "o_orderkey", line, ["o_orderkey,o_orderstatus,o_orderpriority"])) + "/*"


@query(
    "csv_header_checks",
    """SELECT o_orderpriority AS file_group,
         CASE CAST(substring(o_orderpriority, 1, 1) AS INTEGER) WHEN 1 THEN 'source.empty_header'
           WHEN 2 THEN 'source.duplicate_header' WHEN 3 THEN 'source.empty_header' ELSE 'ok' END AS code,
         CASE CAST(substring(o_orderpriority, 1, 1) AS INTEGER) WHEN 1 THEN '[2, 3]' WHEN 2 THEN '[id, x]' ELSE '[]' END AS columns,
         count(*) AS records
       FROM orders GROUP BY o_orderpriority""",
)
def csv_header_checks(spark, sf_dir):
    """Headers of many files checked in one job: blank, repeated or absent names."""
    headers = {"1": ["id,,  "], "2": ["id,x,id,x"], "4": ["a,b,c"], "5": ["a,A,b"]}
    orders = table(spark, sf_dir, "orders")
    chunk = F.floor(F.col("o_orderkey") / (FILE_ROWS * 10)).cast("string")
    file = F.concat_ws("_", F.regexp_replace("o_orderpriority", "[^A-Za-z0-9-]", "."), F.lpad(chunk, 12, "0"))
    # The files of group 3 hold blank lines only.
    group = F.substring("o_orderpriority", 1, 1)
    line = F.when(group == "3", "").otherwise(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.lit("z")))
    rows = orders.select(file.alias("f"), F.col("o_orderkey").alias("p"), line.alias("l"), group.alias("g"), "o_orderpriority")
    head = F.create_map(*[F.lit(x) for pair in ((k, v[0]) for k, v in headers.items()) for x in pair])
    heads = rows.where("g <> '3'").groupBy("f", "g").agg(F.lit(-1).cast("bigint").alias("p")).select("f", "p", F.element_at(head, F.col("g")).alias("l"))
    folder = written_lines(rows.select("f", "p", "l").union(heads), F.col("f"), F.col("p"), F.col("l"))
    found = header_findings(spark, f"{folder}/*", delimiter=",")
    name = F.regexp_extract("path", r"file=([^/]+)_[0-9]{12}", 1)
    shown = F.when(F.size("columns") == 0, "[]").otherwise(F.concat(F.lit("["), F.concat_ws(", ", "columns"), F.lit("]")))
    per_group = found.select(name.alias("g"), F.coalesce("code", F.lit("ok")).alias("code"), shown.alias("columns")).distinct()
    counts = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("records"))
    return per_group.join(
        counts, per_group.g == F.regexp_replace("o_orderpriority", "[^A-Za-z0-9-]", ".")
    ).select(F.col("o_orderpriority").alias("file_group"), "code", "columns", "records")


@query(
    "source_formats",
    """SELECT f.kind, f.named, c.o_orderkey, c.o_totalprice FROM (VALUES ('csv', 'suffix'), ('parquet', 'suffix'), ('csv', 'format'), ('parquet', 'format')) f(kind, named),
         (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS o_totalprice FROM orders) c""",
)
def source_formats(spark, sf_dir):
    """One table as text and as Parquet, opened by the suffix of its path and by a declared format."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"))
    opened = []
    for kind in ("csv", "parquet"):
        for named, suffix, declared in (("suffix", f".{kind.upper()}", None), ("format", ".data", kind)):
            folder = written_csv(rows, suffix) if kind == "csv" else scratch_path(spark, "parquet") + suffix
            if kind == "parquet":
                rows.write.parquet(folder)
            section = {"path": folder, "format": declared, "encoding": "utf-8", "delimiter": ","}
            texts = [F.col(name).cast("string").alias(name) for name in rows.columns]
            opened.append(open_source(spark, section).rows().select(F.lit(kind).alias("kind"), F.lit(named).alias("named"), *texts))
    return functools.reduce(DataFrame.union, opened)
