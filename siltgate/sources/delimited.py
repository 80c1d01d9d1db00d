"""Delimited text, read losslessly: every value a string, an empty cell an empty string."""

from __future__ import annotations

import codecs
import csv
import io
import itertools
import re
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siltgate.errors import fail
from siltgate.operators.tracked import ColumnNumbering, ROW_INDEX
from siltgate.session import pin_file_splits
from siltgate.sources.base import Source, slots
from siltgate.sources.files import literal, readable
from siltgate.sources.encodings import REPLACEMENT, Encoding, resolve
from siltgate.sources.position import FILE, POSITION, SEQ, START, FileOrderNumbering, position_columns
from siltgate.sources.records import QUOTED_CELL, raw_lines, records_span_lines, spanning_records, split_quotes
from siltgate.sources.wide import wide_lines

CORRUPT = "__corrupt"
BAD_BYTES = "__bad"


def read_delimited(
    spark: SparkSession,
    path: str,
    *,
    encoding: str | None,
    delimiter: str | None,
    header_row: int = 1,
    skip_rows: int = 0,
    multi_line: bool | None = None,
    files: list[str] | None = None,
) -> Source:
    """A file, or a folder of files that share one header.

    Only the first file's head is read beforehand; the scan itself checks the other headers.
    """
    missing = [key for key, value in (("encoding", encoding), ("delimiter", delimiter)) if not value]
    if missing:
        raise fail("source.csv_settings_required", "A CSV source needs an encoding and a delimiter.", path=path, missing=missing)
    if len(delimiter) != 1:
        raise fail("source.invalid_delimiter", "A delimiter is exactly one character.", path=path)
    check_row_options(header_row, skip_rows)
    pin_file_splits(spark)
    files = [literal(file) for file in files or list_files(spark, path)]
    resolved = resolve(encoding, path)

    lines = raw_lines(spark, files) if resolved.by_line else wide_lines(spark, files, resolved)
    quotes = None
    if multi_line is not False or not resolved.by_line:
        quotes = split_quotes(lines, delimiter)
    spans_lines = quotes is not None and records_span_lines(quotes, path)

    above = skip_rows + header_row
    head = read_head(spark, files[0], resolved, delimiter, above, one_line=multi_line is False)
    header = check_header(head, above, path)
    # Spark never counts empty lines as records.
    skipped = sum(1 for record in head if _counts(record))
    plain_header = above == 1 and skipped == 1
    if multi_line is None:
        multi_line = spans_lines
    names = slots(len(header))
    # With one plain header per file, Spark itself can compare each file's header with the
    # names; where it cannot, the record reader does.
    comparable = not resolved.mapped_from and len({name.lower() for name in header}) == len(header)
    by_records = not resolved.by_line or multi_line or (plain_header and len(files) > 1 and not comparable)
    options = {
        "sep": delimiter,
        "quote": '"',
        "escape": '"',
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "multiLine": multi_line or by_records,
        "maxColumns": max(20480, len(header) + 2),
    }
    if by_records:
        if quotes is None:
            quotes = split_quotes(lines, delimiter)
            records_span_lines(quotes, path)
        rows, numbering = _record_rows(lines, quotes, resolved, header, skipped, options)
        bare = None
    else:
        rows, bare, numbering = _line_rows(spark, files, resolved, header, skipped, plain_header, options)
    # Spark refuses a query on the corrupt record alone, so the test also reads a first cell.
    malformed = F.col(CORRUPT).isNotNull() & (F.char_length(F.coalesce(F.col(names[0]), F.lit(""))) >= 0)
    decode = (lambda column: column) if by_records else resolved.decode
    too_long = malformed & (record_width(decode(F.col(CORRUPT)), delimiter) > len(header))
    too_short = malformed & ~too_long
    cells = [F.coalesce(decode(F.col(name)), F.lit("")).alias(name) for name in names]
    faults = {"source.read_failed": F.col("__too_long")}
    checked = [too_long.alias("__too_long"), too_short.alias("__too_short")]
    if resolved.checks_bytes:
        # Lines of wide characters come as UTF-8 that is invalid where the bytes were.
        suspicious = [F.contains(decode(F.col(name)), F.lit(REPLACEMENT)) for name in names if resolved.by_line]
        bad = F.col(BAD_BYTES) if by_records else F.lit(False)
        checked.append(F.coalesce(F.greatest(bad, *suspicious, F.lit(False)), F.lit(False)).alias("__bad_bytes"))
        faults["source.bad_bytes"] = F.col("__bad_bytes")
    frame = rows.select(*cells, *POSITION, *checked)
    above_is_header = skipped == 1 and (by_records or plain_header)
    if not above_is_header:
        numbered = numbering.number(frame, "__place")
        kept = _without_header(F.col("__place") == skipped - 1, names, header).otherwise(F.col(ROW_INDEX).isNotNull())
        frame = numbered.where(kept).drop("__place").withColumnRenamed(ROW_INDEX, "__n")
    return Source(
        df=frame,
        bare=bare.select(*cells, *checked) if bare is not None and above_is_header else None,
        columns=header,
        numbering=numbering if above_is_header else ColumnNumbering("__n"),
        file_type="csv",
        path=path,
        encoding=encoding,
        delimiter=delimiter,
        faults=faults,
    )


def _line_rows(
    spark: SparkSession,
    files: list[str],
    encoding: Encoding,
    header: list[str],
    skipped: int,
    plain_header: bool,
    options: dict,
) -> tuple[DataFrame, DataFrame, FileOrderNumbering]:
    """Rows of Spark's own reader, with and without positions; in splits."""
    compare_headers = plain_header and len(files) > 1

    def scan(*, prune: bool, locate: bool) -> DataFrame:
        columns = [*(header if compare_headers else slots(len(header))), *([] if prune else [CORRUPT])]
        reader = spark.read.schema(_text_schema(columns)).options(
            **options, encoding=encoding.charset, header=plain_header, enforceSchema=not compare_headers, columnPruning=prune
        )
        df = reader.csv(files)
        named = [F.col(_quoted(name)).alias(slot) for name, slot in zip(columns, [*slots(len(header)), CORRUPT])]
        return df.select(*named, *(position_columns() if locate else []))

    counted = scan(prune=True, locate=True).select(*POSITION)
    numbering = FileOrderNumbering(counted, 0 if plain_header else skipped)
    return scan(prune=False, locate=True), scan(prune=False, locate=False), numbering


def _record_rows(
    lines: DataFrame,
    quotes: DataFrame,
    encoding: Encoding,
    header: list[str],
    skipped: int,
    options: dict,
) -> tuple[DataFrame, FileOrderNumbering]:
    """Rows of records that may span lines, assembled in parallel, then split by Spark."""
    records = spanning_records(lines, quotes)
    raw = F.col("record")
    text = F.decode(raw, encoding.charset) if encoding.charset == "ISO-8859-1" else raw.cast("string")
    bad = ~F.is_valid_utf8(raw.cast("string")) if encoding.charset == "UTF-8" or not encoding.by_line else F.lit(False)
    if encoding.charset == "US-ASCII":
        bad = raw.cast("string").rlike(r"[^\x00-\x7f]")
    names = [*slots(len(header)), CORRUPT]
    cells = F.from_csv(F.regexp_replace(encoding.decode(text), "\r$", ""), ", ".join(f"{name} string" for name in names), options)
    rows = records.select(*POSITION, bad.alias(BAD_BYTES), cells.alias("cells")).select(*POSITION, BAD_BYTES, "cells.*")
    numbering = FileOrderNumbering(records.select(*POSITION), skipped)
    if skipped == 1:
        is_header = (F.col(START) == 0) & (F.col(SEQ) == 0)
        rows = rows.where(_without_header(is_header, names[:-1], header).otherwise(True))
    return rows, numbering


def _without_header(is_header: Column, names: list[str], header: list[str]) -> Column:
    """False for a file's header record; the job fails where it is not the expected header."""
    same = F.array(*map(F.col, names)) == F.array(*map(F.lit, header))
    differs = F.raise_error(F.lit("Files of one source must share one header.")).cast("boolean")
    return F.when(is_header, F.when(F.coalesce(same, F.lit(False)), False).otherwise(differs))


def _text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def check_row_options(header_row: int, skip_rows: int) -> None:
    if header_row < 1:
        raise fail("source.invalid_header_row", "header_row starts at 1.", header_row=header_row)
    if skip_rows < 0:
        raise fail("source.invalid_skip_rows", "skip_rows cannot be negative.", skip_rows=skip_rows)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The data files of one source, in path order, or an error if there is none."""
    listed = spark.read.format("binaryFile").load(readable(spark, path)).select("path")
    files = sorted(unquote(file) for file in listed.inputFiles())
    if not files:
        raise fail("source.empty", "The source has no files.", path=path)
    return files


def read_head(
    spark: SparkSession, file: str, encoding: Encoding, delimiter: str, records: int, *, one_line: bool = False
) -> list[list[str]]:
    """The first records of one file. Reads as much text as these records span, no more."""
    if not encoding.by_line:
        return _wide_head(spark, file, encoding, delimiter, records)
    wanted = records
    while True:
        lines = spark.read.text(file).select(F.col("value").cast("binary")).limit(wanted).collect()
        text = _decoded(b"\n".join(bytes(line[0]) for line in lines), encoding, file)
        head = list(itertools.islice(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), records))
        # An odd number of quotes means the last record goes on in further lines.
        if one_line or len(lines) < wanted or (len(head) >= records and text.count('"') % 2 == 0):
            return head
        wanted *= 2


def _wide_head(spark: SparkSession, file: str, encoding: Encoding, delimiter: str, records: int) -> list[list[str]]:
    """The first records of a file of 2- or 4-byte characters, from its first pieces between LF bytes."""
    wanted = 2 * records + 2
    while True:
        pieces = spark.read.option("lineSep", "\n").text(file).select(F.col("value").cast("binary")).limit(wanted).collect()
        whole = len(pieces) < wanted
        try:
            # a file's last LF byte may be missing from its pieces; no character needs it
            text = codecs.getincrementaldecoder(encoding.codec)().decode(b"\n".join(bytes(piece[0]) for piece in pieces))
        except UnicodeError:
            raise _undecodable(encoding, file) from None
        head = list(itertools.islice(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), records + 1))
        # A record is known to be whole once another one follows it.
        if whole or len(head) > records:
            return head[:records]
        wanted *= 2


def check_header(head: list[list[str]], position: int, path: str) -> list[str]:
    """The header record, refused when it is absent, blank somewhere or repeats a name."""
    if len(head) < position:
        raise fail("source.empty", "The source has no readable header.", path=path)
    header = head[position - 1]
    blank = [place for place, name in enumerate(header, start=1) if not name.strip()]
    if blank or not header:
        raise fail("source.empty_header", "A header cell is empty.", path=path, columns=blank)
    repeated = [name for name in dict.fromkeys(header) if header.count(name) > 1]
    if repeated:
        raise fail("source.duplicate_header", "The header repeats a column name.", path=path, columns=repeated)
    return header


def record_width(record: Column, delimiter: str) -> Column:
    """Number of fields of one raw record; delimiters within quotes do not count."""
    sep = re.escape(delimiter)
    bare = F.regexp_replace(record, f"(?<=^|{sep}){QUOTED_CELL}", "")
    return F.char_length(bare) - F.char_length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _counts(record: list[str]) -> bool:
    return len(record) > 1 or bool(record and record[0].strip())


def _decoded(raw: bytes, encoding: Encoding, path: str) -> str:
    try:
        return raw.decode(encoding.codec)
    except UnicodeError:
        raise _undecodable(encoding, path) from None


def _undecodable(encoding: Encoding, path: str) -> Exception:
    return fail("source.encoding_failed", f"The source cannot be read as {encoding.name}.", path=path)


def record_faults(source: Source) -> DataFrame:
    """One row: records, and those with more and with fewer fields than the header."""
    return source.df.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("__too_long").alias("too_long"),
        F.count_if("__too_short").alias("too_short"),
    )


def has_bad_bytes(spark: SparkSession, path: str, encoding_name: str) -> bool:
    """Whether U+FFFD seen in the data stands for bytes the encoding does not have.

    Only run after such a character was seen, because a file may also hold it rightfully.
    """
    encoding = resolve(encoding_name, path)
    if encoding.charset != "UTF-8":
        return True
    return not spark.read.text([literal(file) for file in list_files(spark, path)]).where(~F.is_valid_utf8("value")).isEmpty()


def fault_counts(source: Source) -> list[Column]:
    """Records with each fault of the scan, as aggregates under the fault's code."""
    return [F.count_if(broken).alias(code) for code, broken in source.faults.items()]


def refuse_faults(spark: SparkSession, source: Source, counts: Mapping[str, int]) -> None:
    """Fail when the counted faults make the source unreadable."""
    if counts.get("source.read_failed"):
        raise fail("source.read_failed", "Records have more fields than the header.", path=source.path, records=counts["source.read_failed"])
    if counts.get("source.bad_bytes") and has_bad_bytes(spark, source.path, source.encoding):
        raise fail("source.read_failed", f"The source has bytes that {source.encoding} does not know.", path=source.path, records=counts["source.bad_bytes"])


def faulty_files(source: Source) -> DataFrame:
    """(path, code, records) of files that hold records with more fields than the header."""
    broken = source.df.where(source.faults["source.read_failed"]).groupBy(F.col(FILE).alias("path"))
    return broken.agg(F.count(F.lit(1)).alias("records")).select("path", F.lit("source.read_failed").alias("code"), "records")
