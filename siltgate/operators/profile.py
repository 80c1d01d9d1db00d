"""Profiling of files: what they are, how they are written, and the schema they suggest.

Everything per file is one row of a DataFrame, so a folder of any number of files takes a
fixed number of jobs. Only small facts about files reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from siltgate.errors import ResultCode, fail
from siltgate.functions.text import iso_timestamp
from siltgate.functions.naming import (
    distinct_names_column,
    numbered_column,
    recipe_name,
    recipe_name_column,
    safe_name_column,
    safe_names,
)
from siltgate.operators.tracked import ROW_INDEX
from siltgate.plans.recipe import Recipe, resolve_settings
from siltgate.session import pin_file_splits, scratch_table
from siltgate.sources.base import Source, slots
from siltgate.sources.delimited import fault_counts, refuse_faults
from siltgate.sources.files import decoded_path, folder_scan, listed_files, readable, root_path
from siltgate.sources.open import open_source, source_format
from siltgate.sources.position import FILE, RANGE, SEQ, START, position_columns, ranged, running_before
from siltgate.sources.records import QUOTED_CELL, literal_quote, quote_count, spanning_records
from siltgate.sources.workbook import column_type, sheet_extents, workbook_files, workbook_rows, workbook_sheets

# Delimiters looked for, in order of preference, and rows of a preview.
DELIMITERS = (",", "\t", ";", "|")
ANY_DELIMITER = r"[,\t;|]"
PREVIEW_ROWS = 5
# Share of lines that must hold equally many delimiters.
CONSISTENT_SHARE = 0.9
# The longest text proposed as VARCHAR, and the length proposed without data.
VARCHAR_LIMIT = 255

# Patterns of the names that a folder profile takes, in any case.
TEXT_NAMES = "*.[cC][sS][vV]"
WORKBOOK_NAMES = "*.[xX][lL][sS][xX]"


def discover_files(spark: SparkSession, directory: str, *, recursive: bool = False, own_folder: str | None = None) -> DataFrame:
    """Supported files below a directory: path, URI, size, kind and stem. Reads no content."""
    both = f"{{{TEXT_NAMES},{WORKBOOK_NAMES}}}"
    scan = folder_scan(spark, directory, "binaryFile", both, recursive=recursive, own_folder=own_folder)
    # A scan has no rows for empty files, so the files come from the listing itself.
    sizes = scan.select(F.col("_metadata.file_path").alias("file"), "length")
    files = listed_files(scan).join(sizes, "file", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    files = files.withColumn("path", decoded_path(F.col("file")))
    if not recursive:
        files = files.where(F.regexp_replace("path", "/[^/]*$", "") == root_path(spark, directory))
    if own_folder:
        files = files.where(~F.contains("path", F.lit(f"/{own_folder.strip('/')}/")))
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return files.select("path", "file", "length", kind.alias("kind"), file_stem(F.col("path")).alias("file_stem"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", "")


def check_scope(directory: str, project: str) -> None:
    """A scanned directory lies inside the project."""
    inside = f"{directory.rstrip('/')}/".startswith(f"{project.rstrip('/')}/") and ".." not in directory.split("/")
    if not inside:
        raise fail("scan.directory_out_of_scope", "The directory lies outside the project.", path=directory, project=project)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as raw bytes, with their positions. Lines end at LF alone."""
    pin_file_splits(spark)
    return located_lines(spark.read.option("lineSep", "\n").text(readable(spark, path)))


def located_lines(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.col("_metadata.file_size").alias("size"), *position_columns())


def line_histogram(lines: DataFrame) -> DataFrame:
    """Everything later steps ask of raw lines, from one pass, combined map-side.

    One row per file, split and numbers of delimiters outside quotes, with the lines of this
    kind, the bytes they take and what was seen in them. Delimiters and quotes are ASCII, so
    they are counted before the encoding is known. Blank lines count as no lines.
    """
    value = F.col("value")
    kinds = lines.groupBy(F.col(FILE).alias("path"), START, *_delimiter_counts(value), _filled(value).alias("filled"))
    return kinds.agg(
        F.count(F.lit(1)).alias("lines"),
        F.first("size").alias("size"),
        F.sum(F.octet_length(value)).alias("octets"),
        F.bool_and(F.is_valid_utf8(value)).alias("utf8"),
        F.bool_or(quote_count(value) % 2 == 1).alias("odd_line"),
        F.sum(quote_count(value)).alias("quotes"),
        F.min(SEQ).alias("first"),
        F.max(F.struct(F.col(SEQ), literal_quote(value, ANY_DELIMITER).alias("literal"))).alias("last"),
    )


def _delimiter_counts(value: Column) -> list[Column]:
    """Occurrences of every delimiter outside quotes; an open quote reaches to the end."""
    bare = F.when(F.contains(value, F.lit('"')), F.regexp_replace(value, f'{QUOTED_CELL}|"[^"]*+$', "")).otherwise(value)
    lengths = [F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(d), F.lit(""))) for d in DELIMITERS]
    return [length.alias(f"n{i}") for i, length in enumerate(lengths)]


def _filled(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, "\r$", "")) != ""


def file_facts(histogram: DataFrame) -> DataFrame:
    """Per file: encoding, whether some record spans lines, whether it ends in quotes, and whether it was cut short.

    The reader drops a byte order mark, so it shows as 3 bytes that no line accounts for, or 2 if
    the last line has no end. More bytes are missing where reading failed midway.
    """
    # The last filled line of a file; see ends_in_quotes, which does the same by split.
    at_end = F.max(F.when(F.col("filled"), F.struct(F.col(START), "last")))["last"]["literal"]
    unread = F.first("size") - F.sum("octets") - F.sum("lines")
    facts = histogram.groupBy("path").agg(
        (unread >= 2).alias("marked"),
        (unread > 3).alias("cut_short"),
        F.bool_and("utf8").alias("utf8"),
        F.bool_or("odd_line").alias("spans_lines"),
        ((F.sum("quotes") % 2 == 1) & ~F.coalesce(at_end, F.lit(False))).alias("open_quote"),
        F.min(F.when(F.col(START) == 0, F.col("first"))).alias("first"),
    )
    # The three encodings told apart.
    encoding = F.when(F.col("marked"), "utf-8-sig").when(F.col("utf8"), "utf-8").otherwise("latin-1")
    return facts.select("path", encoding.alias("encoding"), "spans_lines", "open_quote", "cut_short", "first")


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding) of every text file, from all of its bytes."""
    return file_facts(line_histogram(text_lines(spark, path))).select("path", "encoding")


def decoded(value: Column, encoding: Column) -> Column:
    """A raw line as characters, without its carriage return."""
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return F.regexp_replace(F.when(encoding == "latin-1", latin).otherwise(value), "\r$", "")


def spanning_values(lines: DataFrame, histogram: DataFrame, facts: DataFrame) -> DataFrame | None:
    """Records (file, start, seq, value) of the files whose records span lines; None without any."""
    spanning = facts.where("spans_lines AND NOT open_quote")
    if spanning.isEmpty():
        return None
    kinds = histogram.join(spanning.select("path"), "path").groupBy(F.col("path").alias(FILE), START)
    quotes = ranged(kinds.agg((F.sum("quotes") % 2).alias("odd")), FILE, START)
    records = spanning_records(lines.select("value", FILE, START, SEQ), quotes)
    return records.withColumn("value", F.col("record").cast("string")).drop("record")


def delimiter_histogram(histogram: DataFrame, facts: DataFrame, records: DataFrame | None) -> DataFrame:
    """(path, n0.., lines): records by their numbers of delimiters.

    A line is a record, except in files whose records span lines: those count by record.
    """
    counts = [f"n{i}" for i in range(len(DELIMITERS))]
    lines = F.when(F.col("filled"), F.col("lines")).otherwise(0).alias("lines")
    by_line = histogram.join(facts.where("NOT spans_lines OR open_quote"), "path", "left_semi").select("path", *counts, lines)
    if records is None:
        return by_line
    kinds = records.groupBy(F.col(FILE).alias("path"), *_delimiter_counts(F.col("value")), _filled(F.col("value")).alias("filled"))
    return by_line.union(kinds.agg(F.count(F.lit(1)).alias("lines")).select("path", *counts, lines))


def detect_delimiters(histogram: DataFrame) -> DataFrame:
    """(path, delimiter, confident) from a :func:`delimiter_histogram` of whole files.

    Confident: some delimiter occurs equally often, outside quotes, on nearly all lines. Else
    the delimiter with most occurrences, or a comma.
    """
    kinds = F.array(*[F.struct(F.lit(i).alias("d"), F.col(f"n{i}").alias("n")) for i in range(len(DELIMITERS))])
    counted = histogram.select("path", "lines", F.inline(kinds)).groupBy("path", "d", "n").agg(F.sum("lines").alias("lines"))
    seen = counted.groupBy("path", "d").agg(
        F.max(F.when(F.col("n") > 0, F.col("lines"))).alias("most"),
        F.sum("lines").alias("total"),
        F.sum(F.col("n") * F.col("lines")).alias("seen"),
    )
    consistent = F.col("most") / F.greatest("total", F.lit(1)) >= CONSISTENT_SHARE
    chosen = seen.groupBy("path").agg(
        F.min(F.when(consistent, F.col("d"))).alias("sure"),
        F.min(F.when(F.col("seen") > 0, F.struct((-F.col("seen")).alias("rank"), "d")))["d"].alias("likely"),
    )
    place = F.coalesce("sure", "likely", F.lit(0))
    return chosen.select(
        "path", F.element_at(F.array(*map(F.lit, DELIMITERS)), place + 1).alias("delimiter"), F.col("sure").isNotNull().alias("confident")
    )


def split_record(line: Column, delimiter: Column) -> Column:
    """The fields of a one-line record: quotes removed, doubled quotes single."""
    sep = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    field = F.concat(sep, F.lit(f"({QUOTED_CELL}|[^"), sep, F.lit("]*+)"))
    cells = F.regexp_extract_all(F.concat(delimiter, line), field, F.lit(1))
    quoted = lambda cell: cell.startswith('"') & cell.endswith('"') & (F.char_length(cell) > 1)
    inner = lambda cell: F.replace(F.substring(cell, F.lit(2), F.char_length(cell) - 2), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda cell: F.when(quoted(cell), inner(cell)).otherwise(cell))


def is_blank(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)\s+", "") == ""


def header_code(header: Column) -> Column:
    """The finding about a header, if any: an empty name comes before a repeated one."""
    blank = F.exists(header, is_blank)
    repeated = F.size(F.array_distinct(header)) < F.size(header)
    return F.when(blank, "source.empty_header").when(repeated, "source.duplicate_header")


def header_findings(spark: SparkSession, path: str, *, delimiter: str, encoding: str = "utf-8") -> DataFrame:
    """(path, header, code, columns) for every file: blank places or repeated names."""
    lines = text_lines(spark, path)
    firsts = lines.where(F.col(START) == 0).groupBy(FILE).agg(F.min_by("value", SEQ).alias("value"))
    line = decoded(F.col("value"), F.lit("latin-1" if encoding == "latin-1" else "utf-8"))
    split = firsts.select(F.col(FILE).alias("path"), split_record(line, F.lit(delimiter)).alias("header"))
    coded = split.withColumn("code", header_code(F.col("header")))
    places = F.transform(F.sequence(F.lit(1), F.size("header")), lambda i: F.when(is_blank(F.element_at("header", i)), i.cast("string")))
    repeats = F.array_distinct(
        F.filter("header", lambda name: F.size(F.filter("header", lambda other: other == name)) > 1)
    )
    lone_blank = (F.size("header") == 1) & (F.element_at("header", 1) == "")
    columns = (
        F.when(lone_blank, F.array().cast("array<string>"))
        .when(F.col("code") == "source.empty_header", F.array_compact(places))
        .when(F.col("code") == "source.duplicate_header", repeats)
        .otherwise(F.array().cast("array<string>"))
    )
    return coded.select("path", "header", "code", columns.alias("columns"))


def text_type(longest: Column) -> Column:
    """The declared type proposed for text whose longest value has this many characters."""
    sized = F.concat(F.lit("VARCHAR("), F.greatest(longest, F.lit(1)).cast("string"), F.lit(")"))
    return F.when(longest.isNull(), f"VARCHAR({VARCHAR_LIMIT})").when(longest <= VARCHAR_LIMIT, sized).otherwise("TEXT")


def typed_proposal(data_type: T.DataType) -> str | None:
    """The declared type proposed for a typed column; None for text, whose lengths decide."""
    if isinstance(data_type, T.StringType):
        return None
    if isinstance(data_type, T.DecimalType):
        return f"DECIMAL({data_type.precision},{data_type.scale})"
    for kinds, name in (
        (T.BooleanType, "BOOLEAN"),
        (T.IntegralType, "BIGINT"),
        ((T.FloatType, T.DoubleType), "DOUBLE"),
        (T.DateType, "DATE"),
        ((T.TimestampType, T.TimestampNTZType), "DATETIME"),
    ):
        if isinstance(data_type, kinds):
            return name
    return "TEXT"


def infer_schema(df: DataFrame) -> DataFrame:
    """(position, column, type) proposed for a DataFrame, from one aggregate over it."""
    fixed = {field.name: typed_proposal(field.dataType) for field in df.schema}
    slots = {name: f"m{i}" for i, name in enumerate(df.columns)}
    texts = [name for name, proposal in fixed.items() if proposal is None]
    longest = df.agg(F.count(F.lit(1)).alias("rows"), *[F.max(F.char_length(df[f"`{n}`"])).alias(slots[n]) for n in texts])
    proposals = [
        F.struct(
            F.lit(place).alias("position"),
            F.lit(name).alias("column"),
            (text_type(F.col(slots[name])) if fixed[name] is None else F.lit(fixed[name])).alias("type"),
        )
        for place, name in enumerate(df.columns, start=1)
    ]
    return longest.select(F.inline(F.array(*proposals)))


@dataclass(frozen=True)
class Inspection:
    """What a source looks like, with its first rows."""

    path: str
    file_type: str
    encoding: str | None
    delimiter: str | None
    sheets: list[str]
    selected_sheet: str | None
    columns: list[str]
    row_count: int
    dtypes: dict[str, str]
    preview: list[dict[str, Any]]

    @property
    def column_count(self) -> int:
        return len(self.columns)


def inspect_source(
    spark: SparkSession, path: str, *, sheet: str | None = None, encoding: str | None = None, delimiter: str | None = None
) -> Inspection:
    source = _opened(spark, path, sheet, encoding, delimiter, sure=False)
    counts = source.df.agg(F.count(F.lit(1)).alias("records"), *fault_counts(source)).first().asDict()
    refuse_faults(spark, source, counts)
    types = {name: field.dataType.simpleString() for name, field in zip(source.columns, source.rows().schema)}
    preview = preview_rows(source).collect()
    return Inspection(
        path=path,
        file_type=source.file_type,
        encoding=source.encoding,
        delimiter=source.delimiter,
        sheets=list(source.sheets),
        selected_sheet=source.sheet,
        columns=source.columns,
        row_count=counts["records"],
        dtypes=types,
        preview=[dict(zip(source.columns, row[1:])) for row in preview],
    )


def preview_rows(source: Source, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in source order: dates and times as ISO text, decimals as text."""
    frame = source.tracked()
    shown = [preview_value(frame.value(name), frame.type_of(name)).alias(name) for name in source.columns]
    first = frame.numbering.number(frame.df).where(F.col(ROW_INDEX) <= rows)
    return first.select(ROW_INDEX, *shown).orderBy(ROW_INDEX)


def preview_value(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return iso_timestamp(column)
    return column.cast("string") if isinstance(data_type, (T.DateType, T.DecimalType)) else column


def source_summary(source: Source) -> DataFrame:
    """(position, column, dtype, row_count) of a source, from one count."""
    frame = source.tracked()
    described = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(frame.type_of(n).simpleString()).alias("dtype"))
            for i, n in enumerate(source.columns, start=1)
        ]
    )
    return source.df.agg(F.count(F.lit(1)).alias("row_count")).select(F.inline(described), "row_count")


def sniffed(spark: SparkSession, path: str, encoding: str | None) -> tuple[str, str, bool]:
    """(encoding, delimiter, confident) of one text source."""
    lines = text_lines(spark, path)
    histogram = scratch_table(line_histogram(lines), "histogram")
    facts = scratch_table(file_facts(histogram), "facts")
    row = facts.orderBy("path").first()
    if row is None:
        raise fail("source.empty", "The source file is empty.", path=path)
    if row.open_quote:
        raise fail("source.read_failed", "A file ends within a quoted cell.", path=path, file=row.path)
    counts = delimiter_histogram(histogram, facts, spanning_values(lines, histogram, facts))
    found = detect_delimiters(counts).orderBy("path").first()
    return encoding or row.encoding, found.delimiter, found.confident


def _opened(spark, path: str, sheet: str | None, encoding: str | None, delimiter: str | None, *, sure: bool) -> Source:
    section = {"path": path, "sheet": sheet}
    if source_format(path) == "csv":
        if not (encoding and delimiter):
            encoding, found, confident = sniffed(spark, path, encoding)
            if not delimiter and sure and not confident:
                raise fail("source.csv_detection_failed", "The delimiter is not certain; name one.", path=path)
            delimiter = delimiter or found
        section |= {"encoding": encoding, "delimiter": delimiter}
    return open_source(spark, section)


def starter_recipe(
    spark: SparkSession,
    path: str,
    *,
    sheet: str | None = None,
    table: str | None = None,
    encoding: str | None = None,
    delimiter: str | None = None,
    defaults: Mapping[str, Any] | None = None,
    call: Mapping[str, Any] | None = None,
    existing: Container[str] = (),
) -> Recipe:
    """A recipe proposed for one source; its column names and types come from the data."""
    source = _opened(spark, path, sheet, encoding, delimiter, sure=True)
    observed = Observation()
    counted = source.df.observe(observed, F.count(F.lit(1)).alias("records"), *fault_counts(source))
    types = [row.type for row in infer_schema(counted.select(*slots(len(source.columns)))).orderBy("position").collect()]
    refuse_faults(spark, source, observed.get)
    stem = path.rstrip("/").rpartition("/")[2].rpartition(".")[0]
    name = recipe_name(table or stem)
    if name in existing:
        raise fail("recipe.exists", f"There is a recipe `{name}` already.", path=name, result_code=ResultCode.USAGE_OR_DRIFT, recipe=name)
    return Recipe.from_dict(
        recipe_mapping(
            name, table or name, path, source.columns, types, resolve_settings(defaults, call=call),
            sheet=source.sheet, encoding=source.encoding, delimiter=source.delimiter,
        )
    )


def recipe_mapping(name, table, path, columns, types, settings, *, sheet=None, encoding=None, delimiter=None) -> dict[str, Any]:
    names = safe_names(columns)
    renamed = {old: new for old, new in zip(columns, names) if old != new}
    about = {"sheet": sheet, "encoding": encoding, "delimiter": delimiter}
    return {
        "name": name,
        "source": {"path": path, "header_row": 1, "skip_rows": 0, **{k: v for k, v in about.items() if v is not None}},
        "target": {
            "profile": settings.profile,
            "table": table,
            "mode": "append",
            "charset": settings.charset,
            "collation": settings.collation,
            "engine": settings.engine,
        },
        "schema": [{"name": n, "type": t, "nullable": True} for n, t in zip(names, types)],
        "edits": [{"rename": renamed}] if renamed else [],
        "options": {"reject_threshold": settings.reject_threshold, "batch_size": settings.batch_size},
    }


def profile_folder(
    spark: SparkSession,
    directory: str,
    *,
    project: str | None = None,
    recursive: bool = False,
    encoding: str | None = None,
    delimiter: str | None = None,
    own_folder: str | None = None,
    existing: Iterable[str] = (),
) -> DataFrame:
    """Every supported file and sheet of a folder with its proposed table and columns.

    The folder is read by recursive scans keyed on the files' URIs; no list of paths is made, and
    a file that cannot be read is one failed entry.

    One row per column: (source_path, sheet, sheet_position, status, table, position,
    source_column, column, type, code, encoding, delimiter). An entry that cannot be profiled is one row with its code; the rest go on.
    Encodings, structure and delimiters of all text files come from one pass over them, headers
    and column lengths from a second one.
    """
    if project is not None:
        check_scope(directory, project)
    files = scratch_table(discover_files(spark, directory, recursive=recursive, own_folder=own_folder), "files")
    within = lambda form, names, **options: folder_scan(
        spark, directory, form, names, recursive=recursive, own_folder=own_folder, **options
    )
    texts = text_entries(files.where("kind = 'csv'"), within("text", TEXT_NAMES, lineSep="\n"), encoding, delimiter)
    books = workbook_entries(files.where("kind = 'xlsx'"), within("binaryFile", WORKBOOK_NAMES))
    columns = scratch_table(texts.unionByName(books), "profile")
    named = folder_tables(columns.select("source_path", "sheet", "sheets", "sheet_position").distinct())
    placed = columns.join(named, (columns.source_path == named.path) & columns.sheet.eqNullSafe(named.sheet_name), "left")
    taken = F.col("code").isNull() & F.col("table").isin(*existing)
    code = F.when(taken, "recipe.exists").otherwise(F.col("code"))
    return placed.where(~taken | (F.col("position") == 1)).select(
        "source_path", "sheet", "sheet_position", F.when(code.isNull(), "created").otherwise("failed").alias("status"), "table",
        *[F.when(~taken, F.col(name)).alias(name) for name in ("position", "source_column", "column", "type")],
        code.alias("code"), "encoding", "delimiter",
    )


def folder_totals(profile: DataFrame) -> DataFrame:
    """One row: files found, tables proposed, entries failed, and the first failure's result code."""
    entries = profile.select("source_path", "sheet", "sheet_position", "status", "code").distinct()
    failed = F.col("status") == "failed"
    first = F.min_by("code", F.when(failed, F.struct("source_path", "sheet_position")))
    exit_code = F.when(first == "recipe.exists", int(ResultCode.USAGE_OR_DRIFT)).when(
        first.isNotNull(), int(ResultCode.VALIDATION_ERROR)
    )
    return entries.agg(
        F.count_distinct("source_path").alias("files_found"),
        F.count_if(~failed).alias("created"),
        F.count_if(failed).alias("failed"),
        exit_code.otherwise(int(ResultCode.SUCCESS)).alias("exit_code"),
    )


def folder_recipes(profile: DataFrame, defaults: Mapping[str, Any] | None = None) -> list[Recipe]:
    """The proposals as recipes: plan objects, a few kilobytes each."""
    ok = profile.where(F.col("status") == "created").groupBy("source_path", "sheet", "table", "encoding", "delimiter").agg(
        F.array_sort(F.collect_list(F.struct("position", "source_column", "type"))).alias("columns")
    )
    settings = resolve_settings(defaults)
    return [
        Recipe.from_dict(
            recipe_mapping(
                recipe_name(row.table), row.table, row.source_path,
                [c.source_column for c in row.columns], [c.type for c in row.columns], settings,
                sheet=row.sheet, encoding=row.encoding, delimiter=row.delimiter,
            )
        )
        for row in ok.orderBy("source_path", "table").toLocalIterator()
    ]


def folder_tables(entries: DataFrame) -> DataFrame:
    """(path, sheet_name, table): one table name per file or sheet, none used twice.

    In order of path and sheet, an entry gets its own name, or the first free number behind it.
    """
    stems = entries.withColumn("stem", recipe_name_column(file_stem(F.col("source_path"))))
    files = stems.select("source_path", "stem").distinct().groupBy("stem").agg(F.count(F.lit(1)).alias("files"))
    kind = F.when(F.col("sheets").isNull(), "csv").otherwise("xlsx")
    base = (
        F.when(F.col("sheets") > 1, F.concat_ws("_", "stem", recipe_name_column(F.col("sheet"))))
        .when(F.col("files") > 1, F.concat_ws("_", "stem", kind))
        .otherwise(F.col("stem"))
    )
    based = stems.join(files, "stem").select("source_path", "sheet", "sheet_position", safe_name_column(base).alias("base"))
    return dealt_names(based, "base", ["source_path", "sheet_position"]).select(
        F.col("source_path").alias("path"), F.col("sheet").alias("sheet_name"), F.col("name").alias("table")
    )


def dealt_names(rows: DataFrame, base: str, order: list[str]) -> DataFrame:
    """Add ``name``: in order, each row's base, or the first free number behind it; letter case does not part names.

    Equal bases take their numbers by rank, from sums over ranges. A number may also be what
    another base is called or numbered to: of all rows that claim a name, the first keeps it. Its
    rivals, and the rows after them with their base, move on by one, until no name is claimed
    twice. A row never moves past a name that would have been free for it.
    """
    key = F.lower(base)
    table = ranged(rows.withColumn("__key", key), "__key", *order)
    ranks = running_before(table, ["__key"], order, F.lit(1), "__rank").drop(RANGE).withColumn("__number", F.col("__rank") + 1)
    place = F.struct(*order, "__key")
    while True:
        named = scratch_table(ranks.withColumn("name", numbered_column(F.col(base), F.col("__number"))), "names")
        claims = named.groupBy(F.lower("name").alias("claimed")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        rivals = named.join(claims.where("n > 1"), F.lower("name") == F.col("claimed")).where(F.col("first") != place)
        moved = rivals.groupBy("__key").agg(F.min(F.struct("__rank", "__number")).alias("lost"))
        moved = scratch_table(moved.select("__key", F.col("lost")["__rank"].alias("from"), F.col("lost")["__number"].alias("taken")), "moved")
        if moved.isEmpty():
            return named.drop("__key", "__rank", "__number")
        least = F.col("taken") + 1 + F.col("__rank") - F.col("from")
        number = F.when(F.col("__rank") >= F.col("from"), F.greatest("__number", least)).otherwise(F.col("__number"))
        ranks = named.drop("name").join(moved, "__key", "left").withColumn("__number", number).drop("from", "taken")


ENTRY = (
    "source_path string, sheet string, sheets int, sheet_position int, position int, "
    "source_column string, `column` string, type string, code string, encoding string, delimiter string"
)


def _entries(described: DataFrame) -> DataFrame:
    """One row per column of (source_path, sheet..., code, header, types), or one with the code."""
    fine = F.when(F.col("code").isNull(), F.col("header"))
    named = described.withColumn("names", distinct_names_column(F.transform(fine, safe_name_column)))
    columns = F.when(
        F.col("code").isNull(), F.arrays_zip(F.col("header").alias("header"), F.col("names").alias("names"), F.col("types").alias("types"))
    )
    exploded = named.select("source_path", "sheet", "sheets", "sheet_position", "code", "encoding", "delimiter", F.posexplode_outer(columns))
    return exploded.select(
        "source_path", "sheet", "sheets", "sheet_position", (F.col("pos") + 1).alias("position"),
        F.col("col.header").alias("source_column"), F.col("col.names").alias("column"), F.col("col.types").alias("type"),
        "code", "encoding", "delimiter",
    )


def text_entries(files: DataFrame, scan: DataFrame, encoding: str | None, delimiter: str | None) -> DataFrame:
    """Entries of the delimited files, from a scan of their lines."""
    pin_file_splits(files.sparkSession)
    lines = located_lines(scan)
    histogram = scratch_table(line_histogram(lines), "histogram")
    facts = scratch_table(file_facts(histogram), "facts")
    records = spanning_values(lines, histogram, facts)
    found = detect_delimiters(delimiter_histogram(histogram, facts, records))
    if encoding:
        facts = facts.withColumn("encoding", F.lit("latin-1" if encoding == "latin-1" else "utf-8"))
    if delimiter:
        found = found.withColumn("delimiter", F.lit(delimiter)).withColumn("confident", F.lit(True))
    formats = scratch_table(facts.join(found, "path", "left"), "formats")

    # Formats by split, so that a large file's text is no single key where this join shuffles.
    wanted = formats.where("confident AND NOT open_quote").join(histogram.select("path", START).distinct(), "path")
    wanted = scratch_table(wanted.withColumnRenamed("path", FILE), "split_formats")
    by_line = lines.select(FILE, START, SEQ, "value").join(wanted.where("NOT spans_lines"), [FILE, START])
    cells = _split_cells(by_line, F.col("first"))
    if records is not None:
        cells = cells.union(_split_cells(records.join(wanted, [FILE, START]), F.lit(0)))
    headers = cells.where("is_header").select(F.col(FILE).alias("path"), F.col("cells").alias("header"))
    lengths = (
        cells.where("not is_header and not blank")
        .select(FILE, F.posexplode("cells").alias("pos", "cell"))
        .groupBy(F.col(FILE).alias("path"), "pos")
        .agg(F.max(F.char_length("cell")).alias("longest"))
        .groupBy("path")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "longest"))).alias("longest"), F.max("pos").alias("last"))
    )
    places = F.sequence(F.lit(0), F.size("header") - 1)
    length_at = lambda i: F.when(F.col("longest").isNotNull(), F.coalesce(F.element_at("longest", i), F.lit(0)))
    described = (
        files.select(F.col("path").alias("source_path"), F.col("file").alias("path"), "length")
        .join(formats, "path", "left")
        .join(headers, "path", "left")
        .join(lengths, "path", "left")
        .withColumn(
            "code",
            F.when(F.col("length") == 0, "source.empty")
            .when(F.col("encoding").isNull() | F.col("cut_short") | F.col("open_quote"), "source.read_failed")
            .when(~F.coalesce("confident", F.lit(False)), "source.csv_detection_failed")
            .when(header_code(F.col("header")).isNotNull(), header_code(F.col("header")))
            .when(F.col("last") >= F.size("header"), "source.read_failed"),
        )
        .select(
            "source_path", F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("int").alias("sheets"),
            F.lit(None).cast("int").alias("sheet_position"), "code", "header", "encoding", "delimiter",
            F.transform(places, lambda i: text_type(length_at(i))).alias("types"),
        )
    )
    return _entries(described)


def _split_cells(read: DataFrame, first: Column) -> DataFrame:
    """(file, is_header, cells, blank) of raw records with their file's format beside them."""
    line = decoded(F.col("value"), F.col("encoding"))
    is_header = (F.col(START) == 0) & (F.col(SEQ) == first)
    return read.select(
        FILE, is_header.alias("is_header"), split_record(line, F.col("delimiter")).alias("cells"), (line == "").alias("blank")
    )


def workbook_entries(files: DataFrame, scan: DataFrame) -> DataFrame:
    """Entries of the workbooks: one per sheet, from one parse of each workbook."""
    content = scan.select(F.col("_metadata.file_path").alias("path"), "content")
    sheets = scratch_table(workbook_sheets(content), "sheets")
    rows = scratch_table(workbook_rows(content).where(F.col("fault").isNull()), "sheet_rows")
    described = described_sheets(sheets, rows).withColumnRenamed("source_path", "file")
    # a workbook that could not be read at all has no sheet, not even a faulty one
    named = files.select("file", F.col("path").alias("source_path"), "length").join(described.withColumn("seen", F.lit(True)), "file", "left")
    code = F.when(F.col("length") == 0, "source.empty").when(F.col("seen").isNull(), "source.read_failed").otherwise(F.col("code"))
    return _entries(named.withColumn("code", code).withColumn("sheets", F.coalesce("sheets", F.lit(0))))


def described_sheets(sheets: DataFrame, rows: DataFrame) -> DataFrame:
    """Per sheet: header, proposed types, or the code of what is wrong with it."""
    key = ["path", "sheet"]
    extents = sheet_extents(rows, *key)
    placed = rows.join(extents, key)
    width = F.col("right") - F.col("left") + 1
    dense = lambda column, filler: F.transform(
        F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(column, F.col("left") - 1 + i), F.lit(filler))
    )
    headers = placed.where(F.col("row_no") == F.col("top")).select(*key, dense("texts", "").alias("header"))
    cells = placed.where(F.col("row_no") > F.col("top")).select(
        *key, F.posexplode(F.arrays_zip(dense("kinds", "empty").alias("kind"), dense("texts", "").alias("text"))).alias("pos", "cell")
    )
    columns = cells.groupBy(*key, "pos").agg(
        F.collect_set("cell.kind").alias("kinds"), F.max(F.char_length("cell.text")).alias("longest")
    )
    spark_type = column_type(F.col("kinds"))
    proposal = (
        F.when(spark_type == "double", "DOUBLE").when(spark_type == "boolean", "BOOLEAN").when(spark_type == "date", "DATE")
        .when(spark_type == "timestamp_ntz", "DATETIME").otherwise(text_type(F.col("longest")))
    )
    types = columns.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("pos", proposal.alias("t")))).alias("by_place"))
    counts = Window.partitionBy("path")
    return (
        sheets.withColumn("sheets", F.count("sheet").over(counts).cast("int"))
        .join(headers, key, "left")
        .join(types, key, "left")
        .withColumn(
            "code",
            F.when(F.col("fault") == "source.empty", "source.empty")
            .when(F.col("fault").isNotNull(), "source.read_failed")
            .when(F.col("header").isNull(), "source.empty")
            .otherwise(header_code(F.col("header"))),
        )
        .select(
            F.col("path").alias("source_path"), "sheet", "sheets", F.col("position").alias("sheet_position"), "code", "header",
            F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("string").alias("delimiter"),
            F.transform(
                F.sequence(F.lit(0), F.size("header") - 1),
                lambda i: F.coalesce(F.element_at("by_place", i), F.lit(f"VARCHAR({VARCHAR_LIMIT})")),
            ).alias("types"),
        )
    )
