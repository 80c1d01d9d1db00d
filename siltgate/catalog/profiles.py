"""Detection and inference over files and tables."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from siltgate.catalog.files import FILE_ROWS, with_lines_above, written_csv, written_lines
from siltgate.catalog.raw import ORDERS_RAW_SQL, orders_raw
from siltgate.catalog.registry import query, table
from siltgate.engine import validate
from siltgate.functions.naming import safe_name_column
from siltgate.operators.profile import (
    delimiter_histogram,
    detect_delimiters,
    detect_encodings,
    discover_files,
    file_facts,
    folder_tables,
    folder_totals,
    infer_schema,
    line_histogram,
    profile_folder,
    source_summary,
    starter_recipe,
    text_lines,
)
from siltgate.sources.delimited import read_delimited
from siltgate.sources.files import decoded_path
from siltgate.session import scratch_table

# Documents per written file.
DOCUMENTS_PER_FILE = 500


def source_number() -> Column:
    return F.regexp_extract("source", "([0-9]+)$", 1).cast("int")


def encoded_documents(spark: SparkSession, sf_dir: str) -> str:
    """Document texts in files by source; a source's number picks its encoding."""
    style = source_number() % 3
    line = F.replace(F.regexp_replace("text", r"[^\x01-\xff]", "?"), F.lit("\n"), F.lit(" "))
    latin = F.encode(line, "ISO-8859-1").cast("string")
    file = F.concat_ws("_", "source", F.lpad(F.floor(F.col("doc_id") / DOCUMENTS_PER_FILE).cast("string"), 12, "0"))
    rows = table(spark, sf_dir, "documents").select(
        file.alias("f"), F.col("doc_id").alias("p"), F.when(style == 2, latin).otherwise(line).alias("l"), style.alias("s")
    )
    marks = rows.groupBy("f", "s").agg(F.lit(-1).cast("bigint").alias("p")).select(
        "f", "p", F.when(F.col("s") == 0, "\ufeffheader").otherwise("header").alias("l")
    )
    return written_lines(rows.select("f", "p", "l").union(marks), F.col("f"), F.col("p"), F.col("l"))


@query(
    "detect_encoding",
    f"""SELECT source, doc_id // {DOCUMENTS_PER_FILE} AS file_no,
          CASE WHEN CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 3 = 0 THEN 'utf-8-sig'
               WHEN CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 3 = 2
                 AND bool_or(regexp_matches(text, '[\\x{{80}}-\\x{{ff}}]')) THEN 'latin-1'
               ELSE 'utf-8' END AS encoding
        FROM documents GROUP BY source, file_no""",
)
def detect_encoding(spark, sf_dir):
    """Whole texts, in three encodings, told apart from the bytes of the files."""
    found = detect_encodings(spark, encoded_documents(spark, sf_dir) + "/*")
    file = F.regexp_extract("path", "file=([^/]+)/", 1)
    return found.select(
        F.substring_index(file, "_", 1).alias("source"), F.substring_index(file, "_", -1).cast("bigint").alias("file_no"), "encoding"
    )


@query(
    "detect_delimiter",
    f"""SELECT 'p' || substring(o_orderpriority, 1, 1) || '_' || lpad(CAST(o_orderkey // {FILE_ROWS} AS VARCHAR), 12, '0') AS file,
          CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN ',' WHEN '2' THEN chr(9) WHEN '3' THEN ';' WHEN '4' THEN '|' ELSE ',' END AS delimiter,
          substring(o_orderpriority, 1, 1) <> '5' AS confident
        FROM orders GROUP BY ALL""",
)
def detect_delimiter(spark, sf_dir):
    """Four delimiters, with others inside quotes, and files of one column, which have none.

    Every file starts with a long line of notes whose commas must not decide.
    """
    group = F.substring("o_orderpriority", 1, 1)
    delimiter = F.element_at(F.array(*map(F.lit, (",", "\t", ";", "|"))), group.cast("int"))
    cells = [F.col("o_orderkey").cast("string"), F.lit('"a,b;c|d"'), F.col("o_orderstatus")]
    line = F.when(group == "5", cells[0]).otherwise(
        F.concat(cells[0], delimiter_of(group, delimiter), cells[1], delimiter_of(group, delimiter), cells[2])
    )
    file = F.concat(F.lit("p"), group, F.lit("_"), F.lpad(F.floor(F.col("o_orderkey") / FILE_ROWS).cast("string"), 12, "0"))
    rows = table(spark, sf_dir, "orders").select(file.alias("f"), F.col("o_orderkey").alias("p"), line.alias("l"))
    notes = rows.select("f").distinct().select("f", F.lit(-1).cast("bigint").alias("p"), F.repeat(F.lit("note, "), 2_000).alias("l"))
    folder = written_lines(rows.union(notes), F.col("f"), F.col("p"), F.col("l"))
    histogram = scratch_table(line_histogram(text_lines(spark, folder + "/*")), "histogram")
    found = detect_delimiters(delimiter_histogram(histogram, file_facts(histogram), None))
    return found.select(F.regexp_extract("path", "file=([^/]+)/", 1).alias("file"), "delimiter", "confident")


def delimiter_of(group: Column, delimiter: Column) -> Column:
    return F.when(group != "5", delimiter)


@query(
    "inspect_summary",
    """SELECT position, col, dtype, (SELECT count(*) FROM customer) AS row_count FROM (VALUES
         (1, 'c_custkey', 'string'), (2, 'c_name', 'string'), (3, 'c_nationkey', 'string'), (4, 'c_acctbal', 'string'),
         (5, 'c_mktsegment', 'string')) v(position, col, dtype)""",
)
def inspect_summary(spark, sf_dir):
    folder = written_csv(table(spark, sf_dir, "customer"))
    source = read_delimited(spark, folder, encoding="utf-8", delimiter=",")
    return source_summary(source).withColumnRenamed("column", "col")


def proposal_sql(position: int, column: str, source: str) -> str:
    longest = f"max(length({source}))"
    return f"""SELECT {position} AS position, '{column}' AS col, CASE WHEN {longest} IS NULL THEN 'VARCHAR(255)'
        WHEN {longest} <= 255 THEN 'VARCHAR(' || greatest(1, {longest}) || ')' ELSE 'TEXT' END AS type"""


RAW_NAMES = ["order_id", "cust", "order_date", "status", "priority", "price", "active", "small"]


@query(
    "infer_schema",
    f"WITH {ORDERS_RAW_SQL} " + " UNION ALL ".join(f"{proposal_sql(i, n, n)} FROM raw" for i, n in enumerate(RAW_NAMES, start=1)),
)
def infer_raw(spark, sf_dir):
    raw = orders_raw(spark, sf_dir).drop("row_index").withColumnRenamed("Order ID", "order_id")
    return infer_schema(raw).withColumnRenamed("column", "col")


@query(
    "starter_recipe",
    f"""WITH {ORDERS_RAW_SQL}, proposed AS ({" UNION ALL ".join(f"{proposal_sql(i, n, n)} FROM raw" for i, n in enumerate(RAW_NAMES, start=1))})
        SELECT proposed.*, CASE position WHEN 1 THEN 'Order ID' ELSE col END AS source_column, 'orders_raw' AS recipe, ';' AS delimiter,
               (SELECT count(*) FROM raw) AS validated, (SELECT count(*) FROM raw) AS read_rows FROM proposed""",
)
def starter(spark, sf_dir):
    """The recipe proposed for a text source, and the counts of validating it as it is."""
    path = written_csv(orders_raw(spark, sf_dir).drop("row_index"), ".csv", sep=";")
    recipe = starter_recipe(spark, path, table="Orders RAW")
    result = validate(spark, recipe)
    before = {new: old for edit in recipe.edits for old, new in edit.get("rename", {}).items()}
    rows = [
        (i, c.name, c.type.text, before.get(c.name, c.name), recipe.name, recipe.source["delimiter"], result.rows["validated"], result.rows["read"])
        for i, c in enumerate(recipe.schema, start=1)
    ]
    schema = "position int, col string, type string, source_column string, recipe string, delimiter string, validated bigint, read_rows bigint"
    return spark.createDataFrame(rows, schema)


@query(
    "infer_schema_typed",
    f"""SELECT 1 AS position, 'doc_id' AS col, 'BIGINT' AS type UNION ALL {proposal_sql(2, 'text', 'text')} FROM documents
        UNION ALL {proposal_sql(3, 'lang', 'lang')} FROM documents UNION ALL {proposal_sql(4, 'source', 'source')} FROM documents
        UNION ALL SELECT 5, 'n_chars', 'BIGINT'""",
)
def infer_typed(spark, sf_dir):
    return infer_schema(table(spark, sf_dir, "documents")).withColumnRenamed("column", "col")


WORD_SQL = "regexp_replace(regexp_replace(lower({0}), '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(
    "safe_names",
    f"""SELECT page_id, url, regexp_replace(substring(CASE WHEN regexp_full_match(url, '[A-Za-z_][A-Za-z0-9_]*') AND length(url) <= 64 THEN url
          WHEN regexp_matches({WORD_SQL.format('url')}, '^[a-z_]') THEN {WORD_SQL.format('url')}
          WHEN {WORD_SQL.format('url')} = '' THEN 'column' ELSE 'col_' || {WORD_SQL.format('url')} END, 1, 64), '_+$', '') AS safe_name
        FROM (SELECT page_id, ['', '_', '9 ', ' - ', 'Q'][1 + CAST(page_id % 5 AS INTEGER)] || url AS url FROM pages)""",
)
def names(spark, sf_dir):
    """Safe names of header texts of every kind: here, page addresses after various first characters."""
    url = F.expr("concat(element_at(array('', '_', '9 ', ' - ', 'Q'), 1 + cast(page_id % 5 as int)), url)")
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), safe_name_column(url).alias("safe_name"))


def order_files(spark: SparkSession, sf_dir: str) -> str:
    """CSV files of orders in folders, with headers that need safe names and quoted cells."""
    status = F.concat(F.lit('"'), "o_orderstatus", F.lit(', ""x"""'))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority", status)
    rows = with_lines_above(table(spark, sf_dir, "orders"), "o_orderkey", line, ["Order Key,2nd Priority,Order Key "])
    return written_lines(*rows, as_csv=True)


def folder_of(path: str) -> Column:
    return F.regexp_extract(path, "(file=[^/]+)/", 1).alias("folder")


FOLDER_SQL = f"'file=' || lpad(CAST(o_orderkey // {FILE_ROWS} AS VARCHAR), 12, '0')"


@query("folder_files", f"SELECT DISTINCT {FOLDER_SQL} AS folder, 'csv' AS kind, 1 AS files, 1 AS tables FROM orders")
def folder_files(spark, sf_dir):
    """Supported files found recursively, each with a table name of its own."""
    found = discover_files(spark, order_files(spark, sf_dir), recursive=True)
    no_sheet = [F.lit(None).cast(kind).alias(name) for name, kind in (("sheet", "string"), ("sheets", "int"), ("sheet_position", "int"))]
    named = folder_tables(found.select(F.col("path").alias("source_path"), *no_sheet))
    per_folder = found.join(named, "path").groupBy(folder_of("path"), "kind")
    return per_folder.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("table").alias("tables"))


PATH = "'/data/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '/g' || (o_custkey % 40)"


@query(
    "folder_table_names",
    f"""WITH f AS (SELECT o_orderkey AS k, 'g' || (o_custkey % 40) AS g, o_custkey % 40 AS n, {PATH} AS stem, o_orderkey % 10 AS kind FROM orders),
        stems AS (SELECT g, count(*) AS files FROM f GROUP BY g),
        named AS (
          SELECT k, n, stem || CASE WHEN kind IN (3, 7) THEN '.xlsx' ELSE '.csv' END AS path, CASE WHEN kind = 3 THEN 'S' WHEN kind = 7 THEN 'Data ' || s END AS sheet,
                 CASE WHEN kind = 7 THEN g || '_data_' || s WHEN files = 1 THEN g WHEN kind = 3 THEN g || '_xlsx' ELSE g || '_csv' END AS base
          FROM f JOIN stems USING (g), range(1, 3) r(s) WHERE kind = 7 OR s = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY k) AS i FROM named),
        lone AS (SELECT n, max(CASE WHEN base = 'g' || n || '_csv' THEN i ELSE 0 END) AS csvs FROM ranked GROUP BY n)
        SELECT path, sheet, base || CASE WHEN i = 1 THEN '' WHEN base = 'g' || n || '_csv' AND n % 2 = 0 THEN '_' || (i + 1) ELSE '_' || i END AS tbl FROM ranked
        UNION ALL SELECT '/' || CASE WHEN n % 2 = 0 THEN 'a' ELSE 'z' END || '/g' || n || '_csv_2.csv', NULL,
               'g' || n || '_csv_2' || CASE WHEN n % 2 = 1 AND csvs > 1 THEN '_2' ELSE '' END FROM lone""",
)
def folder_table_names(spark, sf_dir):
    """Table names of files with equal stems, workbooks beside text, several sheets, and names that numbers also lead to."""
    kind = F.col("o_orderkey") % 10
    stem = F.concat(F.lit("g"), (F.col("o_custkey") % 40).cast("string"))
    path = F.concat(F.lit("/data/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit("/"), stem, F.when(kind.isin(3, 7), ".xlsx").otherwise(".csv"))
    sheets = F.when(kind == 7, F.array(F.lit("Data 1"), F.lit("Data 2"))).when(kind == 3, F.array(F.lit("S")))
    orders = table(spark, sf_dir, "orders")
    files = orders.select(path.alias("source_path"), F.when(kind.isin(3, 7), F.size(sheets)).alias("sheets"), F.posexplode_outer(sheets).alias("pos", "sheet"))
    entries = files.select("source_path", "sheet", "sheets", (F.col("pos") + 1).alias("sheet_position"))
    # a lone file of each stem that is called as the second file of the stem is numbered, before or after all others
    place = F.when(F.col("o_custkey") % 2 == 0, "/a/").otherwise("/z/")
    lone = orders.select(F.concat(place, stem, F.lit("_csv_2.csv")).alias("source_path")).distinct()
    return folder_tables(entries.unionByName(lone, allowMissingColumns=True)).select("path", F.col("sheet_name").alias("sheet"), F.col("table").alias("tbl"))


@query(
    "profile_folder",
    f"""WITH f AS (SELECT {FOLDER_SQL} AS folder, * FROM orders)
        SELECT folder, 1 AS position, 'created' AS status, 'Order Key' AS source_column, 'order_key' AS col,
               'VARCHAR(' || max(length(CAST(o_orderkey AS VARCHAR))) || ')' AS type FROM f GROUP BY folder
        UNION ALL SELECT folder, 2, 'created', '2nd Priority', 'col_2nd_priority', 'VARCHAR(' || max(length(o_orderpriority)) || ')' FROM f GROUP BY folder
        UNION ALL SELECT folder, 3, 'created', 'Order Key ', 'order_key_2', 'VARCHAR(' || (max(length(o_orderstatus)) + 5) || ')' FROM f GROUP BY folder""",
)
def profiled(spark, sf_dir):
    """Proposed columns of every file of a folder."""
    profile = profile_folder(spark, order_files(spark, sf_dir), recursive=True)
    return profile.select(folder_of("source_path"), "position", "status", "source_column", F.col("column").alias("col"), "type")


@query(
    "profile_totals",
    f"SELECT count(DISTINCT o_orderkey // {FILE_ROWS}) AS files_found, count(DISTINCT o_orderkey // {FILE_ROWS}) AS created, 0 AS failed, 0 AS exit_code FROM orders",
)
def totals(spark, sf_dir):
    return folder_totals(profile_folder(spark, order_files(spark, sf_dir), recursive=True))


def faulty_files(spark: SparkSession, sf_dir: str) -> str:
    """CSV files of orders by priority: sound, over-long, with an open quote, with bad headers."""
    heads = F.array(*map(F.lit, ("id,status", "id,status", "id,status", "id,id", "id, ")))
    group = F.substring("o_orderpriority", 1, 1).cast("int")
    status = F.when((group == 2) & (F.col("o_orderkey") % 23 == 0), F.concat("o_orderstatus", F.lit(",more"))).otherwise(F.col("o_orderstatus"))
    file = F.concat_ws("_", F.lit("p +[{"), group.cast("string"), F.floor(F.col("o_orderkey") / FILE_ROWS).cast("string"))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), status)
    rows = table(spark, sf_dir, "orders").select(file.alias("f"), F.col("o_orderkey").cast("bigint").alias("p"), line.alias("l"), group.alias("g"))
    files = rows.groupBy("f", "g").agg(F.max("p").alias("last"))
    titles = files.select("f", F.lit(-1).cast("bigint").alias("p"), F.element_at(heads, F.col("g")).alias("l"))
    strays = files.where("g = 3").select("f", (F.col("last") + 1).alias("p"), F.lit('0,"open').alias("l"))
    return written_lines(rows.drop("g").union(titles).union(strays), F.col("f"), F.col("p"), F.col("l"), as_csv=True)


@query(
    "profile_failures",
    f"""SELECT 'p +[{{_' || g || '_' || chunk AS file, CASE WHEN g = '1' OR (g = '2' AND NOT long_ones) THEN 'created' ELSE 'failed' END AS status,
          CASE WHEN g = '2' AND long_ones THEN 'source.read_failed' WHEN g = '3' THEN 'source.read_failed'
            WHEN g = '4' THEN 'source.duplicate_header' WHEN g = '5' THEN 'source.empty_header' END AS code
        FROM (SELECT substring(o_orderpriority, 1, 1) AS g, o_orderkey // {FILE_ROWS} AS chunk, bool_or(o_orderkey % 23 = 0) AS long_ones
              FROM orders GROUP BY ALL)""",
)
def profile_failures(spark, sf_dir):
    """Files that cannot be profiled are entries with their code; the others go on."""
    profile = profile_folder(spark, faulty_files(spark, sf_dir), recursive=True)
    # Spark's writer has put codes for some characters into the folders' names
    file = decoded_path(F.regexp_extract("source_path", "file=([^/]+)/", 1)).alias("file")
    return profile.select(file, "status", "code").distinct()
