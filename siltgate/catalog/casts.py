"""One query per cast target and text form. A value that cannot be cast comes out null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltgate.catalog.raw import EDITED_SQL, ORDERS_RAW_SQL, raw_frame
from siltgate.catalog.registry import query, table
from siltgate.operators.edits import apply_edits
from siltgate.operators.rejects import reject_rows
from siltgate.operators.tracked import ROW_INDEX
from siltgate.sources.tables import from_dataframe


def cast_values(df: DataFrame, key: str, raw: Column, spec: dict) -> DataFrame:
    """The key, the raw text and the cast value of every row, failures included."""
    frame = from_dataframe(df.select(F.col(key), raw.alias("raw"), (F.col(key) + 1).alias("i")), row_index="i").tracked()
    after = apply_edits(frame, [{"cast": {"raw": spec}}])
    return after.df.select(frame.value(key).alias(key), frame.value("raw").alias("raw"), after.value("raw").alias("value"))


def variants(key: str, *forms: Column) -> Column:
    """The form whose place is the key modulo their number."""
    chosen = F.when(F.col(key) % len(forms) == 0, forms[0])
    for place, form in enumerate(forms[1:], start=1):
        chosen = chosen.when(F.col(key) % len(forms) == place, form)
    return chosen


def line_ended(text: Column) -> tuple[Column, Column]:
    """The text with a line end after it, which no grammar takes."""
    return F.concat(text, F.lit("\n")), F.concat(text, F.lit("\r\n"))


INT_FORMS = """CASE o_orderkey % 8 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN '00' || CAST(o_custkey AS VARCHAR)
 WHEN 2 THEN '-' || CAST(o_custkey AS VARCHAR) WHEN 3 THEN CAST(o_custkey AS VARCHAR) || '.5'
 WHEN 4 THEN ' ' || CAST(o_custkey AS VARCHAR) WHEN 5 THEN '9999999999999999' || CAST(o_custkey AS VARCHAR)
 WHEN 6 THEN CAST(o_custkey AS VARCHAR) || chr(10) ELSE CAST(o_custkey AS VARCHAR) || chr(13) || chr(10) END"""


@query(
    "cast_int",
    f"""SELECT o_orderkey, raw, CASE WHEN regexp_full_match(raw, '[+-]?[0-9]+') THEN TRY_CAST(raw AS BIGINT) END AS value
        FROM (SELECT o_orderkey, {INT_FORMS} AS raw FROM orders)""",
)
def cast_int(spark, sf_dir):
    cust = F.col("o_custkey").cast("string")
    raw = variants(
        "o_orderkey", cust, F.concat(F.lit("00"), cust), F.concat(F.lit("-"), cust), F.concat(cust, F.lit(".5")),
        F.concat(F.lit(" "), cust), F.concat(F.lit("9999999999999999"), cust), *line_ended(cust),
    )
    return cast_values(table(spark, sf_dir, "orders"), "o_orderkey", raw, {"type": "int"})


FLOAT_FORMS = """CASE o_orderkey % 8 WHEN 0 THEN p WHEN 1 THEN p || 'e2' WHEN 2 THEN '.' || CAST(o_custkey AS VARCHAR)
 WHEN 3 THEN p || 'd' WHEN 4 THEN p || ' ' WHEN 5 THEN '-' || p WHEN 6 THEN p || chr(10) ELSE p || chr(13) || chr(10) END"""


@query(
    "cast_float",
    f"""SELECT o_orderkey, raw,
        CASE WHEN regexp_full_match(raw, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(raw AS DOUBLE) END AS value
        FROM (SELECT o_orderkey, {FLOAT_FORMS} AS raw
              FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS p FROM orders))""",
)
def cast_float(spark, sf_dir):
    price, cust = F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.col("o_custkey").cast("string")
    raw = variants(
        "o_orderkey", price, F.concat(price, F.lit("e2")), F.concat(F.lit("."), cust), F.concat(price, F.lit("d")),
        F.concat(price, F.lit(" ")), F.concat(F.lit("-"), price), *line_ended(price),
    )
    return cast_values(table(spark, sf_dir, "orders"), "o_orderkey", raw, {"type": "float"})


DECIMAL_FORMS = """CASE l_orderkey % 7 WHEN 0 THEN p WHEN 1 THEN p || 'e1' WHEN 2 THEN '+' || p WHEN 3 THEN replace(p, '.', ',')
 WHEN 4 THEN ' ' || p WHEN 5 THEN p || chr(10) ELSE p || chr(13) || chr(10) END"""


@query(
    "cast_decimal",
    f"""SELECT l_orderkey, l_linenumber, raw,
               CASE WHEN regexp_full_match(raw, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN TRY_CAST(raw AS DECIMAL(7,1)) END AS value
        FROM (SELECT l_orderkey, l_linenumber, {DECIMAL_FORMS} AS raw
              FROM (SELECT *, CAST(CAST(l_extendedprice * 20 AS DECIMAL(14,2)) AS VARCHAR) AS p FROM lineitem))""",
)
def cast_decimal(spark, sf_dir):
    """Digits beyond the scale round half up; values beyond the precision and malformed text fail."""
    price = (F.col("l_extendedprice") * 20).cast("decimal(14,2)").cast("string")
    raw = variants(
        "l_orderkey", price, F.concat(price, F.lit("e1")), F.concat(F.lit("+"), price), F.replace(price, F.lit("."), F.lit(",")),
        F.concat(F.lit(" "), price), *line_ended(price),
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"), (F.col("l_orderkey") + 1).alias("i"))
    frame = from_dataframe(lines, row_index="i").tracked()
    after = apply_edits(frame, [{"cast": {"raw": {"type": "decimal", "precision": 7, "scale": 1}}}])
    return after.df.select(
        frame.value("l_orderkey").alias("l_orderkey"), frame.value("l_linenumber").alias("l_linenumber"),
        frame.value("raw").alias("raw"), after.value("raw").alias("value"),
    )


@query(
    "cast_boolean",
    f"""WITH {ORDERS_RAW_SQL} SELECT row_index, active,
        CASE WHEN lower(trim(active)) IN ('true', '1', 'yes', 'y') THEN TRUE
             WHEN lower(trim(active)) IN ('false', '0', 'no', 'n') THEN FALSE END AS value FROM raw""",
)
def cast_boolean(spark, sf_dir):
    frame = raw_frame(spark, sf_dir)
    after = apply_edits(frame, [{"cast": {"active": {"type": "boolean"}}}])
    return frame.numbering.number(after.df).select(
        F.col(ROW_INDEX).alias("row_index"), frame.value("active").alias("active"), after.value("active").alias("value")
    )


@query(
    "cast_string",
    """SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price FROM part""",
)
def cast_string(spark, sf_dir):
    """Typed columns become text."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", F.col("p_retailprice").cast("decimal(12,2)").alias("price"), (F.col("p_partkey") + 1).alias("i")
    )
    casts = {"p_size": {"type": "string"}, "price": {"type": "string"}}
    return apply_edits(from_dataframe(part, row_index="i").tracked(), [{"cast": casts}]).live_rows()


DATE_FORMS = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
 WHEN 2 THEN strftime(o_orderdate, '%Y') || '-02-30' WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || ' '
 WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') || chr(10) ELSE strftime(o_orderdate, '%Y-%m-%d') || chr(13) || chr(10) END"""


@query(
    "cast_date_iso",
    f"""SELECT o_orderkey, raw, CASE WHEN regexp_full_match(raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST(raw AS DATE) END AS value
        FROM (SELECT o_orderkey, {DATE_FORMS} AS raw FROM orders)""",
)
def cast_date_iso(spark, sf_dir):
    day = F.col("o_orderdate")
    iso = F.date_format(day, "yyyy-MM-dd")
    raw = variants(
        "o_orderkey", iso, F.date_format(day, "yyyy/MM/dd"), F.concat(F.date_format(day, "yyyy"), F.lit("-02-30")),
        F.concat(iso, F.lit(" ")), *line_ended(iso),
    )
    return cast_values(table(spark, sf_dir, "orders"), "o_orderkey", raw, {"type": "date"})


@query(
    "cast_date_format",
    f"WITH {ORDERS_RAW_SQL} SELECT row_index, order_date AS raw, CAST(try_strptime(order_date, '%m/%d/%Y') AS DATE) AS value FROM raw",
)
def cast_date_format(spark, sf_dir):
    frame = raw_frame(spark, sf_dir)
    after = apply_edits(frame, [{"cast": {"order_date": {"type": "date", "format": "%m/%d/%Y"}}}])
    return frame.numbering.number(after.df).select(
        F.col(ROW_INDEX).alias("row_index"), frame.value("order_date").alias("raw"), after.value("order_date").alias("value")
    )


@query(
    "cast_date_short_year",
    """SELECT o_orderkey, raw, CAST(try_strptime(raw, '%d.%m.%y') AS DATE) AS value
       FROM (SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%y') AS raw FROM orders)""",
)
def cast_date_short_year(spark, sf_dir):
    """Two-digit years from 70 on belong to the 1900s."""
    raw = F.date_format("o_orderdate", "dd.MM.yy")
    return cast_values(table(spark, sf_dir, "orders"), "o_orderkey", raw, {"type": "date", "format": "%d.%m.%y"})


@query(
    "cast_datetime_format",
    """SELECT event_id, raw, try_strptime(raw, '%d %b %Y %H:%M:%S.%f') AS value
       FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN '31 Feb 2024 10:00:00.5'
                                   ELSE strftime(ts, '%d %b %Y %H:%M:%S.%f') END AS raw FROM events)""",
)
def cast_datetime_format(spark, sf_dir):
    shown = F.date_format("ts", "dd MMM yyyy HH:mm:ss.SSSSSS")
    raw = F.when(F.col("event_id") % 13 == 0, "31 Feb 2024 10:00:00.5").otherwise(shown)
    spec = {"type": "datetime", "format": "%d %b %Y %H:%M:%S.%f"}
    return cast_values(table(spark, sf_dir, "events"), "event_id", raw, spec)


@query(
    "cast_datetime_iso",
    """SELECT event_id, raw, CASE WHEN regexp_full_match(raw,
         '[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]{1,9})?)?)?') THEN TRY_CAST(raw AS TIMESTAMP) END AS value
       FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f')
               WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d')
               WHEN 3 THEN strftime(ts, '%Y%m%d') WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || chr(10)
               ELSE strftime(ts, '%Y-%m-%d') || chr(13) || chr(10) END AS raw FROM events)""",
)
def cast_datetime_iso(spark, sf_dir):
    seconds, day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("ts", "yyyy-MM-dd")
    raw = variants(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), seconds, day, F.date_format("ts", "yyyyMMdd"),
        line_ended(seconds)[0], line_ended(day)[1],
    )
    return cast_values(table(spark, sf_dir, "events"), "event_id", raw, {"type": "datetime"})


CASTS = {
    "cust": {"type": "int"},
    "order_date": {"type": "date", "format": "%m/%d/%Y"},
    "price": {"type": "decimal", "precision": 12, "scale": 2},
    "active": {"type": "boolean"},
}
ACTIVE_FAILS = "lower(trim(t_active)) NOT IN ('true', '1', 'yes', 'y', 'false', '0', 'no', 'n')"
REJECT_COLUMNS = (ROW_INDEX, "__column", "__value", "__reason")


def _cast_rejects(frame) -> DataFrame:
    return reject_rows(frame).select(*[F.col(name).alias(name.lstrip("_")) for name in REJECT_COLUMNS])


@query(
    "cast_rejects",
    f"""WITH {EDITED_SQL} SELECT row_index, col AS "column", val AS value, 'Could not cast value to ' || typ || '.' AS reason
        FROM (SELECT * FROM edit_rejects UNION ALL SELECT row_index, 'active', t_active, 'boolean' FROM casted WHERE {ACTIVE_FAILS})""",
)
def cast_rejects(spark, sf_dir):
    """One cast edit of four columns: a row gives one reject for each value that fails."""
    return _cast_rejects(apply_edits(raw_frame(spark, sf_dir), [{"cast": CASTS}]))


@query(
    "cast_rejects_sequential",
    f"""WITH {EDITED_SQL}, first_dead AS (SELECT row_index FROM casted WHERE cust IS NULL OR order_date IS NULL)
        SELECT row_index, col AS "column", val AS value, 'Could not cast value to ' || typ || '.' AS reason FROM (
          SELECT * FROM edit_rejects WHERE col <> 'price'
          UNION ALL SELECT * FROM edit_rejects WHERE col = 'price' AND row_index NOT IN (SELECT row_index FROM first_dead)
          UNION ALL SELECT row_index, 'active', t_active, 'boolean' FROM casted
            WHERE {ACTIVE_FAILS} AND row_index NOT IN (SELECT row_index FROM first_dead))""",
)
def cast_rejects_sequential(spark, sf_dir):
    """Two cast edits: rows the first one rejects give no rejects in the second."""
    first = {name: CASTS[name] for name in ("cust", "order_date")}
    second = {name: CASTS[name] for name in ("price", "active")}
    return _cast_rejects(apply_edits(raw_frame(spark, sf_dir), [{"cast": first}, {"cast": second}]))
