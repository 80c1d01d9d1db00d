"""``orders_raw``: the orders table as dirty text, in Spark and in SQL, and the recipe over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltgate.catalog.registry import table
from siltgate.engine import Plan, compile_recipe
from siltgate.operators.tracked import TrackedFrame
from siltgate.sources.base import Source
from siltgate.sources.tables import from_dataframe

RAW_COLUMNS = ["Order ID", "cust", "order_date", "status", "priority", "price", "active", "small"]


def orders_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (k + 1).alias("row_index"),
        k.cast("string").alias("Order ID"),
        F.when(k % 97 == 0, "bad").otherwise(F.col("o_custkey").cast("string")).alias("cust"),
        F.when(k % 89 == 0, "not-a-date").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("order_date"),
        F.when(k % 5 == 0, "").when(k % 11 == 0, "N/A").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(k % 3 == 0, F.concat(F.lit("\t"), "o_orderpriority", F.lit("  "))).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(k % 101 == 0, "99999999999.99").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string")).alias("price"),
        F.element_at(F.array(*map(F.lit, ("yes", "NO", "1", "0", "maybe", " True ", ""))), (k % 7 + 1).cast("int")).alias("active"),
        (k % 300).cast("string").alias("small"),
    )


ORDERS_RAW_SQL = """
raw AS (
  SELECT o_orderkey + 1 AS row_index,
         CAST(o_orderkey AS VARCHAR) AS order_id,
         CASE WHEN o_orderkey % 97 = 0 THEN 'bad' ELSE CAST(o_custkey AS VARCHAR) END AS cust,
         CASE WHEN o_orderkey % 89 = 0 THEN 'not-a-date' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS order_date,
         CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'N/A' ELSE o_orderstatus END AS status,
         CASE WHEN o_orderkey % 3 = 0 THEN chr(9) || o_orderpriority || '  ' ELSE o_orderpriority END AS priority,
         CASE WHEN o_orderkey % 101 = 0 THEN '99999999999.99'
              ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS price,
         CASE o_orderkey % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'NO' WHEN 2 THEN '1' WHEN 3 THEN '0'
              WHEN 4 THEN 'maybe' WHEN 5 THEN ' True ' ELSE '' END AS active,
         CAST(o_orderkey % 300 AS VARCHAR) AS small
  FROM orders
)"""

RECIPE = {
    "name": "orders_raw",
    "source": {"path": "orders_raw.parquet"},
    "target": {"table": "orders_clean", "mode": "append"},
    "schema": [
        {"name": "order_id", "type": "BIGINT", "nullable": False},
        {"name": "cust", "type": "BIGINT", "nullable": False},
        {"name": "order_date", "type": "DATE"},
        {"name": "status", "type": "VARCHAR(8)", "nullable": False},
        {"name": "priority", "type": "VARCHAR(12)"},
        {"name": "price", "type": "DECIMAL(12,2)"},
        {"name": "small", "type": "TINYINT"},
    ],
    "edits": [
        {"rename": {"Order ID": "order_id"}},
        {"drop": ["active"]},
        {"trim": ["priority"]},
        {"parse_null": {"columns": ["status"], "values": ["N/A"]}},
        {
            "cast": {
                "order_id": {"type": "int"},
                "cust": {"type": "int"},
                "order_date": {"type": "date", "format": "%m/%d/%Y"},
                "price": {"type": "decimal"},
                "small": {"type": "int"},
            }
        },
        {"fill_null": {"status": "U"}},
        {"parse_null": {"columns": ["status"], "values": [""]}},
    ],
    "options": {"reject_threshold": 0.9},
}

# The same recipe in SQL, over the CTE ``raw``: casts, their failures, then the row checks.
EDITED_SQL = ORDERS_RAW_SQL + """,
casted AS (
  SELECT row_index, order_id AS t_order_id, cust AS t_cust, order_date AS t_order_date, status AS t_status,
         priority AS t_priority, price AS t_price, active AS t_active, small AS t_small,
         CASE WHEN regexp_full_match(order_id, '[+-]?[0-9]+') THEN TRY_CAST(order_id AS BIGINT) END AS order_id,
         CASE WHEN regexp_full_match(cust, '[+-]?[0-9]+') THEN TRY_CAST(cust AS BIGINT) END AS cust,
         CAST(try_strptime(order_date, '%m/%d/%Y') AS DATE) AS order_date,
         CASE WHEN status = 'N/A' THEN 'U' WHEN status = '' THEN NULL ELSE status END AS status,
         regexp_replace(priority, '^\\s+|\\s+$', '', 'g') AS priority,
         TRY_CAST(price AS DECIMAL(12,2)) AS price,
         CASE WHEN regexp_full_match(small, '[+-]?[0-9]+') THEN TRY_CAST(small AS BIGINT) END AS small
  FROM raw
),
edit_rejects AS (
  SELECT row_index, 'cust' AS col, t_cust AS val, 'int' AS typ FROM casted WHERE cust IS NULL
  UNION ALL SELECT row_index, 'order_date', t_order_date, 'date' FROM casted WHERE order_date IS NULL
  UNION ALL SELECT row_index, 'price', t_price, 'decimal' FROM casted WHERE price IS NULL
),
edited AS (
  SELECT * FROM casted WHERE order_id IS NOT NULL AND cust IS NOT NULL AND order_date IS NOT NULL
                         AND price IS NOT NULL AND small IS NOT NULL
),
check_rejects AS (
  SELECT row_index, 'status' AS col, 'not_null' AS chk, '' AS val, 'Value is required.' AS reason
  FROM edited WHERE status IS NULL
  UNION ALL SELECT row_index, 'priority', 'varchar_length', priority, 'Value exceeds VARCHAR(12).'
  FROM edited WHERE length(priority) > 12
  UNION ALL SELECT row_index, 'small', 'numeric_range', CAST(small AS VARCHAR), 'Value is outside TINYINT range.'
  FROM edited WHERE small > 127
),
all_rejects AS (
  SELECT 'edit' AS stage, row_index, col, 'cast_failed' AS chk, val,
         'Could not cast value to ' || typ || '.' AS reason FROM edit_rejects
  UNION ALL SELECT 'validate', row_index, col, chk, val, reason FROM check_rejects
),
clean AS (
  SELECT order_id, cust, order_date, status, priority, price, small FROM edited
  WHERE status IS NOT NULL AND length(priority) <= 12 AND small <= 127
)"""


def raw_source(spark: SparkSession, sf_dir: str) -> Source:
    return from_dataframe(orders_raw(spark, sf_dir), row_index="row_index", name="orders_raw")


def raw_frame(spark: SparkSession, sf_dir: str) -> TrackedFrame:
    return raw_source(spark, sf_dir).tracked()


def recipe_plan(spark: SparkSession, sf_dir: str) -> Plan:
    return compile_recipe(spark, RECIPE, source=raw_source(spark, sf_dir))
