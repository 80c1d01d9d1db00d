"""Edits other than casts, one query each, and a whole sequence of them."""

from __future__ import annotations

from siltgate.catalog.raw import EDITED_SQL, ORDERS_RAW_SQL, raw_frame, recipe_plan
from siltgate.catalog.registry import query, table
from siltgate.operators.edits import apply_edits
from siltgate.sources.tables import from_dataframe
from pyspark.sql import functions as F


@query(
    "edit_rename",
    "SELECT n_nationkey + 1 AS row_no, n_regionkey AS n_nationkey, n_nationkey AS n_regionkey, n_name AS nation FROM nation",
)
def edit_rename(spark, sf_dir):
    """Simultaneous renames: two columns trade names."""
    nation = table(spark, sf_dir, "nation").withColumn("row_no", F.col("n_nationkey").cast("bigint") + 1)
    frame = from_dataframe(nation.withColumn("i", F.col("row_no")), row_index="i").tracked()
    swap = {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey", "n_name": "nation"}
    return apply_edits(frame, [{"rename": swap}]).live_rows()


@query("edit_drop", f"WITH {ORDERS_RAW_SQL} SELECT order_id, cust, order_date, status, priority FROM raw")
def edit_drop(spark, sf_dir):
    edits = [{"rename": {"Order ID": "order_id"}}, {"drop": ["price", "active", "small"]}]
    return apply_edits(raw_frame(spark, sf_dir), edits).live_rows()


@query(
    "edit_trim",
    f"""WITH {ORDERS_RAW_SQL} SELECT order_id, regexp_replace(priority, '^\\s+|\\s+$', '', 'g') AS priority,
        regexp_replace(active, '^\\s+|\\s+$', '', 'g') AS active FROM raw""",
)
def edit_trim(spark, sf_dir):
    edits = [{"rename": {"Order ID": "order_id"}}, {"trim": ["priority", "active"]}]
    return apply_edits(raw_frame(spark, sf_dir), edits).live_rows(["order_id", "priority", "active"])


@query(
    "edit_trim_documents",
    "SELECT doc_id, regexp_replace(text, '^[\\s\\v]+|[\\s\\v]+$', '', 'g') AS text FROM documents",
)
def edit_trim_documents(spark, sf_dir):
    """The same trim over whole document texts."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") + 1).alias("i"))
    return apply_edits(from_dataframe(documents, row_index="i").tracked(), [{"trim": ["text"]}]).live_rows()


@query(
    "edit_parse_null",
    f"""WITH {ORDERS_RAW_SQL} SELECT order_id, CASE WHEN status IN ('', 'N/A') THEN NULL ELSE status END AS status,
        CASE WHEN active IN ('', 'N/A') THEN NULL ELSE active END AS active FROM raw""",
)
def edit_parse_null(spark, sf_dir):
    edits = [
        {"rename": {"Order ID": "order_id"}},
        {"parse_null": {"columns": ["status", "active"], "values": ["", "N/A"]}},
    ]
    return apply_edits(raw_frame(spark, sf_dir), edits).live_rows(["order_id", "status", "active"])


@query(
    "edit_fill_null",
    f"""WITH {ORDERS_RAW_SQL} SELECT order_id, CASE WHEN status IN ('', 'N/A') THEN 'UNKNOWN' ELSE status END AS status,
        coalesce(CASE WHEN small = '7' THEN NULL ELSE CAST(small AS BIGINT) END, -1) AS small FROM raw""",
)
def edit_fill_null(spark, sf_dir):
    edits = [
        {"rename": {"Order ID": "order_id"}},
        {"parse_null": {"columns": ["status"], "values": ["", "N/A"]}},
        {"parse_null": {"columns": ["small"], "values": ["7"]}},
        {"cast": {"small": {"type": "int"}}},
        {"fill_null": {"status": "UNKNOWN", "small": -1}},
    ]
    return apply_edits(raw_frame(spark, sf_dir), edits).live_rows(["order_id", "status", "small"])


@query(
    "edit_sequence",
    f"WITH {EDITED_SQL} SELECT order_id, cust, order_date, status, priority, price, small FROM edited",
)
def edit_sequence(spark, sf_dir):
    """All edits of the recipe, without its row checks."""
    plan = recipe_plan(spark, sf_dir)
    return apply_edits(raw_frame(spark, sf_dir), plan.recipe.edits, plan.recipe.schema).live_rows()
