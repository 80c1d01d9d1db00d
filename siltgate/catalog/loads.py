"""Table loads and the run log. Tables live in a database of the query's own, in scratch."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, SparkSession, functions as F

from siltgate.catalog.raw import EDITED_SQL, RECIPE, raw_source, recipe_plan
from siltgate.catalog.registry import query, table
from siltgate.engine import Workspace, load
from siltgate.errors import EngineError
from siltgate.plans.recipe import resolve_settings
from siltgate.plans.types import parse_schema
from siltgate.session import scratch_path, scratch_table
from siltgate.sinks import runlog
from siltgate.sinks.tables import append_rows, create_table


def own_database(spark: SparkSession) -> str:
    name = f"siltgate_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark, 'db')}'")
    return name


def workspace(spark: SparkSession) -> Workspace:
    return Workspace(rejects=scratch_path(spark, "rejects"), runs=scratch_path(spark, "runs"))


def target(table_name: str, mode: str, **options) -> dict:
    return {**RECIPE, "target": {"table": table_name, "mode": mode, **options}}


@query("table_append", f"WITH {EDITED_SQL} SELECT * FROM clean UNION ALL SELECT * FROM clean")
def table_append(spark, sf_dir):
    """Two loads into one table: the first creates it, the second passes the drift check."""
    name, space = f"{own_database(spark)}.orders_clean", workspace(spark)
    for _ in range(2):
        result = load(spark, target(name, "append"), workspace=space, source=raw_source(spark, sf_dir))
        assert result.status == "success", result.diagnostics
    return spark.table(name)


@query(
    "table_append_drift",
    f"""WITH {EDITED_SQL}, drift(position, chk, col, expected, actual) AS (VALUES
          (1, 'missing_column', 'small', NULL, NULL), (2, 'extra_column', 'note', NULL, NULL),
          (3, 'type', 'cust', 'BIGINT', 'INT'), (4, 'nullability', 'cust', 'False', 'True'),
          (5, 'type', 'priority', 'VARCHAR(12)', 'VARCHAR(20)'))
        SELECT drift.*, (SELECT count(*) FROM clean) AS rows_kept FROM drift""",
)
def table_append_drift(spark, sf_dir):
    """An append to a table of another shape reports every difference and writes nothing."""
    name = f"{own_database(spark)}.orders_clean"
    live = parse_schema(
        [
            {"name": "order_id", "type": "BIGINT", "nullable": False},
            {"name": "cust", "type": "INT"},
            {"name": "order_date", "type": "DATE"},
            {"name": "status", "type": "VARCHAR(8)", "nullable": False},
            {"name": "priority", "type": "VARCHAR(20)"},
            {"name": "price", "type": "DECIMAL(12,2)"},
            {"name": "note", "type": "TEXT"},
        ]
    )
    rows = recipe_plan(spark, sf_dir).accepted().withColumnRenamed("small", "note")
    append_rows(spark, name, live, rows, resolve_settings())
    result = load(spark, target(name, "append"), workspace=workspace(spark), source=raw_source(spark, sf_dir))
    diffs = result.diagnostics[0].details["diffs"]
    return spark.table(name).agg(F.count(F.lit(1)).alias("rows_kept")).select(F.inline(_listed(diffs)), "rows_kept")


@query(
    "table_drift_kinds",
    f"""WITH {EDITED_SQL}, drift(live, position, chk, col, expected, actual) AS (VALUES
          ('other', 1, 'engine', NULL, 'parquet', 'orc'), ('other', 2, 'charset', NULL, 'utf8', 'latin1'),
          ('other', 3, 'collation', NULL, 'UTF8_BINARY', 'UTF8_LCASE'), ('other', 4, 'missing_column', 'price', NULL, NULL),
          ('other', 5, 'extra_column', 'note', NULL, NULL), ('other', 6, 'type', 'cust', 'BIGINT', 'INT'),
          ('other', 7, 'nullability', 'cust', 'False', 'True'), ('other', 8, 'column_charset', 'status', 'utf8', 'latin1'),
          ('other', 9, 'column_collation', 'status', 'UTF8_BINARY', 'UTF8_LCASE'),
          ('moved', 1, 'column_order', NULL, 'order_id,cust,status,price', 'price,status,cust,order_id'))
        SELECT drift.*, (SELECT count(*) FROM clean) AS rows_kept FROM drift""",
)
def table_drift_kinds(spark, sf_dir):
    """Every kind of difference, as appends to two filled tables report them; both keep their rows."""
    database, rows = own_database(spark), recipe_plan(spark, sf_dir).accepted()
    declared = [
        {"name": "order_id", "type": "BIGINT", "nullable": False},
        {"name": "cust", "type": "BIGINT", "nullable": False},
        {"name": "status", "type": "TEXT"},
        {"name": "price", "type": "DECIMAL(12,2)"},
    ]
    other = [declared[0], {"name": "cust", "type": "INT"}, declared[2], {"name": "note", "type": "TEXT"}]
    foreign = resolve_settings({"engine": "orc", "charset": "latin1", "collation": "UTF8_LCASE"})
    tables = {"other": (other, foreign), "moved": (declared[::-1], resolve_settings())}
    found = []
    for name, (columns, settings) in tables.items():
        append_rows(spark, f"{database}.{name}", parse_schema(columns), rows.withColumn("note", F.col("priority")), settings)
        try:
            append_rows(spark, f"{database}.{name}", parse_schema(declared), rows, resolve_settings())
        except EngineError as error:
            diffs = error.diagnostic.details["diffs"]
        found.append(spark.table(f"{database}.{name}").agg(F.count(F.lit(1)).alias("rows_kept")).select(F.lit(name).alias("live"), F.inline(_listed(diffs)), "rows_kept"))
    return found[0].unionByName(found[1])


def _listed(diffs: list[dict]) -> Column:
    """The differences as an array of structs with their places."""

    def shown(diff: dict, side: str) -> Column:
        value = diff.get(side)
        text = ",".join(value) if isinstance(value, list) else str(value)
        return F.lit(text if side in diff else None).cast("string").alias(side)

    return F.array(
        *[
            F.struct(
                F.lit(place).alias("position"), F.lit(diff["check"]).alias("chk"), F.lit(diff.get("column")).cast("string").alias("col"),
                shown(diff, "expected"), shown(diff, "actual"),
            )
            for place, diff in enumerate(diffs, start=1)
        ]
    )


@query("table_replace", f"WITH {EDITED_SQL} SELECT * FROM clean")
def table_replace(spark, sf_dir):
    """A drifted table is replaced whole; the accepted rows are counted while they are staged."""
    name = f"{own_database(spark)}.orders_clean"
    old = parse_schema([{"name": "order_id", "type": "VARCHAR(20)"}, {"name": "old_value", "type": "TEXT"}])
    create_table(spark, name, old, resolve_settings())
    raw = raw_source(spark, sf_dir).rows().select("Order ID", F.col("cust").alias("old_value")).withColumnRenamed("Order ID", "order_id")
    raw.write.insertInto(name)
    result = load(spark, target(name, "replace"), workspace=workspace(spark), source=raw_source(spark, sf_dir))
    assert result.status == "success", result.diagnostics
    return spark.table(name)


@query(
    "load_accounting",
    f"""WITH {EDITED_SQL} SELECT (SELECT count(*) FROM raw) AS read_rows, (SELECT count(*) FROM edited) AS edited,
          (SELECT count(*) FROM clean) AS validated, (SELECT count(*) FROM clean) AS loaded, 0 AS exit_code""",
)
def load_accounting(spark, sf_dir):
    """The counts a load leaves in the run log."""
    name, space = f"{own_database(spark)}.orders_clean", workspace(spark)
    load(spark, target(name, "replace"), workspace=space, source=raw_source(spark, sf_dir))
    logged = runlog.list_runs(spark, space.runs, table=name)
    return logged.select(F.col("rows.read").alias("read_rows"), "rows.edited", "rows.validated", "rows.loaded", "exit_code")


def event_log(spark: SparkSession, sf_dir: str) -> str:
    """A run log with one record per event: user as table, event time as append time."""
    events = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    counts = ("read", "edited", "validated", "loaded", "rejected_edit", "rejected_validate")
    records = events.select(
        F.concat(F.lit("r_"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("run_id"),
        F.col("event_type").alias("recipe"),
        F.lit("default").alias("profile"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("table"),
        F.lit("append").alias("mode"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("finished_at"),
        F.col("event_id").alias("duration_ms"),
        F.struct(*[F.lit(1).cast("bigint").alias(name) for name in counts]).alias("rows"),
        F.lit(None).cast("string").alias("rejects"),
        F.array().cast("array<struct<code:string,message:string,path:string,details:string>>").alias("diagnostics"),
        F.when(failed, 20).otherwise(0).alias("exit_code"),
        F.lit(None).cast("string").alias("git_sha"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("recorded_at"),
    )
    folder = scratch_path(spark, "runs")
    runlog.append_runs(records, folder)
    return folder


LOG_SQL = """
log AS (
  SELECT 'r_' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS run_id, event_type AS recipe,
         'user_' || CAST(user_id AS VARCHAR) AS "table", event_id AS duration_ms,
         CASE WHEN event_type = 'error' THEN 20 ELSE 0 END AS exit_code, ts
  FROM events
)"""
LOG_COLUMNS = ("run_id", "recipe", "table", "duration_ms", "exit_code")
LOG_COLUMNS_SQL = 'run_id, recipe, "table", duration_ms, exit_code'


@query("run_log_latest", f"WITH {LOG_SQL} SELECT {LOG_COLUMNS_SQL} FROM log ORDER BY ts DESC, run_id DESC LIMIT 25")
def run_log_latest(spark, sf_dir):
    return runlog.list_runs(spark, event_log(spark, sf_dir), limit=25).select(*LOG_COLUMNS)


@query("run_log_by_table", f"WITH {LOG_SQL} SELECT {LOG_COLUMNS_SQL} FROM log WHERE \"table\" = 'user_8'")
def run_log_by_table(spark, sf_dir):
    return runlog.list_runs(spark, event_log(spark, sf_dir), table="user_8").select(*LOG_COLUMNS)


@query("run_log_by_id", f"WITH {LOG_SQL} SELECT {LOG_COLUMNS_SQL} FROM log WHERE run_id = 'r_000000000042'")
def run_log_by_id(spark, sf_dir):
    found = runlog.find_run(spark, event_log(spark, sf_dir), "r_000000000042")
    schema = "run_id string, recipe string, `table` string, duration_ms bigint, exit_code int"
    return spark.createDataFrame([tuple(found[name] for name in LOG_COLUMNS)], schema)


@query(
    "run_log_corrupt",
    "SELECT count(*) AS records, (SELECT count(*) FROM events WHERE event_type = 'error') AS corrupt FROM events",
)
def run_log_corrupt(spark, sf_dir):
    """A log into which something else has written lines that are not records."""
    folder = event_log(spark, sf_dir)
    broken = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("{bad "), "props").alias("value"))
    broken.write.mode("append").text(folder)
    return runlog.corrupt_lines(spark, folder)


@query(
    "run_log_newest",
    f"WITH {LOG_SQL} SELECT {LOG_COLUMNS_SQL} FROM log QUALIFY row_number() OVER (PARTITION BY \"table\" ORDER BY ts DESC, run_id DESC) = 1",
)
def run_log_newest(spark, sf_dir):
    return runlog.newest_runs(spark, event_log(spark, sf_dir)).select(*LOG_COLUMNS)


@query(
    "run_log_compacted",
    f"""WITH {LOG_SQL} SELECT {LOG_COLUMNS_SQL} FROM log
        UNION ALL SELECT run_id || '_again', recipe, "table", duration_ms, exit_code FROM log WHERE recipe = 'error'
        UNION ALL SELECT run_id || '_late', recipe, "table", duration_ms, exit_code FROM log WHERE recipe = 'error'""",
)
def run_log_compacted(spark, sf_dir):
    """A log compacted twice, with records added before each compaction and after the last."""
    folder = event_log(spark, sf_dir)
    errors = runlog.run_records(spark, folder).where("recipe = 'error'")
    added = [
        scratch_table(errors.withColumn("run_id", F.concat("run_id", F.lit(suffix))).select(*runlog.run_schema().names), "runs")
        for suffix in ("_again", "_late")
    ]
    for records in added:
        runlog.compact_runs(spark, folder)
        runlog.append_runs(records, folder)
    return runlog.list_runs(spark, folder).select(*LOG_COLUMNS)
