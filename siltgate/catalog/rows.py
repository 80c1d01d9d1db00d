"""Row checks, reject rows, accounting and diagnostics over the raw orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltgate.catalog.raw import EDITED_SQL, RECIPE, raw_source, recipe_plan
from siltgate.catalog.registry import query
from siltgate.engine import Plan, compile_recipe
from siltgate.operators.accounting import row_accounting
from siltgate.operators.rejects import read_manifest, read_rejects, reject_report, write_rejects
from siltgate.operators.tracked import ROW_INDEX
from siltgate.session import scratch_path

METADATA = {"__stage": "stage", ROW_INDEX: "row_index", "__column": "col", "__check": "chk", "__value": "val", "__reason": "reason"}
METADATA_SQL = "stage, row_index, col, chk, val, reason"


def plain_names(rejects: DataFrame) -> DataFrame:
    return rejects.select(*[F.col(name).alias(plain) for name, plain in METADATA.items()])


def one_check(plan: Plan, check: str) -> DataFrame:
    return plain_names(plan.rejects().where(F.col("__check") == check)).drop("stage", "chk")


def check_sql(check: str) -> str:
    return f"WITH {EDITED_SQL} SELECT row_index, col, val, reason FROM check_rejects WHERE chk = '{check}'"


@query("check_not_null", check_sql("not_null"))
def check_not_null(spark, sf_dir):
    return one_check(recipe_plan(spark, sf_dir), "not_null")


@query("check_varchar_length", check_sql("varchar_length"))
def check_varchar_length(spark, sf_dir):
    return one_check(recipe_plan(spark, sf_dir), "varchar_length")


@query("check_numeric_range", check_sql("numeric_range"))
def check_numeric_range(spark, sf_dir):
    return one_check(recipe_plan(spark, sf_dir), "numeric_range")


@query(
    "validate_rejects",
    f"""WITH {EDITED_SQL} SELECT raw.*, stage, col, chk, val, reason FROM all_rejects JOIN raw USING (row_index)""",
)
def validate_rejects(spark, sf_dir):
    """Every reject of both stages, beside its row as the source had it."""
    rejects = recipe_plan(spark, sf_dir).rejects().withColumnRenamed("Order ID", "order_id")
    return rejects.withColumnsRenamed(METADATA)


@query("validate_clean", f"WITH {EDITED_SQL} SELECT * FROM clean")
def validate_clean(spark, sf_dir):
    """Accepted rows in declared order."""
    return recipe_plan(spark, sf_dir).accepted()


@query(
    "row_accounting",
    f"""WITH {EDITED_SQL}, n AS (
          SELECT (SELECT count(*) FROM raw) AS read_rows,
                 (SELECT count(DISTINCT row_index) FROM edit_rejects) AS rejected_edit,
                 (SELECT count(DISTINCT row_index) FROM check_rejects) AS rejected_validate)
        SELECT read_rows AS "read", read_rows - rejected_edit AS edited,
               read_rows - rejected_edit - rejected_validate AS validated, rejected_edit, rejected_validate,
               CAST(rejected_edit + rejected_validate AS DOUBLE) / read_rows AS reject_ratio,
               CASE WHEN CAST(rejected_edit + rejected_validate AS DOUBLE) / read_rows > 0.9 THEN 20 ELSE 0 END AS result_code
        FROM n""",
)
def accounting(spark, sf_dir):
    plan = recipe_plan(spark, sf_dir)
    return row_accounting(plan.frame, plan.settings.reject_threshold, has_diagnostics=bool(plan.diagnostics))


@query(
    "row_accounting_gate",
    f"""WITH {EDITED_SQL} SELECT t.threshold,
          CASE WHEN (SELECT count(DISTINCT row_index) FROM all_rejects)::DOUBLE / (SELECT count(*) FROM raw) > t.threshold
               THEN 20 ELSE 0 END AS result_code
        FROM (VALUES (0.0::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) t(threshold)""",
)
def accounting_gate(spark, sf_dir):
    """The code the same rows lead to under three thresholds."""
    plan = recipe_plan(spark, sf_dir)
    gates = [
        row_accounting(plan.frame, limit).select(F.lit(limit).alias("threshold"), "result_code") for limit in (0.0, 0.9, 1.0)
    ]
    return gates[0].union(gates[1]).union(gates[2])


@query(
    "reject_report",
    f"WITH {EDITED_SQL} SELECT stage, col, chk, count(*) AS rejects FROM all_rejects GROUP BY stage, col, chk",
)
def report(spark, sf_dir):
    return reject_report(recipe_plan(spark, sf_dir).frame).withColumnsRenamed(METADATA)


@query(
    "reject_file",
    f"WITH {EDITED_SQL} SELECT CAST(row_index AS VARCHAR) AS row_index, stage, col, chk, val, reason FROM all_rejects",
)
def reject_file(spark, sf_dir):
    """Rejects written as CSV and read back as text."""
    folder = write_rejects(recipe_plan(spark, sf_dir).frame, scratch_path(spark, "rejects"))
    return plain_names(read_rejects(spark, folder))


@query(
    "reject_manifest",
    f"""WITH {EDITED_SQL} SELECT count(*) AS rejects, min(row_index) AS first_row, max(row_index) AS last_row, 0 AS misplaced
        FROM all_rejects""",
)
def reject_manifest(spark, sf_dir):
    """What the manifest of a reject folder tells, and how many rejects its files hold outside the rows it names."""
    folder = write_rejects(recipe_plan(spark, sf_dir).frame, scratch_path(spark, "rejects"))
    manifest, number = read_manifest(spark, folder), F.col(ROW_INDEX).cast("bigint")
    held = spark.read.options(header=True, quote='"', escape='"').csv(folder).select(F.col("_metadata.file_name").alias("part"), number.alias("n"))
    named = held.join(manifest, "part", "left")
    astray = named.agg(F.count_if(~F.coalesce(F.col("n").between(F.col("first_row"), F.col("last_row")), F.lit(False))).alias("n")).first().n
    return manifest.agg(
        F.sum("rows").alias("rejects"), F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), F.lit(astray).alias("misplaced")
    )


DRIFTED_SCHEMA = [
    {"name": "missing_too", "type": "INT"},
    *[{**column, "name": "status_code"} if column["name"] == "status" else column for column in RECIPE["schema"]],
]


@query(
    "schema_diagnostics",
    """WITH diagnostics(position, code, col) AS (VALUES
         (1, 'schema.extra_source_column', 'status'), (2, 'schema.missing_source_column', 'missing_too'),
         (3, 'schema.missing_source_column', 'status_code'))
       SELECT position, code, col, (SELECT count(*) FROM orders) AS source_rows FROM diagnostics""",
)
def schema_diagnostics(spark, sf_dir):
    """Findings about the columns of the edited data, with the number of rows they hold back."""
    return _diagnosed(compile_recipe(spark, {**RECIPE, "schema": DRIFTED_SCHEMA}, source=raw_source(spark, sf_dir)))


@query(
    "schema_diagnostics_types",
    """WITH diagnostics(position, code, col) AS (VALUES
         (1, 'schema.type_mismatch', 'order_id'), (2, 'schema.type_mismatch', 'cust'), (3, 'schema.type_mismatch', 'order_date'),
         (4, 'schema.type_mismatch', 'price'), (5, 'schema.type_mismatch', 'small'))
       SELECT position, code, col, (SELECT count(*) FROM orders) AS source_rows FROM diagnostics""",
)
def schema_diagnostics_types(spark, sf_dir):
    """Without casts every declared number or date still meets text."""
    edits = [edit for edit in RECIPE["edits"] if "cast" not in edit]
    return _diagnosed(compile_recipe(spark, {**RECIPE, "edits": edits}, source=raw_source(spark, sf_dir)))


def _diagnosed(plan: Plan) -> DataFrame:
    found = F.array(
        *[
            F.struct(F.lit(place).alias("position"), F.lit(d.code).alias("code"), F.lit(d.details["column"]).alias("col"))
            for place, d in enumerate(plan.diagnostics, start=1)
        ]
    )
    counts = row_accounting(plan.frame, plan.settings.reject_threshold, has_diagnostics=True)
    return counts.select(F.inline(found), F.col("read").alias("source_rows"))
