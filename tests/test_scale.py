"""Plans and runs that must hold at any size: no shuffle, no Python, no repeated casts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltgate import Workspace, load, validate
from siltgate.catalog.raw import RECIPE, orders_raw, recipe_plan
from siltgate.catalog.registry import table
from siltgate.operators.rejects import found_rejects, reject_report
from siltgate.sources.delimited import read_delimited
from siltgate.sources.tables import from_dataframe, read_parquet

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_accepted_rows_need_no_shuffle(spark):
    plan = plan_of(recipe_plan(spark, SF_DIR).accepted())
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


def test_a_cast_is_evaluated_once_per_row(spark):
    plan = recipe_plan(spark, SF_DIR)
    assert plan_of(plan.accepted()).count("M/d/yyyy") == 1
    assert plan_of(found_rejects(plan.frame)).count("M/d/yyyy") == 1


def test_rejects_are_found_without_a_shuffle(spark):
    plan = plan_of(found_rejects(recipe_plan(spark, SF_DIR).frame))
    assert "Exchange" not in plan and "Python" not in plan


def test_reports_shuffle_one_row_per_task(spark):
    plan = plan_of(reject_report(recipe_plan(spark, SF_DIR).frame))
    assert "partial_count" in plan and "Python" not in plan


def test_scans_read_only_the_columns_in_use(spark):
    source = read_parquet(spark, f"{SF_DIR}/lineitem.parquet")
    frame = source.tracked()
    assert "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in plan_of(frame.live_rows(["l_orderkey", "l_tax"]))


def test_records_of_one_line_are_read_in_splits(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,v\n" + "".join(f"{i},x\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        source = read_delimited(spark, str(path), encoding="utf-8", delimiter=",")
        assert source.df.rdd.getNumPartitions() > 5
        assert "Python" not in plan_of(source.rows())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_hot_value_changes_no_result(spark):
    """A third of all rows share one value and fail one check; every one is reported."""
    df = spark.range(30_000).select(
        (F.col("id") + 1).alias("i"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v")
    )
    recipe = {
        "name": "hot", "source": {"path": "x.csv"}, "target": {"table": "t", "mode": "append"},
        "schema": [{"name": "v", "type": "BIGINT"}], "edits": [{"cast": {"v": {"type": "int"}}}],
        "options": {"reject_threshold": 0.5},
    }
    result = validate(spark, recipe, source=from_dataframe(df, row_index="i"))
    assert (result.rows["rejected_edit"], result.rows["validated"], result.result_code) == (10_000, 20_000, 0)
    assert result.plan.rejects().select("__row_index").distinct().count() == 10_000


@pytest.mark.parametrize("mode", ["append", "replace"])
def test_loads_of_nothing_and_of_rejects_only(spark, tmp_path, mode):
    space = Workspace(str(tmp_path / "rejects"), str(tmp_path / "runs"))
    raw = orders_raw(spark, SF_DIR)
    for name, rows, expected in (("none", raw.where("false"), 0), ("bad", raw.where("cust = 'bad'"), 20)):
        recipe = {**RECIPE, "target": {"table": f"t_{mode}_{name}", "mode": mode}}
        result = load(spark, recipe, workspace=space, source=from_dataframe(rows, row_index="row_index"))
        assert result.result_code == expected
        assert result.rows["read"] == rows.count() and result.rows["loaded"] == (0 if expected == 0 else None)


def test_row_numbers_of_stored_tables_match_their_order(spark):
    source = read_parquet(spark, f"{SF_DIR}/orders.parquet")
    frame = source.tracked()
    numbered = frame.numbering.number(frame.df)
    assert numbered.where(F.col("__row_index") != frame.value("o_orderkey") + 1).count() == 0
    assert numbered.count() == table(spark, SF_DIR, "orders").count()
