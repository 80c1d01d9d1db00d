"""Declared types, recipes, settings, names: plan checks that need no job."""

from __future__ import annotations

import pytest

from siltgate import Recipe, resolve_settings
from pyspark.sql import functions as F

from siltgate.functions.naming import companion_name, distinct_names, quoted, recipe_name, safe_name, safe_name_column, safe_names, split_identifier
from siltgate.plans.types import normal_type, parse_schema, parse_type
from siltgate.sinks.runlog import mask_secrets


def minimal(**changes):
    recipe = {
        "name": "gauges",
        "source": {"path": "gauges.csv", "encoding": "utf-8", "delimiter": ","},
        "target": {"table": "gauges", "mode": "append"},
        "schema": [{"name": "gauge", "type": "BIGINT"}],
    }
    return {**recipe, **changes}


@pytest.mark.parametrize(
    "text, kind, shown",
    [
        ("bigint", "BIGINT", "BIGINT"),
        (" Varchar(16) ", "VARCHAR", "VARCHAR(16)"),
        ("decimal( 12 , 2 )", "DECIMAL", "DECIMAL(12,2)"),
        ("DATETIME", "DATETIME", "DATETIME"),
        ("boolean", "BOOLEAN", "BOOLEAN"),
    ],
)
def test_types_are_read_in_any_case(text, kind, shown):
    parsed = parse_type(text)
    assert (parsed.kind, parsed.text) == (kind, shown)


@pytest.mark.parametrize(
    "text",
    ["JSON", "INT(11)", "VARCHAR", "VARCHAR(0)", "VARCHAR(x)", "DECIMAL", "DECIMAL(5)", "DECIMAL(5,6)", "DECIMAL(0,0)",
     "DECIMAL(39,2)", "", None, 7, "VARCHAR(3", "TEXT()"],
)
def test_other_types_are_refused(text, code):
    assert code(parse_type, text) == "schema.unsupported_type"


def test_schema_entries_are_checked(code):
    assert code(parse_schema, []) == "schema.invalid"
    assert code(parse_schema, ["x"]) == "schema.invalid"
    assert code(parse_schema, [{"name": "a", "type": "INT", "size": 3}]) == "recipe.unknown_key"
    assert code(parse_schema, [{"name": "a", "type": "INT"}, {"name": "a", "type": "INT"}]) == "schema.duplicate_column"
    assert code(parse_schema, [{"name": "a", "type": "INT", "nullable": "no"}]) == "schema.invalid"
    (column,) = parse_schema([{"name": "a", "type": "INT"}])
    assert column.nullable


@pytest.mark.parametrize(
    "changes, expected",
    [
        ({"extra": 1}, "recipe.unknown_key"),
        ({"source": {"path": "a.csv", "sep": ";"}}, "recipe.unknown_key"),
        ({"source": {"path": ""}}, "recipe.invalid"),
        ({"source": {"path": "a.csv", "header_row": 0}}, "recipe.invalid"),
        ({"source": {"path": "a.csv", "skip_rows": True}}, "recipe.invalid"),
        ({"target": {"table": "t", "mode": "upsert"}}, "recipe.invalid"),
        ({"edits": [{"rename": {}, "drop": []}]}, "recipe.invalid"),
        ({"edits": [{"split": {}}]}, "recipe.unknown_edit_op"),
        ({"edits": {"rename": {}}}, "recipe.invalid"),
        ({"options": {"reject_threshold": 1.5}}, "recipe.invalid"),
        ({"options": {"reject_threshold": True}}, "recipe.invalid"),
        ({"options": {"batch_size": 0}}, "recipe.invalid"),
    ],
)
def test_recipe_sections_are_checked(changes, expected, code):
    assert code(Recipe.from_dict, minimal(**changes)) == expected


def test_recipe_needs_its_sections(code):
    for key in ("name", "source", "target", "schema"):
        raw = minimal()
        del raw[key]
        assert code(Recipe.from_dict, raw) == "recipe.invalid"
    assert code(Recipe.from_dict, "text") == "recipe.invalid"


def test_recipe_survives_a_round_trip():
    recipe = Recipe.from_dict(minimal(edits=[{"trim": ["gauge"]}], options={"reject_threshold": 0}))
    assert Recipe.from_dict(recipe.to_dict()) == recipe


def test_settings_come_from_the_nearest_layer(code):
    recipe = Recipe.from_dict(
        minimal(target={"table": "t", "mode": "append", "profile": "recipe", "engine": "orc"}, options={"batch_size": 250})
    )
    project = {"profile": "project", "batch_size": 100, "reject_threshold": 0.25, "collation": "UTF8_LCASE"}
    settings = resolve_settings(project, recipe, {"profile": "call"})
    assert settings.profile == "call"
    assert settings.batch_size == 250
    assert settings.reject_threshold == 0.25
    assert (settings.engine, settings.collation) == ("orc", "UTF8_LCASE")
    assert code(resolve_settings, {"colour": "red"}) == "config.unknown_key"
    assert code(resolve_settings, {"batch_size": 0}) == "config.invalid"


def test_safe_names_keep_usable_ones_and_part_the_rest():
    assert safe_names(["Company ID", "Company Name", "1st Value"]) == ["company_id", "company_name", "col_1st_value"]
    assert safe_names(["a", "A", "a "]) == ["a", "A_2", "a_3"]
    assert safe_names(["__", "***"]) == ["column", "column_2"]
    long = safe_names(["x" * 80, "x" * 90])
    assert long == ["x" * 64, "x" * 62 + "_2"]
    assert safe_names(["Émile"]) == ["mile"]
    assert safe_names(["___", "id\n"]) == ["column", "id"]


def test_native_names_are_those_of_the_list_form(spark):
    names = ["Company ID", "1st", "___", "id\n", "_x_", "", "Émile", "a" * 70, "a" * 63 + "_b", "x y\r\n", "A_b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(safe_name_column(F.col("n"))).collect()
    assert [r[0] for r in rows] == [safe_name(n) for n in names]


def test_table_names_differ_from_each_other():
    assert distinct_names(["a", "a", "a_2", "A"]) == ["a", "a_2", "a_2_2", "A_3"]
    assert recipe_name(" Sales 2024 (final) ") == "sales_2024_final"
    assert recipe_name("***") == "recipe"


def test_identifiers_are_one_or_two_safe_names(code):
    assert split_identifier("db.t") == ("db", "t")
    assert quoted("db.t") == "`db`.`t`"
    for text in ("", "a.b.c", "a`b", "a;b", "1a", "a.", "x" * 65, None):
        assert code(split_identifier, text) == "mysql.invalid_identifier"


def test_companion_names_stay_within_the_limit(code):
    run_id = "r_2026_05_19T12_00_00Z_abcd"
    name = companion_name("analytics." + "x" * 60, "staging", run_id)
    assert name.startswith("analytics.x") and name.endswith(f"__siltgate_staging__{run_id}")
    assert len(name.split(".")[1]) == 64
    assert code(companion_name, "t", "spare", run_id) == "mysql.invalid_companion_table"
    assert code(companion_name, "t", "backup", "r" * 60) == "mysql.invalid_companion_table"


@pytest.mark.parametrize(
    "text, normal",
    [("bigint(20)", "BIGINT"), ("TINYINT(1)", "TINYINT(1)"), ("tinyint(4)", "TINYINT"), ("boolean", "TINYINT(1)"),
     ("varchar (16)", "VARCHAR(16)"), ("decimal( 12 , 2)", "DECIMAL(12,2)"), ("text", "TEXT"), ("int", "INT")],
)
def test_type_spellings_are_normalised(text, normal):
    assert normal_type(text) == normal


def test_passwords_are_masked():
    text = mask_secrets("jdbc://bob:pw1@host/db Password = hunter2;")
    assert "pw1" not in text and "hunter2" not in text and "bob" in text
    shown = mask_secrets('{"api_key": "k1", "table": "t", "db_pwd": "k2", "at": "s3a://u:k3@h/p?token=k4&n=1"}')
    assert not any(key in shown for key in ("k1", "k2", "k3", "k4")) and '"t"' in shown and "n=1" in shown
