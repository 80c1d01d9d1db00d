"""Edits and casts on small frames, with the rows expected in full."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from siltgate.functions.casting import translate_format
from siltgate.operators.edits import apply_edits
from siltgate.operators.rejects import ordered_rejects, read_manifest, read_rejects, reject_rows, write_rejects
from siltgate.plans.types import parse_schema


def rows(frame):
    return [row.asDict() for row in frame.live_rows().collect()]


def rejects(frame):
    return [(r["__row_index"], r["__column"], r["__check"], r["__value"]) for r in ordered_rejects(frame).collect()]


def test_each_edit_sees_what_those_before_it_left(frame):
    blanks = {"trim": ["depth"]}
    nulls = {"parse_null": {"columns": ["depth"], "values": ["n/a"]}}
    filled = {"fill_null": {"depth": "0"}}

    def depths(*edits):
        return [r["depth"] for r in rows(apply_edits(frame([(" n/a",), ("7 ",), (None,)], "depth string"), list(edits)))]

    assert depths(blanks, nulls, filled) == ["0", "7", "0"]
    assert depths(nulls, blanks, filled) == ["n/a", "7", "0"]  # the blank hid the null text
    assert depths(filled, blanks, nulls) == [None, "7", "0"]
    moved = apply_edits(frame([("x", "y")], "left string, right string"), [{"drop": ["left"]}, {"rename": {"right": "left"}}])
    assert rows(moved) == [{"left": "y"}] and rejects(moved) == []


def test_rename_swaps_and_refuses_clashes(frame, code):
    start = frame([("1", "2")], "a string, b string")
    assert rows(apply_edits(start, [{"rename": {"a": "b", "b": "a"}}])) == [{"b": "1", "a": "2"}]
    assert code(apply_edits, start, [{"rename": {"a": "b"}}]) == "edit.rename_collision"
    assert code(apply_edits, start, [{"rename": {"a": "x", "b": "x"}}]) == "edit.rename_collision"
    assert code(apply_edits, start, [{"rename": {"z": "y"}}]) == "edit.missing_column"
    assert code(apply_edits, start, [{"rename": {"a": "__row_index"}}]) == "edit.reserved_column"
    assert code(apply_edits, start, [{"rename": {}}]) == "edit.invalid"


def test_names_may_differ_by_case_or_hold_dots(frame):
    start = frame([("1", "2")], "`a.b` string, c string")
    assert rows(apply_edits(start, [{"rename": {"c": "A.B"}}, {"trim": ["a.b"]}]))[0] == {"a.b": "1", "A.B": "2"}


def test_edit_specs_are_checked(frame, code):
    start = frame([("1", 2)], "a string, n bigint")
    for edit, expected in [
        ({"drop": ["missing"]}, "edit.missing_column"),
        ({"drop": "a"}, "edit.invalid"),
        ({"trim": ["n"]}, "edit.type_mismatch"),
        ({"parse_null": {"columns": ["a"], "values": [1]}}, "edit.invalid"),
        ({"parse_null": {"columns": ["a"], "values": [], "x": 1}}, "edit.unknown_key"),
        ({"parse_null": {"columns": ["n"], "values": [""]}}, "edit.type_mismatch"),
        ({"fill_null": {"n": "x"}}, "edit.type_mismatch"),
        ({"fill_null": {"z": "x"}}, "edit.missing_column"),
        ({"cast": {}}, "edit.invalid"),
        ({"cast": {"a": {"type": "uuid"}}}, "edit.invalid"),
        ({"cast": {"a": {"type": "int", "base": 16}}}, "edit.unknown_key"),
        ({"cast": {"a": {"type": "decimal"}}}, "edit.invalid"),
        ({"cast": {"a": {"type": "decimal", "precision": 4, "scale": 5}}}, "edit.invalid"),
        ({"cast": {"a": {"type": "date", "format": 3}}}, "edit.invalid"),
        ({"cast": {"a": {"type": "date", "format": "%Q"}}}, "edit.invalid"),
        ({"cast": {"a": {"type": "date", "format": "%H:%M"}}}, "edit.invalid"),
        ({"cast": {"n": {"type": "date", "format": "%Y-%m-%d"}}}, "edit.type_mismatch"),
        ({"explode": ["a"]}, "edit.unknown_op"),
    ]:
        assert code(apply_edits, start, [edit]) == expected, edit
    schema = parse_schema([{"name": "a", "type": "VARCHAR(16)"}])
    assert code(apply_edits, start, [{"cast": {"a": {"type": "int"}}}], schema) == "schema.type_mismatch"


def test_empty_lists_change_nothing(frame):
    start = frame([(" x ",)], "a string")
    done = apply_edits(start, [{"drop": []}, {"trim": []}, {"parse_null": {"columns": ["a"], "values": []}}])
    assert rows(done) == [{"a": " x "}]


def test_trim_takes_all_white_space(frame):
    start = frame([(" \t x y \n",), ("",), (None,)], "a string")
    assert [r["a"] for r in rows(apply_edits(start, [{"trim": ["a"]}]))] == ["x y", "", None]


def test_failed_casts_reject_the_row_once_per_value(frame):
    casts = {"level": {"type": "int"}, "seen": {"type": "date", "format": "%d.%m.%Y"}, "open": {"type": "boolean"}}
    good, one, two = ("-4", "29.02.2024", "false"), ("12", "29.02.2023", "true"), ("4.5", "31.12.1999", "open")
    done = apply_edits(frame([one, good, two], "level string, seen string, open string"), [{"cast": casts}])
    assert rows(done) == [{"level": -4, "seen": dt.date(2024, 2, 29), "open": False}]
    assert sorted(rejects(done)) == [
        (1, "seen", "cast_failed", "29.02.2023"), (3, "level", "cast_failed", "4.5"), (3, "open", "cast_failed", "open"),
    ]
    kept = {tuple(r[name] for name in casts) for r in reject_rows(done).collect()}
    assert kept == {one, two}  # cells that could be cast keep their first form too


def test_rows_removed_by_one_cast_are_unseen_by_the_next(frame):
    start = frame([("x", "y"), ("1", "y"), ("1", "2")], "a string, b string")
    done = apply_edits(start, [{"cast": {"a": {"type": "int"}}}, {"cast": {"b": {"type": "int"}}}])
    assert rejects(done) == [(1, "a", "cast_failed", "x"), (2, "b", "cast_failed", "y")]
    assert rows(done) == [{"a": 1, "b": 2}]


def test_rejects_keep_the_source_row_and_the_value_before_the_cast(frame):
    start = frame([(" x ", "n")], "`First Name` string, other string")
    done = apply_edits(
        start, [{"rename": {"First Name": "a"}}, {"drop": ["other"]}, {"trim": ["a"]}, {"cast": {"a": {"type": "int"}}}]
    )
    (row,) = reject_rows(done).collect()
    assert (row["First Name"], row["other"], row["__column"], row["__value"]) == (" x ", "n", "a", "x")


def test_decimal_takes_its_size_from_the_schema(frame):
    start = frame([("12.34",), ("1234.56",), (None,)], "amount string")
    done = apply_edits(start, [{"cast": {"amount": {"type": "decimal"}}}], parse_schema([{"name": "amount", "type": "DECIMAL(5,2)"}]))
    assert [r["amount"] for r in rows(done)] == [Decimal("12.34"), None]
    assert rejects(done) == [(2, "amount", "cast_failed", "1234.56")]


@pytest.mark.parametrize(
    "target, text, value",
    [
        ("int", "001", 1), ("int", "+5", 5), ("int", "-9223372036854775808", -(2**63)), ("int", "9223372036854775808", None),
        ("int", " 1", None), ("int", "1.5", None), ("int", "1e3", None), ("int", "", None),
        ("float", "1e3", 1000.0), ("float", ".5", 0.5), ("float", "5.", 5.0), ("float", "1d", None), ("float", " 1", None),
        ("float", "inf", float("inf")), ("float", "1_0", None),
        ("boolean", " Yes ", True), ("boolean", "0", False), ("boolean", "N", False), ("boolean", "t", None), ("boolean", "on", None),
        ("date", "2024-01-02", dt.date(2024, 1, 2)), ("date", "2024-1-2", None), ("date", "2024", None), ("date", "2023-02-29", None),
        ("datetime", "2024-01-02", dt.datetime(2024, 1, 2)), ("datetime", "2024-01-02T03:04:05.5", dt.datetime(2024, 1, 2, 3, 4, 5, 500000)),
        ("datetime", "2024-01-02 03:04", dt.datetime(2024, 1, 2, 3, 4)), ("datetime", "2024-01-02 25:00:00", None),
        ("string", "x", "x"),
    ],
)
def test_text_grammars(frame, target, text, value):
    start = frame([(text,)], "a string")
    done = apply_edits(start, [{"cast": {"a": {"type": target}}}])
    assert done.df.select(done.value("a")).first()[0] == value


@pytest.mark.parametrize(
    "form, text, value",
    [
        ("%m/%d/%Y", "1/2/2024", dt.datetime(2024, 1, 2)),
        ("%m/%d/%Y", "02/30/2024", None),
        ("%Y%m%d", "20240102", dt.datetime(2024, 1, 2)),
        ("%Y%m%d%H%M%S", "20240102030405", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("%d/%m/%y", "31/12/69", dt.datetime(2069, 12, 31)),
        ("%d/%m/%y", "31/12/70", dt.datetime(1970, 12, 31)),
        ("%d/%m/%y", "29/02/96", dt.datetime(1996, 2, 29)),
        ("%d %b %Y", "5 Jan 2024", dt.datetime(2024, 1, 5)),
        ("%B %d, %Y", "January 5, 2024", dt.datetime(2024, 1, 5)),
        ("%Y-%m-%dT%H:%M:%S", "2024-01-02T03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("%F %T", "2024-01-02 03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("%F %I:%M %p", "2024-01-02 03:04 PM", dt.datetime(2024, 1, 2, 15, 4)),
        ("%Y %j", "2024 032", dt.datetime(2024, 2, 1)),
        ("%Y-%m-%d %H:%M:%S.%f", "2024-01-02 03:04:05.25", dt.datetime(2024, 1, 2, 3, 4, 5, 250000)),
        ("100%% of %Y-%m-%d's", "100% of 2024-01-02's", dt.datetime(2024, 1, 2)),
        ("%m/%d/%Y", "1/2/2024 ", None),
    ],
)
def test_date_formats(frame, form, text, value):
    start = frame([(text,)], "a string")
    done = apply_edits(start, [{"cast": {"a": {"type": "datetime", "format": form}}}])
    assert done.df.select(done.value("a")).first()[0] == value
    dated = apply_edits(start, [{"cast": {"a": {"type": "date", "format": form}}}])
    assert dated.df.select(dated.value("a")).first()[0] == (value and value.date())


def test_formats_translate_to_patterns():
    assert translate_format("%m/%d/%Y").spark == "M/d/yyyy"
    assert translate_format("%Y%m%d").spark == "yyyyMMdd"
    assert translate_format("%d.%m.%y").short_year


def test_typed_values_cast_too(frame):
    start = frame([(1, 2.9, True, dt.date(2024, 1, 2)), (3, float("nan"), False, None)], "i int, f double, b boolean, d date")
    done = apply_edits(
        start,
        [{"cast": {"i": {"type": "string"}, "f": {"type": "int"}, "b": {"type": "int"}, "d": {"type": "datetime"}}}],
    )
    assert rows(done) == [{"i": "1", "f": 2, "b": 1, "d": dt.datetime(2024, 1, 2)}]
    assert rejects(done) == [(2, "f", "cast_failed", "nan")]


def test_reject_files_hold_text_as_it_was(frame, spark, tmp_path):
    start = frame([(' "q", x ', None, 12345678.5)], "a string, b string, c double")
    done = apply_edits(start, [{"cast": {"a": {"type": "int"}}}])
    folder = write_rejects(done, str(tmp_path / "rejects"))
    back = spark.read.options(header=True, quote='"', escape='"').csv(folder).first().asDict()
    assert back["a"] == ' "q", x ' and back["b"] is None and back["c"] == "12345678.5"
    assert back["__row_index"] == "1" and back["__reason"] == "Could not cast value to int."


def test_a_manifest_names_the_rows_of_each_reject_file(frame, spark, tmp_path):
    start = frame([("x\ny",), ("1",), ("z",)] * 40, "a string")
    folder = write_rejects(apply_edits(start, [{"cast": {"a": {"type": "int"}}}]), str(tmp_path / "rejects"))
    bad = [n for n in range(1, 121) if n % 3 != 2]
    held = read_rejects(spark, folder).selectExpr("_metadata.file_name AS part", "int(__row_index) AS n", "a", "__value AS v").collect()
    assert sorted(r.n for r in held) == bad and all(r.a == r.v == ("x\ny" if r.n % 3 == 1 else "z") for r in held)
    for part in read_manifest(spark, folder).collect():
        numbers = [r.n for r in held if r.part == part.part]
        assert (part.rows, part.first_row, part.last_row) == (len(numbers), min(numbers), max(numbers)) and numbers == sorted(numbers)


def test_no_rejects_leave_an_empty_manifest(frame, spark, tmp_path):
    done = apply_edits(frame([("1",)], "a string"), [{"cast": {"a": {"type": "int"}}}])
    folder = write_rejects(done, str(tmp_path / "rejects"))
    assert read_manifest(spark, folder).collect() == [] and read_rejects(spark, folder).count() == 0
