"""Schema drift: a declared schema against a live table, as an ordered list of differences."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from siltgate.functions.naming import quoted
from siltgate.plans.recipe import Settings
from siltgate.plans.types import DeclaredColumn, normal_type

# Spark keeps no NOT NULL for file tables, so the names of required columns are a property.
REQUIRED_PROPERTY = "siltgate.required"
# Nor has it charsets: the one a table was declared with is a property too.
CHARSET_PROPERTY = "siltgate.charset"

# Declared spelling of the Spark types whose names differ.
LIVE_TYPES = {"string": "TEXT", "timestamp_ntz": "DATETIME"}


@dataclass(frozen=True)
class LiveColumn:
    name: str
    type: str
    nullable: bool
    charset: str | None = None
    collation: str | None = None


@dataclass(frozen=True)
class LiveTable:
    engine: str
    collation: str
    columns: tuple[LiveColumn, ...]
    charset: str | None = None


def live_table(spark: SparkSession, table: str) -> LiveTable | None:
    """The table as the catalog describes it, or None when there is none."""
    if not spark.catalog.tableExists(quoted(table)):
        return None
    described = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)} AS JSON").first()[0])
    # Only the plain description keeps VARCHAR lengths.
    listed = spark.sql(f"DESCRIBE TABLE {quoted(table)}").collect()
    properties = described.get("table_properties", {})
    required, charset = json.loads(properties.get(REQUIRED_PROPERTY, "[]")), properties.get(CHARSET_PROPERTY)
    columns = []
    for row in listed[: len(described["columns"])]:
        name, _, collation = row.data_type.partition(" collate ")
        text = name.startswith(("string", "varchar", "char"))
        columns.append(
            LiveColumn(
                name=row.col_name,
                type=LIVE_TYPES.get(name, name),
                nullable=row.col_name not in required,
                charset=charset if text else None,
                collation=(collation or "UTF8_BINARY") if text and name == "string" else None,
            )
        )
    return LiveTable(described.get("provider", ""), described.get("collation", "UTF8_BINARY"), tuple(columns), charset)


def schema_drift(declared: Sequence[DeclaredColumn], live: LiveTable, settings: Settings) -> list[dict[str, Any]]:
    """Differences in a fixed order: table options, column sets, column order, then per column."""
    return [
        *_option_drift(live, settings),
        *_column_set_drift([c.name for c in declared], [c.name for c in live.columns]),
        *(diff for pair in _shared(declared, live) for diff in _column_drift(*pair, settings)),
    ]


def _same(left: str | None, right: str | None) -> bool:
    return (left or "").lower() == (right or "").lower()


def _option_drift(live: LiveTable, settings: Settings) -> Iterator[dict[str, Any]]:
    for check in ("engine", "charset", "collation"):
        expected, actual = getattr(settings, check), getattr(live, check)
        # tables of other makers report no charset
        if not (check == "charset" and actual is None) and not _same(expected, actual):
            yield {"check": check, "expected": expected, "actual": actual}


def _column_set_drift(declared: list[str], live: list[str]) -> Iterator[dict[str, Any]]:
    yield from ({"check": "missing_column", "column": name} for name in declared if name not in live)
    yield from ({"check": "extra_column", "column": name} for name in live if name not in declared)
    if declared != live and sorted(declared) == sorted(live):
        yield {"check": "column_order", "expected": declared, "actual": live}


def _shared(declared: Sequence[DeclaredColumn], live: LiveTable) -> Iterator[tuple[DeclaredColumn, LiveColumn]]:
    by_name = {column.name: column for column in live.columns}
    return ((column, by_name[column.name]) for column in declared if column.name in by_name)


def _column_drift(declared: DeclaredColumn, live: LiveColumn, settings: Settings) -> Iterator[dict[str, Any]]:
    facts = [
        ("type", normal_type(declared.type.text), normal_type(live.type)),
        ("nullability", declared.nullable, live.nullable),
    ]
    if declared.type.is_text:
        facts += [
            (f"column_{option}", getattr(settings, option), getattr(live, option))
            for option in ("charset", "collation")
            if getattr(live, option) and not _same(getattr(settings, option), getattr(live, option))
        ]
    for check, expected, actual in facts:
        if expected != actual:
            yield {"check": check, "column": declared.name, "expected": expected, "actual": actual}
