"""Schema checks: column set and types at plan time, row checks as findings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from siltgate.errors import Diagnostic
from siltgate.operators.tracked import Finding, TrackedFrame
from siltgate.plans.types import INTEGER_BOUNDS, DeclaredColumn

# Row checks see only rows that survived every edit, so their step follows any edit step.
CHECK_STEP = 1 << 30


def shape_diagnostics(frame: TrackedFrame, schema: Iterable[DeclaredColumn]) -> list[Diagnostic]:
    """Extra columns, then missing ones; only when the sets agree, columns of the wrong family."""
    declared = {column.name: column for column in schema}
    present = set(frame.columns)
    found = [
        Diagnostic("schema.extra_source_column", f"The edited data has an undeclared column `{name}`.", "schema", {"column": name})
        for name in sorted(present - set(declared))
    ]
    found += [
        Diagnostic("schema.missing_source_column", f"The edited data lacks the declared column `{name}`.", "schema", {"column": name})
        for name in declared
        if name not in present
    ]
    if found:
        return found
    return [
        Diagnostic(
            "schema.type_mismatch",
            f"`{name}` is declared {column.type.text}, but the edited data holds {frame.type_of(name).simpleString()}.",
            "schema",
            {"column": name, "schema_type": column.type.text, "dtype": frame.type_of(name).simpleString()},
        )
        for name, column in declared.items()
        if not column.type.accepts(frame.type_of(name))
    ]


def check_rows(frame: TrackedFrame, schema: Iterable[DeclaredColumn]) -> TrackedFrame:
    """Add the row checks of every column: required, then length, then range."""
    return frame.with_findings(tuple(finding for column in schema for finding in _row_checks(frame, column)))


def _row_checks(frame: TrackedFrame, column: DeclaredColumn) -> Iterable[Finding]:
    value, kind = frame.value(column.name), column.type.kind

    def finding(check: str, reason: str, failed) -> Finding:
        return Finding("validate", CHECK_STEP, column.name, check, reason, failed, frame.names[column.name])

    # The check names and reasons are fixed values of the reject format.
    if not column.nullable:
        yield finding("not_null", "Value is required.", value.isNull())
    if kind == "VARCHAR":
        too_long = value.isNotNull() & (F.char_length(value) > column.type.length)
        yield finding("varchar_length", f"Value exceeds {column.type.text}.", too_long)
    if kind in INTEGER_BOUNDS and kind != "BIGINT":
        low, high = INTEGER_BOUNDS[kind]
        outside = value.isNotNull() & ~value.between(low, high)
        yield finding("numeric_range", f"Value is outside {kind} range.", outside)


def accepted_rows(frame: TrackedFrame, schema: Iterable[DeclaredColumn]) -> DataFrame:
    """Rows without a finding, projected to the declared columns in declared order."""
    return frame.live_rows([column.name for column in schema])
