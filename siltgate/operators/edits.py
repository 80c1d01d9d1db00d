"""Column edits: an ordered list of one-key mappings folded over a tracked frame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import functions as F, types as T

from siltgate.errors import EngineError, fail
from siltgate.functions.casting import CastSpec, fill_literal
from siltgate.functions.text import strip_unicode
from siltgate.operators.tracked import ROW_INDEX, Finding, TrackedFrame
from siltgate.plans.types import DeclaredColumn


def apply_edits(
    frame: TrackedFrame,
    edits: Iterable[Mapping[str, Any]],
    schema: Iterable[DeclaredColumn] = (),
) -> TrackedFrame:
    """Run the edits from left to right. Names are checked against the columns as they then are."""
    declared = {column.name: column for column in schema}
    steps = [_operation(edit) for edit in edits]
    return reduce(
        lambda done, step: _cast(done, step[1][1], declared, step[0]) if step[1][0] == "cast" else _EDITS[step[1][0]](done, step[1][1]),
        enumerate(steps, start=1),
        frame,
    )


def _operation(edit: object) -> tuple[str, Any]:
    if not isinstance(edit, Mapping) or len(edit) != 1:
        raise fail("edit.invalid", "An edit is a mapping with one operation.")
    ((name, spec),) = edit.items()
    if name != "cast" and name not in _EDITS:
        raise fail("edit.unknown_op", f"There is no edit operation `{name}`.", op=name)
    return name, spec


def _rename(frame: TrackedFrame, spec: object) -> TrackedFrame:
    if not isinstance(spec, Mapping) or not spec or not all(_name(k) and _name(v) for k, v in spec.items()):
        raise _invalid("rename", "must map column names to column names")
    for source in spec:
        frame.require(source, "rename")
    if ROW_INDEX in spec.values():
        raise fail("edit.reserved_column", f"`{ROW_INDEX}` is a reserved column name.", column=ROW_INDEX)
    renamed = [spec.get(name, name) for name in frame.columns]
    clashes = sorted(name for name in set(renamed) if renamed.count(name) > 1)
    if clashes:
        raise fail("edit.rename_collision", f"The rename gives two columns the name `{clashes[0]}`.", column=clashes[0])
    return frame.with_names(dict(zip(renamed, frame.names.values())))


def _drop(frame: TrackedFrame, spec: object) -> TrackedFrame:
    dropped = _names(frame, spec, "drop")
    return frame.with_names({name: slot for name, slot in frame.names.items() if name not in dropped})


def _trim(frame: TrackedFrame, spec: object) -> TrackedFrame:
    columns = _names(frame, spec, "trim")
    _require_text(frame, columns, "trim")
    return frame.with_values({name: strip_unicode(frame.value(name)) for name in columns})


def _parse_null(frame: TrackedFrame, spec: object) -> TrackedFrame:
    if not isinstance(spec, Mapping):
        raise _invalid("parse_null", "must be a mapping")
    for key in sorted(set(spec) - {"columns", "values"}):
        raise fail("edit.unknown_key", f"parse_null has no key `{key}`.", key=key)
    texts = spec.get("values")
    if not isinstance(texts, (list, tuple)) or not all(isinstance(text, str) for text in texts):
        raise _invalid("parse_null", "needs a list of string values")
    columns = _names(frame, spec.get("columns"), "parse_null")
    _require_text(frame, columns, "parse_null")
    if not texts:
        return frame
    return frame.with_values(
        {name: F.when(frame.value(name).isin(*texts), None).otherwise(frame.value(name)) for name in columns}
    )


def _fill_null(frame: TrackedFrame, spec: object) -> TrackedFrame:
    if not isinstance(spec, Mapping) or not all(isinstance(name, str) for name in spec):
        raise _invalid("fill_null", "must map column names to values")
    for name in spec:
        frame.require(name, "fill_null")
    return frame.with_values(
        {
            name: F.coalesce(frame.value(name), fill_literal(name, value, frame.type_of(name)))
            for name, value in spec.items()
        }
    )


def _cast(frame: TrackedFrame, spec: object, declared: Mapping[str, DeclaredColumn], step: int) -> TrackedFrame:
    """Convert columns; a value that is lost rejects its row for every later step."""
    if not isinstance(spec, Mapping) or not spec or not all(isinstance(name, str) for name in spec):
        raise _invalid("cast", "must be a non-empty mapping of columns")
    casts = {}
    for name, raw in spec.items():
        frame.require(name, "cast")
        casts[name] = CastSpec.parse(name, raw, declared.get(name))
    after = frame.with_values(
        {name: cast.apply(name, frame.value(name), frame.type_of(name)) for name, cast in casts.items()}
    )
    return after.with_findings(
        tuple(
            Finding(
                stage="edit",
                step=step,
                column=name,
                check="cast_failed",
                reason=f"Could not cast value to {cast.target}.",
                failed=frame.value(name).isNotNull() & after.value(name).isNull(),
                slot=frame.names[name],
            )
            for name, cast in casts.items()
        )
    )


_EDITS = {"rename": _rename, "drop": _drop, "trim": _trim, "parse_null": _parse_null, "fill_null": _fill_null}


def _name(value: object) -> bool:
    return isinstance(value, str) and value != ""


def _names(frame: TrackedFrame, value: object, operation: str) -> list[str]:
    if not isinstance(value, (list, tuple)) or not all(_name(item) for item in value):
        raise _invalid(operation, "needs a list of column names")
    for name in value:
        frame.require(name, operation)
    return list(dict.fromkeys(value))


def _require_text(frame: TrackedFrame, columns: list[str], operation: str) -> None:
    for name in columns:
        if not isinstance(frame.type_of(name), T.StringType):
            raise fail("edit.type_mismatch", f"`{name}` must be text for {operation}.", column=name, op=operation)


def _invalid(operation: str, why: str) -> EngineError:
    return fail("edit.invalid", f"{operation} {why}.", op=operation)
