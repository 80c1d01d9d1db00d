"""Declared column types: parsing, Spark counterparts, family checks and normal forms."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from siltgate.errors import EngineError, fail

# Inclusive bounds of the declared integer types.
INTEGER_BOUNDS = {
    "TINYINT": (-128, 127),
    "SMALLINT": (-32768, 32767),
    "INT": (-2147483648, 2147483647),
    "BIGINT": (-9223372036854775808, 9223372036854775807),
}

# Declared types a cast target may feed.
CAST_FEEDS = {
    "string": ("VARCHAR", "TEXT"),
    "boolean": ("BOOLEAN",),
    "int": ("TINYINT", "SMALLINT", "INT", "BIGINT"),
    "float": ("FLOAT", "DOUBLE"),
    "decimal": ("DECIMAL",),
    "date": ("DATE",),
    "datetime": ("DATETIME",),
}

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)
_TIMESTAMPS = (T.TimestampNTZType, T.TimestampType)

# Per declared kind: Spark type at the sink, Spark classes accepted from the edited data.
_PLAIN_KINDS: dict[str, tuple[T.DataType, tuple[type, ...]]] = {
    "BOOLEAN": (T.BooleanType(), (T.BooleanType,)),
    "TINYINT": (T.ByteType(), _INTEGRAL),
    "SMALLINT": (T.ShortType(), _INTEGRAL),
    "INT": (T.IntegerType(), _INTEGRAL),
    "BIGINT": (T.LongType(), _INTEGRAL),
    "FLOAT": (T.FloatType(), _FRACTIONAL),
    "DOUBLE": (T.DoubleType(), _FRACTIONAL),
    "TEXT": (T.StringType(), (T.StringType,)),
    "DATE": (T.DateType(), (T.DateType,)),
    "DATETIME": (T.TimestampNTZType(), _TIMESTAMPS),
}

SPARK_MAX_PRECISION = 38


@dataclass(frozen=True)
class DeclaredType:
    kind: str
    length: int | None = None
    precision: int | None = None
    scale: int | None = None

    @property
    def text(self) -> str:
        if self.kind == "VARCHAR":
            return f"VARCHAR({self.length})"
        if self.kind == "DECIMAL":
            return f"DECIMAL({self.precision},{self.scale})"
        return self.kind

    @property
    def is_text(self) -> bool:
        return self.kind in ("VARCHAR", "TEXT")

    def sink_type(self) -> T.DataType:
        if self.kind == "VARCHAR":
            return T.StringType()
        if self.kind == "DECIMAL":
            return T.DecimalType(self.precision, self.scale)
        return _PLAIN_KINDS[self.kind][0]

    def sink_ddl(self) -> str:
        return self.text if self.kind == "VARCHAR" else self.sink_type().simpleString()

    def accepts(self, data_type: T.DataType) -> bool:
        if self.kind == "VARCHAR":
            return isinstance(data_type, T.StringType)
        if self.kind == "DECIMAL":
            return isinstance(data_type, T.DecimalType)
        return isinstance(data_type, _PLAIN_KINDS[self.kind][1])


@dataclass(frozen=True)
class DeclaredColumn:
    name: str
    type: DeclaredType
    nullable: bool = True


def parse_type(value: object, *, path: str | None = None) -> DeclaredType:
    """``"varchar(16)"`` -> ``DeclaredType("VARCHAR", length=16)``, case-insensitively."""

    def unsupported(why: str) -> EngineError:
        return fail("schema.unsupported_type", why, path=path, type=value)

    if not isinstance(value, str) or not value.strip():
        raise unsupported("A schema type must be a non-empty string.")
    kind, _, rest = value.strip().upper().partition("(")
    params = None
    if rest or value.strip().endswith("("):
        if not rest.endswith(")") or ")" in rest[:-1]:
            raise unsupported(f"Cannot read schema type `{value}`.")
        params = [part.strip() for part in rest[:-1].split(",")]
    if kind in _PLAIN_KINDS and params is None:
        return DeclaredType(kind)
    if kind not in ("VARCHAR", "DECIMAL"):
        raise unsupported(f"Schema type `{value}` is not supported.")
    if params is None or not all(re.fullmatch(r"[+-]?[0-9]+", part) for part in params):
        raise unsupported(f"Schema type `{value}` needs whole-number parameters.")
    numbers = [int(part) for part in params]
    if kind == "VARCHAR":
        if len(numbers) != 1 or numbers[0] <= 0:
            raise unsupported(f"`{value}` needs one positive length.")
        return DeclaredType("VARCHAR", length=numbers[0])
    if len(numbers) != 2 or not 0 <= numbers[1] <= numbers[0] or numbers[0] == 0:
        raise unsupported(f"`{value}` needs a precision and a scale between 0 and it.")
    if numbers[0] > SPARK_MAX_PRECISION:
        raise unsupported(f"`{value}` exceeds the largest decimal precision, {SPARK_MAX_PRECISION}.")
    return DeclaredType("DECIMAL", precision=numbers[0], scale=numbers[1])


def parse_schema(entries: object, *, path: str = "schema") -> tuple[DeclaredColumn, ...]:
    """The declared contract, in declared order."""
    if not isinstance(entries, (list, tuple)) or not entries:
        raise fail("schema.invalid", "The schema must be a non-empty list.", path=path)
    columns: dict[str, DeclaredColumn] = {}
    for position, entry in enumerate(entries):
        here = f"{path}[{position}]"
        if not isinstance(entry, Mapping):
            raise fail("schema.invalid", "A schema entry must be a mapping.", path=here)
        for key in sorted(set(entry) - {"name", "type", "nullable"}):
            raise fail("recipe.unknown_key", f"A schema entry has no key `{key}`.", path=f"{here}.{key}", key=key)
        name, nullable = entry.get("name"), entry.get("nullable", True)
        if not isinstance(name, str) or not name:
            raise fail("schema.invalid", "A schema column needs a name.", path=f"{here}.name")
        if name in columns:
            raise fail("schema.duplicate_column", f"`{name}` is declared twice.", path=f"{here}.name", column=name)
        if not isinstance(nullable, bool):
            raise fail("schema.invalid", f"`{name}`: nullable must be true or false.", path=f"{here}.nullable", column=name)
        columns[name] = DeclaredColumn(name, parse_type(entry.get("type"), path=f"{here}.type"), nullable)
    return tuple(columns.values())


def schema_entries(columns: Iterable[DeclaredColumn]) -> list[dict[str, Any]]:
    return [{"name": c.name, "type": c.type.text, "nullable": c.nullable} for c in columns]


def normal_type(text: str) -> str:
    """One spelling per stored type, so that a declared and a live type compare as text."""
    squeezed = "".join(text.upper().split())
    if squeezed in ("BOOL", "BOOLEAN", "TINYINT(1)"):
        return "TINYINT(1)"
    kind, _, params = squeezed.partition("(")
    if kind in INTEGER_BOUNDS and re.fullmatch(r"[0-9]+\)|", params):
        return kind
    if kind in ("DECIMAL", "VARCHAR") and re.fullmatch(r"[0-9]+(,[0-9]+)?\)", params):
        return f"{kind}({','.join(str(int(n)) for n in params[:-1].split(','))})"
    return squeezed
