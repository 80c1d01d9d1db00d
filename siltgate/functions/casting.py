"""Casts that turn a value into null instead of failing, with strict text grammars."""

from __future__ import annotations

import datetime as dt
import decimal
import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from siltgate.errors import EngineError, fail
from siltgate.functions.text import SEPARATORS, float_text, strip_unicode
from siltgate.plans.types import CAST_FEEDS, SPARK_MAX_PRECISION, DeclaredColumn

# Texts read as true and as false.
TRUE_TEXTS = ("true", "1", "yes", "y")
FALSE_TEXTS = ("false", "0", "no", "n")

# Text grammars (Java regular expressions); anything else is a cast failure. They end in \\z,
# because $ would also match before a final line end.
INT_TEXT = r"\A[+-]?[0-9]+\z"
FLOAT_TEXT = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z|\A[+-]?(?i:inf|infinity|nan)\z"
DECIMAL_TEXT = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z"
DATE_TEXT = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DATETIME_TEXT = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?)?\z"

# Strptime directives and the Spark letters for them, as (next to another
# number, standing alone). A lone letter takes one or more digits, a repeated one a fixed width.
NUMBER_DIRECTIVES = {
    "Y": ("yyyy", "yyyy"),
    "y": ("yy", "yy"),
    "m": ("MM", "M"),
    "d": ("dd", "d"),
    "e": ("dd", "d"),
    "j": ("DDD", "D"),
    "H": ("HH", "H"),
    "I": ("hh", "h"),
    "M": ("mm", "m"),
    "S": ("ss", "s"),
    "f": ("SSSSSSSSS", "SSSSSSSSS"),
}
OTHER_DIRECTIVES = {
    "b": "MMM",
    "h": "MMM",
    "B": "MMMM",
    "p": "a",
    ".f": "[.SSSSSSSSS]",
    ".3f": ".SSS",
    ".6f": ".SSSSSS",
    ".9f": ".SSSSSSSSS",
    "3f": "SSS",
    "6f": "SSSSSS",
    "9f": "SSSSSSSSS",
}
# Directives that stand for several.
COMPOUND_DIRECTIVES = {"F": "%Y-%m-%d", "D": "%m/%d/%y", "T": "%H:%M:%S", "R": "%H:%M"}

_DIRECTIVE = re.compile(r"%(\.?[369]?[A-Za-z%])")


@dataclass(frozen=True)
class DatePattern:
    """A Spark datetime pattern, and whether its years are the two-digit kind."""

    spark: str
    short_year: bool
    has_date: bool


def translate_format(text: str) -> DatePattern:
    """A ``%``-style format as a Spark pattern; unknown directives are refused."""
    expanded = re.sub("%([FDTR])", lambda m: COMPOUND_DIRECTIVES[m[1]], text)
    pieces = _DIRECTIVE.split(expanded)
    literals, directives = pieces[0::2], pieces[1::2]
    if any("%" in literal for literal in literals):
        raise _bad_format(text)
    numeric = [d in NUMBER_DIRECTIVES for d in directives]
    pattern = _quote(literals[0])
    for i, directive in enumerate(directives):
        if directive == "%":
            pattern += _quote("%")
        elif numeric[i]:
            left = i > 0 and numeric[i - 1] and not literals[i]
            right = i + 1 < len(directives) and numeric[i + 1] and not literals[i + 1]
            pattern += NUMBER_DIRECTIVES[directive][0 if left or right else 1]
        elif directive in OTHER_DIRECTIVES:
            pattern += OTHER_DIRECTIVES[directive]
        else:
            raise _bad_format(text)
        pattern += _quote(literals[i + 1])
    used = set(directives)
    has_year = bool(used & {"Y", "y"})
    has_day = "j" in used or bool(used & {"m", "b", "B", "h"}) and bool(used & {"d", "e"})
    return DatePattern(pattern, "y" in used and "Y" not in used, has_year and has_day)


def _quote(literal: str) -> str:
    return re.sub(r"[A-Za-z\[\]#{}']+", lambda m: "'" + m[0].replace("'", "''") + "'", literal)


def _bad_format(text: str) -> EngineError:
    return fail("edit.invalid", f"The date format `{text}` has a directive that cannot be read.", format=text)


@dataclass(frozen=True)
class CastSpec:
    """One checked ``cast`` entry."""

    target: str
    pattern: DatePattern | None = None
    precision: int | None = None
    scale: int | None = None

    @classmethod
    def parse(cls, column: str, raw: object, declared: DeclaredColumn | None) -> "CastSpec":
        if not isinstance(raw, Mapping):
            raise fail("edit.invalid", f"The cast of `{column}` must be a mapping.", column=column)
        for key in sorted(set(raw) - {"type", "format", "precision", "scale"}):
            raise fail("edit.unknown_key", f"A cast has no key `{key}`.", column=column, key=key)
        target = raw.get("type")
        if not isinstance(target, str) or target not in CAST_FEEDS:
            raise fail("edit.invalid", f"The cast of `{column}` has no valid type.", column=column)
        if declared and declared.type.kind not in CAST_FEEDS[target]:
            raise fail(
                "schema.type_mismatch",
                f"A cast of `{column}` to {target} cannot fill {declared.type.text}.",
                column=column,
                cast_type=target,
                schema_type=declared.type.text,
            )
        if target == "decimal":
            precision = raw.get("precision", declared.type.precision if declared else None)
            scale = raw.get("scale", declared.type.scale if declared else None)
            if type(precision) is not int or not 0 < precision <= SPARK_MAX_PRECISION:
                raise fail("edit.invalid", f"The decimal cast of `{column}` needs a precision of 1 to {SPARK_MAX_PRECISION}.", column=column)
            if type(scale) is not int or not 0 <= scale <= precision:
                raise fail("edit.invalid", f"The decimal cast of `{column}` needs a scale of 0 to its precision.", column=column)
            return cls(target, precision=precision, scale=scale)
        if target in ("date", "datetime") and "format" in raw:
            if not isinstance(raw["format"], str):
                raise fail("edit.invalid", f"The date format of `{column}` must be a string.", column=column)
            if raw["format"]:
                pattern = translate_format(raw["format"])
                if not pattern.has_date:
                    raise fail("edit.invalid", f"The date format of `{column}` does not name a day.", column=column)
                return cls(target, pattern=pattern)
        return cls(target)

    def spark_type(self) -> T.DataType:
        if self.target == "decimal":
            return T.DecimalType(self.precision, self.scale)
        return {
            "string": T.StringType(),
            "boolean": T.BooleanType(),
            "int": T.LongType(),
            "float": T.DoubleType(),
            "date": T.DateType(),
            "datetime": T.TimestampNTZType(),
        }[self.target]

    def apply(self, name: str, column: Column, data_type: T.DataType) -> Column:
        """The converted value: null where the value cannot be converted."""
        is_text = isinstance(data_type, T.StringType)
        if self.pattern and not is_text:
            raise fail("edit.type_mismatch", f"`{name}` must be text for a date format.", column=name, op="cast")
        if self.target == "string":
            return column.cast("string")
        if self.target == "boolean":
            return boolean_value(column, data_type)
        if self.pattern:
            return formatted_value(column, self.pattern, self.target)
        if not is_text and not _castable(data_type, self.target):
            raise fail(
                "edit.type_mismatch",
                f"`{name}` holds {data_type.simpleString()}, which has no cast to {self.target}.",
                column=name,
                op="cast",
            )
        converted = column.try_cast(self.spark_type())
        if not is_text:
            return converted
        grammar = {"int": INT_TEXT, "float": FLOAT_TEXT, "decimal": DECIMAL_TEXT, "date": DATE_TEXT, "datetime": DATETIME_TEXT}
        return F.when(column.rlike(grammar[self.target]), converted)


def boolean_value(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.BooleanType):
        return column
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        column = float_text(column)
    word = F.lower(strip_unicode(column.cast("string"), also=SEPARATORS))
    return F.when(word.isin(*TRUE_TEXTS), True).when(word.isin(*FALSE_TEXTS), False)


def formatted_value(column: Column, pattern: DatePattern, target: str) -> Column:
    if target == "date":
        value = F.try_to_date(column, pattern.spark)
    else:
        value = F.try_to_timestamp(column, F.lit(pattern.spark)).cast("timestamp_ntz")
    if pattern.short_year:
        # Two-digit years 70 to 99 belong to the 1900s; Spark reads them as 2070 to 2099.
        earlier = value - F.make_ym_interval(F.lit(100))
        value = F.when(F.year(value) >= 2070, earlier).otherwise(value)
    return value


def _castable(data_type: T.DataType, target: str) -> bool:
    number = isinstance(data_type, T.NumericType)
    if target in ("int", "float", "decimal"):
        return number or isinstance(data_type, T.BooleanType)
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def fill_literal(name: str, value: Any, data_type: T.DataType) -> Column:
    """``value`` as a literal of the column's type, refused where it does not fit."""
    fitted = _fit(value, data_type)
    if fitted is None:
        raise fail(
            "edit.type_mismatch",
            f"`{name}` holds {data_type.simpleString()} and cannot be filled with {value!r}.",
            column=name,
            op="fill_null",
        )
    return F.lit(fitted).cast(data_type)


def _fit(value: Any, data_type: T.DataType) -> Any:
    if isinstance(value, bool) and not isinstance(data_type, T.StringType):
        return value if isinstance(data_type, T.BooleanType) else None
    if isinstance(data_type, T.StringType):
        if isinstance(value, bool):
            return str(value).lower()
        return str(value) if isinstance(value, (str, int, float, decimal.Decimal, dt.date)) else None
    if isinstance(data_type, T.IntegralType):
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(data_type)]
        return value if isinstance(value, int) and -(2**bits) <= value < 2**bits else None
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return float(value) if isinstance(value, (int, float)) else None
    if isinstance(data_type, T.DecimalType):
        return _fit_decimal(value, data_type) if isinstance(value, (int, float, decimal.Decimal)) else None
    if isinstance(data_type, T.DateType):
        return _fit_date(value, dt.date)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return _fit_date(value, dt.datetime)
    return None


def _fit_decimal(value: Any, data_type: T.DecimalType) -> str | None:
    exact = decimal.Decimal(str(value))
    if not exact.is_finite() or exact != round(exact, data_type.scale):
        return None
    return str(exact) if abs(exact) < decimal.Decimal(10) ** (data_type.precision - data_type.scale) else None


def _fit_date(value: Any, kind: type) -> str | None:
    if isinstance(value, (dt.date, dt.datetime)):
        value = value.isoformat()
    if not isinstance(value, str):
        return None
    try:
        return kind.fromisoformat(value).isoformat()
    except ValueError:
        return None
