"""Native text expressions: Unicode trim and the text forms used in reject rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The characters with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Control characters that also count as space around a boolean.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def strip_unicode(column: Column, also: str = "") -> Column:
    """Remove white space of every kind from both ends (SQL ``trim`` only knows U+0020)."""
    return F.btrim(column, F.lit(WHITE_SPACE + also))


def iso_timestamp(column: Column) -> Column:
    """``2024-01-02T03:04:05``, with six fraction digits only when there is a fraction."""
    fraction = F.date_format(column, ".SSSSSS")
    return F.concat(
        F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == ".000000", "").otherwise(fraction),
    )


def float_text(column: Column) -> Column:
    """Shortest decimal text: plain from 1e-4 up to 1e16, exponent form beyond.

    Spark itself switches to exponents at 1e-3 and 1e7; its digits are kept.
    """
    spark_text = column.cast("string")
    size = F.abs(column)
    digits = F.regexp_replace(spark_text.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.substring_index(spark_text, "E", 1), r"\.0$", "")
    power = F.substring_index(spark_text, "E", -1).try_cast("int")
    exponent = F.concat(
        mantissa,
        F.when(power < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")),
    )
    return (
        F.when(F.isnan(column), "nan")
        .when(size == float("inf"), F.when(column > 0, "inf").otherwise("-inf"))
        .when(~F.contains(spark_text, F.lit("E")), spark_text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(exponent)
    )


def plain_text(column: Column, data_type: T.DataType) -> Column:
    """Any accepted value as text; null stays null."""
    if isinstance(data_type, T.StringType):
        return column
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return iso_timestamp(column)
    if isinstance(data_type, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return float_text(column)
    return column.cast("string")
