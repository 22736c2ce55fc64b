"""Text form of one cell, and back, for staged files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T


@dataclass(frozen=True)
class CellStyle:
    null: str
    true: str
    false: str
    header: bool


# The null marks and boolean words of the two staged-file styles.
SENTINEL = CellStyle(null="__DBM_NULL__", true="TRUE", false="FALSE", header=True)
BACKSLASH_N = CellStyle(null="\\N", true="1", false="0", header=False)
STYLES = {"sentinel": SENTINEL, "backslash_n": BACKSLASH_N}


def float_text(value: Column) -> Column:
    """Floats as 1.5, 0.0001, 1e+16, 2.5e-07, inf, nan: the same text in every engine.

    Spark switches to exponents outside [1e-3, 1e7); here the switch is at
    1e-4 and 1e16, so the digits are moved with an exact decimal in between.
    """
    java = value.cast("string")
    size = F.abs(value)
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.substring_index(java, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")),
    )
    digits = F.regexp_replace(F.format_number(java.try_cast(T.DecimalType(38, 21)), 21), ",", "")
    plain = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", ".0")
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(~java.contains("E"), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def cell_text(value: Column, kind: T.DataType, style: CellStyle) -> Column:
    """``value`` as staged text, never null."""
    if isinstance(kind, T.BooleanType):
        text = F.when(value, F.lit(style.true)).when(~value, F.lit(style.false))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = float_text(value)
    elif isinstance(kind, T.DecimalType) and kind.scale > 6:
        text = F.replace(F.format_number(value, kind.scale), F.lit(","), F.lit(""))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # A cast, not date_format, which would move a plain time into the session's zone.
        trimmed = value.cast("string")
        text = F.when(trimmed.contains("."), F.rpad(trimmed, 26, "0")).otherwise(trimmed)
    elif isinstance(kind, T.BinaryType):
        text = F.lower(F.hex(value))
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(style.null))


def cell_value(text: Column, kind: T.DataType, style: CellStyle, name: str) -> Column:
    """The typed value of staged text; text that does not fit fails the load."""
    text = F.nullif(F.coalesce(text, F.lit("")), F.lit(style.null))
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BooleanType):
        value = F.when(text == style.true, F.lit(True)).when(text == style.false, F.lit(False))
    elif isinstance(kind, T.BinaryType):
        value = F.unhex(text)
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        value = F.from_json(text, kind)
    else:
        value = text.try_cast(kind)
    problem = F.concat(F.lit(f"column {name}: not a {kind.simpleString()}: "), text)
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(problem).cast(kind)).otherwise(value)
