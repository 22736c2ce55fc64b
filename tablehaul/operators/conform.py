"""Type mapping of column catalogs, and casts of data to a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablehaul.functions.names import quoted
from tablehaul.functions.sql_types import (
    base_type,
    declared_text,
    kept_suffix,
    mapped_base,
    sized_type,
    spark_type,
    type_suffix,
)


def map_types(columns: DataFrame, source: str, target: str, declared: str = "declared_type") -> DataFrame:
    """Catalog rows with a ``mapped_type``; row-wise, the map is a literal.

    ``source`` and ``target`` name columns that hold lower-case engine names.
    """
    steps = (
        columns.withColumn("_text", declared_text(F.col(declared)))
        .withColumns({"_base": base_type(F.col("_text")), "_suffix": type_suffix(F.col("_text"))})
        .withColumn("_mapped", mapped_base(F.col(source), F.col(target), F.col("_base")))
        .withColumn("_suffix", kept_suffix(F.col("_base"), F.col("_mapped"), F.col("_suffix")))
    )
    sized = sized_type(F.col(target), F.col("_mapped"), F.col("_suffix"))
    mapped = F.when(F.col("_base") == "", F.col(declared)).otherwise(sized)
    return steps.withColumn("mapped_type", mapped).drop("_text", "_base", "_suffix", "_mapped")


def changed(col: Column, kind: T.DataType, value: Column, target: str) -> Column:
    """Whether a cast to ``target`` that succeeded lost something: digits, precision, or the time of a day.

    The value is cast back and compared, numbers in text exactly as decimals. What can't be compared counts as kept.
    """
    if target.startswith(("decimal", "float", "double")) or target in ("tinyint", "smallint", "int", "bigint"):
        if isinstance(kind, T.StringType):
            exact, back = col.try_cast("decimal(38,18)"), value.cast("string").try_cast("decimal(38,18)")
            return F.coalesce(exact != back, F.lit(False))
        if isinstance(kind, T.NumericType):
            return F.coalesce(value.try_cast(kind) != col, F.lit(True)) & ~F.coalesce(F.isnan(col.cast("double")), F.lit(False))
    if target == "date" and isinstance(kind, (T.StringType, T.TimestampType, T.TimestampNTZType)):
        whole = col if not isinstance(kind, T.StringType) else col.try_cast("timestamp_ntz")
        return F.coalesce(whole.cast("timestamp_ntz") != value.cast("timestamp_ntz"), F.lit(False))
    if target.startswith("timestamp") and isinstance(kind, T.StringType):
        return F.regexp_extract(col, r"\.[0-9]{6}([0-9]*)", 1).rlike("[1-9]")
    return F.lit(False)


def conform(df: DataFrame, declared: dict[str, str], engine: str = "", on_error: str = "null", on_loss: str = "allow") -> DataFrame:
    """Cast columns to declared SQL types; other columns stay as they are.

    ``on_error``: "null" turns values that do not fit into null, "count" also adds
    ``bad_cells`` with their number per row, "fail" stops the query. ``on_loss`` says what
    becomes of values that fit but not whole, 1.239 in two digits or a time in a date:
    "allow" takes what is left, "null" and "count" (``lossy_cells``) and "fail" are as above.
    """
    if on_error not in {"null", "count", "fail"}:
        raise ValueError(f"on_error must be null, count or fail, not {on_error!r}")
    if on_loss not in {"allow", "null", "count", "fail"}:
        raise ValueError(f"on_loss must be allow, null, count or fail, not {on_loss!r}")
    out, bad, lossy = [], F.lit(0), F.lit(0)
    for name in df.columns:
        col = F.col(quoted(name))
        if name not in declared:
            out.append(col)
            continue
        kind = spark_type(declared[name], engine)
        value = col.try_cast(kind)
        lost = col.isNotNull() & value.isNull()
        less = col.isNotNull() & value.isNotNull() & changed(col, df.schema[name].dataType, value, kind)
        if on_error == "fail":
            problem = F.concat(F.lit(f"column {name}: not a {kind}: "), col.cast("string"))
            value = F.when(lost, F.raise_error(problem).cast(kind)).otherwise(value)
        if on_loss == "fail":
            problem = F.concat(F.lit(f"column {name}: not whole as {kind}: "), col.cast("string"))
            value = F.when(less, F.raise_error(problem).cast(kind)).otherwise(value)
        elif on_loss == "null":
            value = F.when(~less, value)
        bad = bad + F.when(lost, F.lit(1)).otherwise(F.lit(0))
        lossy = lossy + F.when(less, F.lit(1)).otherwise(F.lit(0))
        out.append(value.alias(name))
    if on_error == "count":
        out.append(bad.alias("bad_cells"))
    if on_loss == "count":
        out.append(lossy.alias("lossy_cells"))
    return df.select(*out)
