"""Partition key, bounds and key-range chunks."""

from __future__ import annotations

import datetime as dt
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablehaul.functions.names import quoted

DEFAULT_PARTITIONS = 8
#: Rows that one reader should get at most.
ROWS_PER_RANGE = 1_000_000


def _splittable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType))


def choose_key(
    schema: T.StructType,
    primary_key: list[str] = (),
    partition_column: str | None = None,
    chunk_column: str | None = None,
    fallback: bool = True,
) -> str | None:
    """An explicit column, else a splittable key column, else any splittable column."""
    if partition_column or chunk_column:
        return partition_column or chunk_column
    kinds = {f.name: f.dataType for f in schema.fields}
    candidates = [c for c in primary_key if c in kinds] + (schema.names if fallback else [])
    return next((c for c in candidates if _splittable(kinds[c])), None)


def key_bounds(df: DataFrame, key: str, lower=None, upper=None, partitions: int = DEFAULT_PARTITIONS) -> DataFrame:
    """One row (lower_bound, upper_bound, num_partitions); no row for an empty table."""
    col = F.col(quoted(key))
    kind = df.schema[key].dataType
    if lower is not None and upper is not None:
        found = df.sparkSession.range(1).select(F.lit(lower).cast(kind).alias("lo"), F.lit(upper).cast(kind).alias("hi"))
    else:
        found = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).filter("lo IS NOT NULL")
    given = [F.col(c) if v is None else F.lit(v).cast(kind) for c, v in (("lo", lower), ("hi", upper))]
    return found.select(
        given[0].alias("lower_bound"), given[1].alias("upper_bound"), F.lit(partitions).alias("num_partitions")
    )


def _ordinal(df: DataFrame, key: str) -> Column | None:
    """The key as a whole number: floor of a number, day of a date, microsecond of a time; None for other kinds."""
    col, kind = F.col(quoted(key)), df.schema[key].dataType
    if isinstance(kind, T.NumericType):
        return F.floor(col).cast("decimal(38,0)")
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("decimal(38,0)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col).cast("decimal(38,0)")
    if isinstance(kind, T.TimestampNTZType):
        return (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col)).cast("decimal(38,0)")
    return None


def _plan(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """One row: first key, range width and number of ranges, in exact integers."""
    at = _ordinal(df, key)
    ends = df.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    n = max(1, int(partitions or 1))
    return (
        ends.withColumn("step", F.greatest(F.lit(1), F.expr(f"(hi - lo + {n}) div {n}")).cast("decimal(38,0)"))
        .withColumn("ranges", F.expr("(hi - lo + step) div step").cast("int"))
    )


def with_chunk_id(df: DataFrame, key: str, partitions: int = DEFAULT_PARTITIONS) -> DataFrame:
    """``df`` with the number of the half-open key range each row is in.

    Null keys have a null ``chunk_id``. Numbers, dates and times are cut by
    width; other keys have none, so use :func:`with_quantile_chunk` for order
    or leave the table whole: it is range 0.
    """
    at = _ordinal(df, key)
    if at is None:
        return df.withColumn("chunk_id", F.when(F.col(quoted(key)).isNotNull(), F.lit(0).cast("bigint")))
    plan = _plan(df, key, partitions).select(F.struct("lo", "step")).scalar()
    offset = at - plan.getField("lo")
    return df.withColumn("chunk_id", F.call_function("div", offset, plan.getField("step")))


def chunk_stats(df: DataFrame, key: str, partitions: int = DEFAULT_PARTITIONS) -> DataFrame:
    """Rows, least and greatest key per range; empty ranges stay, null keys get a row of their own.

    ``range_start`` and ``range_end`` are whole numbers: of days for dates, of
    microseconds for times, null for kinds without a width.
    """
    col = F.col(quoted(key))
    counted = (
        with_chunk_id(df.select(col), key, partitions)
        .groupBy("chunk_id")
        .agg(F.count("*").alias("row_count"), F.min(col).alias("min_key"), F.max(col).alias("max_key"))
    )
    if _ordinal(df, key) is None:
        none = F.lit(None).cast("bigint")
        return counted.select("chunk_id", none.alias("range_start"), none.alias("range_end"), "row_count", "min_key", "max_key")
    ranges = (
        _plan(df, key, partitions)
        .filter("ranges IS NOT NULL")
        .select("lo", "hi", "step", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("id"))
        .select(
            F.col("id").cast("bigint").alias("range_id"),
            F.expr("lo + id * step").cast("bigint").alias("range_start"),
            F.least(F.expr("lo + (id + 1) * step - 1"), F.col("hi")).cast("bigint").alias("range_end"),
        )
    )
    # Both sides have at most partitions + 1 rows.
    return ranges.join(counted, ranges.range_id == counted.chunk_id, "full_outer").select(
        F.coalesce("range_id", "chunk_id").alias("chunk_id"),
        "range_start",
        "range_end",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        "min_key",
        "max_key",
    )


def cut_points(lower, upper, partitions: int = DEFAULT_PARTITIONS) -> list:
    """Inner bounds of ranges of equal width from ``lower`` to ``upper``: integers, decimals, dates or times."""
    n = max(1, int(partitions or 1))
    if isinstance(lower, (dt.date, dt.datetime)):
        unit = dt.timedelta(microseconds=1) if isinstance(lower, dt.datetime) else dt.timedelta(days=1)
        span = (upper - lower) // unit + 1
        step = max(1, -(-span // n))
        return [lower + unit * at for at in range(step, span, step)]
    low, high = math.floor(lower), math.floor(upper)
    step = max(1, -(-(high - low + 1) // n))
    return list(range(low + step, high + 1, step))


def _sql_value(value, engine: str = "") -> str:
    """A literal as the engine writes it; without an engine as Spark does."""
    if not isinstance(value, dt.date):
        return str(value)
    kind, text = ("TIMESTAMP", value.isoformat(sep=" ")) if isinstance(value, dt.datetime) else ("DATE", value.isoformat())
    if engine == "SQL Server":
        return f"CAST('{text}' AS {'datetime2' if kind == 'TIMESTAMP' else 'date'})"
    return f"{kind} '{text}'"


def cut_predicates(key: str, cuts: list, engine: str = "") -> list[str]:
    """SQL conditions, one per reader, that cover every row exactly once.

    The ranges are half-open, so fractional keys between two cuts are read; the
    first and last are open outwards, and null keys have their own reader. ``key`` is
    a name as the engine quotes it.
    """
    if not cuts:
        return [f"{key} IS NOT NULL", f"{key} IS NULL"]
    at = [_sql_value(c, engine) for c in cuts]
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(at, at[1:])]
    return [f"{key} < {at[0]}", *inner, f"{key} >= {at[-1]}", f"{key} IS NULL"]


def range_predicates(key: str, lower, upper, partitions: int = DEFAULT_PARTITIONS, engine: str = "") -> list[str]:
    """:func:`cut_predicates` of ranges of equal width."""
    return cut_predicates(key, cut_points(lower, upper, partitions), engine)


def sized_cuts(df: DataFrame, key: str, rows: int = ROWS_PER_RANGE) -> list:
    """Cuts between which no more than ``rows`` rows lie, unless one key alone has more.

    The number of ranges follows the number of rows: cuts are quantiles for half as
    many rows a range, with an error of an eighth at most. The driver sees the cuts.
    """
    n = df.agg(F.count(quoted(key))).first()[0]
    ranges = max(1, math.ceil(2 * n / max(1, rows)))
    if ranges == 1 or n <= rows:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(F.col(quoted(key)), shares, max(10_000, 16 * ranges)).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def plan_ranges(
    df: DataFrame, key: str | None = None, partitions: int = DEFAULT_PARTITIONS, quantiles: bool = False, rows: int | None = None, **choice
) -> list[str] | None:
    """Key, bounds and conditions of a table in one step; None if no column can be cut.

    With ``rows`` there are as many ranges as the table needs for so many rows each.
    Else bounds are one aggregation, or with ``quantiles`` the cuts are approximate
    quantiles, for uneven keys; the driver sees ``partitions`` values.
    """
    key = key or choose_key(df.schema, **choice)
    if key is None or not _splittable(df.schema[key].dataType):
        return None
    name = quoted(key)
    if rows is not None:
        return cut_predicates(name, sized_cuts(df, key, rows))
    if quantiles:
        shares = [i / partitions for i in range(1, partitions)]
        found = df.agg(F.percentile_approx(F.col(name), shares, 10000).alias("cuts")).first()["cuts"] if shares else None
        return cut_predicates(name, sorted(set(found or [])))
    ends = df.agg(F.min(name).alias("lo"), F.max(name).alias("hi")).first()
    return cut_predicates(name, [] if ends["lo"] is None else cut_points(ends["lo"], ends["hi"], partitions))


def read_ranges(df: DataFrame, predicates: list[str]) -> DataFrame:
    """The table as the union of its ranged reads; each condition is pushed to the scan."""
    return reduce(DataFrame.unionAll, [df.filter(p) for p in predicates])


def quantile_cuts(df: DataFrame, key: str, partitions: int = DEFAULT_PARTITIONS, accuracy: int = 10000) -> Column:
    """Scalar array of inner cut points with about equal rows between them (for uneven keys)."""
    shares = [i / partitions for i in range(1, partitions)]
    return df.agg(F.array_distinct(F.percentile_approx(F.col(quoted(key)), shares, accuracy))).scalar()


def with_quantile_chunk(df: DataFrame, key: str, partitions: int = DEFAULT_PARTITIONS) -> DataFrame:
    """As :func:`with_chunk_id`, but cut at approximate quantiles instead of equal widths."""
    col = F.col(quoted(key))
    cuts = quantile_cuts(df, key, partitions)
    below = sum((F.when(F.get(cuts, F.lit(i)) <= col, 1).otherwise(0) for i in range(partitions - 1)), F.lit(0))
    return df.withColumn("chunk_id", F.when(col.isNotNull(), below.cast("bigint")))
