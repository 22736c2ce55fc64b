"""Joins of rows with hot keys to one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablehaul.functions.names import quoted


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``rows``, in which one key may be very frequent, to ``per_key``, which has each key once.

    ``per_key`` mostly comes out of an aggregation by the same keys. Spark would
    join it as it lies, and a side without a shuffle of its own keeps adaptive
    execution from splitting the hot partitions of the other. Joining on a second
    function of the key as well gives both sides a shuffle, so they are split.
    """
    tie = F.pmod(F.xxhash64(*[F.col(quoted(k)) for k in keys]), F.lit(2))
    joined = rows.withColumn("_tie", tie).join(per_key.withColumn("_tie", tie), [*keys, "_tie"], how)
    return joined.drop("_tie")
