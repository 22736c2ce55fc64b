"""Row counts of source and target tables, and the safe-replay decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of many tables in one job; each is a count(*) that reads no column."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, counts)


def reconcile(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Per table: source rows, target rows and ``max(source - target, 0)`` missing rows."""
    source = table_counts({name: src for name, (src, _) in pairs.items()}).withColumn("side", F.lit("source"))
    target = table_counts({name: tgt for name, (_, tgt) in pairs.items()}).withColumn("side", F.lit("target"))
    # One row per table and side from here on.
    sides = source.unionAll(target).groupBy("table_name").agg(
        F.sum(F.when(F.col("side") == "source", F.col("row_count"))).alias("source_row_count"),
        F.sum(F.when(F.col("side") == "target", F.col("row_count"))).alias("target_row_count"),
    )
    return sides.withColumn(
        "missing_row_count",
        F.greatest(F.col("source_row_count") - F.col("target_row_count"), F.lit(0).cast("bigint")),
    )


def replay_check(
    counts: DataFrame, mode: str = "insert", truncate: bool = False, rerun: bool = True
) -> DataFrame:
    """Adds ``skip_copy``: a rerun of a plain insert whose target already holds all source rows."""
    plain_rerun = F.lit(rerun and mode == "insert" and not truncate)
    complete = (F.col("target_row_count") >= F.col("source_row_count")) & (F.col("missing_row_count") == 0)
    return counts.withColumn("skip_copy", plain_rerun & complete)
