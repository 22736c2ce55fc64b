"""Statistics, statuses and checkpoints over object rows (one row per moved object).

Runs are groups of any size here, so everything is a partial aggregation: no
operator gathers a run's rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablehaul.functions.records import OBJECT_TYPES

_SUMS = {
    "total_rows_migrated": "rows_migrated",
    "total_source_rows": "source_row_count",
    "total_target_rows": "target_row_count",
    "total_missing_rows": "missing_row_count",
    "total_retries": "retry_count",
}
_TALLIES = ["success", "error", "skipped"]


def object_rows(records: DataFrame) -> DataFrame:
    """Run records flattened to one row per object result, numbered in record order."""
    return records.select(
        F.col("run_summary.run_id").alias("record_run_id"),
        F.posexplode("run_summary.object_results").alias("pos", "o"),
    ).select(F.col("record_run_id"), (F.col("pos") + 1).cast("bigint").alias("object_seq"), "o.*")


def _per_type(objects: DataFrame) -> DataFrame:
    status = F.col("status")
    return objects.groupBy("run_id", "object_type").agg(
        F.count("*").alias("total_objects"),
        *[F.count_if(status == s).alias(f"{s}_objects") for s in _TALLIES],
        *[F.sum(F.coalesce(F.col(c), F.lit(0)).cast("bigint")).alias(name) for name, c in _SUMS.items()],
    )


def run_stats(objects: DataFrame) -> DataFrame:
    """Counters and row sums per (run, type) and, with ``is_total`` 1, per run.

    The rows are summed per type first; the run totals come from those sums.
    """
    names = ["total_objects", *[f"{s}_objects" for s in _TALLIES], *_SUMS]
    run, kind = F.col("run_id"), F.col("object_type")
    return (
        _per_type(objects)
        .groupingSets([[run, kind], [run]], run, kind)
        .agg(F.grouping("object_type").cast("int").alias("is_total"), *[F.sum(n).alias(n) for n in names])
    )


def run_stats_by_type(objects: DataFrame) -> DataFrame:
    """Counters per run for all nine known types, zero where a run has none, and any other type it has, null too."""
    counted = objects.groupBy("run_id", "object_type").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in _TALLIES]
    )
    # Each of these few rows brings zeros for all known types along; nothing is gathered per run.
    names = ["total", *_TALLIES]
    zeros = [F.struct(F.lit(t).alias("object_type"), *[F.lit(0).cast("bigint").alias(n) for n in names]) for t in OBJECT_TYPES]
    rows = counted.select("run_id", F.inline(F.array(F.struct("object_type", *names), *zeros)))
    return rows.groupBy("run_id", "object_type").agg(*[F.sum(n).alias(n) for n in names])


def run_status(objects: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Status and counters per run.

    ``runs`` (run_id, and optionally booleans ``failed`` and ``stopped``) adds runs
    without objects, and runs that ended by an exception or a stop.
    """
    counted = objects.groupBy("run_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in _TALLIES]
    )
    failed = stopped = F.lit(False)
    if runs is not None:
        counted = runs.join(counted, "run_id", "left")
        failed = F.coalesce(F.col("failed"), failed) if "failed" in runs.columns else failed
        stopped = F.coalesce(F.col("stopped"), stopped) if "stopped" in runs.columns else stopped
    zero = F.lit(0).cast("bigint")
    tallies = [F.coalesce(F.col(c), zero) for c in ["total", *_TALLIES]]
    status = (
        F.when(failed, "error").when(stopped, "stopped").when(tallies[0] == tallies[1], "success").otherwise("partial")
    )
    return counted.select("run_id", status.alias("status"), *[t.alias(c) for t, c in zip(tallies, ["total", *_TALLIES])])


def resume_point(objects: DataFrame, order: str = "seq") -> DataFrame:
    """Per run with errors: the first failed object, and the first error message that says anything."""
    said = F.col("error_message").isNotNull() & (F.col("error_message") != "")
    first = F.min_by(F.struct("object_type", "object_name"), order)
    return (
        objects.filter(F.col("status") == "error")
        .groupBy("run_id")
        .agg(
            first.alias("first"),
            F.min(order).alias("resume_seq"),
            F.min_by("error_message", F.when(said, F.col(order))).alias("error_message"),
        )
        .select("run_id", F.col("first.object_type"), F.col("first.object_name"), "resume_seq", "error_message")
    )


def missing_objects(objects: DataFrame) -> DataFrame:
    """Objects whose target lacks rows."""
    return objects.filter(F.coalesce(F.col("missing_row_count"), F.lit(0)) > 0)


def failed_objects(objects: DataFrame) -> DataFrame:
    return objects.filter(F.col("status") == "error")


def history_totals(records: DataFrame) -> DataFrame:
    """One row of sums over the given (filtered) records."""
    def total(field: str) -> Column:
        return F.coalesce(F.sum(f"run_summary.stats.{field}"), F.lit(0).cast("bigint"))

    return records.agg(
        F.count("*").alias("runs"),
        total("total_objects").alias("objects"),
        total("success_objects").alias("success"),
        total("error_objects").alias("error"),
        total("total_rows_migrated").alias("rows"),
        total("total_missing_rows").alias("missing"),
    )
