"""JSON-lines run and diagnostics logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablehaul.functions.records import DIAGNOSTICS_SCHEMA, RECORD_SCHEMA
from tablehaul.operators.history import diagnostics_archive, success_archive
from tablehaul.session import scratch_path

# Times with all six digits, or none; Spark's own JSON format would cut them to three.
TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}
# Log files are compressed, and a file is read by one task, so its number of records is limited.
WRITTEN = {**TIMES, "compression": "gzip", "maxRecordsPerFile": "100000"}


ZONE = r"[0-9](Z|[+-][0-9]{2}:?[0-9]{2})$"


def plain_time(text: Column) -> Column:
    """A time as written, one with a zone in UTC; null if it is no time."""
    written = F.trim(text)
    in_utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), written.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(written.rlike(ZONE), in_utc).otherwise(written.try_cast("timestamp_ntz"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records; blank lines are no records, a broken line fails the scan.

    Times are read as text first: one that can't be understood is null in its
    record, which stays, and sorts last.
    """
    as_text = RECORD_SCHEMA.replace("timestamp_ntz", "string")
    rows = spark.read.schema(as_text).option("mode", "FAILFAST").json(path)
    timed = lambda c: c.withField("started_at", plain_time(c["started_at"])).withField("completed_at", plain_time(c["completed_at"]))
    run = F.col("run_summary")
    objects = F.transform(run["object_results"], timed)
    return rows.withColumn("run_summary", timed(run.withField("object_results", objects)))


def read_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DIAGNOSTICS_SCHEMA).options(**TIMES).option("mode", "FAILFAST").json(path)


def _fixed(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "log-copy")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_runs(records: DataFrame, path: str, archive: str | None = None) -> None:
    """Append run records to the log, and those that succeeded to the archive.

    Both are written from one copy, so they agree even if ``records`` would come
    out differently when computed again.
    """
    records = _fixed(records) if archive else records
    records.write.mode("append").options(**WRITTEN).json(path)
    if archive:
        success_archive(records).write.mode("append").options(**WRITTEN).json(archive)


def append_diagnostics(diagnostics: DataFrame, path: str, archive: str | None = None) -> None:
    diagnostics = _fixed(diagnostics) if archive else diagnostics
    diagnostics.write.mode("append").options(**WRITTEN).json(path)
    if archive:
        diagnostics_archive(diagnostics).write.mode("append").options(**WRITTEN).json(archive)
