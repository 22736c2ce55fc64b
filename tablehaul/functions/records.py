"""Schema and row-level views of nested run records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablehaul.functions.text import first_filled, plain, strip

# Object types in the order they are moved.
OBJECT_TYPES = ["sequence", "synonym", "table", "view", "function", "storedprocedure", "trigger", "event", "cursor"]

OBJECT_FIELDS = (
    "run_id string, object_name string, object_type string, status string, source_db string, target_db string, "
    "rows_migrated bigint, source_row_count bigint, target_row_count bigint, missing_row_count bigint, "
    "retry_count bigint, error_type string, error_message string, remediation string, transformed_sql string, "
    "started_at timestamp_ntz, completed_at timestamp_ntz"
)
_COUNTERS = "total bigint, success bigint, error bigint, skipped bigint"
STATS_FIELDS = (
    "total_objects bigint, success_objects bigint, error_objects bigint, skipped_objects bigint, "
    "total_rows_migrated bigint, total_source_rows bigint, total_target_rows bigint, total_missing_rows bigint, "
    f"total_retries bigint, by_type map<string, struct<{_COUNTERS}>>"
)
_STATEMENT_FIELDS = "type string, name string, query string, object_type string, object_name string, transformed_sql string"
RECORD_SCHEMA = (
    "run_summary struct<run_id string, status string, source_db string, target_db string, "
    f"execution_order array<string>, stats struct<{STATS_FIELDS}>, object_results array<struct<{OBJECT_FIELDS}>>, "
    "started_at timestamp_ntz, completed_at timestamp_ntz>, "
    "logs array<string>, "
    f"results array<struct<{_STATEMENT_FIELDS}, status string>>, "
    f"transformed_queries array<struct<{_STATEMENT_FIELDS}>>, "
    "job_request struct<mode string, payload string, parent_job_id string, trigger_type string, event_name string, "
    "captured_at string>, "
    "seq bigint"
)
DIAGNOSTICS_SCHEMA = (
    "run_id string, mode string, source_db string, target_db string, execution_order array<string>, "
    "started_at string, completed_at string, objects array<struct<object_type string, object_name string, "
    "status string, error_type string, remediation string, diagnostics string>>, seq bigint"
)


def _total(objects: Column, field: str) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.aggregate(objects, zero, lambda acc, o: acc + F.coalesce(o[field], zero))


def _tally(objects: Column, status: str) -> Column:
    return F.size(F.filter(objects, lambda o: o["status"] == status)).cast("bigint")


def _counters(objects: Column) -> Column:
    return F.struct(
        F.size(objects).cast("bigint").alias("total"),
        *[_tally(objects, status).alias(status) for status in ("success", "error", "skipped")],
    )


def record_stats(objects: Column) -> Column:
    """The stats struct of one record's object results; every known type has its counters."""
    extra = F.array_except(F.transform(objects, lambda o: o["object_type"]), F.lit(OBJECT_TYPES))
    types = F.concat(F.lit(OBJECT_TYPES), F.array_distinct(F.array_compact(extra)))
    by_type = F.map_from_entries(
        F.transform(types, lambda t: F.struct(t, _counters(F.filter(objects, lambda o: o["object_type"] == t))))
    )
    return F.struct(
        F.size(objects).cast("bigint").alias("total_objects"),
        *[_tally(objects, s).alias(f"{s}_objects") for s in ("success", "error", "skipped")],
        _total(objects, "rows_migrated").alias("total_rows_migrated"),
        _total(objects, "source_row_count").alias("total_source_rows"),
        _total(objects, "target_row_count").alias("total_target_rows"),
        _total(objects, "missing_row_count").alias("total_missing_rows"),
        _total(objects, "retry_count").alias("total_retries"),
        by_type.alias("by_type"),
    )


def record_status(objects: Column) -> Column:
    """success when every object succeeded (or there is none), else partial."""
    return F.when(F.forall(objects, lambda o: o["status"] == "success"), F.lit("success")).otherwise(F.lit("partial"))


def run_succeeded(run: Column) -> Column:
    return (plain(run["status"]) == "success") & (strip(F.coalesce(run["run_id"], F.lit(""))) != "")


def diagnostics_succeeded(objects: Column) -> Column:
    return F.coalesce((F.size(objects) > 0) & F.forall(objects, lambda o: plain(o["status"]) == "success"), F.lit(False))


def script_objects(record: Column | None = None) -> Column:
    """(type, name, query) of a record's statements, from the first list that is not empty."""
    def rows(items, kind, name, query):
        return F.transform(
            items,
            lambda o: F.struct(
                strip(kind(o)).alias("type"), strip(name(o)).alias("name"), strip(query(o)).alias("query")
            ),
        )

    def statements(items):
        return rows(
            items,
            lambda o: first_filled(o["type"], o["object_type"]),
            lambda o: first_filled(o["name"], o["object_name"]),
            lambda o: first_filled(o["query"], o["transformed_sql"]),
        )

    object_results = F.col("run_summary.object_results")
    from_objects = rows(
        object_results,
        lambda o: first_filled(o["object_type"]),
        lambda o: first_filled(o["object_name"]),
        lambda o: first_filled(o["transformed_sql"]),
    )
    chosen = (
        F.when(F.size("results") > 0, statements(F.col("results")))
        .when(F.size(object_results) > 0, from_objects)
        .otherwise(statements(F.coalesce(F.col("transformed_queries"), F.array())))
    )
    return F.filter(chosen, lambda o: o["query"] != "")


def script_text(objects: Column) -> Column:
    """One script: a comment line with type and name above each statement."""
    entries = F.transform(
        objects,
        lambda o: F.concat(
            F.lit("-- "), first_filled(o["type"], F.lit("object")), F.lit(": "),
            first_filled(o["name"], F.lit("unnamed")), F.lit("\n"), o["query"],
        ),
    )
    return strip(F.array_join(entries, "\n\n"))


def _clock(started: Column, completed: Column) -> tuple[Column, Column, Column]:
    """Whole hours, minutes and seconds between two times; no session zone involved."""
    def part(unit: str) -> Column:
        return F.floor(F.extract(F.lit(unit), completed - started)).cast("bigint")

    return part("DAY") * 24 + part("HOUR"), part("MINUTE"), part("SECOND")


def _unknown(started: Column, completed: Column) -> Column:
    return started.isNull() | completed.isNull() | (completed < started)


def duration_label(started: Column, completed: Column) -> Column:
    """1h 2m 03s, 2m 03s or 3s; ``--`` when a time is missing or they are the wrong way round."""
    h, m, s = _clock(started, completed)
    return (
        F.when(_unknown(started, completed), F.lit("--"))
        .when(h > 0, F.format_string("%dh %dm %02ds", h, m, s))
        .when(m > 0, F.format_string("%dm %02ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def minutes_label(started: Column, completed: Column) -> Column:
    """The short form: 62m 3s."""
    h, m, s = _clock(started, completed)
    return F.when(_unknown(started, completed), F.lit("--")).otherwise(F.format_string("%dm %ds", h * 60 + m, s))


def by_type_label(by_type: Column) -> Column:
    """table:3/4 | view:1/1, for the types that occur."""
    entries = F.filter(F.map_entries(by_type), lambda e: e["value"]["total"] > 0)
    return F.array_join(
        F.transform(
            entries,
            lambda e: F.concat(
                e["key"], F.lit(":"), e["value"]["success"].cast("string"), F.lit("/"), e["value"]["total"].cast("string")
            ),
        ),
        " | ",
    )
