"""Filters, order, pages and flat forms of nested run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablehaul.functions.messages import log_level
from tablehaul.functions.records import (
    by_type_label,
    diagnostics_succeeded,
    duration_label,
    run_succeeded,
    script_objects,
    script_text,
)
from tablehaul.operators.merge import one_per_key

PAGE_SIZE = 10
#: Records that are sorted for a page at most, and ranges they are counted by.
SORTED, RANGES = 10_000, 1024


def latest_runs(records: DataFrame, limit: int | None = 100, order: str = "seq") -> DataFrame:
    """Newest first by append order; no limit when it is None or negative."""
    newest = records.orderBy(F.col(order).desc())
    return newest if limit is None or limit < 0 else newest.limit(limit)


def find_run(records: DataFrame, run_id: str, order: str = "seq") -> DataFrame:
    """The newest record of a run."""
    return latest_runs(records.filter(F.col("run_summary.run_id") == run_id), 1, order)


def history_search(
    records: DataFrame,
    status: str = "",
    object_type: str = "",
    search: str = "",
    date_from: str = "",
    date_to: str = "",
) -> DataFrame:
    """Records that pass every given filter; a record without a start fails a date filter."""
    run = F.col("run_summary")
    found = records
    if status:
        found = found.filter(F.lower(run["status"]) == status)
    if object_type:
        found = found.filter(F.exists(run["object_results"], lambda o: o["object_type"] == object_type))
    if search:
        blank = F.lit("")
        names = F.transform(
            F.coalesce(run["object_results"], F.array()),
            lambda o: F.concat_ws(" ", F.coalesce(o["object_type"], blank), F.coalesce(o["object_name"], blank)),
        )
        heads = F.array(*[F.coalesce(run[c], blank) for c in ("run_id", "source_db", "target_db")])
        found = found.filter(F.lower(F.array_join(F.concat(heads, names), " ")).contains(search.lower()))
    if date_from:
        found = found.filter(run["started_at"] >= F.lit(f"{date_from} 00:00:00").cast("timestamp_ntz"))
    if date_to:
        found = found.filter(run["started_at"] <= F.lit(f"{date_to} 23:59:59").cast("timestamp_ntz"))
    return found


def history_page(records: DataFrame, page: int = 1, size: int = PAGE_SIZE, order: str = "seq") -> DataFrame:
    """One page by start time, latest first, records without a start last; adds ``position``.

    A page past the end gives the last one. Records are counted by ranges of their
    start until the page is known to lie in ranges of at most ``SORTED`` records (or
    among as many of one start by ``order``, which no two records share); only those are sorted. So the last page
    costs no more than the first, and the driver sees at most ``RANGES`` numbers a pass.
    """
    page = max(1, page)
    start = F.col("run_summary.started_at")
    by = [start.desc_nulls_last(), F.col(order).desc()]
    found = records.agg(F.count("*").alias("n"), F.count(start).alias("started")).first()
    shown = min(page, max(1, -(-found["n"] // size)))
    skip = (shown - 1) * size
    if skip + size <= SORTED:
        parts = [(records, skip, size)]
    else:
        at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), start)
        dated = min(max(found["started"] - skip, 0), size)
        parts = _ranges_of(records.filter(start.isNotNull()), [at, F.col(order)], skip, dated)
        parts += _ranges_of(records.filter(start.isNull()), [F.col(order)], max(skip - found["started"], 0), size - dated)
    done, out = skip, None
    for rows, above, wanted in parts:
        # one partition, in order: what comes out of a sort with a limit
        one = rows.orderBy(*by).offset(above).limit(wanted).withColumn("position", F.monotonically_increasing_id() + F.lit(done + 1).cast("bigint"))
        out, done = one if out is None else out.unionAll(one), done + wanted
    return out


def _ranges_of(rows: DataFrame, keys: list[Column], skip: int, size: int) -> list[tuple[DataFrame, int, int]]:
    """(rows, skip, size) of the key ranges that hold the ``size`` rows after the first ``skip``, greatest keys first."""
    if size <= 0:
        return []
    key = keys[0]
    low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    if n <= SORTED or n == 0:
        return [(rows, skip, size)]
    if low == high:
        return _ranges_of(rows, keys[1:], skip, size) if keys[1:] else [(rows, skip, size)]
    step = max(1, -(-(high - low + 1) // RANGES))
    number = F.call_function("div", key - F.lit(low), F.lit(step))
    counts = dict(rows.groupBy(number.alias("range")).count().collect())
    first, above, held = None, skip, []
    for r in sorted(counts, reverse=True):
        if first is None and above >= counts[r]:
            above -= counts[r]
            continue
        first = r if first is None else first
        held.append(r)
        if sum(counts[x] for x in held) - above >= size:
            break
    between = lambda a, b: rows.filter((key >= F.lit(low + a * step)) & (key < F.lit(low + (b + 1) * step)))
    if sum(counts[x] for x in held) <= SORTED:
        return [(between(held[-1], held[0]), above, size)]
    out = []
    for r in held:
        take = min(size, counts[r] - above)
        out += _ranges_of(between(r, r), keys, above, take)
        size, above = size - take, 0
    return out


def history_after(records: DataFrame, started_at=None, seq: int | None = None, size: int = PAGE_SIZE, order: str = "seq") -> DataFrame:
    """The page after the record with this start and number, in the order of :func:`history_page`; the first without ``seq``.

    However deep the page is, each task keeps ``size`` records: the last record
    shown says where to go on, and nothing before it is sorted or counted.
    """
    start, number = F.col("run_summary.started_at"), F.col(order)
    rest = records
    if seq is not None and started_at is None:
        rest = records.filter(start.isNull() & (number < seq))
    elif seq is not None:
        at = F.lit(started_at).cast("timestamp_ntz")
        rest = records.filter(start.isNull() | (start < at) | ((start == at) & (number < seq)))
    return rest.orderBy(start.desc_nulls_last(), number.desc()).limit(size)


def history_flat(records: DataFrame) -> DataFrame:
    """The flat export: one row of plain cells per record, and the two labels shown with it."""
    run = F.col("run_summary")
    stats = run["stats"]
    numbers = [
        "total_objects", "success_objects", "error_objects", "skipped_objects", "total_rows_migrated",
        "total_source_rows", "total_target_rows", "total_missing_rows", "total_retries",
    ]
    return records.select(
        *[F.coalesce(run[c], F.lit("")).alias(c) for c in ("run_id", "status", "source_db", "target_db")],
        run["started_at"].alias("started_at"),
        run["completed_at"].alias("completed_at"),
        *[F.coalesce(stats[c], F.lit(0).cast("bigint")).alias(c) for c in numbers],
        duration_label(run["started_at"], run["completed_at"]).alias("duration"),
        by_type_label(stats["by_type"]).alias("by_type"),
    )


def export_history(records: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with every cell quoted, or the records as JSON lines."""
    if kind == "json":
        records.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path)
        return
    cells = history_flat(records).drop("duration", "by_type")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cells.columns]
    cells.select(*text).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def job_summary(
    records: DataFrame, schedules: DataFrame, search: str = "", status: str = "", trigger: str = ""
) -> DataFrame:
    """Runs with their schedule (one per ``job_id``), filtered by text, status and trigger type."""
    run = F.col("run_summary")
    wanted = history_search(records, status=status)
    jobs = wanted.filter(run["run_id"].isNotNull() & (run["run_id"] != "")).select(
        run["run_id"].alias("job_id"),
        F.concat(F.coalesce(run["source_db"], F.lit("Unknown")), F.lit(" -> "), F.coalesce(run["target_db"], F.lit("Unknown"))).alias("job_name"),
        F.coalesce(run["status"], F.lit("success")).alias("status"),
        run["source_db"].alias("source_db"),
        run["target_db"].alias("target_db"),
        F.coalesce(F.size(run["object_results"]), F.lit(0)).cast("bigint").alias("task_count"),
        *[
            F.coalesce(run["stats"][c], F.lit(0).cast("bigint")).alias(name)
            for c, name in (("success_objects", "successful_tasks"), ("error_objects", "failed_tasks"), ("skipped_objects", "skipped_tasks"))
        ],
        F.array_join(F.transform(run["object_results"], lambda o: F.concat_ws(" ", o["object_type"], o["object_name"])), " ").alias("_tasks"),
    )
    if search:
        blank = F.lit("")
        text = F.concat_ws(" ", *[F.coalesce(F.col(c), blank) for c in ("job_id", "job_name", "source_db", "target_db", "_tasks")])
        jobs = jobs.filter(F.lower(text).contains(search.lower()))
    plans = schedules.select("job_id", F.col("trigger_type").alias("_trigger"), F.col("enabled").alias("schedule_enabled"))
    joined = jobs.drop("_tasks").join(plans, "job_id", "left")
    joined = joined.withColumn("trigger_type", F.coalesce("_trigger", F.lit("none"))).drop("_trigger")
    return joined.filter(F.col("trigger_type") == trigger) if trigger else joined


def success_archive(records: DataFrame) -> DataFrame:
    return records.filter(run_succeeded(F.col("run_summary")))


def diagnostics_archive(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.filter(diagnostics_succeeded(F.col("objects")) & (F.trim("run_id") != ""))


def run_scripts(records: DataFrame) -> DataFrame:
    """Per record: how many statements it has and all of them as one script; no shuffle."""
    return records.select(
        F.col("run_summary.run_id").alias("run_id"), script_objects().alias("objects")
    ).select("run_id", F.size("objects").cast("bigint").alias("statements"), script_text(F.col("objects")).alias("full_script"))


def newest_records(records: DataFrame, order: str = "seq") -> DataFrame:
    """The newest record of each run; records without a run id are left out."""
    run_id = F.col("run_summary.run_id")
    named = records.filter(F.coalesce(F.trim(run_id), F.lit("")) != "").withColumn("_run", run_id)
    return one_per_key(named, ["_run"], [order]).drop("_run")


def mirror_objects(records: DataFrame) -> DataFrame:
    """Child rows: the objects of each record, numbered from 1, with what is missing as empty text or 0."""
    blank = F.lit("")
    o = F.col("o")
    return records.select(F.col("run_summary.run_id").alias("run_id"), F.posexplode("run_summary.object_results").alias("pos", "o")).select(
        "run_id",
        (F.col("pos") + 1).cast("bigint").alias("sequence_no"),
        *[F.coalesce(o[c], blank).alias(c) for c in ("object_type", "object_name", "status")],
        F.coalesce(o["rows_migrated"], F.lit(0)).cast("bigint").alias("rows_migrated"),
        *[o[c].alias(c) for c in ("error_type", "error_message", "remediation", "started_at", "completed_at")],
    )


def mirror_runs(records: DataFrame, order: str = "seq") -> DataFrame:
    """Parent rows: the newest record of each run, with its first failed object and first error message."""
    named = records.filter(F.coalesce(F.trim("run_summary.run_id"), F.lit("")) != "")
    rows = run_rows(named, F.col(order).alias("_order"))
    return one_per_key(rows, ["run_id"], ["_order"]).drop("_order")


def run_rows(records: DataFrame, *more: Column) -> DataFrame:
    """The parent row of each record, and ``more`` columns of the record."""
    run = F.col("run_summary")
    failed = F.filter(run["object_results"], lambda o: o["status"] == "error")
    said = F.filter(failed, lambda o: F.coalesce(o["error_message"], F.lit("")) != "")
    return records.select(
        run["run_id"].alias("run_id"),
        F.coalesce(run["status"], F.lit("unknown")).alias("status"),
        F.coalesce(run["source_db"], F.lit("")).alias("source_db"),
        F.coalesce(run["target_db"], F.lit("")).alias("target_db"),
        F.get(failed, F.lit(0))["object_type"].alias("current_object_type"),
        F.get(failed, F.lit(0))["object_name"].alias("current_object_name"),
        F.get(said, F.lit(0))["error_message"].alias("error_message"),
        run["started_at"].alias("started_at"),
        run["completed_at"].alias("completed_at"),
        *more,
    )


#: What a mirror stores of a run and of its objects.
_RUN_PARTS = ("run_id", "status", "source_db", "target_db", "started_at", "completed_at")
_OBJECT_PARTS = (
    "object_type", "object_name", "status", "rows_migrated", "error_type", "error_message", "remediation", "started_at", "completed_at",
)


def mirrored_parts(records: DataFrame, order: str = "seq") -> DataFrame:
    """Records with only what a mirror stores: neither statistics nor statements."""
    run = F.col("run_summary")
    objects = F.transform(run["object_results"], lambda o: F.struct(*[o[c].alias(c) for c in _OBJECT_PARTS]))
    kept = F.struct(*[run[c].alias(c) for c in _RUN_PARTS], objects.alias("object_results"))
    return records.select(kept.alias("run_summary"), "logs", order)


def log_rows(records: DataFrame) -> DataFrame:
    """Child rows: the log lines of each record, numbered from 1, with their level."""
    return records.select(
        F.col("run_summary.run_id").alias("run_id"), F.posexplode("logs").alias("pos", "message")
    ).select("run_id", (F.col("pos") + 1).cast("bigint").alias("sequence_no"), log_level(F.col("message")).alias("level"), "message")
