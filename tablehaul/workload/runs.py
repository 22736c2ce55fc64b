"""Run-log analytics, work lists and time slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablehaul.functions import messages
from tablehaul.functions.records import OBJECT_TYPES, minutes_label
from tablehaul.operators import history, runlog, slots, writes
from tablehaul.plans import work_list as plans
from tablehaul.plans.rules import BLOCKERS, UNSUPPORTED
from tablehaul.session import scratch_path
from tablehaul.sources import run_log
from tablehaul.workload.inputs import RECORD_OBJECTS, RECORDS, base, ctes, run_records, table
from tablehaul.workload.registry import query


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- statistics over object rows ------------------------------------------

_STATS = """count(*) AS total_objects, count(*) FILTER (status = 'success') AS success_objects,
      count(*) FILTER (status = 'error') AS error_objects, count(*) FILTER (status = 'skipped') AS skipped_objects,
      CAST(sum(rows_migrated) AS bigint) AS total_rows_migrated, CAST(sum(source_row_count) AS bigint) AS total_source_rows,
      CAST(sum(target_row_count) AS bigint) AS total_target_rows,
      CAST(sum(coalesce(missing_row_count, 0)) AS bigint) AS total_missing_rows, CAST(sum(retry_count) AS bigint) AS total_retries"""


@query(
    f"""WITH {ctes("objects")} SELECT run_id, object_type, grouping(object_type)::integer AS is_total, {_STATS}
    FROM objects GROUP BY GROUPING SETS ((run_id, object_type), (run_id))"""
)
def run_stats(spark, sf):
    return runlog.run_stats(table(spark, sf, "objects"))


@query(
    f"""WITH {ctes("objects")}, runs AS (SELECT DISTINCT run_id FROM objects),
    kinds(object_type) AS (VALUES {", ".join(f"('{t}')" for t in OBJECT_TYPES)})
    SELECT r.run_id, k.object_type, count(o.seq) AS total, count(*) FILTER (o.status = 'success') AS success,
      count(*) FILTER (o.status = 'error') AS error, count(*) FILTER (o.status = 'skipped') AS skipped
    FROM runs r CROSS JOIN kinds k LEFT JOIN objects o ON o.run_id = r.run_id AND o.object_type = k.object_type
    GROUP BY 1, 2"""
)
def run_stats_by_type(spark, sf):
    # Only some types occur, so that the zero fill shows.
    return runlog.run_stats_by_type(table(spark, sf, "objects"))


@query(
    f"""WITH {ctes("objects")}, varied AS (SELECT CASE WHEN run_id = 'run-5' THEN 'elsewhere' ELSE run_id END AS run_id,
      CASE WHEN CAST(substr(run_id, 5) AS bigint) % 3 = 0 THEN 'success' ELSE status END AS status FROM objects),
    runs AS (SELECT 'run-' || user_id AS run_id, bool_or(user_id % 40 = 3) AS failed, bool_or(user_id % 30 = 4) AS stopped
             FROM events GROUP BY user_id),
    c AS (SELECT run_id, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS error,
      count(*) FILTER (status = 'skipped') AS skipped FROM varied WHERE run_id IS NOT NULL GROUP BY 1)
    SELECT r.run_id, CASE WHEN failed THEN 'error' WHEN stopped THEN 'stopped' WHEN coalesce(total, 0) = coalesce(success, 0) THEN 'success' ELSE 'partial' END AS status,
      coalesce(total, 0) AS total, coalesce(success, 0) AS success, coalesce(error, 0) AS error, coalesce(skipped, 0) AS skipped
    FROM runs r LEFT JOIN c USING (run_id)"""
)
def run_status(spark, sf):
    # All objects; those of every third run succeed and one run has none, so that each status occurs.
    run = F.col("run_id")
    varied = F.when(F.substring(run, 5, 20).cast("bigint") % 3 == 0, "success").otherwise(F.col("status"))
    objects = table(spark, sf, "objects").withColumns({"status": varied, "run_id": F.when(run == "run-5", "elsewhere").otherwise(run)})
    runs = base(spark, sf, "events").groupBy("user_id").agg(
        F.bool_or(F.col("user_id") % 40 == 3).alias("failed"), F.bool_or(F.col("user_id") % 30 == 4).alias("stopped")
    )
    runs = runs.select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), "failed", "stopped")
    return runlog.run_status(objects, runs)


@query(
    f"""WITH {ctes("objects")}, e AS (SELECT * FROM objects WHERE status = 'error'),
    f AS (SELECT run_id, min(seq) AS resume_seq, min(seq) FILTER (error_message IS NOT NULL AND error_message <> '') AS said FROM e GROUP BY 1)
    SELECT f.run_id, a.object_type, a.object_name, f.resume_seq, b.error_message
    FROM f JOIN e a ON a.run_id = f.run_id AND a.seq = f.resume_seq LEFT JOIN e b ON b.run_id = f.run_id AND b.seq = f.said"""
)
def resume_point(spark, sf):
    return runlog.resume_point(table(spark, sf, "objects"))


@query(f"WITH {ctes('objects')} SELECT run_id, object_type, object_name, source_row_count, target_row_count, missing_row_count FROM objects WHERE missing_row_count > 0")
def missing_objects(spark, sf):
    return runlog.missing_objects(table(spark, sf, "objects")).select(
        "run_id", "object_type", "object_name", "source_row_count", "target_row_count", "missing_row_count"
    )


@query(f"WITH {ctes('objects')} SELECT run_id, object_type, object_name, error_message FROM objects WHERE status = 'error'")
def failed_objects(spark, sf):
    return runlog.failed_objects(table(spark, sf, "objects")).select("run_id", "object_type", "object_name", "error_message")


# --- nested run records ---------------------------------------------------


@query(
    f"""WITH {RECORDS} SELECT seq, run_id, status, source_db, target_db, total_objects, 1 + total_objects AS log_lines,
      total_rows_migrated, started_at, completed_at FROM records"""
)
def runs_scan(spark, sf):
    """Records written as JSON lines and read again."""
    path = scratch_path(spark, "runs")
    run_log.append_runs(run_records(spark, sf), path)
    run = F.col("run_summary")
    return run_log.read_runs(spark, path).select(
        "seq", *[run[c].alias(c) for c in ("run_id", "status", "source_db", "target_db")],
        F.size(run["object_results"]).cast("bigint").alias("total_objects"),
        F.size("logs").cast("bigint").alias("log_lines"),
        run["stats"]["total_rows_migrated"].alias("total_rows_migrated"),
        run["started_at"].alias("started_at"), run["completed_at"].alias("completed_at"),
    )


@query(
    f"""WITH {RECORD_OBJECTS} SELECT run_id, i + 1 AS object_seq, object_type, object_name, status, rows_migrated,
      source_row_count, missing_row_count, retry_count, error_message FROM rec_objects"""
)
def object_rows(spark, sf):
    rows = runlog.object_rows(run_records(spark, sf))
    return rows.select(
        "run_id", "object_seq", "object_type", "object_name", "status", "rows_migrated", "source_row_count",
        "missing_row_count", "retry_count", "error_message",
    )


@query(f"WITH {RECORDS} SELECT seq, run_id, status FROM records ORDER BY seq DESC LIMIT 100")
def latest_runs(spark, sf):
    run = F.col("run_summary")
    return history.latest_runs(run_records(spark, sf)).select("seq", run["run_id"].alias("run_id"), run["status"].alias("status"))


@query(f"WITH {RECORDS} SELECT seq, run_id, status, total_objects FROM records WHERE run_id = 'r123'")
def find_run(spark, sf):
    run = F.col("run_summary")
    return history.find_run(run_records(spark, sf), "r123").select(
        "seq", run["run_id"].alias("run_id"), run["status"].alias("status"),
        run["stats"]["total_objects"].alias("total_objects"),
    )


_FOUND = """lower(status) = 'partial' AND list_contains(types, 'view')
    AND contains(lower(run_id || ' ' || source_db || ' ' || target_db) || CASE WHEN names = '' THEN '' ELSE ' ' || names END, 'server')
    AND started_at >= TIMESTAMP '2024-01-05 00:00:00' AND started_at <= TIMESTAMP '2024-01-25 23:59:59'"""


def _search(spark, sf):
    return history.history_search(
        run_records(spark, sf), status="partial", object_type="view", search="Server", date_from="2024-01-05",
        date_to="2024-01-25",
    )


@query(f"WITH {RECORDS} SELECT run_id, source_db, target_db, started_at FROM records WHERE {_FOUND}")
def history_search(spark, sf):
    run = F.col("run_summary")
    return _search(spark, sf).select(*[run[c].alias(c) for c in ("run_id", "source_db", "target_db", "started_at")])


@query(f"WITH {RECORDS} SELECT run_id FROM records WHERE contains(lower(run_id || ' ' || source_db || ' ' || target_db) || CASE WHEN names = '' THEN '' ELSE ' ' || names END, 'table o12')")
def history_text_search(spark, sf):
    return history.history_search(run_records(spark, sf), search="table o12").select("run_summary.run_id")


@query(
    f"""WITH {RECORDS}, o AS (SELECT run_id, row_number() OVER (ORDER BY started_at DESC NULLS LAST, seq DESC) AS position FROM records)
    SELECT * FROM o WHERE position BETWEEN 21 AND 30"""
)
def history_page(spark, sf):
    page = history.history_page(run_records(spark, sf), page=3)
    return page.select("run_summary.run_id", F.col("position").cast("bigint").alias("position"))


@query(
    f"""WITH {RECORDS}, o AS (SELECT run_id, row_number() OVER (ORDER BY started_at DESC NULLS LAST, seq DESC) AS position, count(*) OVER () AS n FROM records)
    SELECT run_id, position FROM o WHERE position > (n - 1) // 10 * 10"""
)
def history_last_page(spark, sf):
    page = history.history_page(run_records(spark, sf), page=10**9)
    return page.select("run_summary.run_id", "position")


@query(
    f"""WITH {RECORDS}, o AS (SELECT run_id, row_number() OVER (ORDER BY started_at DESC NULLS LAST, seq DESC) AS position FROM records)
    SELECT run_id FROM o WHERE position BETWEEN 21 AND 30"""
)
def history_page_after(spark, sf):
    """The third page, reached from the last record of the one before."""
    records = run_records(spark, sf)
    last = (None, None)
    for _ in range(2):
        shown = history.history_after(records, *last).select("run_summary.started_at", "seq").collect()
        last = (shown[-1].started_at, shown[-1].seq)
    return history.history_after(records, *last).select("run_summary.run_id")


@query(
    f"""WITH {RECORDS} SELECT count(*) AS runs, CAST(sum(total_objects) AS bigint) AS objects, CAST(sum(success_objects) AS bigint) AS success,
      CAST(sum(error_objects) AS bigint) AS error, CAST(sum(total_rows_migrated) AS bigint) AS rows, CAST(sum(total_missing_rows) AS bigint) AS missing
    FROM records WHERE {_FOUND}"""
)
def history_totals(spark, sf):
    return runlog.history_totals(_search(spark, sf))


@query(
    f"""WITH {RECORDS}, bt AS (SELECT event_id, string_agg(object_type || ':' || ok || '/' || n, ' | ' ORDER BY type_no) AS label
      FROM (SELECT event_id, object_type, type_no, count(*) AS n, count(*) FILTER (status = 'success') AS ok FROM rec_objects GROUP BY 1, 2, 3) GROUP BY 1),
    d AS (SELECT *, CAST(floor((epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0) AS bigint) AS s FROM records)
    SELECT run_id, status, source_db, target_db, started_at, completed_at, total_objects, success_objects, error_objects, skipped_objects,
      total_rows_migrated, total_source_rows, total_target_rows, total_missing_rows, total_retries, coalesce(label, '') AS by_type,
      CASE WHEN s IS NULL OR completed_at < started_at THEN '--' WHEN s >= 3600 THEN printf('%dh %dm %02ds', s // 3600, s % 3600 // 60, s % 60)
        WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration,
      CASE WHEN s IS NULL OR completed_at < started_at THEN '--' ELSE printf('%dm %ds', s // 60, s % 60) END AS minutes
    FROM d LEFT JOIN bt ON bt.event_id = d.seq"""
)
def history_flat(spark, sf):
    flat = history.history_flat(run_records(spark, sf))
    return flat.withColumn("minutes", minutes_label(F.col("started_at"), F.col("completed_at")))


@query(f"WITH {RECORDS} SELECT run_id, status, total_objects::varchar AS total_objects, total_retries::varchar AS total_retries FROM records")
def history_export(spark, sf):
    """The quoted CSV export, read back as text."""
    path = scratch_path(spark, "history")
    history.export_history(run_records(spark, sf), path)
    return spark.read.csv(path, header=True).select("run_id", "status", "total_objects", "total_retries")


@query(
    f"""WITH {RECORDS}, {ctes("schedules")}
    SELECT r.run_id AS job_id, source_db || ' -> ' || target_db AS job_name, status, source_db, target_db, total_objects AS task_count,
      success_objects AS successful_tasks, error_objects AS failed_tasks, skipped_objects AS skipped_tasks,
      coalesce(trigger_type, 'none') AS trigger_type, enabled AS schedule_enabled
    FROM records r LEFT JOIN schedules s ON s.job_id = r.run_id
    WHERE contains(lower(concat_ws(' ', r.run_id, source_db || ' -> ' || target_db, source_db, target_db, names)), 'mysql')
      AND status = 'partial'"""
)
def job_summary(spark, sf):
    return history.job_summary(run_records(spark, sf), table(spark, sf, "schedules"), search="MySQL", status="partial")


@query(
    f"""WITH {RECORDS}, {ctes("schedules")} SELECT r.run_id AS job_id, status
    FROM records r LEFT JOIN schedules s ON s.job_id = r.run_id WHERE coalesce(trigger_type, 'none') = 'none'"""
)
def unscheduled_jobs(spark, sf):
    return history.job_summary(run_records(spark, sf), table(spark, sf, "schedules"), trigger="none").select("job_id", "status")


@query(f"WITH {RECORDS} SELECT run_id, total_objects FROM records WHERE status = 'success'")
def success_archive(spark, sf):
    path = scratch_path(spark, "runs")
    run_log.append_runs(run_records(spark, sf), path, archive=path + "-archive")
    run = F.col("run_summary")
    return run_log.read_runs(spark, path + "-archive").select(
        run["run_id"].alias("run_id"), run["stats"]["total_objects"].alias("total_objects")
    )


@query(f"WITH {RECORDS} SELECT run_id FROM records WHERE total_objects > 0 AND total_objects = success_objects")
def diagnostics_archive(spark, sf):
    run = F.col("run_summary")
    path = scratch_path(spark, "diagnostics")
    diagnostics = run_records(spark, sf).select(
        run["run_id"].alias("run_id"), F.lit("bulk").alias("mode"),
        F.transform(run["object_results"], lambda o: F.struct(o["object_type"], o["object_name"], F.upper(o["status"]).alias("status"))).alias("objects"),
        "seq",
    )
    run_log.append_diagnostics(diagnostics, path, archive=path + "-archive")
    return run_log.read_diagnostics(spark, path + "-archive").select("run_id")


@query(
    f"""WITH {RECORDS}, s AS (SELECT event_id, count(*) AS n,
      string_agg('-- ' || object_type || ': ' || object_name || chr(10) || statement, chr(10) || chr(10) ORDER BY i) AS script
      FROM rec_objects WHERE statement <> '' GROUP BY 1)
    SELECT run_id, CASE WHEN total_objects = 0 THEN 1 ELSE coalesce(n, 0) END AS statements,
      CASE WHEN total_objects = 0 THEN '-- object: unnamed' || chr(10) || 'SELECT ' || seq ELSE coalesce(script, '') END AS full_script
    FROM records LEFT JOIN s ON s.event_id = seq"""
)
def run_script(spark, sf):
    return history.run_scripts(run_records(spark, sf))


@query(
    f"""WITH {RECORDS}, f AS (SELECT event_id, arg_min(object_type, i) AS current_object_type, arg_min(object_name, i) AS current_object_name,
      arg_min(error_message, i) FILTER (error_message IS NOT NULL) AS error_message FROM rec_objects WHERE status = 'error' GROUP BY 1)
    SELECT run_id, status, source_db, target_db, current_object_type, current_object_name, error_message, started_at, completed_at
    FROM records LEFT JOIN f ON f.event_id = seq"""
)
def mirror_runs(spark, sf):
    return history.mirror_runs(run_records(spark, sf))


_PARENTS = f"""WITH {RECORDS}, f AS (SELECT event_id, arg_min(object_type, i) AS current_object_type, arg_min(object_name, i) AS current_object_name,
      arg_min(error_message, i) FILTER (error_message IS NOT NULL) AS error_message FROM rec_objects WHERE status = 'error' GROUP BY 1)
    SELECT run_id, CASE WHEN seq % 2 = 0 THEN status ELSE 'queued' END AS status, source_db, target_db, current_object_type, current_object_name, error_message, started_at, completed_at
    FROM records LEFT JOIN f ON f.event_id = seq"""


def _mirrored(spark, sf, label):
    """All records mirrored as queued runs, then every other run again as it ended."""
    root = scratch_path(spark, label)
    name = "t_" + root.rsplit("-", 1)[1]
    records = run_records(spark, sf)
    queued = records.withColumn("run_summary", F.col("run_summary").withField("status", F.lit("queued")))
    writes.mirror_records(queued, name, root)
    writes.mirror_records(records.filter("seq % 2 = 0"), name, root)
    return root, name


@query(_PARENTS)
def mirror_parents(spark, sf):
    return spark.table(_mirrored(spark, sf, "parents")[1])


@query(
    f"""WITH {RECORD_OBJECTS} SELECT run_id, i + 1 AS sequence_no, object_type, object_name, status, rows_migrated, error_message, e.ts AS started_at
    FROM rec_objects JOIN events e USING (event_id)"""
)
def mirror_objects(spark, sf):
    """Objects of runs that were mirrored twice, then compacted."""
    path = _mirrored(spark, sf, "objects")[0] + "/objects"
    writes.compact_children(spark, path)
    return writes.read_children(spark, path).select(
        "run_id", "sequence_no", "object_type", "object_name", "status", "rows_migrated", "error_message", "started_at"
    )


@query(
    f"""WITH {RECORDS}, first_pass AS (SELECT run_id, 1 AS sequence_no, 'info' AS level, 'old line' AS message FROM records WHERE seq % 4 <> 1),
    lines AS (SELECT 'r' || event_id AS run_id, 1 AS sequence_no, 'Starting r' || event_id AS message, event_id FROM events
      UNION ALL SELECT run_id, i + 2, object_type || ' ' || object_name || ' ' || upper(status), event_id FROM rec_objects),
    fresh AS (SELECT run_id, sequence_no, CASE WHEN contains(lower(message), 'error') THEN 'error' WHEN contains(lower(message), 'skipped') THEN 'warn'
      WHEN contains(lower(message), 'success') THEN 'success' ELSE 'info' END AS level, message FROM lines WHERE event_id % 2 = 0)
    SELECT run_id, sequence_no, level, message FROM first_pass WHERE run_id NOT IN (SELECT 'r' || event_id FROM events WHERE event_id % 2 = 0)
    UNION ALL SELECT * FROM fresh"""
)
def mirror_children(spark, sf):
    path = scratch_path(spark, "children")
    records = run_records(spark, sf)
    runs = records.select("run_summary.run_id", "seq")
    old = runs.filter("seq % 4 <> 1")
    first = old.select("run_id", F.lit(1).cast("bigint").alias("sequence_no"), F.lit("info").alias("level"), F.lit("old line").alias("message"))
    writes.mirror_children(first, old, path)
    again = records.filter("seq % 2 = 0")
    writes.mirror_children(history.log_rows(again), again.select("run_summary.run_id"), path)
    return writes.read_children(spark, path)


@query(
    """SELECT 'r' || event_id AS run_id, 1::bigint AS sequence_no, CASE WHEN event_id % 3 = 1 THEN 'new' ELSE 'old' END AS message FROM events"""
)
def mirror_new_runs(spark, sf):
    """What is mirrored belongs to runs that are not stored yet and that ``runs`` does not name."""
    path = scratch_path(spark, "new-runs")
    runs = base(spark, sf, "events").select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("run_id"), "event_id")
    rows = runs.withColumn("sequence_no", F.lit(1).cast("bigint"))
    columns = ["run_id", "sequence_no", "message"]
    writes.mirror_children(rows.filter("event_id % 3 <> 1").withColumn("message", F.lit("old")).select(*columns), runs, path)
    fresh = rows.filter("event_id % 3 = 1").withColumn("message", F.lit("new")).select(*columns)
    writes.mirror_children(fresh, runs.limit(0), path)
    return writes.read_children(spark, path)


@query(
    """SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 3 THEN ts - INTERVAL 2 HOUR ELSE ts END AS started_at FROM events"""
)
def runs_odd_dates(spark, sf):
    """Run records whose times are no times, or have a zone."""
    path = scratch_path(spark, "odd-dates")
    e, at = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(e % 4 == 0, "not a date").when(e % 4 == 1, at).when(e % 4 == 2, F.concat(at, F.lit("Z"))).otherwise(F.concat(at, F.lit("+02:00")))
    records = base(spark, sf, "events").select(F.struct(e.cast("string").alias("run_id"), text.alias("started_at")).alias("run_summary"), e.alias("seq"))
    records.write.json(path)
    return run_log.read_runs(spark, path).select("seq", F.col("run_summary.started_at").alias("started_at"))


# --- messages -------------------------------------------------------------


@query(
    f"""WITH {ctes("log_lines")}, m AS (SELECT *, lower(message) AS l,
      regexp_extract(message, '^(\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}(?:\\.\\d+)?)\\s+-\\s+([^\\n\\r]*)$', 1) AS stamp FROM log_lines)
    SELECT conv_id, turn, CASE WHEN contains(l, 'error') THEN 'error' WHEN contains(l, 'skipped') THEN 'warn' WHEN contains(l, 'success') THEN 'success' ELSE 'info' END AS level,
      CASE WHEN contains(l, 'error') OR contains(l, 'failed') THEN 'error' WHEN contains(l, 'success') OR contains(l, 'completed') THEN 'success'
        WHEN contains(l, 'warn') OR contains(l, 'retry') OR contains(l, 'stopped') THEN 'warn' WHEN contains(l, '[system]') THEN 'dim'
        WHEN contains(l, '[migration]') THEN 'blue' ELSE 'info' END AS tone,
      nullif(stamp, '') AS logged_at, CASE WHEN stamp = '' THEN message ELSE substr(message, length(stamp) + 4) END AS text
    FROM m"""
)
def log_levels(spark, sf):
    message = F.col("message")
    return table(spark, sf, "log_lines").select(
        "conv_id", "turn", messages.log_level(message).alias("level"), messages.log_tone(message).alias("tone"),
        messages.log_stamp(message).alias("logged_at"), messages.log_text(message).alias("text"),
    )


@query(
    """SELECT 'doc-' || doc_id AS run_id, pos AS sequence_no, lines[pos] AS message,
      CASE WHEN contains(lower(lines[pos]), 'error') THEN 'error' WHEN contains(lower(lines[pos]), 'skipped') THEN 'warn'
        WHEN contains(lower(lines[pos]), 'success') THEN 'success' ELSE 'info' END AS level
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"""
)
def log_numbering(spark, sf):
    """Every line of every document as a numbered log line."""
    docs = base(spark, sf, "documents").select(
        F.struct(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("run_id")).alias("run_summary"),
        F.split("text", "\n").alias("logs"),
    )
    return history.log_rows(docs)


_CLASS = """CASE WHEN contains(l, 'not authorized') OR contains(l, 'permission') OR contains(l, 'access denied') THEN 'authorization'
      WHEN contains(l, 'does not exist') OR contains(l, 'doesn''t exist') OR contains(l, 'unknown table') OR contains(l, 'unknown column')
        OR contains(l, 'base table or view not found') THEN 'dependency'
      WHEN contains(l, 'syntax') OR contains(l, 'compilation error') OR contains(l, 'parse') THEN 'syntax'
      WHEN contains(l, 'invalid default value') OR contains(l, 'data type') OR contains(l, 'datatype') THEN 'transformation'
      WHEN contains(l, 'timeout') OR contains(l, 'network') OR contains(l, 'connection') THEN 'connectivity' ELSE 'execution' END"""


@query(
    f"""WITH {ctes("messages")}, m AS (SELECT *, lower(message) AS l FROM messages)
    SELECT event_id, {_CLASS} AS error_type,
      CASE event_id % 13 WHEN 0 THEN 't' || event_id WHEN 6 THEN 'x' || split_part(split_part(message, 'shop.x', 2), chr(39), 1)
        WHEN 7 THEN 't' || event_id WHEN 5 THEN 'T' || event_id WHEN 8 THEN 'r' || event_id END AS missing_name,
      contains(l, 'already exists') OR contains(l, 'there is already an object named')
        OR ((contains(l, 'table ''') OR contains(l, 'view ''')) AND contains(l, 'exists')) AS already_exists,
      status = 'error' AND object_type = 'table' AND target_db = 'Snowflake' AND contains(l, 'does not exist or not authorized') AS retryable
    FROM m"""
)
def error_classes(spark, sf):
    m = F.col("message")
    return table(spark, sf, "messages").select(
        "event_id", messages.error_class(m).alias("error_type"), messages.missing_name(m).alias("missing_name"),
        messages.already_exists(m).alias("already_exists"),
        messages.retryable_dependency(F.col("status"), F.col("object_type"), F.col("target_db"), m).alias("retryable"),
    )


def _hint_sql() -> str:
    """(no, condition, hint) of every hint as one list, filtered and joined per message."""
    parts = []
    for engine, kind, words, hint in messages.ENGINE_HINTS:
        terms = [f"contains(target_db, '{engine}')"] + ([f"object_type = '{kind}'"] if kind else [])
        if words:
            terms.append("(" + " OR ".join(f"contains(message, {_sql_text(w)})" for w in words) + ")")
        parts.append(f"CASE WHEN {' AND '.join(terms)} THEN {_sql_text(hint)} END")
    for engine, kind, tokens, hint in messages.HINT_RULES:
        terms = [f"lower(target_db) = '{engine}'", f"object_type = '{kind}'"] + [f"contains(l, {_sql_text(t)})" for t in tokens]
        parts.append(f"CASE WHEN {' AND '.join(terms)} THEN {_sql_text(hint)} END")
    general = " ".join(f"WHEN '{k}' THEN {_sql_text(v)}" for k, v in messages.CLASS_HINTS.items())
    return f"concat_ws(' ', CASE {_CLASS} {general} END, {', '.join(parts)})"


@query(f"WITH {ctes('messages')}, m AS (SELECT *, lower(message) AS l FROM messages) SELECT event_id, trim({_hint_sql()}) AS remediation FROM m")
def remediation(spark, sf):
    hint = messages.remediation(F.col("target_db"), F.col("object_type"), F.col("message"))
    return table(spark, sf, "messages").select("event_id", F.trim(hint).alias("remediation"))


# --- work list ------------------------------------------------------------

_RANK = "CASE o.object_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(OBJECT_TYPES)) + " ELSE 99 END"


@query(
    f"""WITH {ctes("schema_objects")},
    o AS (SELECT o.schema_id, o.object_type, o.object_name, {_RANK} AS type_rank FROM schema_objects o
      WHERE o.object_type <> 'synonym' AND (o.object_type <> 'view' OR o.object_name IN (SELECT object_name FROM schema_objects WHERE object_type = 'view' AND event_type <> 'click'))),
    p AS (SELECT schema_id, object_type, object_name FROM schema_objects WHERE event_type = 'purchase'),
    r AS (SELECT schema_id, 'table' AS object_type, min(object_name) AS object_name FROM schema_objects WHERE object_type = 'table' AND schema_id % 4 = 1 GROUP BY 1
      UNION ALL SELECT DISTINCT schema_id, 'function', 'nowhere' FROM schema_objects WHERE schema_id % 4 = 2),
    x AS (SELECT o.*, r.schema_id IS NOT NULL AS given, EXISTS (SELECT 1 FROM o c WHERE c.schema_id = r.schema_id AND c.object_type = r.object_type AND c.object_name = r.object_name) AS there,
      r.object_name AS at_name, EXISTS (SELECT 1 FROM p WHERE p.schema_id = o.schema_id AND p.object_type = o.object_type AND p.object_name = o.object_name) AS done
      FROM o LEFT JOIN r ON r.schema_id = o.schema_id),
    a AS (SELECT *, CASE WHEN given AND NOT (there AND (type_rank > 2 OR (type_rank = 2 AND object_name >= at_name))) THEN 'not_reached'
      WHEN done THEN 'skip_previous' WHEN object_type IN ('event', 'cursor', 'synonym') THEN 'skip_unsupported' ELSE 'run' END AS action FROM x)
    SELECT schema_id, object_type, object_name, type_rank, action, CASE WHEN action = 'skip_previous' THEN {_sql_text(plans.SUCCEEDED_BEFORE)}
      WHEN action = 'skip_unsupported' AND object_type = 'event' THEN {_sql_text(UNSUPPORTED[3][3])}
      WHEN action = 'skip_unsupported' THEN {_sql_text(UNSUPPORTED[4][3])} END AS reason FROM a"""
)
def migration_plan(spark, sf):
    objects = table(spark, sf, "schema_objects")
    views = objects.filter("object_type = 'view' AND event_type <> 'click'")
    previous = objects.withColumn("status", F.when(F.col("event_type") == "purchase", "success").otherwise("error"))
    first_table = objects.filter("object_type = 'table' AND schema_id % 4 = 1").groupBy("schema_id").agg(F.min("object_name").alias("object_name"))
    gone = objects.filter("schema_id % 4 = 2").select("schema_id").distinct()
    resume = first_table.select("schema_id", F.lit("table").alias("object_type"), "object_name").unionAll(
        gone.select("schema_id", F.lit("function").alias("object_type"), F.lit("nowhere").alias("object_name"))
    )
    return plans.work_list(
        objects.drop("event_type"), "mysql", "Snowflake", types=[t for t in OBJECT_TYPES if t != "synonym"],
        selection=views, previous=previous, resume=resume, scope=["schema_id"],
    ).orderBy("schema_id", *plans.PLAN_ORDER)


def _blocks_sql() -> str:
    """Failures that count, one blocking type after the other, by running counts."""
    steps, last = [], "ordered_results"
    for kind in ("table", "view", "function", "storedprocedure"):
        clear = "".join(f" AND f_{b} = 0" for b in BLOCKERS.get(kind, []))
        steps.append(
            f"s_{kind} AS (SELECT *, coalesce(sum(CASE WHEN status = 'error' AND object_type = '{kind}'{clear} THEN 1 ELSE 0 END)"
            f" OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f_{kind} FROM {last})"
        )
        last = f"s_{kind}"
    blocked = "CASE " + " ".join(
        f"WHEN object_type = '{kind}' THEN concat_ws(', ', " + ", ".join(f"CASE WHEN f_{b} > 0 THEN '{b}' END" for b in sorted(blockers)) + ")"
        for kind, blockers in BLOCKERS.items()
    ) + " ELSE '' END"
    return (
        f"WITH {ctes('ordered_results')}, {', '.join(steps)}, b AS (SELECT *, {blocked} AS blocked_by FROM {last}) "
        "SELECT run_id, seq, object_type, object_name, CASE WHEN blocked_by <> '' THEN 'skipped' ELSE status END AS status, blocked_by, "
        "CASE WHEN blocked_by <> '' THEN 'Skipped because prerequisite object types failed earlier: ' || blocked_by || '.' END AS reason FROM b"
    )


@query(_blocks_sql())
def dependency_blocks(spark, sf):
    return plans.dependency_blocks(table(spark, sf, "ordered_results"))


# --- time slots -----------------------------------------------------------


@query(
    """SELECT event_id, ts FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 18
    AND (day(ts) IN (1, 15) OR dayofweek(ts) BETWEEN 1 AND 3)"""
)
def cron_events(spark, sf):
    return slots.cron_events(base(spark, sf, "events").select("event_id", "ts"), "ts", "*/15 8-18 1,15 * 1-3")


@query(
    """WITH l AS (SELECT event_id, ts + INTERVAL 330 MINUTE AS t FROM events)
    SELECT event_id FROM l WHERE minute(t) % 5 = 0 AND hour(t) IN (0, 6, 12, 18) AND dayofweek(t) IN (0, 6)"""
)
def cron_events_zone(spark, sf):
    """Six fields, Sunday as 7, in a zone of its own."""
    return slots.cron_events(base(spark, sf, "events"), "ts", "0 */5 0/6 ? * 6,7", "Asia/Kolkata").select("event_id")


def _next_sql(condition: str, shift: int = 0) -> str:
    return f"""WITH e AS (SELECT event_id, date_trunc('minute', ts + INTERVAL {shift} MINUTE) AS t FROM events),
    m AS (SELECT unnest(generate_series((SELECT min(t) FROM e), (SELECT max(t) + INTERVAL 31 DAY FROM e), INTERVAL 1 MINUTE)) AS s),
    slots AS (SELECT s FROM m WHERE {condition})
    SELECT event_id, CASE WHEN s <= t + INTERVAL 31 DAY THEN s - INTERVAL {shift} MINUTE END AS next_slot
    FROM e ASOF LEFT JOIN slots ON slots.s > e.t"""


@query(_next_sql("minute(s) IN (5, 35) AND hour(s) % 6 = 2 AND (day(s) = 13 OR dayofweek(s) = 1)"))
def cron_next(spark, sf):
    return slots.with_next_slot(base(spark, sf, "events").select("event_id", "ts"), "ts", "5,35 2-23/6 13 * 1").drop("ts")


@query(_next_sql("minute(s) = 0 AND hour(s) = 12 AND day(s) = 31 AND month(s) IN (1, 3)", 330))
def cron_next_zone(spark, sf):
    """A slot that is often more than 31 days away, so there is none."""
    events = base(spark, sf, "events").select("event_id", "ts")
    return slots.with_next_slot(events, "ts", "0 12 31 1,3 *", "Asia/Kolkata").drop("ts")


@query(
    """SELECT event_type, strftime(ts, '%Y-%m-%dT%H:%M') AS slot, min(ts) AS first_at, count(*) AS hits FROM events
    WHERE minute(ts) % 2 = 0 GROUP BY 1, 2"""
)
def cron_slots(spark, sf):
    return slots.cron_slots(base(spark, sf, "events"), "ts", "*/2 * * * *", by=["event_type"])
