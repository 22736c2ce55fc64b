import re
import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tablehaul.functions import messages
from tablehaul.functions.records import OBJECT_TYPES, RECORD_SCHEMA, duration_label, minutes_label
from tablehaul.operators import history, runlog
from tablehaul.plans import work_list as plans
from tablehaul.plans.rules import BLOCKERS, UNSUPPORTED

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def result(spark, fn, *values):
    types = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], types).select(fn(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    "message, expected",
    [
        ("Access DENIED", "authorization"), ("x does not exist or not authorized", "authorization"), ("Table 'a.b' doesn't exist", "dependency"),
        ("Syntax error", "syntax"), ("could not parse", "syntax"), ("Invalid default value for 'a'", "transformation"),
        ("network down", "connectivity"), ("boom", "execution"), (None, "execution"),
    ],
)
def test_error_class(spark, message, expected):
    assert result(spark, messages.error_class, message) == expected


@pytest.mark.parametrize(
    "message, expected",
    [
        ("Table 'db.`t 1`' doesn't exist", "t 1"), ("table  'x'  does not exist", "x"), ("Unknown table 'a.b.c'", "c"),
        ('Base table or view not found: 1146 "s"."t" in', "t"), ("relation 'r' does not exist", "r"), ("object '.' does not exist", "."),
        ("nothing", None), (None, None),
    ],
)
def test_missing_name(spark, message, expected):
    assert result(spark, messages.missing_name, message) == expected


def test_levels_tones_and_stamps(spark):
    line = "2024-01-01 10:00:00.5 -  Error: migration SUCCESS"
    assert result(spark, messages.log_level, line) == "error"
    assert result(spark, messages.log_level, "skipped success") == "warn"
    assert result(spark, messages.log_tone, "Step completed, retry") == "success"
    assert result(spark, messages.log_tone, "[SYSTEM] up") == "dim"
    assert result(spark, messages.log_stamp, line) == "2024-01-01 10:00:00.5"
    assert result(spark, messages.log_text, line) == "Error: migration SUCCESS"
    assert result(spark, messages.log_text, line + "\n") == line + "\n"


def test_remediation(spark):
    text = result(spark, messages.remediation, "Snowflake", "table", "x does not exist or not authorized")
    assert text.startswith("Verify target object privileges") and text.count("exact target table") == 2
    assert result(spark, messages.remediation, "MySQL", "view", "boom").endswith("already exist in the target schema.")
    assert result(spark, messages.remediation, "Snowflake", "trigger", None).endswith("Do not emit CREATE TRIGGER.")


def test_durations(spark):
    start = dt.datetime(2024, 1, 1)
    ends = [start + dt.timedelta(seconds=s) for s in (3.9, 63, 3723, -1)] + [None]
    df = spark.createDataFrame([(start, e) for e in ends], "a timestamp_ntz, b timestamp_ntz")
    got = df.select(duration_label(F.col("a"), F.col("b")), minutes_label(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("3s", "0m 3s"), ("1m 03s", "1m 3s"), ("1h 2m 03s", "62m 3s"), ("--", "--"), ("--", "--")]


def records(spark, runs):
    """(seq, run_id, status, started_at, [(type, name, status)]) as nested records."""
    data = []
    for seq, run_id, status, started, objects in runs:
        results = [(run_id, n, t, s, None, None, 0, 0, 0, 0, 0, None, None, None, f"sql {n}", None, None) for t, n, s in objects]
        data.append(((run_id, status, "MySQL", None, [], None, results, started, None), [], [], [], None, seq))
    return spark.createDataFrame(data, RECORD_SCHEMA)


DAY = dt.datetime(2024, 5, 1)


@pytest.fixture
def log(spark):
    return records(
        spark,
        [
            (1, "a", "success", DAY, [("table", "t1", "success")]),
            (2, "b", "partial", DAY + dt.timedelta(days=1, hours=23, minutes=59, seconds=59), [("view", "v", "error"), ("table", "t2", "success")]),
            (3, "c", "success", None, []),
            (4, "a", "Success ", DAY + dt.timedelta(days=2), []),
        ],
    )


def ids(df):
    return [r[0] for r in df.select("seq").collect()]


def test_latest_and_find(log):
    assert ids(history.latest_runs(log, 2)) == [4, 3]
    assert ids(history.latest_runs(log, 0)) == []
    assert ids(history.latest_runs(log, None)) == ids(history.latest_runs(log, -1)) == [4, 3, 2, 1]
    assert ids(history.find_run(log, "a")) == [4]


def test_search(log):
    assert sorted(ids(history.history_search(log, object_type="table"))) == [1, 2]
    assert ids(history.history_search(log, search="V TABLE t2")) == [2]
    assert ids(history.history_search(log, search="mysql  view")) == [2]  # the empty target is between them
    assert ids(history.history_search(log, date_from="2024-05-02", date_to="2024-05-02")) == [2]
    assert sorted(ids(history.history_search(log, date_from="2024-01-01"))) == [1, 2, 4]
    assert sorted(ids(history.history_search(log, status="success"))) == [1, 3]


def test_pages(log):
    assert ids(history.history_page(log, 1, 3)) == [4, 2, 1]
    assert ids(history.history_page(log, 2, 3)) == [3]
    assert ids(history.history_page(log, 9, 3)) == [3]
    assert ids(history.history_page(log, 0, 10)) == [4, 2, 1, 3]
    assert ids(history.history_page(log.filter("seq > 9"), 1)) == []


def test_archive_and_scripts(log):
    assert sorted(ids(history.success_archive(log))) == [1, 3, 4]
    scripts = {r["run_id"]: r["full_script"] for r in history.run_scripts(log.filter("seq < 4")).collect()}
    assert scripts == {"a": "-- table: t1\nsql t1", "b": "-- view: v\nsql v\n\n-- table: t2\nsql t2", "c": ""}


def test_mirror_takes_the_newest_record(log):
    rows = {r["run_id"]: (r["status"], r["current_object_name"]) for r in history.mirror_runs(log).collect()}
    assert rows == {"a": ("Success ", None), "b": ("partial", "v"), "c": ("success", None)}


def test_status_of_runs_without_objects(spark):
    objects = spark.createDataFrame([("a", "success"), ("b", "skipped")], "run_id string, status string")
    runs = spark.createDataFrame([("a", False, True), ("b", None, None), ("c", None, None), ("d", True, True)], "run_id string, failed boolean, stopped boolean")
    got = {r["run_id"]: r["status"] for r in runlog.run_status(objects, runs).collect()}
    assert got == {"a": "stopped", "b": "partial", "c": "success", "d": "error"}


def test_unknown_type_keeps_its_counters(spark):
    objects = spark.createDataFrame([("a", "package", "success"), ("a", "table", "error")], "run_id string, object_type string, status string")
    got = {r["object_type"]: tuple(r)[2:] for r in runlog.run_stats_by_type(objects).collect()}
    assert len(got) == 10 and got["package"] == (1, 1, 0, 0) and got["table"] == (1, 0, 1, 0) and got["view"] == (0, 0, 0, 0)


TYPES = ["table", "view", "function", "storedprocedure", "trigger", "event"]


@QUICK
@given(st.lists(st.tuples(st.sampled_from(["r1", "r2"]), st.sampled_from(TYPES), st.booleans()), max_size=25))
def test_blocks_like_a_run_in_order(spark, items):
    data = [(run, i, kind, f"o{i}", "error" if bad else "success") for i, (run, kind, bad) in enumerate(items)]
    df = spark.createDataFrame(data, "run_id string, seq int, object_type string, object_name string, status string")
    got = {r["seq"]: (r["status"], r["blocked_by"]) for r in plans.dependency_blocks(df).collect()}
    failed, want = {"r1": set(), "r2": set()}, {}
    for run, seq, kind, _, status in data:
        blockers = failed[run] & set(BLOCKERS.get(kind, []))
        if blockers:
            want[seq] = ("skipped", ", ".join(sorted(blockers)))
            continue
        want[seq] = (status, "")
        if status == "error":
            failed[run].add(kind)
    assert got == want


@pytest.fixture
def objects(spark):
    return spark.createDataFrame([("view", "v1"), ("table", "t2"), ("table", "t1"), ("event", "e"), ("zebra", "z")], "object_type string, object_name string")


def actions(df):
    return [(r["object_name"], r["action"]) for r in df.orderBy(*plans.PLAN_ORDER).collect()]


def test_plan_order_and_rules(objects):
    got = plans.work_list(objects, "mysql", "snowflake")
    assert actions(got) == [("t1", "run"), ("t2", "run"), ("v1", "run"), ("e", "skip_unsupported"), ("z", "run")]


def test_selection_limits_only_its_types(spark, objects):
    picked = spark.createDataFrame([("table", "t2"), ("table", "t2")], "object_type string, object_name string")
    assert [n for n, _ in actions(plans.work_list(objects, "mysql", "mysql", ["table", "view"], picked))] == ["t2", "v1"]


def test_resume(spark, objects):
    def at(*rows):
        return spark.createDataFrame(list(rows), "object_type string, object_name string")

    def first(resume):
        return [n for n, a in actions(plans.work_list(objects, "mysql", "mysql", resume=resume)) if a != "not_reached"]

    assert first(at(("table", "t2"))) == ["t2", "v1", "e", "z"]
    assert first(at(("table", "gone"))) == []
    assert first(at()) == ["t1", "t2", "v1", "e", "z"]


def test_triggers_of_snowflake_are_not_stopped_by_rule(spark):
    df = spark.createDataFrame([("trigger", "x")], "object_type string, object_name string")
    assert ("PostgreSQL", "Snowflake", "trigger") in {u[:3] for u in UNSUPPORTED}
    assert actions(plans.work_list(df, "postgres", "snowflake")) == [("x", "run")]


def test_types_are_the_known_nine():
    assert len(OBJECT_TYPES) == 9 and set(BLOCKERS) <= set(OBJECT_TYPES)


@pytest.mark.parametrize("limit", [7, 40, 10_000])
def test_any_page_by_counted_ranges(spark, monkeypatch, limit):
    """Ties, records without a start, and one start that a third of all records have."""
    import datetime as dt
    import random

    monkeypatch.setattr(history, "SORTED", limit)
    monkeypatch.setattr(history, "RANGES", 16)
    pick = random.Random(limit)
    some = [None if pick.random() < 0.2 else dt.datetime(2024, 1, 1) if pick.random() < 0.4 else dt.datetime(2020, 1, 1) + dt.timedelta(microseconds=pick.randrange(10**14)) for _ in range(300)]
    rows = [((at,), i) for i, at in enumerate(some)]
    df = spark.createDataFrame(rows, "run_summary struct<started_at: timestamp_ntz>, seq bigint")
    order = sorted(rows, key=lambda r: (r[0][0] is not None, r[0][0] or dt.datetime.min, r[1]), reverse=True)
    for page, size in ((1, 10), (2, 10), (13, 10), (24, 10), (25, 10), (30, 10), (99, 10), (2, 170), (1, 1000), (43, 7), (0, 10)):
        last = -(-300 // size)
        first = (min(max(1, page), last) - 1) * size
        got = [(r.seq, r.position) for r in history.history_page(df, page, size).orderBy("position").collect()]
        assert got == [(r[1], first + i + 1) for i, r in enumerate(order[first : first + size])], (page, size)
    assert history.history_page(df.limit(0), 3).count() == 0


def test_a_deep_page_sorts_only_its_range(spark, monkeypatch):
    monkeypatch.setattr(history, "SORTED", 50)
    df = spark.range(20_000).selectExpr("named_struct('started_at', timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id)) AS run_summary", "id AS seq")
    page = history.history_page(df, 1990)
    assert [r.seq for r in page.orderBy("position").collect()] == list(range(109, 99, -1))
    text = page._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "SinglePartition" not in text
    limits = [int(n) for n in re.findall(r"TakeOrderedAndProject\(limit=([0-9]+)", text)]
    assert limits and max(limits) <= 60
