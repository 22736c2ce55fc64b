import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from tablehaul.operators import writes
from tablehaul.session import scratch_path, shared_root
from tablehaul.sources import run_log, staged_csv, tables
from tablehaul.streaming import streams

KINDS = "a boolean, b int, c decimal(12,8), d double, e timestamp_ntz, f date, g binary, h string, i array<int>"
CELLS = [
    (True, -1, Decimal("0.00000001"), 1e300, dt.datetime(2024, 1, 1, 0, 0, 0, 500000), dt.date(2024, 1, 1), b"\x00\xff", 'q"q, \\ \n\r\n x', [1, None]),
    (False, None, None, -2.5e-10, None, None, b"", "", []),
    (None, 2, Decimal("1.5"), None, dt.datetime(2024, 1, 1), None, None, None, None),
    (None, None, None, 0.1, None, None, None, "\\N x", None),
]


@pytest.mark.parametrize("style", ["sentinel", "backslash_n"])
def test_staged_round_trip(spark, rows, style):
    df = spark.createDataFrame(CELLS, KINDS)
    path = scratch_path(spark, "test")
    staged_csv.stage_csv(df, path, style)
    assert rows(staged_csv.load_csv(spark, path, df.schema, style)) == rows(df)


def test_staged_files_are_bounded_by_bytes(spark, rows, tmp_path):
    import glob
    import os

    long = spark.range(3000).selectExpr("id", "repeat('x\n', 500) AS cell", "CASE WHEN id % 2 = 0 THEN NULL ELSE 'y' END AS other").coalesce(1)
    staged_csv.stage_csv(long, str(tmp_path / "a"), file_bytes=200_000)
    sizes = [os.path.getsize(f) for f in glob.glob(str(tmp_path / "a" / "part-*"))]
    assert max(sizes) <= 210_000 and len(sizes) >= 15
    assert staged_csv.load_csv(spark, str(tmp_path / "a"), long.schema).count() == 3000
    staged_csv.stage_csv(long, str(tmp_path / "b"), rows_per_file=1500)
    assert len(glob.glob(str(tmp_path / "b" / "part-*"))) == 2
    staged_csv.stage_csv(long.limit(0), str(tmp_path / "c"))


def test_file_written_by_others(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "x.csv").write_bytes(b'c,c,c\r\n1,,__DBM_NULL__\r\n__DBM_NULL__,"a ""b""\nc",TRUE\r\n')
    got = staged_csv.load_csv(spark, str(tmp_path / "in"), "a int, b string, c boolean")
    assert [tuple(r) for r in got.collect()] == [(1, "", None), (None, 'a "b"\nc', True)]


def test_bad_staged_files_fail(spark, tmp_path):
    (tmp_path / "x.csv").write_text("c\nten\n")
    with pytest.raises(Exception, match="column a: not a int: ten"):
        staged_csv.load_csv(spark, str(tmp_path), "a int").collect()
    (tmp_path / "y.csv").write_text("c,c\n1\n")
    with pytest.raises(Exception):
        staged_csv.load_csv(spark, str(tmp_path / "y.csv"), "a int, b int").collect()
    with pytest.raises(Exception):
        staged_csv.load_csv(spark, str(tmp_path / "none"), "a int")
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        staged_csv.load_csv(spark, str(tmp_path / "empty"), "a int")


def test_extract_counts_while_writing(spark):
    path = scratch_path(spark, "test")
    result = staged_csv.bulk_extract(spark.range(100).repartition(7), path, 3)
    assert (result["row_count"], result["status"]) == (100, "success")
    assert len(spark.read.csv(path, header=True).inputFiles()) == 3


def test_extract_reads_compressed_columns(spark, rows, tmp_path):
    """A file's task reads its share of compressed columns, not of shuffled rows, and the copy goes at the end."""
    import glob
    import os

    path = str(tmp_path / "out")
    df = spark.range(5003, numPartitions=9).selectExpr("id AS `a.b`", "IF(id % 5 = 0, NULL, concat('x\n', id)) AS file", "array(id) AS `f g`")
    plans, write = [], staged_csv._dealt
    staged_csv._dealt = lambda *a: plans.append(write(*a)) or plans[0]
    try:
        assert staged_csv.bulk_extract(df, path, 4)["row_count"] == 5003
    finally:
        staged_csv._dealt = write
    assert "Exchange" not in plans[0]._jdf.queryExecution().toString()
    files = sorted(glob.glob(path + "/part-*.csv"))
    back = [spark.read.options(header=True, multiLine=True, escape='"').csv(f) for f in files]
    assert back[0].columns == ["a.b", "file", "f g"] and [1245 <= f.count() <= 1256 for f in back] == [True] * 4
    assert sorted(int(r[0]) for f in back for r in f.collect()) == list(range(5003))
    assert {tuple(r) for r in back[0].where("`a.b` % 5 > 0").limit(3).collect()} <= {(str(i), f"x\n{i}", f"[{i}]") for i in range(5003)}
    assert not glob.glob(f"{shared_root(spark)}/tablehaul/extract-stage-*") and not os.path.exists(path + "/file=0")
    for few in (0, 1, 3):
        assert staged_csv.bulk_extract(spark.range(few), path, 4)["row_count"] == few
        assert sorted(r[0] for r in spark.read.csv(path, header=True, schema="id bigint").collect()) == list(range(few))
        assert glob.glob(path + "/part-*.csv")


def test_append_sends_the_shared_columns(spark, rows):
    path = scratch_path(spark, "test")
    spark.createDataFrame([(1, "a")], "id bigint, name string").write.parquet(path)
    sent = writes.append_load(spark.createDataFrame([(2, "x", " "), (None, "x", "\t")], "ID int, extra string, Name string").filter("id = 2"), path)
    assert sent == 1 and rows(spark.read.parquet(path)) == [(1, "a"), (2, " ")]


def test_publish_while_reading_the_same_table(spark, rows):
    root = scratch_path(spark, "test")
    name = "t_" + root.rsplit("-", 1)[1]
    frame = lambda data: spark.createDataFrame(data, "k int, v string")
    writes.publish(frame([(1, "a"), (2, "b")]), name, root)
    for _ in range(2):  # twice is as good as once
        writes.upsert_load(frame([(2, "B"), (3, "C")]), name, root, ["k"])
        assert rows(spark.table(name)) == [(1, "a"), (2, "B"), (3, "C")]
    writes.evolve_load(spark.createDataFrame([(9, 1.5)], "k int, score double"), name, root)
    assert rows(spark.table(name))[-1] == (9, None, 1.5)
    writes.truncate_load(frame([(7, "x")]), name, root)
    assert rows(spark.table(name)) == [(7, "x", None)]
    writes.replace_load(spark.createDataFrame([(1,)], "other int"), name, root + "/new")
    assert spark.table(name).columns == ["other"]


@pytest.mark.parametrize("compact", [False, True])
def test_children_of_a_rerun_are_replaced(spark, rows, compact):
    path = scratch_path(spark, "test")
    frame = lambda data: spark.createDataFrame(data, "run_id string, message string")
    runs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "run_id string")

    def kept():
        if compact:
            writes.compact_children(spark, path)
        return rows(writes.read_children(spark, path))

    with pytest.raises(FileNotFoundError):
        writes.read_children(spark, path)
    writes.mirror_children(frame([("a", "1"), ("b", "1"), ("c", "1")]), runs("a", "b", "c"), path)
    writes.mirror_children(frame([("a", "2"), ("a", "3")]), runs("a", "b"), path)
    assert kept() == [("a", "2"), ("a", "3"), ("c", "1")]
    writes.mirror_children(frame([]), runs(), path)
    writes.mirror_children(frame([]), runs("a", "c"), path)
    assert kept() == []
    writes.mirror_children(frame([("c", "9")]), runs("c"), path)
    assert kept() == [("c", "9")]


def test_run_log_skips_blank_lines_and_keeps_micros(spark, tmp_path):
    moment = dt.datetime(2024, 1, 1, 1, 2, 3, 4)
    path = str(tmp_path / "log")
    line = '{"run_summary": {"run_id": "a", "status": "success", "started_at": "2024-01-01T01:02:03.000004"}, "logs": ["x"]}'
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.json").write_text(f"\n{line}\n\n  \n")
    records = run_log.read_runs(spark, path)
    assert [r["run_summary"]["started_at"] for r in records.collect()] == [moment]
    run_log.append_runs(records, path + "2", path + "3")
    assert run_log.read_runs(spark, path + "3").first()["run_summary"]["started_at"] == moment
    (tmp_path / "log" / "2.json").write_text("{broken\n")
    with pytest.raises(Exception):
        run_log.read_runs(spark, path).collect()


def test_stream_equals_batch(spark, rows):
    root = scratch_path(spark, "test")
    events = spark.createDataFrame([("log", "2024-01-01 00:00:00 - ERROR x", "a", 1), ("result", "{}", "a", 2), ("log", "done", "b", 1)], streams.LIVE_EVENT)
    events.write.json(f"{root}/in")
    streams.start_sink(streams.describe_log(streams.live_log(spark, f"{root}/in")), f"{root}/out", f"{root}/state").awaitTermination()
    assert rows(spark.read.parquet(f"{root}/out")) == rows(streams.describe_log(events))


def test_stream_upsert_in_several_batches_and_again(spark, rows):
    root = scratch_path(spark, "test")
    schema = "k int, v string, n int"
    target = spark.createDataFrame([(1, "old", 0), (5, "old", 0)], schema)

    def feed():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        streams.start_upsert(source, f"{root}/kept", f"{root}/state", ["k"], ["n"]).awaitTermination()
        return rows(streams.current_rows(target, f"{root}/kept", ["k"], ["n"]))

    add = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    add([(1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "d", 1)])
    assert feed() == [(1, "b", 2), (2, "c", 1), (5, "old", 0), (None, "d", 1)]
    add([(1, "e", 1), (None, "d", 1)])  # a later batch wins, whatever its order column says
    expected = [(1, "e", 1), (2, "c", 1), (5, "old", 0), (None, "d", 1), (None, "d", 1)]
    assert feed() == expected and feed() == expected


def test_jdbc_options():
    mine = tables.jdbc_options("redshift", {"host": "h", "database": "d", "username": "u", "password": "p"}, batch=-1)
    assert mine == {"url": "jdbc:postgresql://h:5432/d", "driver": "org.postgresql.Driver", "fetchsize": "10000", "batchsize": "10000", "user": "u", "password": "p"}
    assert tables.jdbc_options("Azure SQL", {"host": "h", "database": "d"})["url"].startswith("jdbc:sqlserver://h:1433;databaseName=d")
    assert tables.jdbc_options("any", {"url": "jdbc:x:y"}, 5) == {"url": "jdbc:x:y", "fetchsize": "5", "batchsize": "5"}
    with pytest.raises(ValueError, match="Unsupported DB"):
        tables.jdbc_options("oracle", {"host": "h"})
    with pytest.raises(ValueError, match="url and driver"):
        tables.jdbc_options("Snowflake", {"host": "h"})


def test_scratch_is_below_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or scratch_path(spark, "x").startswith(named.rstrip("/"))
    assert shared_root(spark)


# --- write paths that must not lose anything ------------------------------


def children(spark, *rows):
    return spark.createDataFrame(list(rows), "run_id string, message string")


def test_mirror_stores_one_reading_of_the_records(spark, tmp_path):
    """Objects and parents agree even if the records come out differently when computed again."""
    from pyspark.sql.functions import uuid

    from tablehaul.functions.records import RECORD_SCHEMA

    line = '{"run_summary": {"run_id": "r%d", "object_results": [{"object_name": "x", "status": "error"}, null]}, "logs": ["a", null], "seq": %d}'
    (tmp_path / "log.json").write_text("\n".join([line % (i % 3, i) for i in range(5)] + ['{"run_summary": {"run_id": " "}, "seq": 9}']))
    records = spark.read.schema(RECORD_SCHEMA).json(str(tmp_path / "log.json")).withColumn("_name", uuid())
    objects = F.transform("run_summary.object_results", lambda o: F.when(o.isNotNull(), o.withField("object_name", F.col("_name"))))
    records = records.withColumn("run_summary", F.col("run_summary").withField("object_results", objects)).drop("_name")
    root = scratch_path(spark, "one-reading")
    name = "t_" + root.rsplit("-", 1)[1]
    for _ in range(2):
        writes.mirror_records(records, name, root)
    parents = {r["run_id"]: r["current_object_name"] for r in spark.table(name).collect()}
    found = writes.read_children(spark, f"{root}/objects").where("sequence_no = 1").collect()
    assert {r["run_id"]: r["object_name"] for r in found} == parents and sorted(parents) == ["r0", "r1", "r2"]
    assert writes.read_children(spark, f"{root}/objects").count() == writes.read_children(spark, f"{root}/logs").count() == 6


def test_run_log_is_written_compressed_in_files_of_bounded_rows(spark, rows, tmp_path, monkeypatch):
    import glob

    plain = tmp_path / "plain.json"
    plain.write_text("\n".join('{"run_summary": {"run_id": "r%d", "status": "success"}, "logs": ["line"], "seq": %d}' % (i, i) for i in range(50)))
    records = run_log.read_runs(spark, str(plain))
    monkeypatch.setitem(run_log.WRITTEN, "maxRecordsPerFile", "20")
    run_log.append_runs(records, str(tmp_path / "log"), str(tmp_path / "archive"))
    for folder in ("log", "archive"):
        files = glob.glob(str(tmp_path / folder / "part-*"))
        assert len(files) >= 3 and all(f.endswith(".json.gz") for f in files)
        assert rows(run_log.read_runs(spark, str(tmp_path / folder)).select("seq", "logs", "run_summary.run_id")) == rows(records.select("seq", "logs", "run_summary.run_id"))


def test_mirror_keeps_runs_that_it_does_not_name(spark, rows):
    path = scratch_path(spark, "bucket")
    stored = [(f"r{i}", "old") for i in range(20)]
    writes.mirror_children(children(spark, *stored), children(spark, *stored).select("run_id"), path)
    fresh = [(f"n{i}", "new") for i in range(6)]
    writes.mirror_children(children(spark, *fresh), children(spark, fresh[0]).select("run_id"), path)
    assert rows(writes.read_children(spark, path)) == sorted(stored + fresh, key=repr)


def test_mirror_only_adds_files_and_the_last_generation_counts(spark, rows):
    from tablehaul.operators import versions

    path = scratch_path(spark, "generations")
    for i in range(3):
        writes.mirror_children(children(spark, ("a", f"a{i}"), (f"b{i}", "x"), (None, "nobody's")), children(spark, ("c", "")).select("run_id"), path)
    number, folders = versions.newest(spark, path)
    assert (number, len(folders)) == (3, 3)
    assert rows(writes.read_children(spark, path)) == [("a", "a2"), ("b0", "x"), ("b1", "x"), ("b2", "x")]
    text = writes.read_children(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text
    before = rows(writes.read_children(spark, path))
    writes.compact_children(spark, path)
    assert len(versions.newest(spark, path)[1]) == 1 and rows(writes.read_children(spark, path)) == before
    assert versions.retire_versions(spark, path) == 3 and rows(writes.read_children(spark, path)) == before


def test_generation_added_while_another_compacts(spark, rows, monkeypatch):
    from tablehaul.operators import versions

    path = scratch_path(spark, "compacting")
    for i in range(2):
        writes.mirror_children(children(spark, ("a", f"{i}"), ("b", f"{i}")), children(spark, ("a", "")).select("run_id"), path)
    plain = writes._children_of

    def slow(spark_, folders):
        found = plain(spark_, folders)
        monkeypatch.setattr(writes, "_children_of", plain)
        writes.mirror_children(children(spark, ("a", "new")), children(spark, ("a", "")).select("run_id"), path)
        return found

    monkeypatch.setattr(writes, "_children_of", slow)
    writes.compact_children(spark, path)
    assert len(versions.newest(spark, path)[1]) == 2
    assert rows(writes.read_children(spark, path)) == [("a", "new"), ("b", "1")]


def test_replace_may_read_its_own_table_and_survives_a_failed_write(spark, rows):
    location = scratch_path(spark, "own")
    name = "t_" + location.rsplit("-", 1)[1]
    writes.replace_load(spark.range(6), name, location)
    assert writes.replace_load(spark.table(name).filter("id > 2"), name, location) == 3
    broken = spark.table(name).select(F.when(F.col("id") > 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        writes.replace_load(broken, name, location)
    assert rows(spark.table(name)) == [(3,), (4,), (5,)]


def test_order_columns_need_not_be_in_the_target(spark, rows):
    root = scratch_path(spark, "order")
    name = "t_" + root.rsplit("-", 1)[1]
    target = spark.createDataFrame([("a", "old", "mon")], "k string, v string, day string")
    source = spark.createDataFrame([("a", "early", "tue", 1), ("a", "late", "tue", 2)], "k string, v string, DAY string, loaded_at int")
    writes.publish(target, name, root)
    writes.upsert_load(source, name, root, ["k"], ["DAY", "loaded_at"])
    assert rows(spark.table(name)) == [("a", "late", "tue")]
    with pytest.raises(ValueError, match="no column"):
        writes.upsert_load(source, name, root, ["k"], ["nowhere"])
    path = scratch_path(spark, "order-skip")
    target.limit(0).write.parquet(path)
    assert writes.skip_existing_load(source, path, ["k"], ["loaded_at"]) == 1
    assert rows(spark.read.parquet(path)) == [("a", "early", "tue")]


def test_appending_fewer_columns_keeps_the_schema(spark):
    path = scratch_path(spark, "fewer")
    spark.createDataFrame([(1, "x")], "k int, v string").write.parquet(path)
    for i in range(4):
        writes.append_load(spark.createDataFrame([(i,)], "k int"), path)
        assert spark.read.parquet(path).columns == ["k", "v"]
    assert spark.read.parquet(path).filter("v IS NULL").count() == 4


@pytest.mark.parametrize("mode,expected", [("append", 5), ("truncate", 3), ("replace", 3), ("upsert", 4), ("skip_existing", 4)])
def test_copy_counts_what_is_stored(spark, mode, expected):
    from tablehaul.operators.copy import copy_table

    root = scratch_path(spark, "copy")
    name = "t_" + root.rsplit("-", 1)[1]
    writes.publish(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), name, root)
    source = spark.createDataFrame([(2, "B"), (3, "C"), (4, "D")], "K int, V string")
    record = copy_table(source, name, root, mode, ["k"]).first()
    assert (record.status, record.source_row_count, record.target_row_count) == ("success", 3, expected)
    assert spark.table(name).count() == expected
    with pytest.raises(ValueError):
        copy_table(source, name, root, "other")


# --- logs -----------------------------------------------------------------


def test_odd_times_keep_their_record(spark):
    path = scratch_path(spark, "times")
    lines = [
        '{"run_summary": {"run_id": "%s", "started_at": %s, "object_results": [{"object_name": "o", "started_at": %s}]}, "seq": 1}' % (i, t, t)
        for i, t in enumerate(['"not a date"', '"2024-01-01T01:02:03Z"', '"2024-01-01T01:02:03+01:00"', '"2024-01-01 01:02:03.5"', "null"])
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    found = {r.run_summary.run_id: (r.run_summary.started_at, r.run_summary.object_results[0].started_at) for r in run_log.read_runs(spark, path).collect()}
    at = lambda h, s=3, u=0: dt.datetime(2024, 1, 1, h, 2, s, u)
    assert found == {"0": (None, None), "1": (at(1), at(1)), "2": (at(0), at(0)), "3": (at(1, 3, 500000),) * 2, "4": (None, None)}


def test_folded_batches_are_passed_over(spark, rows):
    root = scratch_path(spark, "fold")
    name = "t_" + root.rsplit("-", 1)[1]
    frame = lambda *r: spark.createDataFrame(list(r), "k int, v string, at int")
    writes.publish(frame().select("k", "v"), name, f"{root}/table")
    frame((1, "a", 1), (2, "b", 1)).write.parquet(f"{root}/in/batch_id=0")
    streams.fold(name, f"{root}/table", f"{root}/in", ["k"], ["at"])
    assert rows(spark.table(name)) == [(1, "a"), (2, "b")] and streams.folded_batch(spark, f"{root}/in") == 0
    # someone else's newer write is not undone by the batch that was folded
    writes.publish(frame((1, "newer", 0)).select("k", "v"), name, f"{root}/table")
    assert rows(streams.current_rows(spark.table(name), f"{root}/in", ["k"], ["at"])) == [(1, "newer")]
    assert streams.retire(spark, f"{root}/in") == 1
    assert rows(streams.current_rows(spark.table(name), f"{root}/in", ["k"], ["at"])) == [(1, "newer")]
    frame((3, "c", 1)).write.parquet(f"{root}/in/batch_id=1")
    assert rows(streams.current_rows(spark.table(name), f"{root}/in", ["k"], ["at"])) == [(1, "newer"), (3, "c")]


def test_each_line_of_a_live_log_is_in_one_output(spark, rows):
    path = scratch_path(spark, "split")
    lines = [
        '{"type": "log", "message": "done", "run_id": "a", "seq": 1}', '{"type": "log", "message": "x", "run_id": "a", "seq": "no number"}', '{"type": "result", "message": "{}", "run_id": "a", "seq": 2}',
        '{"type": "log", "message": "cut', '{"message": "no type", "seq": 3}', "[1, 2]", '{"type": "log", "message": null, "seq": 4}',
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/in")
    for _ in range(2):  # a second run finds nothing new
        streams.start_log(streams.live_log(spark, f"{path}/in"), f"{path}/out", f"{path}/state").awaitTermination()
    found = {name: streams.read_log(spark, f"{path}/out", name) for name in streams.OUTPUTS}
    assert {name: df.count() for name, df in found.items()} == {"log": 2, "other": 2, "broken": 3}
    assert [r.seq for r in found["log"].orderBy("seq").collect()] == [1, 4]
    assert "no number" in "".join(r.line for r in found["broken"].collect())
    assert streams.describe_log(streams.live_log(spark, f"{path}/in")).columns == ["run_id", "seq", "level", "tone", "logged_at", "text"]
    with pytest.raises(ValueError, match="unknown output"):
        streams.read_log(spark, f"{path}/out", "logs")


def test_clashing_target_names_are_an_error(spark):
    from tablehaul.operators.columns import matched_names

    with pytest.raises(ValueError, match="one normal name"):
        matched_names(["a_b"], ["A B", "a-b"])
