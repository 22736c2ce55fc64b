"""Commits of table versions, with several writers at the same time."""

import threading

import pytest
from pyspark.sql import functions as F

from tablehaul.operators import versions, writes
from tablehaul.operators.merge import upsert
from tablehaul.session import scratch_path


@pytest.fixture
def made(spark):
    root = scratch_path(spark, "versions")
    return "t_" + root.rsplit("-", 1)[1], root


def frame(spark, *data):
    return spark.createDataFrame(list(data), "k int, v string")


def test_two_overlapping_writers_keep_both_rows(spark, rows, made):
    name, root = made
    writes.publish(frame(spark, (1, "a")), name, root)
    runs = []

    def slow(current):
        runs.append(current.count())
        if len(runs) == 1:  # another writer is faster
            writes.upsert_load(frame(spark, (2, "other")), name, root, ["k"])
        return upsert(current, frame(spark, (1, "A"), (3, "own")), ["k"])

    versions.commit(spark, name, root, slow)
    assert rows(spark.table(name)) == [(1, "A"), (2, "other"), (3, "own")]
    assert runs == [1, 2] and versions.newest(spark, root)[0] == 3


def test_writers_in_threads_lose_nothing(spark, rows, made):
    name, root = made
    writes.publish(frame(spark, (0, "start")), name, root)
    errors = []

    def write(i):
        try:
            writes.upsert_load(frame(spark, (i, f"w{i}")), name, root, ["k"])
        except Exception as error:  # shown below
            errors.append(error)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert errors == []
    assert rows(spark.table(name)) == [(0, "start")] + [(i, f"w{i}") for i in range(1, 5)]


def test_a_replacement_is_not_written_twice(spark, rows, made):
    name, root = made
    writes.publish(frame(spark, (1, "a")), name, root)
    built = []

    def whole(current):
        built.append(1)
        writes.upsert_load(frame(spark, (2, "between")), name, root, ["k"])
        return frame(spark, (9, "all"))

    versions.commit(spark, name, root, whole, again=False)
    assert rows(spark.table(name)) == [(9, "all")] and built == [1]


def test_table_lost_between_commit_and_catalog_comes_back(spark, rows, made):
    name, root = made
    writes.replace_load(frame(spark, (1, "a")), name, root)
    writes.replace_load(spark.createDataFrame([(1.5,)], "other double"), name, root)
    spark.sql(f"DROP TABLE {name}")  # where a writer stopped
    versions.open_table(spark, name, root)
    assert rows(spark.table(name)) == [(1.5,)]
    spark.sql(f"DROP TABLE {name}")
    writes.replace_load(frame(spark, (2, "b")), name, root)
    assert rows(spark.table(name)) == [(2, "b")] and versions.newest(spark, root)[0] == 3


def test_stale_catalog_does_not_lose_a_version(spark, rows, made):
    """The newest files count, not where the catalog points."""
    name, root = made
    first = writes.publish(frame(spark, (1, "a")), name, root)
    writes.upsert_load(frame(spark, (2, "b")), name, root, ["k"])
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{first}'")
    writes.upsert_load(frame(spark, (3, "c")), name, root, ["k"])
    assert rows(spark.table(name)) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_failed_write_leaves_the_version(spark, rows, made):
    name, root = made
    writes.publish(frame(spark, (1, "a")), name, root)
    broken = frame(spark, (2, "b")).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        writes.publish(broken, name, root)
    assert rows(spark.table(name)) == [(1, "a")] and versions.newest(spark, root)[0] == 1


def test_claims_and_retired_versions(spark, rows, made):
    name, root = made
    assert versions.newest(spark, root) == (0, [])
    assert versions.claim(spark, root, 1, ["x"]) and not versions.claim(spark, root, 1, ["y"])
    assert versions.newest(spark, root) == (1, ["x"])
    assert versions.add_version(spark, root, lambda folders: [*folders, "z"]) == ["x", "z"]
    other = root + "/table"
    for i in range(3):
        writes.publish(frame(spark, (i, "a")), name, other)
    assert versions.retire_versions(spark, other, keep=1) == 2
    assert rows(spark.table(name)) == [(2, "a")] and versions.newest(spark, other)[0] == 3
    writes.upsert_load(frame(spark, (5, "b")), name, other, ["k"])
    assert rows(spark.table(name)) == [(2, "a"), (5, "b")]


def test_a_table_without_versions_becomes_one(spark, rows, made):
    name, root = made
    versions.create_table(spark, name, frame(spark, (1, "a")).schema, root + "/plain")
    frame(spark, (1, "a")).write.insertInto(name)
    writes.upsert_load(frame(spark, (2, "b")), name, root, ["k"])
    assert rows(spark.table(name)) == [(1, "a"), (2, "b")] and versions.newest(spark, root)[0] == 1


def test_too_many_conflicts_are_an_error(spark, made, monkeypatch):
    name, root = made
    monkeypatch.setattr(versions, "ATTEMPTS", 2)
    monkeypatch.setattr(versions, "claim", lambda *a: False)
    with pytest.raises(versions.Conflict):
        writes.publish(frame(spark, (1, "a")), name, root)
    with pytest.raises(versions.Conflict):
        versions.add_version(spark, root, lambda f: f)
