import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tablehaul.operators import merge

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
SCHEMA = "k int, v string, n int"


def frame(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def applied(target, source, skip=False):
    """Row by row, as a database would do it; a null key never matches."""
    table = [list(r) for r in target]
    for k, v, n in source:
        hit = [r for r in table if k is not None and r[0] == k]
        if not hit:
            table.append([k, v, n])
        elif not skip:
            for r in hit:
                r[1:] = [v, n]
    return sorted((tuple(r) for r in table), key=repr)


keys = st.one_of(st.none(), st.integers(0, 4))
targets = st.lists(keys, max_size=8).map(lambda ks: [(k, f"t{i}", -i) for i, k in enumerate(ks) if k is None or k not in ks[:i]])
sources = st.lists(keys, max_size=10).map(lambda ks: [(k, f"s{i}", i) for i, k in enumerate(ks)])


@QUICK
@given(targets, sources)
def test_upsert_is_the_rows_applied_in_order(spark, rows, target, source):
    done = merge.upsert(frame(spark, target), frame(spark, source), ["k"], ["n"])
    assert rows(done) == applied(target, source)


@QUICK
@given(targets, sources)
def test_skip_existing_is_the_rows_applied_in_order(spark, rows, target, source):
    done = merge.skip_existing(frame(spark, target), frame(spark, source), ["k"], ["n"])
    assert rows(done) == applied(target, source, skip=True)


@QUICK
@given(targets, sources)
def test_counts_add_up(spark, target, source):
    counts = merge.merge_counts(frame(spark, target), frame(spark, source), ["k"]).first()
    assert counts["sent"] == len(source)
    assert counts["sent"] == counts["inserted"] + counts["updated"] + counts["superseded"]
    if source:
        after = merge.upsert(frame(spark, target), frame(spark, source), ["k"], ["n"]).count()
        assert after == len(target) + counts["inserted"]


def test_target_only_columns_stay(spark, rows):
    target = frame(spark, [(1, "a", 10), (2, "b", 20)])
    source = frame(spark, [(2, "B"), (3, "C")], "k int, v string")
    assert rows(merge.upsert(target, source, ["k"])) == [(1, "a", 10), (2, "B", 20), (3, "C", None)]


def test_only_key_columns_change_nothing(spark, rows):
    target = frame(spark, [(1, "a", 10)])
    assert rows(merge.upsert(target, frame(spark, [(1,), (2,)], "k int"), ["k"])) == [(1, "a", 10), (2, None, None)]
    both = frame(spark, [(1,)], "k int")
    assert rows(merge.upsert(both, frame(spark, [(1,), (2,)], "k int"), ["k"])) == [(1,), (2,)]


def test_repeated_source_key_without_order_fails(spark):
    with pytest.raises(Exception, match="repeats in the source"):
        merge.upsert(frame(spark, []), frame(spark, [(1, "a", 1), (1, "b", 2)]), ["k"]).collect()


def test_missing_keys_are_an_error(spark):
    empty = frame(spark, [])
    with pytest.raises(ValueError, match="need key columns"):
        merge.upsert(empty, empty, [])
    with pytest.raises(ValueError, match="need key columns"):
        merge.skip_existing(empty, empty, [])
    with pytest.raises(ValueError, match="only target columns"):
        merge.upsert(frame(spark, []), frame(spark, [(1, 2)], "k int, extra int"), ["k"])


def test_composite_key_with_one_null_part(spark, rows):
    schema = "a int, b int, v string"
    target = frame(spark, [(1, None, "t"), (1, 1, "t")], schema)
    source = frame(spark, [(1, None, "s"), (1, 1, "s")], schema)
    assert rows(merge.upsert(target, source, ["a", "b"])) == [(1, 1, "s"), (1, None, "s"), (1, None, "t")]


def test_fill_and_keep(spark, rows):
    target = frame(spark, [(1, "old", 5), (2, "old", None)])
    source = frame(spark, [(1, "x", None, 1), (1, "y", 7, 2), (1, "z", None, 3), (2, "x", None, 1), (3, "p", None, 1), (3, "q", 4, 2)], SCHEMA + ", o int")
    done = merge.upsert(target, source, ["k"], ["o"], fill=["n"], keep=["v"])
    assert rows(done) == [(1, "old", 7), (2, "old", None), (3, "p", 4)]


def test_key_check(spark):
    found = merge.key_check(frame(spark, [(1, "a", 1), (1, "b", 1), (2, "c", 1), (None, "d", 1)]), ["k"]).first()
    assert tuple(found) == (4, 1, 2, 1, False)
    assert merge.key_check(frame(spark, [(1, "a", 1), (2, "b", 1)]), ["k"]).first()["is_key"]
    assert tuple(merge.key_check(frame(spark, []), ["k"]).first()) == (0, 0, 0, 0, True)


def test_hot_key_is_cut_before_the_shuffle(spark):
    items = spark.range(1000).selectExpr("id % 3 AS k", "id AS n")
    plan = merge.one_per_key(items, ["k"], ["n"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_keys_that_repeat_in_the_target_are_each_updated(spark, rows):
    """Whole rows and some columns agree: every target row of the key takes the new values."""
    target = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "c", "z"), (2, "d", "w"), (None, "n", "n"), (None, "n", "n")], "k int, v string, w string")
    source = spark.createDataFrame([(1, "new", "NEW"), (3, "in", "IN")], "k int, v string, w string")
    rest = [(2, "d", "w"), (3, "in", "IN"), (None, "n", "n"), (None, "n", "n")]
    assert rows(merge.upsert(target, source, ["k"])) == sorted([(1, "new", "NEW")] * 3 + rest, key=repr)
    some = rows(merge.upsert(target, source.drop("w"), ["k"]))
    assert some == sorted([(1, "new", w) for w in "xyz"] + [(2, "d", "w"), (3, "in", None), (None, "n", "n"), (None, "n", "n")], key=repr)
    filled = rows(merge.upsert(target, source, ["k"], fill=["w"]))
    assert filled == rows(merge.upsert(target, source, ["k"]))


def test_unique_keys_are_counted_in_as_many_tasks_as_a_shuffle_has(spark):
    source = spark.range(0, 200000, 1, 3).selectExpr("id AS k")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the rows' own partitions and those of the check; adaptive execution made one of the latter
    assert merge.one_per_key(source, ["k"], None).rdd.getNumPartitions() == 3 + tasks
    assert merge.upsert(source, source, ["k"]).count() == 200000
    with pytest.raises(Exception, match="repeats in the source"):
        merge.one_per_key(source.unionAll(source.limit(1)), ["k"], None).count()
