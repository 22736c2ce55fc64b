import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from tablehaul.operators import partition

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def test_key_choice(spark):
    schema = T.StructType.fromDDL("name string, score double, day date, id bigint")
    assert partition.choose_key(schema, ["name", "id"]) == "id"
    assert partition.choose_key(schema) == "day"
    assert partition.choose_key(schema, ["id"], chunk_column="score") == "score"
    assert partition.choose_key(schema, ["id"], "day", "score") == "day"
    assert partition.choose_key(schema, ["name"], fallback=False) is None
    assert partition.choose_key(T.StructType.fromDDL("name string, x double")) is None


def test_bounds(spark):
    df = spark.createDataFrame([(3,), (None,), (9,)], "k int")
    assert tuple(partition.key_bounds(df, "k").first()) == (3, 9, 8)
    assert tuple(partition.key_bounds(df, "k", 1, 5, 2).first()) == (1, 5, 2)
    assert tuple(partition.key_bounds(df, "k", lower=1).first()) == (1, 9, 8)
    assert partition.key_bounds(df.filter("k > 100"), "k").count() == 0


def chunks(spark, keys, n, kind="bigint"):
    df = spark.createDataFrame([(k,) for k in keys], f"k {kind}")
    return {r["chunk_id"]: r for r in partition.chunk_stats(df, "k", n).collect()}


def test_null_negative_and_empty_chunks(spark):
    found = chunks(spark, [-10, -10, None, 29], 4)
    assert {k: r["row_count"] for k, r in found.items()} == {0: 2, 1: 0, 2: 0, 3: 1, None: 1}
    assert [(found[i]["range_start"], found[i]["range_end"]) for i in range(4)] == [(-10, -1), (0, 9), (10, 19), (20, 29)]


def test_fewer_ranges_than_asked(spark):
    assert len(chunks(spark, [1, 2, 3], 8)) == 3
    assert len(chunks(spark, [1, 10], 6)) == 5


def test_keys_beyond_float_precision(spark):
    low = 2**53
    found = chunks(spark, [low + i for i in range(8)], 8)
    assert {r["row_count"] for r in found.values()} == {1}


def test_fractional_keys_between_ranges_are_kept(spark):
    from decimal import Decimal

    found = chunks(spark, [Decimal("-0.5"), Decimal("10.5"), Decimal("11.0"), Decimal("19.9")], 2, "decimal(10,2)")
    assert sum(r["row_count"] for r in found.values()) == 4


def test_empty_table_and_text_key(spark):
    assert chunks(spark, [], 4) == {}
    assert {k: r["row_count"] for k, r in chunks(spark, ["a", None], 4, "string").items()} == {0: 1, None: 1}


@QUICK
@given(st.lists(st.one_of(st.none(), st.integers(-(10**12), 10**12)), min_size=1, max_size=30), st.integers(1, 9))
def test_chunks_hold_every_row_inside_their_range(spark, keys, n):
    found = chunks(spark, keys, n)
    assert sum(r["row_count"] for r in found.values()) == len(keys)
    assert len([c for c in found if c is not None]) <= n
    for chunk, row in found.items():
        if chunk is not None and row["row_count"]:
            assert row["range_start"] <= row["min_key"] <= row["max_key"] <= row["range_end"]


@pytest.mark.parametrize("lower, upper, n", [(0, 99, 8), (5, 5, 8), (-7, 3, 3), (0, 1, 1)])
def test_every_row_meets_one_predicate(spark, lower, upper, n):
    df = spark.createDataFrame([(x,) for x in (None, -1e9, -7.5, -1.0, 0.0, 0.5, 1.0, 2.25, 5.0, 12.5, 13.0, 99.0, 99.5, 1e9)], "k double")
    hits = [F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in partition.range_predicates("k", lower, upper, n)]
    assert {r[0] for r in df.select(sum(hits[1:], hits[0])).collect()} == {1}


def test_quantile_chunks_are_even_on_a_skewed_key(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id") * F.col("id")).alias("k"))
    sizes = [r["count"] for r in partition.with_quantile_chunk(df, "k", 4).groupBy("chunk_id").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 10
    widths = [r["count"] for r in partition.with_chunk_id(df, "k", 4).groupBy("chunk_id").count().collect()]
    assert max(widths) > 500


def test_ranged_reads_cover_every_row_once(spark):
    import datetime as dt
    from decimal import Decimal

    day, at = dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 3)
    kinds = {
        "bigint": [1, 5, 5, None, 100, -7],
        "decimal(12,3)": [Decimal("0.5"), Decimal("1.5"), None, Decimal("99.125")],
        "date": [day, None, *[day + dt.timedelta(days=i * i) for i in range(20)]],
        "timestamp_ntz": [at, None, *[at + dt.timedelta(seconds=i**3) for i in range(20)]],
        "timestamp": [at, None, *[at + dt.timedelta(hours=i) for i in range(20)]],
    }
    for kind, values in kinds.items():
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, k {kind}")
        for quantiles in (False, True):
            predicates = partition.plan_ranges(df, "k", 4, quantiles)
            assert 2 <= len(predicates) <= 5 and predicates[-1].endswith("IS NULL")
            assert sorted(r.i for r in partition.read_ranges(df, predicates).collect()) == list(range(len(values)))
        found = {r.chunk_id: r for r in partition.chunk_stats(df, "k", 4).collect()}
        assert sum(r.row_count for r in found.values()) == len(values) and len(found) > 2
    assert partition.plan_ranges(spark.createDataFrame([("a",)], "k string"), "k") is None
    assert partition.chunk_stats(spark.createDataFrame([("a",)], "k string"), "k").columns == partition.chunk_stats(df, "k").columns
    assert partition.plan_ranges(spark.createDataFrame([], "k int"), "k") == ["`k` IS NOT NULL", "`k` IS NULL"]


def test_bounds_query_of_a_server():
    import duckdb

    from tablehaul.sources.tables import bounds_query

    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT range AS k FROM range(3, 9)")
    assert con.execute(f"SELECT * FROM {bounds_query('t', 'k')}").fetchall() == [(3, 8)]


def test_literals_per_engine():
    import datetime as dt

    day, moment = dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 60)
    assert partition.cut_predicates("k", [day])[0] == "k < DATE '2024-01-02'"
    assert partition.cut_predicates("[k]", [day], "SQL Server")[0] == "[k] < CAST('2024-01-02' AS date)"
    assert partition.cut_predicates("[k]", [moment], "SQL Server")[1] == "[k] >= CAST('2024-01-02 03:04:05.000060' AS datetime2)"
    assert partition.cut_predicates("`k`", [moment], "MySQL")[0] == "`k` < TIMESTAMP '2024-01-02 03:04:05.000060'"
    assert partition.range_predicates("k", 0, 9, 2, "MySQL") == ["k < 5", "k >= 5", "k IS NULL"]


@pytest.mark.parametrize("rows", [1, 50, 333, 10_000])
def test_no_range_has_more_rows_than_asked(spark, rows):
    """Keys that crowd at one end, nulls among them."""
    df = spark.range(3000).selectExpr("CASE WHEN id % 10 = 0 THEN NULL WHEN id < 2500 THEN id ELSE id * id * 1000 END AS k")
    conditions = partition.plan_ranges(df, "k", rows=rows)
    counts = [df.filter(c).count() for c in conditions] if rows > 1 else [df.filter(c).count() for c in conditions[:40]]
    assert all(n <= rows for n in counts[:-1]) or rows == 10_000
    if rows > 1:
        assert sum(counts) == 3000 and counts[-1] == 300
    assert len(conditions) >= 2700 / rows


def test_texts_for_databases():
    import duckdb

    from tablehaul.sources import tables

    con = duckdb.connect()
    con.execute("CREATE SCHEMA shop; CREATE TABLE shop.orders (note VARCHAR, b INT, a INT, PRIMARY KEY (a, b))")
    con.execute("INSERT INTO shop.orders SELECT 'x', i, i * i FROM range(1000) t(i)")
    sql = tables.cuts_query("postgresql", "shop.orders", "a", 300)
    cuts = sorted(r[0] for r in con.execute(f"SELECT * FROM ({sql}) asked").fetchall())
    assert cuts == [300**2, 600**2, 900**2]
    counts = [con.execute(f"SELECT count(*) FROM shop.orders WHERE {c}").fetchone()[0] for c in partition.cut_predicates('"a"', cuts, "PostgreSQL")]
    assert counts == [300, 300, 300, 100, 0]
    found = con.execute(tables.primary_key_query("postgresql", "shop.orders")).fetchall()
    assert sorted((r[1], r[0]) for r in found) == [(1, "a"), (2, "b")]
    assert "table_schema" not in tables.primary_key_query("mysql", "orders").split("WHERE")[1]
    assert "= 'it''s'" in tables.primary_key_query("sqlserver", "it's") and tables.primary_key_query("snowflake", "t") is None
    assert tables.cuts_query("sqlserver", ["s", "a]b"], "k", 5).count("[a]]b]") == 1
