import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from tablehaul.functions.encode import BACKSLASH_N, SENTINEL
from tablehaul.functions.names import column_key, column_key_expr, engine_name
from tablehaul.functions.sql_types import spark_type, type_map_rows
from tablehaul.operators import columns, conform


def test_blank_rows_by_every_kind_of_blank(spark):
    data = [(None, None), (None, ""), (None, " \t"), (None, " "), (None, "\x1c "), (None, "x"), (0, None), (None, " .")]
    df = spark.createDataFrame(data, "a int, b string")
    assert [tuple(r) for r in columns.drop_blank_rows(df).collect()] == [(None, "x"), (0, None), (None, " .")]


def test_blank_rows_agree_with_strip(spark):
    chars = [chr(c) for c in range(0x3100)]
    df = spark.createDataFrame([(c,) for c in chars if not 0xD800 <= ord(c) < 0xE000], "b string")
    kept = {r[0] for r in columns.drop_blank_rows(df).collect()}
    assert {c for c in chars if c.strip()} == kept


def test_names_match_by_letters_digits_and_one_alias():
    assert column_key("First_Name") == column_key("FNAME") == column_key("first name") == "firstname"
    assert column_key("member_id_no") == column_key("MemberID") == "memberid"
    assert columns.matched_names(["FNAME", "x", "B b"], ["b_b", "first_name"]) == [("FNAME", "first_name"), ("B b", "b_b")]


def test_name_expression_equals_function(spark):
    names = ["First_Name", "FNAME", "member_id_no", "o_orderkey", "", "Ünï 9"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(column_key_expr(F.col("n"))).collect()] == [column_key(n) for n in names]


def test_no_common_column_is_an_error():
    with pytest.raises(ValueError, match="no column in common"):
        columns.matched_names(["a"], ["b"])


def test_two_sources_for_one_target_are_named():
    with pytest.raises(ValueError, match="FNAME.*first_name|first_name.*FNAME"):
        columns.matched_names(["FNAME", "First_Name"], ["first_name"])


def test_odd_column_names_survive(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `c``d` int")
    assert columns.match_columns(df, ["CD", "A B"]).columns == ["A B", "CD"]
    assert columns.drop_blank_rows(df).count() == 1


def test_target_grows_by_typed_null_columns(spark):
    target = spark.createDataFrame([(1, "a")], "id int, name string")
    source = spark.createDataFrame([(2, 1.5)], "ID int, score double")
    grown = columns.append_evolving(target, source)
    assert grown.dtypes == [("id", "int"), ("name", "string"), ("score", "double")]
    assert sorted(map(tuple, grown.collect()))[1] == (2, None, 1.5)


def test_inferred_types(spark):
    df = spark.createDataFrame(
        [(True, 1, Decimal("1.5"), 1.5, dt.datetime(2024, 1, 1), dt.date(2024, 1, 1), b"x", "7", None)],
        "a boolean, b int, c decimal(5,2), d double, e timestamp_ntz, f date, g binary, h string, i int",
    )
    found = {r[0]: r[1] for r in columns.infer_types(df).collect()}
    assert list(found.values()) == ["BOOLEAN", "NUMBER", "NUMBER", "FLOAT", "TIMESTAMP_NTZ", "DATE", "BINARY", "VARCHAR", "VARCHAR"]
    assert {r[0]: r[1] for r in columns.infer_types(df, parse_text=True).collect()}["h"] == "NUMBER"


def test_cells_as_text(spark):
    row = (True, -5, Decimal("1E-8"), dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 500000), dt.date(2024, 1, 2), b"\x00\xff", 'a"b', None)
    kinds = "a boolean, b int, c decimal(10,8), d timestamp_ntz, e timestamp_ntz, f date, g binary, h string, i string"
    df = spark.createDataFrame([row], kinds)
    expected = ["TRUE", "-5", "0.00000001", "2024-01-02 03:04:05", "2024-01-02 03:04:05.500000", "2024-01-02", "00ff", 'a"b', SENTINEL.null]
    assert list(columns.encode_cells(df).first()) == expected
    other = columns.encode_cells(df, "backslash_n").first()
    assert (other[0], other[-1]) == ("1", BACKSLASH_N.null)


def test_float_text_is_python_repr(spark):
    values = [0.0, -0.0, 1.0, 1e16, 9.9e15, 1e15, 123456789.125, 1e-4, 0.00012345, 1e-5, 1.5e-7, 1e22, 6.55, 1e7, 12345678.9, float("inf"), -float("inf"), float("nan"), 1e100, -2.5e-10]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in columns.encode_cells(df).collect()] == [repr(v) for v in values]


def test_conform_null_count_and_fail(spark):
    df = spark.createDataFrame([("1", "x"), ("z", "y"), (None, None)], "a string, b string")
    assert [tuple(r) for r in conform.conform(df, {"a": "INT"}, on_error="count").collect()] == [(1, "x", 0), (None, "y", 1), (None, None, 0)]
    with pytest.raises(Exception, match="column a: not a int: z"):
        conform.conform(df, {"a": "INT"}, on_error="fail").collect()
    with pytest.raises(ValueError):
        conform.conform(df, {}, on_error="drop")


@pytest.mark.parametrize(
    "declared, engine, expected",
    [
        ("TINYINT", "SQL Server", "smallint"), ("tinyint", "MySQL", "tinyint"), ("BIGINT UNSIGNED", "", "decimal(20,0)"),
        ("int unsigned", "", "bigint"), ("NUMBER", "", "decimal(38,0)"), ("decimal(10, 2)", "", "decimal(10,2)"),
        ("MONEY", "", "decimal(19,4)"), ("timestamp_ntz(9)", "", "timestamp_ntz"), ("TIMESTAMP WITH TIME ZONE", "", "timestamp"),
        ("double  precision", "", "double"), ("VARCHAR(MAX)", "", "string"), ("bytea", "", "binary"),
    ],
)
def test_spark_types(spark, declared, engine, expected):
    assert spark_type(declared, engine) == expected
    T.StructType.fromDDL(f"x {expected}")


def test_every_mapped_type_has_a_spark_type():
    for _, _, declared, mapped in type_map_rows():
        spark_type(declared), spark_type(mapped)
    assert len(type_map_rows()) == 18 + 21 + 21 + 15 + 17 + 27


def test_type_map_edges(spark):
    cases = [
        ("mysql", "snowflake", "INT UNSIGNED", "NUMBER"), ("snowflake", "mysql", "TIMESTAMP_NTZ(9)", "DATETIME"),
        ("sql server", "snowflake", "datetime2(7)", "TIMESTAMP_NTZ"), ("sql server", "snowflake", "NVARCHAR(MAX)", "VARCHAR"),
        ("sql server", "snowflake", "nvarchar(20)", "VARCHAR(20)"), ("snowflake", "mysql", "VARCHAR", "VARCHAR(255)"),
        ("snowflake", "mysql", "VARCHAR(16384)", "TEXT"), ("snowflake", "mysql", "VARCHAR(16383)", "VARCHAR(16383)"),
        ("sql server", "mysql", "NCHAR(256)", "TEXT"), ("sql server", "mysql", "NCHAR", "CHAR(1)"),
        ("mysql", "sql server", "TEXT", "VARCHAR(MAX)"), ("sql server", "snowflake", "money", "NUMBER(19,4)"),
        ("mysql", "snowflake", "decimal(10,2)", "NUMBER(10,2)"), ("postgresql", "mysql", "geography(1)", "GEOGRAPHY(1)"),
        ("postgresql", "mysql", "double precision", "DOUBLE"), ("mysql", "snowflake", "42?", "42?"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "s string, t string, declared_type string")
    mapped = conform.map_types(df, "s", "t").collect()
    assert [r["mapped_type"] for r in mapped] == [c[3] for c in cases]


def test_engine_names(spark):
    df = spark.createDataFrame([("redshift",), ("Azure SQL",), ("mysql",)], "e string")
    assert [r[0] for r in df.select(engine_name(F.col("e"))).collect()] == ["PostgreSQL", "SQL Server", "MySQL"]
    with pytest.raises(Exception, match="Unsupported DB: oracle"):
        df.select(engine_name(F.lit("oracle"))).collect()


def test_lossy_casts_are_seen(spark):
    from decimal import Decimal
    import datetime as dt

    from tablehaul.operators.conform import conform

    kinds = "a string, b double, c decimal(10,3), d timestamp_ntz, e string, f bigint, g string"
    whole = ("1.5", 2.0, Decimal("3.100"), dt.datetime(2024, 1, 1), "2024-01-01", 7, "2024-01-01 00:00:00.123456")
    less = ("1.239", 2.5, Decimal("3.141"), dt.datetime(2024, 1, 1, 1), "2024-01-01 10:00:00", 2**53 + 1, "2024-01-01 00:00:00.1234567")
    declared = {"a": "decimal(5,1)", "b": "int", "c": "decimal(10,1)", "d": "date", "e": "date", "f": "double", "g": "timestamp"}
    none = (None,) * 7
    df = spark.createDataFrame([whole, less, none, ("x", float("nan"), None, None, "x", None, "x")], kinds)
    got = conform(df, declared, on_error="count", on_loss="count").collect()
    assert [(r.bad_cells, r.lossy_cells) for r in got][:3] == [(0, 0), (0, 7), (0, 0)] and got[3].lossy_cells == 0
    assert str(got[1].a) == "1.2" and got[1].d == dt.date(2024, 1, 1)
    nulled = conform(df, declared, on_loss="null").collect()
    assert list(nulled[1]) == [None] * 7 and nulled[0].b == 2
    with pytest.raises(Exception, match="column a: not whole as decimal"):
        conform(df.limit(2), declared, on_loss="fail").collect()
    assert conform(df.limit(1), declared, on_error="fail", on_loss="fail").count() == 1
    with pytest.raises(ValueError, match="on_loss"):
        conform(df, declared, on_loss="other")
