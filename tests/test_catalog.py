import duckdb

from tablehaul.sources import catalog


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "database_name string, schema_name string, kind string, object_name string")


def test_system_schemas_and_other_kinds_are_left_out(spark, rows):
    raw = frame(
        spark, ("d", "s", "BASE TABLE", "b"), ("d", "s", "base table", "a"), ("d", "pg_catalog", "VIEW", "v"),
        ("d", "s", "SYSTEM VIEW", "x"), ("d", "s", "Procedure", "p"), ("d", "s", "cursor", "c"),
    )
    objects = catalog.objects_of(raw)
    assert [r["object_name"] for r in catalog.object_listing(objects, "table", "s").collect()] == ["a", "b"]
    assert catalog.object_listing(objects, "cursor").count() == 0
    counts = catalog.object_summary(objects).first()
    assert (counts["table_count"], counts["view_count"], counts["storedprocedure_count"]) == (2, 0, 1)
    assert rows(catalog.schemas(objects)) == [("d", "s")] and rows(catalog.databases(objects)) == [("d",)]


def test_table_query_of_the_catalog():
    con = duckdb.connect()
    con.execute("CREATE TABLE t (a INT); CREATE VIEW v AS SELECT 1")
    found = con.execute(f"SELECT object_name, kind FROM ({catalog.INVENTORY['MySQL'][0]}) inventory").fetchall()
    assert sorted(found) == [("t", "BASE TABLE"), ("v", "VIEW")]


def test_every_engine_has_its_queries():
    assert set(catalog.INVENTORY) == {"MySQL", "PostgreSQL", "SQL Server", "Snowflake"}
    for queries in catalog.INVENTORY.values():
        assert all(q.count(" AS schema_name") == q.count(" AS object_name") == q.count(" AS kind") == q.count(" AS arguments") == 1 for q in queries)


def test_key_lookup(spark, rows):
    constraints = spark.createDataFrame([("pk", "s", "t", "PRIMARY KEY"), ("u", "s", "t", "UNIQUE"), ("pk", "s2", "t", "CHECK")], "constraint_name string, table_schema string, table_name string, constraint_type string")
    usage = spark.createDataFrame([("pk", "s", "t", 2, "b"), ("pk", "s", "t", 1, "a"), ("u", "s", "t", 1, "c"), ("pk", "s2", "t", 1, "d")], "constraint_name string, table_schema string, table_name string, ordinal_position int, column_name string")
    assert [tuple(r) for r in catalog.key_lookup(constraints, usage).collect()] == [("s", "t", 1, "a"), ("s", "t", 2, "b")]


def test_key_lookup_over_databases_with_equal_names(spark, rows):
    constraints = spark.createDataFrame([(d, "pk", "s", "t", "PRIMARY KEY") for d in ("a", "b")], "database_name string, constraint_name string, table_schema string, table_name string, constraint_type string")
    usage = spark.createDataFrame([("a", "pk", "s", "t", 1, "x"), ("b", "pk", "s", "t", 1, "y")], "database_name string, constraint_name string, table_schema string, table_name string, ordinal_position int, column_name string")
    assert rows(catalog.key_lookup(constraints, usage)) == [("a", "s", "t", 1, "x"), ("b", "s", "t", 1, "y")]


def test_system_schemas_in_any_case(spark):
    raw = frame(spark, *[("d", s, "VIEW", "v") for s in ("INFORMATION_SCHEMA", "sys", "MySQL", "Performance_Schema", "own")])
    assert [r.schema_name for r in catalog.objects_of(raw).collect()] == ["own"]
    assert {r.schema_name for r in catalog.objects_of(raw, "Snowflake").collect()} == {"sys", "MySQL", "Performance_Schema", "own"}


def test_mysql_reads_the_database_that_is_asked_for():
    con = duckdb.connect()
    con.execute("CREATE SCHEMA one; CREATE SCHEMA \"t'wo\"; CREATE TABLE one.t (a INT); CREATE TABLE \"t'wo\".u (a INT)")
    found = con.execute(catalog.inventory_queries("mysql", "t'wo")[0]).fetchall()
    assert found == [("t'wo", "u", "BASE TABLE", "")]
    assert catalog.inventory_queries("postgresql", "d") == catalog.INVENTORY["PostgreSQL"]


def test_overloads_and_tasks_are_objects(spark):
    raw = spark.createDataFrame(
        [("d", "s", "FUNCTION", "f", "int, text"), ("d", "s", "function", "f", "int"), ("d", "s", "PROCEDURE", "f", "(A NUMBER, B VARCHAR)"), ("d", "s", "FUNCTION", "g", None), ("d", "s", "TASK", "nightly", ""), ("d", "s", "BASE TABLE", "t", "")],
        "database_name string, schema_name string, kind string, object_name string, arguments string",
    )
    objects = catalog.objects_of(raw)
    listed = lambda kind: [r.signature for r in catalog.object_listing(objects, kind).collect()]
    assert listed("function") == ["f(int)", "f(int, text)", "g()"] and listed("storedprocedure") == ["f(A NUMBER, B VARCHAR)"]
    assert listed("trigger") == ["nightly"] and listed("table") == ["t"]
    counts = catalog.object_summary(objects).first()
    assert (counts["function_count"], counts["trigger_count"]) == (3, 1)
    plain = catalog.objects_of(raw.drop("arguments"))
    assert {r.signature for r in plain.collect()} == {"f", "g", "nightly", "t"}
