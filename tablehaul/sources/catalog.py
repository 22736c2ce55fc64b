"""Inventory jobs over information_schema rows of many databases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablehaul.functions.records import OBJECT_TYPES
from tablehaul.sources.tables import canonical_engine, jdbc_options, read_query

# Schemas that belong to the engine, in lower case; engines differ in how they write them.
SYSTEM_SCHEMAS = {
    "MySQL": ["information_schema", "mysql", "performance_schema", "sys"],
    "PostgreSQL": ["information_schema", "pg_catalog", "pg_toast"],
    "SQL Server": ["information_schema", "sys", "guest"],
    "Snowflake": ["information_schema"],
}
# Object type of each information_schema kind.
KINDS = {"BASE TABLE": "table", "VIEW": "view", "PROCEDURE": "storedprocedure", "FUNCTION": "function", "TASK": "trigger"}
#: Types of which one name may stand for several objects with other arguments.
ROUTINES = ("storedprocedure", "function")


def _view(view: str, schema: str, item: str, kind: str, arguments: str = "''") -> str:
    return f"SELECT {schema} AS schema_name, {item} AS object_name, {kind} AS kind, {arguments} AS arguments FROM {view}"


_TABLES = _view("information_schema.tables", "table_schema", "table_name", "table_type")
_TRIGGERS = _view("information_schema.triggers", "trigger_schema", "trigger_name", "'TRIGGER'")

# Catalog queries of each engine, all with the columns schema_name, object_name, kind, arguments (the types a routine takes).
INVENTORY = {
    "MySQL": [
        _TABLES,
        _view(
            "information_schema.routines r", "r.routine_schema", "r.routine_name", "r.routine_type",
            "coalesce((SELECT group_concat(p.dtd_identifier ORDER BY p.ordinal_position SEPARATOR ', ') FROM information_schema.parameters p "
            "WHERE p.specific_schema = r.routine_schema AND p.specific_name = r.specific_name AND p.ordinal_position > 0), '')",
        ),
        _TRIGGERS,
        _view("information_schema.events", "event_schema", "event_name", "'EVENT'"),
    ],
    "PostgreSQL": [
        _TABLES,
        _view(
            "pg_catalog.pg_proc p JOIN pg_catalog.pg_namespace n ON n.oid = p.pronamespace WHERE p.prokind IN ('f', 'p')", "n.nspname", "p.proname",
            "CASE p.prokind WHEN 'p' THEN 'PROCEDURE' ELSE 'FUNCTION' END", "pg_catalog.oidvectortypes(p.proargtypes)",
        ),
        _TRIGGERS,
    ],
    "SQL Server": [
        _TABLES,
        _view(
            "information_schema.routines r", "r.routine_schema", "r.routine_name", "r.routine_type",
            "coalesce((SELECT string_agg(p.data_type, ', ') WITHIN GROUP (ORDER BY p.ordinal_position) FROM information_schema.parameters p "
            "WHERE p.specific_schema = r.specific_schema AND p.specific_name = r.specific_name AND p.ordinal_position > 0), '')",
        ),
        _view(
            "sys.triggers t JOIN sys.objects o ON t.parent_id = o.object_id JOIN sys.schemas s ON o.schema_id = s.schema_id WHERE t.parent_class = 1",
            "s.name", "t.name", "'TRIGGER'",
        ),
        _view("sys.sequences", "SCHEMA_NAME(schema_id)", "name", "'SEQUENCE'"),
        _view("sys.synonyms", "SCHEMA_NAME(schema_id)", "name", "'SYNONYM'"),
    ],
    "Snowflake": [
        _TABLES,
        _view("information_schema.procedures", "procedure_schema", "procedure_name", "'PROCEDURE'", "argument_signature"),
        _view("information_schema.functions", "function_schema", "function_name", "'FUNCTION'", "argument_signature"),
    ],
}
#: Tasks have no catalog view in Snowflake: the listing command goes before the query that reads it.
SNOWFLAKE_TASKS = ("SHOW TASKS ->>", 'SELECT "schema_name" AS schema_name, "name" AS object_name, \'TASK\' AS kind, \'\' AS arguments FROM $1')


def inventory_queries(engine: str, database: str | None) -> list[str]:
    """The catalog queries for one database. A MySQL server's views show all its databases, which are its schemas there."""
    queries = INVENTORY[canonical_engine(engine)]
    if canonical_engine(engine) != "MySQL" or not database:
        return queries
    name = database.replace("\\", "\\\\").replace("'", "''")
    return [f"SELECT * FROM ({sql}) found WHERE schema_name = '{name}'" for sql in queries]


def read_inventory(spark: SparkSession, engine: str, connection: dict) -> DataFrame:
    """(schema_name, object_name, object_type, signature, database_name) of one database through its catalog views; Snowflake's tasks are triggers."""
    queries = inventory_queries(engine, connection.get("database"))
    rows = [read_query(spark, sql, engine, connection) for sql in queries]
    if canonical_engine(engine) == "Snowflake":
        before, sql = SNOWFLAKE_TASKS
        rows.append(spark.read.format("jdbc").options(**jdbc_options(engine, connection), prepareQuery=before, query=sql).load())
    united = reduce(DataFrame.unionAll, [r.toDF("schema_name", "object_name", "kind", "arguments") for r in rows])
    return objects_of(united.withColumn("database_name", F.lit(connection.get("database"))), engine)


def objects_of(rows: DataFrame, engine: str | None = None) -> DataFrame:
    """Catalog rows with a ``kind`` as objects with a type and a signature; other kinds and system schemas are left out.

    The signature of a routine is its name with the types of ``arguments``, where the
    rows have them, so overloads are objects of their own; of others it is the name. Schemas are compared in lower case with those of the engine, or of all engines.
    """
    own = SYSTEM_SCHEMAS[canonical_engine(engine)] if engine else sorted({s for names in SYSTEM_SCHEMAS.values() for s in names})
    pairs = [F.lit(part) for item in KINDS.items() for part in item]
    kind = F.upper("kind")
    typed = rows.withColumn("object_type", F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lower("kind")))
    signature = F.col("object_name")
    if "arguments" in rows.columns:
        bare = F.regexp_replace(F.trim(F.coalesce("arguments", F.lit(""))), r"^\(|\)$", "")  # Snowflake has them in parentheses
        signature = F.when(F.col("object_type").isin(*ROUTINES), F.concat("object_name", F.lit("("), F.trim(bare), F.lit(")"))).otherwise(signature)
    typed = typed.withColumn("signature", signature)
    return typed.filter(F.col("object_type").isin(OBJECT_TYPES) & ~F.lower("schema_name").isin(own)).drop("kind", "arguments")


def databases(objects: DataFrame) -> DataFrame:
    return objects.select("database_name").distinct()


def schemas(objects: DataFrame) -> DataFrame:
    return objects.select("database_name", "schema_name").distinct()


def object_listing(objects: DataFrame, object_type: str, schema: str | None = None) -> DataFrame:
    """Objects of one type, sorted; overloads of a routine are objects of their own. No database lists its cursors."""
    found = objects.filter((F.col("object_type") == object_type) & (F.col("object_type") != "cursor"))
    if schema is not None:
        found = found.filter(F.col("schema_name") == schema)
    return found.orderBy("schema_name", "object_name", "signature")


def object_summary(objects: DataFrame) -> DataFrame:
    """Per schema: how many objects of each of the nine types."""
    return objects.groupBy("database_name", "schema_name").agg(
        *[F.count_if(F.col("object_type") == t).alias(f"{t}_count") for t in OBJECT_TYPES]
    )


def key_lookup(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """Primary-key columns of every table by ordinal.

    Constraints meet the key usage on name, schema and table, and on the database
    where both sides name it (``database_name``).
    """
    scope = [c for c in ("database_name",) if c in constraints.columns and c in usage.columns]
    on = [*scope, "constraint_name", "table_schema", "table_name"]
    primary = constraints.filter(F.col("constraint_type") == "PRIMARY KEY").select(*on).distinct()
    placed = [*scope, "table_schema", "table_name", "ordinal_position"]
    return usage.join(primary, on).select(*placed, "column_name").orderBy(*placed)
