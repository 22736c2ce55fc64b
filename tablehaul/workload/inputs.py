"""Inputs derived from the test tables.

Plain ones are SQL that Spark and DuckDB both read, so both sides start from the
same rows; nested run records are built here and unnested in the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablehaul.functions.records import OBJECT_TYPES, record_stats, record_status
from tablehaul.sources.tables import read_table

Q = "chr(39)"


def _pick(values: list[str], index: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {whens} END"


ENGINES = ["MySQL", "PostgreSQL", "SQL Server", "Snowflake"]
_TYPE = _pick(OBJECT_TYPES, "event_id % 9")

_MESSAGE = f"""CASE event_id % 13
 WHEN 0 THEN 'Table ' || {Q} || 'db' || user_id || '.t' || event_id || {Q} || ' doesn' || {Q} || 't exist'
 WHEN 1 THEN 'Access denied for user u' || user_id
 WHEN 2 THEN 'You have an error in your SQL syntax near ' || props
 WHEN 3 THEN 'Invalid default value for ' || {Q} || 'c' || event_id || {Q}
 WHEN 4 THEN 'Connection timeout after ' || user_id || ' s'
 WHEN 5 THEN 'SQL compilation error: Object ' || {Q} || 'DB.S.T' || event_id || {Q} || ' does not exist or not authorized.'
 WHEN 6 THEN 'Unknown table ' || {Q} || 'shop.x' || user_id || {Q}
 WHEN 7 THEN 'Base table or view not found: 1146 `db`.`t' || event_id || '` in ' || event_type
 WHEN 8 THEN 'relation ' || {Q} || 'public.r' || event_id || {Q} || ' does not exist'
 WHEN 9 THEN 'Table ' || {Q} || 't' || event_id || {Q} || ' already exists'
 WHEN 10 THEN 'invalid identifier C' || event_id
 WHEN 11 THEN 'RESULTSET is not allowed here: ' || event_type
 ELSE 'Unexpected failure ' || event_type || ' ' || props END"""

TABLES = {
    # The target of the movement queries: a tenth of the keys missing, some prices old.
    "old_orders": """SELECT o_orderkey, o_custkey, o_orderstatus,
      CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice / 2 ELSE o_totalprice END AS o_totalprice,
      o_orderdate, o_orderpriority
    FROM {orders} WHERE o_orderkey % 10 <> 0""",
    "objects": f"""SELECT 'run-' || user_id AS run_id, event_id AS seq, {_TYPE} AS object_type,
      'obj_' || event_id AS object_name,
      CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'skipped'
           WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'partial' ELSE 'success' END AS status,
      CAST(floor(value) AS bigint) AS rows_migrated,
      CAST(floor(value) AS bigint) + event_id % 3 AS source_row_count,
      CAST(floor(value) AS bigint) AS target_row_count,
      CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 END AS missing_row_count,
      event_id % 4 AS retry_count,
      CASE WHEN event_type = 'error' AND event_id % 4 <> 0 THEN {_MESSAGE} END AS error_message,
      ts AS started_at
    FROM {{events}}""",
    # The objects of a bulk run in move order, one run per user.
    "ordered_results": f"""SELECT 'run-' || user_id AS run_id, event_id AS seq,
      CASE WHEN event_id % 1000 < 150 THEN 'table' WHEN event_id % 1000 < 300 THEN 'view'
           WHEN event_id % 1000 < 500 THEN 'function' WHEN event_id % 1000 < 700 THEN 'storedprocedure'
           WHEN event_id % 1000 < 900 THEN 'trigger' ELSE 'event' END AS object_type,
      'obj_' || event_id AS object_name,
      CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'error' ELSE 'success' END AS status
    FROM {{events}}""",
    "messages": f"""SELECT event_id, {_pick(ENGINES, "user_id % 4")} AS target_db, {_TYPE} AS object_type,
      CASE WHEN event_type = 'view' THEN 'success' ELSE 'error' END AS status, {_MESSAGE} AS message
    FROM {{events}}""",
    "log_lines": """SELECT conv_id, turn,
      CASE WHEN turn % 3 = 0 THEN '2024-01-0' || (1 + turn % 9) || ' 10:00:0' || (turn % 10) || '.25 - ' ELSE '' END ||
      CASE (conv_id + turn) % 8 WHEN 0 THEN 'ERROR: ' WHEN 1 THEN 'SKIPPED: ' WHEN 2 THEN 'Migration SUCCESS ' WHEN 3 THEN '[SYSTEM] '
           WHEN 4 THEN '[Migration] ' WHEN 5 THEN 'retry ' WHEN 6 THEN 'Step failed ' ELSE '' END || text AS message
    FROM {conversations}""",
    "catalog": f"""SELECT 'db' || (user_id % 3) AS database_name,
      CASE WHEN user_id % 25 = 0 THEN 'information_schema' ELSE 's' || user_id END AS schema_name,
      CASE event_id % 7 WHEN 0 THEN 'BASE TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'PROCEDURE' WHEN 3 THEN 'FUNCTION'
           WHEN 4 THEN 'TRIGGER' WHEN 5 THEN 'SEQUENCE' ELSE 'SYSTEM VIEW' END AS kind,
      'o' || event_id AS object_name
    FROM {{events}}""",
    # Routines with overloads, and the tasks of a scheduler.
    "routine_catalog": """SELECT 'db' || (user_id % 3) AS database_name, 's' || (user_id % 7) AS schema_name,
      CASE event_id % 5 WHEN 0 THEN 'PROCEDURE' WHEN 1 THEN 'BASE TABLE' WHEN 2 THEN 'TASK' ELSE 'FUNCTION' END AS kind,
      'r' || (event_id % 50) AS object_name, CASE WHEN event_id % 5 = 4 THEN '(A NUMBER, B' || user_id || ' VARCHAR)' ELSE 'int, t' || event_id END AS arguments
    FROM {events}""",
    "key_usage": """SELECT 'pk' || (l_orderkey % 5) AS constraint_name, 's' || (l_suppkey % 4) AS table_schema,
      't' || l_orderkey AS table_name, l_linenumber AS ordinal_position, 'c' || l_partkey AS column_name
    FROM {lineitem}""",
    "key_constraints": """SELECT DISTINCT 'pk' || (l_orderkey % 5) AS constraint_name, 's' || (l_suppkey % 4) AS table_schema,
      't' || l_orderkey AS table_name,
      CASE WHEN l_orderkey % 3 = 0 THEN 'UNIQUE' ELSE 'PRIMARY KEY' END AS constraint_type
    FROM {lineitem}""",
    "schema_objects": f"""SELECT user_id AS schema_id, {_TYPE} AS object_type, 'o' || event_id AS object_name, event_type
    FROM {{events}}""",
    "gappy": """SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id * user_id * user_id - 1000 END AS k FROM {events}""",
    "sparse_docs": """SELECT doc_id,
      CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' || chr(9) || chr(10) ELSE text END AS body,
      CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN '' END AS lang,
      CASE WHEN doc_id % 8 = 0 THEN n_chars END AS n_chars
    FROM {documents}""",
    "text_cells": """SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE '' || o_orderkey END AS key_text,
      CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'FALSE' END AS flag_text,
      (o_orderkey % 50) || '.5' AS float_text,
      '2024-01-' || (10 + o_orderkey % 20) AS day_text,
      '2024-01-' || (10 + o_orderkey % 20) || ' 1' || (o_orderkey % 10) || ':30:00' AS time_text,
      CASE WHEN o_orderkey = 77 THEN 'n/a' ELSE '' || o_custkey END AS mixed_text,
      CASE WHEN o_orderkey < 0 THEN 1 END AS nothing,
      o_totalprice, o_orderdate, o_orderstatus = 'F' AS finished
    FROM {orders}""",
    "loose_cells": """SELECT event_id, '' || event_id AS id_text,
      CASE WHEN event_id % 6 = 0 THEN 'x' || event_id WHEN event_id % 6 = 1 THEN NULL ELSE '' || user_id END AS user_text,
      CASE WHEN event_id % 8 = 0 THEN '99999999999' ELSE '' || (event_id % 100) END AS small_text,
      CASE WHEN event_id % 5 = 0 THEN 'tomorrow' ELSE '2024-02-' || (10 + event_id % 19) END AS day_text,
      value
    FROM {events}""",
    "lossy_cells": """SELECT event_id, value AS amount, '' || (event_id % 1000) || CASE WHEN event_id % 3 = 0 THEN '.239' ELSE '.5' END AS price,
      CASE WHEN event_id % 4 = 0 THEN date_trunc('day', ts) ELSE ts END AS ts, event_id % 7 + CASE WHEN event_id % 2 = 0 THEN 0e0 ELSE 25e-2 END AS whole,
      CASE WHEN event_id % 5 = 0 THEN 'x' WHEN event_id % 5 = 1 THEN '2024-02-03 04:05:06' ELSE '2024-02-03' END AS day_text
    FROM {events}""",
    "cells": """SELECT event_id, event_id % 2 = 0 AS even,
      CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END AS user_id,
      CAST(value AS decimal(12,3)) AS amount,
      value * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.0001 WHEN 2 THEN 1000000 ELSE 0.5 END AS reading,
      CASE WHEN event_id % 3 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts,
      CAST(ts AS date) AS day,
      CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN NULL
           WHEN event_id % 7 = 2 THEN ' say "hi", ' || chr(10) || chr(92) || 'N ' ELSE props END AS note
    FROM {events}""",
    "declared": f"""SELECT event_id,
      {_pick(["mysql", "mysql", "snowflake", "postgresql", "sql server", "sql server"], "user_id % 6")} AS source_key,
      {_pick(["snowflake", "sql server", "mysql", "mysql", "mysql", "snowflake"], "user_id % 6")} AS target_key,
      CASE event_id % 24 WHEN 0 THEN 'int unsigned' WHEN 1 THEN 'BIGINT' WHEN 2 THEN 'decimal(' || (1 + user_id % 38) || ', 2)'
        WHEN 3 THEN 'varchar(' || event_id * 3 || ')' WHEN 4 THEN 'VARCHAR(MAX)' WHEN 5 THEN 'char( ' || user_id * 3 || ' )'
        WHEN 6 THEN 'varchar' WHEN 7 THEN 'nchar' WHEN 8 THEN 'TIMESTAMP_NTZ(9)' WHEN 9 THEN 'datetime2(7)' WHEN 10 THEN 'double   precision'
        WHEN 11 THEN 'timestamp without time zone' WHEN 12 THEN 'json' WHEN 13 THEN 'VARIANT' WHEN 14 THEN 'money'
        WHEN 15 THEN 'smallmoney' WHEN 16 THEN 'varbinary(' || user_id || ')' WHEN 17 THEN 'character varying(' || user_id || ')'
        WHEN 18 THEN 'text' WHEN 19 THEN 'bit' WHEN 20 THEN 'geography' WHEN 21 THEN 'datetime' WHEN 22 THEN 'Number(10,0)'
        ELSE 'tinyint(1)' END AS declared_type
    FROM {{events}}""",
    "statements": f"""SELECT doc_id, lang, source, CASE doc_id % 8
      WHEN 0 THEN 'CREATE TABLE `doc' || doc_id || '` (' || chr(10) || '  id INT Auto_Increment,   ' || chr(10) || chr(10) || chr(10) || chr(10) || ' body TEXT' || chr(10) || ')  ENGINE=InnoDB DEFAULT CHARSET=utf8 COLLATE=utf8_bin;;;' || chr(10) || text
      WHEN 1 THEN 'SELECT IFNULL(a, 0), NOW( ), SUBSTRING(`c`, 1, 2) FROM t WHERE a != ' || doc_id || ' LIMIT ' || doc_id || ';' || chr(13) || chr(10) || text
      WHEN 2 THEN 'create  or replace function f' || doc_id || '() returns int' || chr(92) || 'n language javascript ' || text || chr(92) || 't'
      WHEN 3 THEN 'SELECT (a, ' || {Q} || text
      WHEN 4 THEN 'DELIMITER $$' || chr(10) || 'SELECT ' || {Q} || 'x' || {Q} || ' AS y;' || chr(10) || text || chr(10) || 'delimiter ;'
      WHEN 5 THEN 'SELECT "Id", "Name" FROM "Users" WHERE a <> 1 FETCH FIRST ' || doc_id || ' ROWS ONLY; SELECT dateadd(day, 3, d) qualify ' || text
      WHEN 6 THEN '  ' || chr(10)
      ELSE text END AS input_sql
    FROM {{documents}}""",
    "pages_text": """SELECT page_id, '  ' || replace(html, '<', chr(13) || chr(10) || '  <') || chr(92) || 'r' || chr(92) || 'n' || chr(92) || chr(34) || ' ' || chr(9) || chr(10) AS body
    FROM {pages}""",
    # Earlier transforms and new requests over the same texts.
    "transforms": f"""SELECT doc_id AS seq, CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE 'SUCCESS' END AS status,
      '  ' || text || ' ' AS input_sql, 'out ' || doc_id AS output_sql,
      CASE WHEN doc_id % 2 = 0 THEN 'MySQL' ELSE 'mysql ' END AS source, 'Snowflake' AS target,
      'shop' AS source_database, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE 'Public' END AS source_schema,
      'DW' AS target_database, lang AS target_schema, 'table' AS object_type, source AS object_name
    FROM {{documents}}""",
    "requests": f"""SELECT doc_id AS request_id, replace(text, ' ', '   ') AS input_sql,
      'mysql' AS source, 'snowflake' AS target, 'SHOP' AS source_database, 'public' AS source_schema,
      'dw' AS target_database, CASE WHEN doc_id % 13 = 0 THEN '' ELSE lang END AS target_schema,
      'Table' AS object_type, CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE source END AS object_name
    FROM {{documents}}""",
    "schedules": """SELECT 'r' || event_id AS job_id,
      CASE event_id % 3 WHEN 0 THEN 'scheduled_trigger' WHEN 1 THEN 'event_trigger' ELSE 'manual' END AS trigger_type,
      event_id % 2 = 0 AS enabled
    FROM {events} WHERE event_id % 5 <> 0""",
    "run_mirror": """SELECT 'r' || event_id AS run_id, 'done' AS status, 'MySQL' AS source_db,
      CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS started_at, CAST(NULL AS timestamp) AS completed_at
    FROM {events} WHERE event_id % 3 <> 0""",
    "run_updates": """SELECT CASE WHEN event_id % 40 = 0 THEN NULL ELSE 'r' || (event_id - event_id % 4) END AS run_id, 'diagnostics' AS status, event_type AS source_db,
      CASE WHEN event_id % 5 = 0 THEN ts END AS started_at, CASE WHEN event_id % 2 = 0 THEN ts END AS completed_at, event_id AS seq
    FROM {events}""",
}

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def base(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived table as Spark reads it."""
    body = TABLES[name].replace("CAST(NULL AS timestamp)", "CAST(NULL AS timestamp_ntz)")
    used = {b: base(spark, sf, b) for b in BASE if "{" + b + "}" in body}
    df = spark.sql(body, **used)
    # date_trunc gives a zoned timestamp; the tables hold plain ones.
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def ctes(*names: str) -> str:
    """The same tables as DuckDB common table expressions, without the leading WITH."""
    return ",\n".join(f"{n} AS ({TABLES[n].format(**{b: b for b in BASE})})" for n in names)


def run_records(spark: SparkSession, sf: str) -> DataFrame:
    """One nested record per event, with up to three objects each."""
    events = base(spark, sf, "events")
    e, ts = F.col("event_id"), F.col("ts")
    types = F.lit(OBJECT_TYPES)

    def item(i):
        name = F.concat(F.lit("o"), e.cast("string"), F.lit("_"), i.cast("string"))
        state = (e * 3 + i) % 5
        rows = (e % 1000) * (i + 1)
        status = F.when(state == 0, "error").when(state == 1, "skipped").otherwise("success")
        none = F.lit(None)
        return F.struct(
            F.concat(F.lit("r"), e.cast("string")).alias("run_id"),
            name.alias("object_name"),
            F.element_at(types, ((e + i) % 9 + 1).cast("int")).alias("object_type"),
            status.alias("status"),
            none.cast("string").alias("source_db"),
            none.cast("string").alias("target_db"),
            rows.alias("rows_migrated"),
            (rows + i).alias("source_row_count"),
            rows.alias("target_row_count"),
            F.when((e + i) % 6 != 0, i.cast("bigint")).alias("missing_row_count"),
            ((e + i) % 3).alias("retry_count"),
            none.cast("string").alias("error_type"),
            F.when((state == 0) & (e % 4 != 1), F.concat(F.lit("lost "), name)).alias("error_message"),
            none.cast("string").alias("remediation"),
            F.when((e + i) % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" CREATE TABLE "), name, F.lit(" (id INT);"))).alias("transformed_sql"),
            ts.alias("started_at"),
            ts.alias("completed_at"),
        )

    def statement(o):
        blank = F.lit(None).cast("string")
        return F.struct(
            blank.alias("type"), blank.alias("name"), blank.alias("query"), o["object_type"].alias("object_type"),
            o["object_name"].alias("object_name"), o["transformed_sql"].alias("transformed_sql"), o["status"].alias("status"),
        )

    def engine(shift):
        return F.element_at(F.lit(ENGINES), ((F.col("user_id") + shift) % 4 + 1).cast("int"))

    objects = F.col("object_results")
    given = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: i < e % 4)
    completed = ts + F.make_dt_interval(secs=(e * 37 % 20000 - 100).cast("decimal(18,6)"))
    # columns of their own first, so that a query which reads some fields of a record computes only those
    parts = {
        "_run_id": F.concat(F.lit("r"), e.cast("string")),
        "_status": F.when(e % 97 == 0, "error").when(e % 89 == 0, "stopped").otherwise(record_status(objects)),
        "_source_db": engine(0),
        "_target_db": engine(1),
        "_stats": record_stats(objects),
        "_started_at": F.when(e % 50 != 7, ts),
        "_completed_at": F.when(e % 61 != 0, completed),
    }
    withs = events.withColumn("object_results", F.transform(given, item)).withColumns(parts)
    run_id = F.col("_run_id")
    lines = F.transform(objects, lambda o: F.concat_ws(" ", o["object_type"], o["object_name"], F.upper(o["status"])))
    return withs.select(
        F.struct(
            run_id.alias("run_id"),
            F.col("_status").alias("status"),
            F.col("_source_db").alias("source_db"),
            F.col("_target_db").alias("target_db"),
            F.lit(OBJECT_TYPES).alias("execution_order"),
            F.col("_stats").alias("stats"),
            objects.alias("object_results"),
            F.col("_started_at").alias("started_at"),
            F.col("_completed_at").alias("completed_at"),
        ).alias("run_summary"),
        F.concat(F.array(F.concat(F.lit("Starting "), run_id)), lines).alias("logs"),
        F.when(e % 3 == 0, F.transform(objects, statement)).otherwise(F.array().cast("array<struct<type:string,name:string,query:string,object_type:string,object_name:string,transformed_sql:string,status:string>>")).alias("results"),
        F.array(
            F.struct(
                F.lit(None).cast("string").alias("type"), F.lit("").alias("name"),
                F.concat(F.lit("SELECT "), e.cast("string"), F.lit("\n")).alias("query"),
                F.lit(None).cast("string").alias("object_type"), F.lit(None).cast("string").alias("object_name"),
                F.lit(None).cast("string").alias("transformed_sql"),
            )
        ).alias("transformed_queries"),
        e.alias("seq"),
    )


# The object rows of run_records, and the records without them, for DuckDB.
RECORD_OBJECTS = f"""rec_objects AS (
  SELECT event_id, i, 'r' || event_id AS run_id, 'o' || event_id || '_' || i AS object_name,
    {_pick(OBJECT_TYPES, "(event_id + i) % 9")} AS object_type, (event_id + i) % 9 AS type_no,
    CASE (event_id * 3 + i) % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'skipped' ELSE 'success' END AS status,
    (event_id % 1000) * (i + 1) AS rows_migrated, (event_id % 1000) * (i + 1) + i AS source_row_count,
    CASE WHEN (event_id + i) % 6 <> 0 THEN i END AS missing_row_count, (event_id + i) % 3 AS retry_count,
    CASE WHEN (event_id * 3 + i) % 5 = 0 AND event_id % 4 <> 1 THEN 'lost o' || event_id || '_' || i END AS error_message,
    CASE WHEN (event_id + i) % 3 = 0 THEN '' ELSE 'CREATE TABLE o' || event_id || '_' || i || ' (id INT);' END AS statement
  FROM (SELECT *, unnest(range(event_id % 4)) AS i FROM events))"""
RECORDS = RECORD_OBJECTS + f""",
rec_stats AS (
  SELECT event_id, count(*) AS total_objects, count(*) FILTER (status = 'success') AS success_objects,
    count(*) FILTER (status = 'error') AS error_objects, count(*) FILTER (status = 'skipped') AS skipped_objects,
    CAST(sum(rows_migrated) AS bigint) AS total_rows_migrated, CAST(sum(source_row_count) AS bigint) AS total_source_rows,
    CAST(sum(rows_migrated) AS bigint) AS total_target_rows, CAST(sum(coalesce(missing_row_count, 0)) AS bigint) AS total_missing_rows,
    CAST(sum(retry_count) AS bigint) AS total_retries,
    lower(string_agg(object_type || ' ' || object_name, ' ' ORDER BY i)) AS names,
    list(object_type) AS types
  FROM rec_objects GROUP BY event_id),
records AS (
  SELECT e.event_id AS seq, 'r' || e.event_id AS run_id, e.user_id,
    CASE WHEN e.event_id % 97 = 0 THEN 'error' WHEN e.event_id % 89 = 0 THEN 'stopped'
         WHEN coalesce(total_objects, 0) = coalesce(success_objects, 0) THEN 'success' ELSE 'partial' END AS status,
    {_pick(ENGINES, "e.user_id % 4")} AS source_db, {_pick(ENGINES, "(e.user_id + 1) % 4")} AS target_db,
    CASE WHEN e.event_id % 50 <> 7 THEN ts END AS started_at,
    CASE WHEN e.event_id % 61 <> 0 THEN ts + to_seconds(e.event_id * 37 % 20000 - 100) END AS completed_at,
    coalesce(total_objects, 0) AS total_objects, coalesce(success_objects, 0) AS success_objects,
    coalesce(error_objects, 0) AS error_objects, coalesce(skipped_objects, 0) AS skipped_objects,
    coalesce(total_rows_migrated, 0) AS total_rows_migrated, coalesce(total_source_rows, 0) AS total_source_rows,
    coalesce(total_target_rows, 0) AS total_target_rows, coalesce(total_missing_rows, 0) AS total_missing_rows,
    coalesce(total_retries, 0) AS total_retries, coalesce(names, '') AS names, types
  FROM events e LEFT JOIN rec_stats s ON s.event_id = e.event_id)"""
