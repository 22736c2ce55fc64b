"""Scans, columns, types, write modes and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablehaul.functions.sql_types import MONEY_PRECISION, MYSQL_DEFAULT_LENGTH, MYSQL_LONGEST, NO_SUFFIX, type_map_rows
from tablehaul.operators import columns, conform as conforming, copy as copying, merge, partition, reconcile as reconciling, writes
from tablehaul.session import scratch_path
from tablehaul.sources import catalog, staged_csv, tables
from tablehaul.workload.inputs import base, ctes, table
from tablehaul.workload.registry import query


# --- scans and partitions -------------------------------------------------


@query("SELECT * FROM orders")
def scan_orders(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_table(spark, f"{sf}/orders.parquet")


@query(
    """WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders)
    SELECT o_orderkey, o_totalprice, (o_orderkey - lo) // ((hi - lo + 8) // 8) AS chunk_id FROM orders, b"""
)
def range_scan(spark, sf):
    orders = base(spark, sf, "orders")
    key = partition.choose_key(orders.schema, primary_key=["o_orderpriority", "o_orderkey"])
    ranged = partition.with_chunk_id(orders, key, 8)
    read = partition.read_ranges(ranged, partition.plan_ranges(orders, key, 8))
    return read.select("o_orderkey", "o_totalprice", "chunk_id")


@query("SELECT event_id, ts FROM events UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 100 = 0")
def range_scan_dates(spark, sf):
    """Ranged reads by a time that is sometimes missing."""
    events = base(spark, sf, "events").select("event_id", "ts")
    rows = events.unionAll(events.filter("event_id % 100 = 0").withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    return partition.read_ranges(rows, partition.plan_ranges(rows, primary_key=["ts"], partitions=6))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def range_scan_quantile(spark, sf):
    """Ranged reads with about equal rows in each."""
    items = base(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return partition.read_ranges(items, partition.plan_ranges(items, "l_orderkey", 6, quantiles=True))


@query("SELECT count(*) AS row_count, count(DISTINCT l_orderkey) AS keys, true AS within FROM lineitem")
def range_scan_sized(spark, sf):
    """As many ranges as the rows need: no reader gets more than a thirtieth of the table."""
    items = base(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    most = items.count() // 30
    conditions = partition.plan_ranges(items, "l_orderkey", rows=most)
    counts = reduce(DataFrame.unionAll, [items.filter(c).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("keys")) for c in conditions])
    return counts.agg(F.sum("n").alias("row_count"), F.sum("keys").alias("keys"), (F.max("n") <= most).alias("within"))


@query("SELECT min(l_orderkey) AS lower_bound, max(l_orderkey) AS upper_bound, 8 AS num_partitions FROM lineitem")
def key_bounds(spark, sf):
    return partition.key_bounds(base(spark, sf, "lineitem"), "l_orderkey")


@query(
    f"""WITH {ctes("gappy")}, b AS (SELECT min(k) AS lo, max(k) AS hi FROM gappy),
    p AS (SELECT lo, hi, (hi - lo + 40) // 40 AS step FROM b),
    r AS (SELECT unnest(range((hi - lo) // step + 1)) AS id, lo, hi, step FROM p),
    c AS (SELECT CASE WHEN k IS NOT NULL THEN (k - lo) // step END AS id, count(*) AS n, min(k) AS a, max(k) AS z
          FROM gappy, p GROUP BY 1)
    SELECT coalesce(r.id, c.id) AS chunk_id, lo + r.id * step AS range_start,
      least(lo + (r.id + 1) * step - 1, hi) AS range_end, coalesce(n, 0) AS row_count, a AS min_key, z AS max_key
    FROM r FULL OUTER JOIN c ON r.id = c.id"""
)
def chunk_stats(spark, sf):
    return partition.chunk_stats(table(spark, sf, "gappy"), "k", 40)


@query(
    f"""WITH {ctes("catalog")} SELECT database_name, schema_name, object_name FROM catalog
    WHERE kind = 'BASE TABLE' AND schema_name <> 'information_schema'"""
)
def object_listing(spark, sf):
    found = catalog.object_listing(catalog.objects_of(table(spark, sf, "catalog")), "table")
    return found.select("database_name", "schema_name", "object_name")


@query(
    f"""WITH {ctes("routine_catalog")} SELECT database_name, schema_name, object_name, object_name || '(' || trim(arguments, '()') || ')' AS signature
    FROM routine_catalog WHERE kind = 'FUNCTION'
    UNION ALL SELECT database_name, schema_name, object_name, object_name FROM routine_catalog WHERE kind = 'TASK'"""
)
def routine_listing(spark, sf):
    """Functions with their overloads, and tasks, which count as triggers."""
    objects = catalog.objects_of(table(spark, sf, "routine_catalog"))
    found = catalog.object_listing(objects, "function").unionByName(catalog.object_listing(objects, "trigger"))
    return found.select("database_name", "schema_name", "object_name", "signature")


@query(
    f"""WITH {ctes("catalog")} SELECT database_name, schema_name,
      count(*) FILTER (kind = 'SEQUENCE') AS sequence_count, 0::bigint AS synonym_count,
      count(*) FILTER (kind = 'BASE TABLE') AS table_count, count(*) FILTER (kind = 'VIEW') AS view_count,
      count(*) FILTER (kind = 'FUNCTION') AS function_count, count(*) FILTER (kind = 'PROCEDURE') AS storedprocedure_count,
      count(*) FILTER (kind = 'TRIGGER') AS trigger_count, 0::bigint AS event_count, 0::bigint AS cursor_count
    FROM catalog WHERE schema_name <> 'information_schema' AND kind <> 'SYSTEM VIEW' GROUP BY 1, 2"""
)
def object_summary(spark, sf):
    return catalog.object_summary(catalog.objects_of(table(spark, sf, "catalog")))


@query(
    f"""WITH {ctes("catalog")} SELECT DISTINCT database_name, schema_name FROM catalog
    WHERE schema_name <> 'information_schema' AND kind <> 'SYSTEM VIEW'"""
)
def schema_listing(spark, sf):
    return catalog.schemas(catalog.objects_of(table(spark, sf, "catalog")))


@query(
    f"""WITH {ctes("key_usage", "key_constraints")}
    SELECT u.table_schema, u.table_name, u.ordinal_position, u.column_name FROM key_usage u
    JOIN key_constraints c ON u.constraint_name = c.constraint_name AND u.table_schema = c.table_schema
      AND u.table_name = c.table_name AND c.constraint_type = 'PRIMARY KEY'"""
)
def key_lookup(spark, sf):
    return catalog.key_lookup(table(spark, sf, "key_constraints"), table(spark, sf, "key_usage"))


# --- columns and types ----------------------------------------------------


@query(
    f"""WITH {ctes("sparse_docs")} SELECT body, lang, n_chars FROM sparse_docs
    WHERE regexp_matches(body, '\\S') OR regexp_matches(lang, '\\S') OR n_chars IS NOT NULL"""
)
def blank_rows(spark, sf):
    return columns.drop_blank_rows(table(spark, sf, "sparse_docs").drop("doc_id"))


@query("""SELECT event_id AS "EVENT ID", user_id AS "User_Identifier", event_type AS "eventType" FROM events""")
def match_columns(spark, sf):
    source = base(spark, sf, "events").toDF("Event_Id", "TS", "UserID", "event-type", "value", "props")
    return columns.match_columns(source, ["eventType", "User_Identifier", "EVENT ID", "loaded_at"])


@query(
    """SELECT c_custkey, c_name, c_acctbal, c_mktsegment, NULL::bigint AS loyalty FROM customer
    UNION ALL BY NAME SELECT s_suppkey AS c_custkey, s_name AS c_name, s_acctbal AS c_acctbal, NULL::varchar AS c_mktsegment,
      CAST(s_nationkey AS bigint) AS loyalty FROM supplier"""
)
def evolve_schema(spark, sf):
    target = base(spark, sf, "customer").drop("c_nationkey")
    extra = base(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("C_CustKey"), F.col("s_name").alias("cName"), F.col("s_acctbal").alias("c-acctbal"),
        F.col("s_nationkey").cast("bigint").alias("loyalty"),
    )
    return columns.append_evolving(target, extra)


@query(
    f"""WITH {ctes("text_cells")}
    SELECT 'key_text' AS column_name, CASE WHEN bool_and(try_cast(key_text AS bigint) IS NOT NULL OR key_text IS NULL) THEN 'NUMBER' ELSE 'VARCHAR' END AS inferred_type, count(key_text) AS non_null FROM text_cells
    UNION ALL SELECT 'flag_text', CASE WHEN bool_and(lower(flag_text) IN ('true', 'false')) THEN 'BOOLEAN' ELSE 'VARCHAR' END, count(flag_text) FROM text_cells
    UNION ALL SELECT 'float_text', CASE WHEN bool_and(try_cast(float_text AS double) IS NOT NULL) THEN 'FLOAT' ELSE 'VARCHAR' END, count(float_text) FROM text_cells
    UNION ALL SELECT 'day_text', CASE WHEN bool_and(length(day_text) = 10 AND try_cast(day_text AS date) IS NOT NULL) THEN 'DATE' ELSE 'VARCHAR' END, count(day_text) FROM text_cells
    UNION ALL SELECT 'time_text', CASE WHEN bool_and(length(time_text) = 19 AND try_cast(time_text AS timestamp) IS NOT NULL) THEN 'TIMESTAMP_NTZ' ELSE 'VARCHAR' END, count(time_text) FROM text_cells
    UNION ALL SELECT 'mixed_text', CASE WHEN bool_and(try_cast(mixed_text AS bigint) IS NOT NULL) THEN 'NUMBER' ELSE 'VARCHAR' END, count(mixed_text) FROM text_cells
    UNION ALL SELECT 'nothing', 'VARCHAR', count(nothing) FROM text_cells
    UNION ALL SELECT 'o_totalprice', 'FLOAT', count(o_totalprice) FROM text_cells
    UNION ALL SELECT 'o_orderdate', 'TIMESTAMP_NTZ', count(o_orderdate) FROM text_cells
    UNION ALL SELECT 'finished', 'BOOLEAN', count(finished) FROM text_cells"""
)
def infer_types(spark, sf):
    return columns.infer_types(table(spark, sf, "text_cells"), parse_text=True)


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


def _listed(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query(
    f"""WITH {ctes("declared")}, pairs(s, t, d, m) AS ({_values(type_map_rows())}),
    parsed AS (SELECT *, upper(trim(regexp_replace(regexp_replace(declared_type, '(?i)\\bunsigned\\b', '', 'g'), '\\s+', ' ', 'g'))) AS txt FROM declared),
    cut AS (SELECT *, trim(split_part(txt, '(', 1)) AS base,
      CASE WHEN contains(txt, '(') THEN substr(txt, strpos(txt, '(')) ELSE '' END AS given FROM parsed),
    found AS (SELECT c.*, coalesce(m, base) AS mapped FROM cut c LEFT JOIN pairs ON s = source_key AND t = target_key AND d = base),
    sized AS (SELECT *, CASE WHEN given = '' AND mapped = 'NUMBER' AND base = 'MONEY' THEN '{MONEY_PRECISION["MONEY"]}'
      WHEN given = '' AND mapped = 'NUMBER' AND base = 'SMALLMONEY' THEN '{MONEY_PRECISION["SMALLMONEY"]}' ELSE given END AS suffix,
      try_cast(trim(regexp_extract(given, '^\\(([0-9 ]+)\\)$', 1)) AS bigint) AS len FROM found)
    SELECT event_id, source_key, target_key, declared_type, CASE
      WHEN target_key = 'mysql' AND suffix = '' AND mapped = 'VARCHAR' THEN 'VARCHAR({MYSQL_DEFAULT_LENGTH["VARCHAR"]})'
      WHEN target_key = 'mysql' AND suffix = '' AND mapped = 'CHAR' THEN 'CHAR({MYSQL_DEFAULT_LENGTH["CHAR"]})'
      WHEN target_key = 'mysql' AND suffix = '' AND mapped = 'VARBINARY' THEN 'VARBINARY({MYSQL_DEFAULT_LENGTH["VARBINARY"]})'
      WHEN target_key = 'mysql' AND suffix = '' AND mapped = 'BINARY' THEN 'BINARY({MYSQL_DEFAULT_LENGTH["BINARY"]})'
      WHEN target_key = 'mysql' AND mapped = 'VARCHAR' AND len > {MYSQL_LONGEST["VARCHAR"]} THEN 'TEXT'
      WHEN target_key = 'mysql' AND mapped = 'CHAR' AND len > {MYSQL_LONGEST["CHAR"]} THEN 'TEXT'
      WHEN target_key = 'snowflake' AND mapped IN ('VARCHAR', 'CHAR', 'BINARY') THEN CASE WHEN len IS NOT NULL THEN mapped || suffix ELSE mapped END
      WHEN mapped IN ({_listed(NO_SUFFIX)}) OR contains(mapped, '(') THEN mapped
      ELSE mapped || suffix END AS mapped_type
    FROM sized"""
)
def type_map(spark, sf):
    declared = table(spark, sf, "declared")
    return conforming.map_types(declared, "source_key", "target_key").select(
        "event_id", "source_key", "target_key", "declared_type", "mapped_type"
    )


@query(
    f"""WITH {ctes("loose_cells")}, cast_cells AS (SELECT *, try_cast(id_text AS bigint) AS a, try_cast(user_text AS integer) AS b,
      try_cast(small_text AS smallint) AS c, try_cast(day_text AS date) AS d, CAST(round(value, 2) AS decimal(12, 2)) AS e FROM loose_cells)
    SELECT event_id, a AS id_text, b AS user_text, c AS small_text, d::varchar AS day_text, e::double AS value,
      (a IS NULL AND id_text IS NOT NULL)::int + (b IS NULL AND user_text IS NOT NULL)::int
        + (c IS NULL AND small_text IS NOT NULL)::int + (d IS NULL AND day_text IS NOT NULL)::int AS bad_cells
    FROM cast_cells"""
)
def conform_cast(spark, sf):
    kinds = {
        "id_text": "bigint", "user_text": "int", "small_text": "smallint", "day_text": "date", "value": "number(12, 2)",
    }
    done = conforming.conform(table(spark, sf, "loose_cells"), kinds, on_error="count")
    return done.withColumns({"day_text": F.col("day_text").cast("string"), "value": F.col("value").cast("double")})


@query(
    f"""WITH {ctes("lossy_cells")} SELECT event_id, CAST(round(value_of, 1) AS double) AS price, strftime(ts, '%Y-%m-%d') AS ts, floor(whole)::int AS whole,
      strftime(day, '%Y-%m-%d') AS day_text, (day IS NULL)::int AS bad_cells,
      (event_id % 3 = 0)::int + (ts <> date_trunc('day', ts))::int + (event_id % 2 = 1)::int + (event_id % 5 = 1)::int AS lossy_cells
    FROM (SELECT *, CAST(price AS decimal(12, 3)) AS value_of, CAST(try_cast(day_text AS timestamp) AS date) AS day FROM lossy_cells)"""
)
def conform_lossy(spark, sf):
    """Digits, times of day and fractions that a type has no room for are counted."""
    kinds = {"price": "decimal(12, 1)", "ts": "date", "whole": "int", "day_text": "date"}
    done = conforming.conform(table(spark, sf, "lossy_cells").drop("amount"), kinds, on_error="count", on_loss="count")
    return done.withColumns({"price": F.col("price").cast("double"), "ts": F.col("ts").cast("string"), "day_text": F.col("day_text").cast("string")})


@query(
    f"""WITH {ctes("cells")}, t AS (SELECT * FROM cells)
    SELECT event_id::varchar AS event_id, CASE WHEN even THEN 'TRUE' ELSE 'FALSE' END AS even,
      coalesce(user_id::varchar, '__DBM_NULL__') AS user_id, amount::varchar AS amount, reading::varchar AS reading,
      CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts,
      strftime(day, '%Y-%m-%d') AS day, coalesce(note, '__DBM_NULL__') AS note FROM t"""
)
def encode_cells(spark, sf):
    return columns.encode_cells(table(spark, sf, "cells"))


# --- write modes ----------------------------------------------------------


def _old_orders_at(spark, sf, label) -> str:
    path = scratch_path(spark, label)
    table(spark, sf, "old_orders").write.parquet(path)
    return path


@query(f"WITH {ctes('old_orders')} SELECT * FROM old_orders UNION ALL SELECT * FROM orders")
def append_load(spark, sf):
    path = _old_orders_at(spark, sf, "append")
    writes.append_load(base(spark, sf, "orders"), path)
    return spark.read.parquet(path)


@query(
    """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
    UNION ALL SELECT -o_orderkey, o_totalprice, NULL FROM orders UNION ALL SELECT -o_orderkey, NULL, NULL FROM orders"""
)
def append_fewer_columns(spark, sf):
    """Sources that lack columns of the target, once and again."""
    path = scratch_path(spark, "append-fewer")
    orders = base(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    orders.write.parquet(path)
    fewer = orders.select((-F.col("o_orderkey")).alias("o_orderkey"), "o_totalprice")
    writes.append_load(fewer, path)
    writes.append_load(fewer.select("o_orderkey"), path)
    return spark.read.parquet(path)


@query(
    f"""WITH {ctes('old_orders')}, src AS (SELECT * FROM orders)
    SELECT * FROM src UNION ALL SELECT * FROM old_orders t WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.o_orderkey = t.o_orderkey)"""
)
def upsert_merge(spark, sf):
    return merge.upsert(table(spark, sf, "old_orders"), base(spark, sf, "orders"), ["o_orderkey"])


@query(
    """WITH src AS (SELECT l_orderkey AS o_orderkey, l_extendedprice AS o_totalprice FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1)
    SELECT o.o_orderkey, o.o_custkey, coalesce(s.o_totalprice, o.o_totalprice) AS o_totalprice, o.o_orderpriority
      FROM orders o LEFT JOIN src s ON s.o_orderkey = o.o_orderkey
    UNION ALL SELECT s.o_orderkey, NULL, s.o_totalprice, NULL FROM src s WHERE s.o_orderkey NOT IN (SELECT o_orderkey FROM orders)"""
)
def upsert_some_columns(spark, sf):
    source = base(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"), "l_shipdate",
        "l_linenumber", "l_partkey", "l_suppkey",
    )
    target = base(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return merge.upsert(target, source, ["o_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "o_totalprice"])


@query(
    f"""WITH {ctes('old_orders')}, src AS (SELECT * FROM orders),
    k AS (SELECT s.o_orderkey, t.o_orderkey IS NOT NULL AS hit FROM src s LEFT JOIN old_orders t ON s.o_orderkey = t.o_orderkey)
    SELECT count(*) AS sent, count(*) FILTER (NOT hit) AS inserted, count(*) FILTER (hit) AS updated, 0::bigint AS superseded FROM k"""
)
def merge_counts(spark, sf):
    return merge.merge_counts(table(spark, sf, "old_orders"), base(spark, sf, "orders"), ["o_orderkey"])


@query(
    f"""WITH tgt AS (SELECT * FROM lineitem WHERE l_orderkey % 3 = 0),
    first_rows AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1)
    SELECT * FROM tgt UNION ALL SELECT * FROM first_rows s
      WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.l_orderkey = s.l_orderkey AND t.l_linenumber = s.l_linenumber)"""
)
def skip_existing(spark, sf):
    items = base(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    return merge.skip_existing(items.filter("l_orderkey % 3 = 0"), items, keys, [c for c in items.columns if c not in keys])


@query("SELECT o_orderkey, o_custkey, NULL::varchar AS o_comment FROM orders")
def truncate_load(spark, sf):
    location = scratch_path(spark, "truncate")
    name = "t_" + location.rsplit("-", 1)[1]
    schema = T.StructType.fromDDL("o_orderkey bigint, o_custkey bigint, o_comment string")
    writes.create_table(spark, name, schema, location)
    old = table(spark, sf, "old_orders")
    writes.truncate_load(old, name, location)
    writes.truncate_load(base(spark, sf, "orders"), name, location)
    return spark.table(name)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def replace_load(spark, sf):
    location = scratch_path(spark, "replace")
    name = "t_" + location.rsplit("-", 1)[1]
    writes.replace_load(base(spark, sf, "nation"), name, location + "/a")
    writes.replace_load(base(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), name, location + "/b")
    return spark.table(name)


@query("SELECT o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0")
def replace_from_itself(spark, sf):
    """The source of a replacement reads the table that it replaces."""
    location = scratch_path(spark, "replace-itself")
    name = "t_" + location.rsplit("-", 1)[1]
    writes.replace_load(base(spark, sf, "orders").select("o_orderkey", "o_totalprice"), name, location)
    half = spark.table(name).filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    writes.replace_load(half, name, location)
    return spark.table(name)


_FIRST, _LAST = "ORDER BY ts, event_id", "ORDER BY ts DESC, event_id DESC"


def _users(spark, sf):
    """Events as a source that is ordered by columns the target lacks."""
    return base(spark, sf, "events").select("user_id", "event_type", "value", F.col("ts").alias("loaded_at"), "event_id")


@query(f"SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id {_LAST}) = 1")
def upsert_order_column(spark, sf):
    root = scratch_path(spark, "order-column")
    name = "t_" + root.rsplit("-", 1)[1]
    rows = _users(spark, sf)
    writes.publish(rows.select("user_id", "event_type", "value").filter("event_id % 2 = 0").dropDuplicates(["user_id"]), name, root)
    writes.upsert_load(rows, name, root, ["user_id"], ["loaded_at", "event_id"])
    return spark.table(name)


@query(f"SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id {_FIRST}) = 1")
def skip_existing_order_column(spark, sf):
    path = scratch_path(spark, "skip-order")
    rows = _users(spark, sf)
    rows.select("user_id", "event_type", "value").limit(0).write.parquet(path)
    writes.skip_existing_load(rows, path, ["user_id"], ["loaded_at", "event_id"])
    writes.skip_existing_load(rows, path, ["user_id"], ["loaded_at", "event_id"])
    return spark.read.parquet(path)


@query(
    f"""WITH {ctes('run_mirror', 'run_updates')},
    latest AS (SELECT run_id, arg_max(source_db, seq) AS source_db, arg_min(status, seq) AS status,
      arg_max(started_at, seq) FILTER (started_at IS NOT NULL) AS started_at,
      arg_max(completed_at, seq) FILTER (completed_at IS NOT NULL) AS completed_at
      FROM run_updates WHERE run_id IS NOT NULL GROUP BY run_id)
    SELECT coalesce(t.run_id, u.run_id) AS run_id, coalesce(t.status, u.status) AS status,
      coalesce(u.source_db, t.source_db) AS source_db, coalesce(u.started_at, t.started_at) AS started_at,
      coalesce(u.completed_at, t.completed_at) AS completed_at
    FROM run_mirror t FULL OUTER JOIN latest u ON t.run_id = u.run_id
    UNION ALL SELECT run_id, status, source_db, started_at, completed_at FROM run_updates WHERE run_id IS NULL"""
)
def coalesce_upsert(spark, sf):
    return merge.upsert(
        table(spark, sf, "run_mirror"), table(spark, sf, "run_updates"), ["run_id"], ["seq"],
        fill=["started_at", "completed_at"], keep=["status"],
    )


_CELLS = f"""WITH {ctes("cells")} SELECT event_id, even, user_id, amount::double AS amount, reading, ts, day::varchar AS day, note FROM cells"""


def _csv_roundtrip(spark, sf, style):
    cells = table(spark, sf, "cells")
    path = scratch_path(spark, f"csv-{style}")
    staged_csv.stage_csv(cells, path, style)
    back = staged_csv.load_csv(spark, path, cells.schema, style)
    return back.withColumns({"amount": F.col("amount").cast("double"), "day": F.col("day").cast("string")})


@query(_CELLS)
def csv_roundtrip(spark, sf):
    return _csv_roundtrip(spark, sf, "sentinel")


@query(_CELLS)
def csv_roundtrip_n(spark, sf):
    return _csv_roundtrip(spark, sf, "backslash_n")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_documents(spark, sf):
    """Whole texts with line ends and quotes through a staged file."""
    docs = base(spark, sf, "documents")
    path = scratch_path(spark, "csv-documents")
    staged_csv.stage_csv(docs, path, "sentinel")
    return staged_csv.load_csv(spark, path, docs.schema, "sentinel")


@query("SELECT 'success' AS status, count(*) AS row_count, 4 AS files, count(*) AS rows_on_disk FROM lineitem")
def bulk_extract(spark, sf):
    path = scratch_path(spark, "extract")
    result = staged_csv.bulk_extract(base(spark, sf, "lineitem"), path, output_partitions=4)
    files = spark.read.csv(result["output_dir"], header=True).select("_metadata.file_name")
    return files.groupBy("file_name").agg(F.count("*").alias("n")).agg(
        F.lit(result["status"]).alias("status"), F.lit(result["row_count"]).cast("bigint").alias("row_count"),
        F.count("*").cast("int").alias("files"), F.sum("n").alias("rows_on_disk"),
    )


@query(
    """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT CAST(sum(n) AS bigint) AS row_count, 0::bigint AS null_key_rows, count(*) AS distinct_keys,
      count(*) FILTER (n > 1) AS repeated_keys, count(*) FILTER (n > 1) = 0 AS is_key FROM g"""
)
def key_check(spark, sf):
    return merge.key_check(base(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return merge.key_groups(base(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- reconciliation -------------------------------------------------------


def _pairs(spark, sf):
    orders, old = base(spark, sf, "orders"), table(spark, sf, "old_orders")
    items, customers = base(spark, sf, "lineitem"), base(spark, sf, "customer")
    return {
        "orders": (orders, old),
        "orders_again": (old, orders),
        "lineitem": (items, items.filter("l_linenumber > 2")),
        "customer": (customers, customers),
    }


_COUNTS = """counts AS (
    SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS s, (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0) AS t
    UNION ALL SELECT 'orders_again', (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0), (SELECT count(*) FROM orders)
    UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem WHERE l_linenumber > 2)
    UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer))"""


@query(
    f"""WITH {_COUNTS} SELECT table_name, s AS source_row_count, t AS target_row_count,
    greatest(s - t, 0) AS missing_row_count FROM counts"""
)
def reconcile(spark, sf):
    return reconciling.reconcile(_pairs(spark, sf))


@query(
    f"""WITH {_COUNTS} SELECT table_name, s AS source_row_count, t AS target_row_count,
    greatest(s - t, 0) AS missing_row_count, t >= s AS skip_copy FROM counts"""
)
def replay_check(spark, sf):
    return reconciling.replay_check(reconciling.reconcile(_pairs(spark, sf)))


@query(
    f"""WITH {ctes('old_orders')}, src AS (SELECT * FROM orders UNION ALL SELECT NULL, NULL, ' ', NULL, NULL, '' FROM customer),
    live AS (SELECT * FROM src WHERE o_orderkey IS NOT NULL),
    merged AS (SELECT * FROM live UNION ALL SELECT * FROM old_orders t WHERE t.o_orderkey NOT IN (SELECT o_orderkey FROM live))
    SELECT 'orders' AS table_name, (SELECT count(*) FROM live) AS source_row_count, count(*) AS target_row_count,
      greatest((SELECT count(*) FROM live) - count(*), 0) AS missing_row_count,
      sum(CAST(o_totalprice * 100 AS bigint))::bigint AS target_cents FROM merged"""
)
def copy_and_reconcile(spark, sf):
    """The whole path of one table: scan, blank rows, column matching, upsert, counts of the stored table."""
    target = table(spark, sf, "old_orders")
    renamed = base(spark, sf, "orders").toDF("O_ORDER_KEY", "oCustKey", "o-orderstatus", "O_TotalPrice", "o_order_date", "oOrderPriority")
    blanks = base(spark, sf, "customer").select(
        *[F.lit({"o-orderstatus": " ", "oOrderPriority": ""}.get(f.name)).cast(f.dataType).alias(f.name) for f in renamed.schema]
    )
    ready = columns.match_columns(columns.drop_blank_rows(renamed.unionAll(blanks)), target.schema)
    root = scratch_path(spark, "copy")
    name = "t_" + root.rsplit("-", 1)[1]
    writes.publish(target, name, root)
    record = copying.copy_table(ready, name, root, "upsert", ["o_orderkey"])
    cents = spark.table(name).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))).scalar()
    return record.select(
        F.lit("orders").alias("table_name"), "source_row_count", "target_row_count", "missing_row_count", cents.alias("target_cents")
    )
