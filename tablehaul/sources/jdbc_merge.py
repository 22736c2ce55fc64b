"""Upsert and skip-existing into JDBC tables: a staging table, then one statement in the database.

The rows are written to a staging table by Spark, in parallel; the merge itself is one
statement that the driver sends, so it happens as a whole or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tablehaul.functions.names import quoted
from tablehaul.operators.merge import _fold, keyed, one_per_key, unkeyed
from tablehaul.operators.writes import _order_names, prepare
from tablehaul.sources.tables import DEFAULT_BATCH, canonical_engine, jdbc_options, qualified, quote_name

MODES = ("upsert", "skip_existing")


def staging_name(table: str | Sequence[str], mark: str | None = None) -> list[str]:
    """A name beside the table that nobody has used yet, short enough for every engine."""
    parts = table.split(".") if isinstance(table, str) else list(table)
    return [*parts[:-1], f"{parts[-1][:24]}_stage_{mark or uuid.uuid4().hex[:16]}"]


def merge_statement(
    engine: str,
    table: str | Sequence[str],
    staging: str | Sequence[str],
    columns: Sequence[str],
    keys: Sequence[str],
    mode: str = "upsert",
    fill: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> str:
    """The statement that merges ``staging``, with one row per key, into ``table``.

    Matched rows take the staged values; ``fill`` columns keep theirs where the
    staged one is null, ``keep`` columns always. With ``skip_existing`` they stay as they
    are. A null key part equals nothing, so such rows are inserted. On MySQL and
    PostgreSQL ``keys`` must be the primary key or have a unique index, which is what
    these engines match by.
    """
    kind = canonical_engine(engine)
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    if not keys or any(k not in columns for k in keys):
        raise ValueError(f"the keys {list(keys)} must be some of the columns {list(columns)}")
    name = lambda c: quote_name(engine, c)
    target, stage = qualified(engine, table), qualified(engine, staging)
    changing = [] if mode == "skip_existing" else [c for c in columns if c not in keys and c not in keep]
    listed = ", ".join(map(name, columns))

    def assigned(left: str, new: str, old: str) -> str:
        value = lambda c: f"COALESCE({new}.{name(c)}, {old}.{name(c)})" if c in fill else f"{new}.{name(c)}"
        return ", ".join(f"{left}{name(c)} = {value(c)}" for c in changing)

    given = ", ".join(f"src.{name(c)}" for c in columns)
    if kind == "MySQL":
        # a key set to itself changes nothing and, unlike IGNORE, hides no other error
        changes = assigned(f"{target}.", "src", target) or f"{target}.{name(keys[0])} = {target}.{name(keys[0])}"
        return f"INSERT INTO {target} ({listed}) SELECT {given} FROM {stage} AS src ON DUPLICATE KEY UPDATE {changes}"
    if kind == "PostgreSQL":
        changes = assigned("", "EXCLUDED", "tgt")
        action = f"DO UPDATE SET {changes}" if changes else "DO NOTHING"
        return f"INSERT INTO {target} AS tgt ({listed}) SELECT {given} FROM {stage} AS src ON CONFLICT ({', '.join(map(name, keys))}) {action}"
    # without the lock two merges could both find a key missing
    lock, end = (" WITH (HOLDLOCK)", ";") if kind == "SQL Server" else ("", "")
    on = " AND ".join(f"tgt.{name(k)} = src.{name(k)}" for k in keys)
    changes = assigned("", "src", "tgt")
    matched = f" WHEN MATCHED THEN UPDATE SET {changes}" if changes else ""
    return f"MERGE INTO {target}{lock} AS tgt USING {stage} AS src ON {on}{matched} WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({given}){end}"


def one_row_per_key(src: DataFrame, keys: list[str], mode: str, order_by: list[str] | None, fill: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """What is staged: one row per key and all rows with a null key part, without the columns to order by."""
    given = keyed(src, keys)
    if mode == "upsert" and (fill or keep) and order_by:
        one = _fold(given, keys, order_by, list(fill), list(keep))
    else:
        one = one_per_key(given, keys, order_by, last=mode == "upsert")
    names = [c for c in src.columns if c not in (order_by or [])]
    return one.select(*[F.col(quoted(c)) for c in names]).unionByName(unkeyed(src, keys).select(*[F.col(quoted(c)) for c in names]))


class Connection:
    """One JDBC connection of the driver, for statements that Spark has no writer for."""

    def __init__(self, spark: SparkSession, options: dict[str, str]):
        if options.get("driver"):
            spark._jvm.java.lang.Class.forName(options["driver"], True, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        properties = spark._jvm.java.util.Properties()
        for key, value in options.items():
            if key not in ("url", "driver", "fetchsize", "batchsize"):
                properties.setProperty(key, value)
        self._connection = spark._jvm.java.sql.DriverManager.getConnection(options["url"], properties)
        self._connection.setAutoCommit(False)

    def run(self, sql: str) -> int:
        """Rows changed by a statement."""
        statement = self._connection.createStatement()
        try:
            return statement.executeUpdate(sql)
        finally:
            statement.close()

    def number(self, sql: str) -> int:
        """The first value of a query's first row."""
        statement = self._connection.createStatement()
        try:
            rows = statement.executeQuery(sql)
            rows.next()
            return rows.getLong(1)
        finally:
            statement.close()

    def commit(self) -> None:
        self._connection.commit()

    def rollback(self) -> None:
        self._connection.rollback()

    def close(self) -> None:
        self._connection.close()


def apply_merge(connection: Connection, engine: str, table, staging, columns, keys, sent: int, mode: str = "upsert", fill=(), keep=()) -> int:
    """Merge a complete staging table in one transaction, and drop it whatever happens; returns the rows changed.

    A staging table with another number of rows than were sent is not merged: a
    writer task that ran twice may have left its rows twice. The target is unchanged then, and
    after any other error.
    """
    stage = qualified(engine, staging)
    try:
        staged = connection.number(f"SELECT count(*) FROM {stage}")
        if staged != sent:
            raise RuntimeError(f"{staged} rows are staged for {sent} that were sent; nothing was merged, repeat the load")
        changed = connection.run(merge_statement(engine, table, staging, columns, keys, mode, fill, keep))
        connection.commit()
        return changed
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.run(f"DROP TABLE {stage}")
        connection.commit()


def merge_jdbc(
    src: DataFrame,
    table: str | Sequence[str],
    engine: str,
    connection: dict,
    keys: list[str],
    mode: str = "upsert",
    order_by: list[str] | None = None,
    fill: Sequence[str] = (),
    keep: Sequence[str] = (),
    batch: int = DEFAULT_BATCH,
    connect=Connection,
) -> int:
    """Upsert or skip-existing of ``src`` into a JDBC table; returns the rows the database says it changed.

    Blank rows go, columns are matched with the target's, and one row per key is
    staged: the last of ``order_by`` for an upsert, the first for skip-existing. Without
    an order a repeated key is an error.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    spark = src.sparkSession
    options = jdbc_options(engine, connection, batch)
    url, rest = options["url"], {k: v for k, v in options.items() if k != "url"}
    empty = f"(SELECT * FROM {qualified(engine, table)} WHERE 1 = 0) target"
    ready = prepare(src, spark.read.jdbc(url, empty, properties=rest).schema, order_by or [])
    rows, seen = one_row_per_key(ready, keys, mode, _order_names(order_by), fill, keep), Observation()
    staging = staging_name(table)
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").jdbc(url, qualified(engine, staging), properties=rest)
    session = connect(spark, options)
    try:
        return apply_merge(session, engine, table, staging, rows.columns, keys, seen.get["n"], mode, fill, keep)
    finally:
        session.close()
