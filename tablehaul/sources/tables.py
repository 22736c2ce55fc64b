"""Table scans: files, catalog tables and JDBC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tablehaul.functions.names import ENGINE_ALIASES
from tablehaul.operators.partition import DEFAULT_PARTITIONS, ROWS_PER_RANGE, choose_key, cut_predicates, range_predicates

DEFAULT_BATCH = 10000

# Default port, driver class and URL form per engine.
_JDBC = {
    "MySQL": (
        3306,
        "com.mysql.cj.jdbc.Driver",
        "jdbc:mysql://{host}:{port}/{database}?useSSL=false&rewriteBatchedStatements=true&useCursorFetch=true",
    ),
    "PostgreSQL": (5432, "org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}"),
    "SQL Server": (
        1433,
        "com.microsoft.sqlserver.jdbc.SQLServerDriver",
        "jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=false;trustServerCertificate=true",
    ),
}


# The signs around a name in each engine.
_MARKS = {"MySQL": "``", "PostgreSQL": '""', "SQL Server": "[]", "Snowflake": '""'}


def canonical_engine(name: str) -> str:
    if name not in ENGINE_ALIASES:
        raise ValueError(f"Unsupported DB: {name}")
    return ENGINE_ALIASES[name]


def quote_name(engine: str, name: str) -> str:
    """One name as the engine quotes it."""
    first, last = _MARKS[canonical_engine(engine)]
    return first + name.replace(last, last * 2) + last


def qualified(engine: str, table: str | Sequence[str]) -> str:
    """A table's name; give the parts as a list where they hold dots."""
    parts = table.split(".") if isinstance(table, str) else table
    return ".".join(quote_name(engine, p) for p in parts)


def jdbc_options(engine: str, connection: dict, batch: int = DEFAULT_BATCH) -> dict[str, str]:
    """Reader and writer options of one JDBC connection.

    ``connection`` may give ``url`` and ``driver`` itself, for any other engine
    with a JDBC driver (Snowflake among them).
    """
    url, driver = connection.get("url"), connection.get("driver")
    if not url:
        kind = canonical_engine(engine)
        if kind not in _JDBC:
            raise ValueError(f"give the JDBC url and driver for {kind}")
        port, known_driver, form = _JDBC[kind]
        url = form.format(
            host=connection.get("host") or "localhost",
            port=connection.get("port") or port,
            database=connection.get("database") or "",
        )
        driver = driver or known_driver
    size = batch if isinstance(batch, int) and batch > 0 else DEFAULT_BATCH
    options = {"url": url, "fetchsize": str(size), "batchsize": str(size)}
    if driver:
        options["driver"] = driver
    for ours, theirs in (("username", "user"), ("user", "user"), ("password", "password")):
        if connection.get(ours):
            options[theirs] = connection[ours]
    return options


def read_table(spark: SparkSession, table: str, fmt: str = "parquet") -> DataFrame:
    """A folder or file of ``fmt``, or with ``fmt="table"`` a catalog table."""
    return spark.table(table) if fmt == "table" else spark.read.format(fmt).load(table)


def read_jdbc(
    spark: SparkSession,
    table: str | Sequence[str],
    engine: str,
    connection: dict,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = DEFAULT_PARTITIONS,
    batch: int = DEFAULT_BATCH,
    rows: int | None = ROWS_PER_RANGE,
) -> DataFrame:
    """A JDBC table, in one task per key range of at most ``rows`` rows.

    Without ``key`` the first column of the primary key that can be cut is taken, else the
    first such column at all. The database says where the cuts are; with ``bounds`` there
    are ``partitions`` ranges of equal width instead, and nothing is asked. Every row
    is read by exactly one range reader, null and fractional keys and keys outside
    the bounds included. A table without such a column, and a small one, is read in one task.
    """
    options = jdbc_options(engine, connection, batch)
    url = options.pop("url")
    name, ask = qualified(engine, table), lambda sql: spark.read.jdbc(url, f"({sql}) asked", properties=options)
    whole = spark.read.jdbc(url, name, properties=options)
    if key is None:
        primary = primary_key_query(engine, table)
        key = choose_key(whole.schema, [r[0] for r in ask(primary).collect()] if primary else [])
    if key is None:
        return whole
    column, kind = quote_name(engine, key), canonical_engine(engine)
    if bounds is None and rows is None:
        bounds = tuple(spark.read.jdbc(url, bounds_query(name, column), properties=options).first())
        if bounds[0] is None:
            return whole
    if bounds is not None:
        return spark.read.jdbc(url, name, predicates=range_predicates(column, *bounds, partitions, kind), properties=options)
    cuts = sorted({r[0] for r in ask(cuts_query(engine, table, key, rows)).collect()})
    return spark.read.jdbc(url, name, predicates=cut_predicates(column, cuts, kind), properties=options) if cuts else whole


def bounds_query(table: str, key: str) -> str:
    return f"(SELECT min({key}) AS lo, max({key}) AS hi FROM {table}) bounds"


def cuts_query(engine: str, table: str | Sequence[str], key: str, rows: int = ROWS_PER_RANGE) -> str:
    """Every ``rows``-th key in order, which is where the ranges are cut; on a key column the database walks its index."""
    column = quote_name(engine, key)
    placed = f"SELECT {column} AS cut, row_number() OVER (ORDER BY {column}) AS place FROM {qualified(engine, table)} WHERE {column} IS NOT NULL"
    return f"SELECT cut FROM ({placed}) placed WHERE place > 1 AND (place - 1) % {int(rows)} = 0"


def primary_key_query(engine: str, table: str | Sequence[str]) -> str | None:
    """The columns of a table's primary key by ordinal; None for Snowflake, whose catalog views lack them."""
    if canonical_engine(engine) == "Snowflake":
        return None
    parts = table.split(".") if isinstance(table, str) else list(table)
    text = lambda value: "'" + value.replace("'", "''") + "'"
    where = f" AND k.table_schema = {text(parts[-2])}" if len(parts) > 1 else ""
    return (
        "SELECT k.column_name AS column_name, k.ordinal_position AS ordinal_position FROM information_schema.table_constraints c "
        "JOIN information_schema.key_column_usage k ON k.constraint_name = c.constraint_name AND k.table_schema = c.table_schema AND k.table_name = c.table_name "
        f"WHERE c.constraint_type = 'PRIMARY KEY' AND k.table_name = {text(parts[-1])}{where}"
    )


def read_query(spark: SparkSession, sql: str, engine: str, connection: dict, batch: int = DEFAULT_BATCH) -> DataFrame:
    """The rows of a query of the database, in one task; for catalog views."""
    options = jdbc_options(engine, connection, batch)
    return spark.read.jdbc(options.pop("url"), f"({sql}) found", properties=options)


def write_jdbc(df: DataFrame, table: str, engine: str, connection: dict, mode: str = "append", batch: int = DEFAULT_BATCH) -> None:
    """Append, or with ``mode="truncate"`` empty the table first and keep its definition."""
    options = jdbc_options(engine, connection, batch)
    url = options.pop("url")
    if mode == "truncate":
        df.write.mode("overwrite").option("truncate", True).jdbc(url, table, properties=options)
    else:
        df.write.mode(mode).jdbc(url, table, properties=options)
