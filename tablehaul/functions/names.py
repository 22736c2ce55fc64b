"""Column-name and engine-name normalisation."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Engine names as users spell them, and the engine each one means.
ENGINE_ALIASES = {
    "MySQL": "MySQL",
    "mysql": "MySQL",
    "SQL Server": "SQL Server",
    "sqlserver": "SQL Server",
    "sql_server": "SQL Server",
    "Azure SQL": "SQL Server",
    "azuresql": "SQL Server",
    "azure_sql": "SQL Server",
    "PostgreSQL": "PostgreSQL",
    "postgresql": "PostgreSQL",
    "postgres": "PostgreSQL",
    "Amazon Redshift": "PostgreSQL",
    "redshift": "PostgreSQL",
    "Google Cloud SQL": "PostgreSQL",
    "Snowflake": "Snowflake",
    "snowflake": "Snowflake",
}

# Column names that count as the same column.
COLUMN_ALIASES = {
    "fname": "first_name",
    "firstname": "first_name",
    "lname": "last_name",
    "lastname": "last_name",
    "memberid": "member_id",
    "memberidno": "member_id",
    "userid": "user_id",
    "useridentifier": "user_id",
    "memberidentifier": "member_id",
}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column_key(name: str, aliases: dict[str, str] | None = None) -> str:
    """Lower-case letters and digits only, then one alias step."""
    def squash(text):
        return re.sub("[^a-z0-9]", "", text.lower())

    table = COLUMN_ALIASES if aliases is None else aliases
    key = squash(name)
    return {squash(k): squash(v) for k, v in table.items()}.get(key, key)


def column_key_expr(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """:func:`column_key` for a column that holds names (catalog rows)."""
    table = COLUMN_ALIASES if aliases is None else aliases
    key = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    if not table:
        return key
    pairs = [F.lit(part) for k, v in table.items() for part in (column_key(k, {}), column_key(v, {}))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), key)


def engine_name(spelled: Column) -> Column:
    """The engine a spelled name means; an unknown name fails the query."""
    pairs = [F.lit(part) for item in ENGINE_ALIASES.items() for part in item]
    known = F.element_at(F.create_map(*pairs), spelled)
    return F.coalesce(
        known,
        F.raise_error(F.concat(F.lit("Unsupported DB: "), F.coalesce(spelled, F.lit("null")))).cast("string"),
    )
