"""Fixed tables of the work list: move order, blockers and unsupported objects."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablehaul.functions.records import OBJECT_TYPES

# An object of the type is not moved once one of these types failed.
BLOCKERS = {
    "view": ["table"],
    "function": ["table", "view"],
    "storedprocedure": ["table", "view", "function"],
    "trigger": ["table", "view", "function", "storedprocedure"],
}

# Fixed values: (source engine, target engine, object type, why it is not moved).
UNSUPPORTED = [
    ("MySQL", "PostgreSQL", "event", "PostgreSQL does not support MySQL EVENT objects directly. Convert them manually to pg_cron, external scheduling, or orchestration."),
    ("MySQL", "PostgreSQL", "cursor", "Standalone cursor objects are not supported as migratable objects for PostgreSQL in this tool."),
    ("MySQL", "PostgreSQL", "synonym", "PostgreSQL synonym migration is not supported by this tool for MySQL sources."),
    ("MySQL", "Snowflake", "event", "Snowflake does not support MySQL EVENT objects directly. Convert them manually to Snowflake tasks or orchestration."),
    ("MySQL", "Snowflake", "cursor", "Standalone cursor objects are not supported as migratable objects for Snowflake in this tool."),
    ("MySQL", "Snowflake", "synonym", "Snowflake synonym migration is not supported by this tool for MySQL sources."),
    ("MySQL", "SQL Server", "event", "SQL Server does not support MySQL EVENT objects directly. Convert them manually to SQL Server Agent jobs or orchestration."),
    ("MySQL", "SQL Server", "cursor", "Standalone cursor objects are not supported as migratable objects for SQL Server in this tool."),
    ("PostgreSQL", "MySQL", "sequence", "MySQL does not support PostgreSQL-style standalone sequence migration directly in this tool."),
    ("PostgreSQL", "MySQL", "cursor", "Standalone cursor objects are not supported as migratable objects for MySQL in this tool."),
    ("PostgreSQL", "MySQL", "synonym", "MySQL does not support synonym objects."),
    ("PostgreSQL", "Snowflake", "trigger", "Snowflake does not support PostgreSQL-style table triggers directly. Convert them manually to a Snowflake stream/task/procedure pattern."),
    ("PostgreSQL", "Snowflake", "cursor", "Standalone cursor objects are not supported as migratable objects for Snowflake in this tool."),
    ("PostgreSQL", "Snowflake", "synonym", "Snowflake synonym migration is not supported by this tool for PostgreSQL sources."),
    ("PostgreSQL", "SQL Server", "cursor", "Standalone cursor objects are not supported as migratable objects for SQL Server in this tool."),
    ("PostgreSQL", "SQL Server", "event", "PostgreSQL event migration is not supported by this tool."),
    ("Snowflake", "MySQL", "trigger", "Snowflake trigger migration is not supported because Snowflake sources do not provide trigger objects in this tool."),
    ("Snowflake", "MySQL", "event", "Snowflake event migration is not supported by this tool."),
    ("Snowflake", "MySQL", "cursor", "Standalone cursor objects are not supported as migratable objects for MySQL in this tool."),
    ("Snowflake", "MySQL", "sequence", "MySQL does not support standalone sequence objects in a Snowflake-compatible way. Convert manually to AUTO_INCREMENT or sequence emulation."),
    ("Snowflake", "MySQL", "synonym", "MySQL does not support synonym objects. Convert manually to views or application-level indirection."),
    ("Snowflake", "PostgreSQL", "trigger", "Snowflake trigger migration is not supported because Snowflake sources do not provide trigger objects in this tool."),
    ("Snowflake", "PostgreSQL", "event", "Snowflake event migration is not supported by this tool."),
    ("Snowflake", "PostgreSQL", "cursor", "Standalone cursor objects are not supported as migratable objects for PostgreSQL in this tool."),
    ("Snowflake", "PostgreSQL", "synonym", "PostgreSQL synonym migration is not supported by this tool for Snowflake sources."),
    ("Snowflake", "SQL Server", "trigger", "Snowflake trigger migration is not supported because Snowflake sources do not provide trigger objects in this tool."),
    ("Snowflake", "SQL Server", "event", "Snowflake event migration is not supported by this tool."),
    ("Snowflake", "SQL Server", "cursor", "Standalone cursor objects are not supported as migratable objects for SQL Server in this tool."),
    ("SQL Server", "MySQL", "table", "SQL Server table extraction is not implemented in this tool yet. Skip table migration from SQL Server or add deterministic extraction support first."),
    ("SQL Server", "MySQL", "sequence", "MySQL does not support SQL Server-style standalone sequence migration directly in this tool."),
    ("SQL Server", "MySQL", "synonym", "MySQL does not support synonym objects. Convert manually to views or application-level indirection."),
    ("SQL Server", "MySQL", "cursor", "Standalone cursor objects are not supported as migratable objects for MySQL in this tool."),
    ("SQL Server", "PostgreSQL", "table", "SQL Server table extraction is not implemented in this tool yet. Skip table migration from SQL Server or add deterministic extraction support first."),
    ("SQL Server", "PostgreSQL", "synonym", "PostgreSQL synonym migration is not supported by this tool for SQL Server sources."),
    ("SQL Server", "PostgreSQL", "cursor", "Standalone cursor objects are not supported as migratable objects for PostgreSQL in this tool."),
    ("SQL Server", "Snowflake", "table", "SQL Server table extraction is not implemented in this tool yet. Skip table migration from SQL Server or add deterministic extraction support first."),
    ("SQL Server", "Snowflake", "trigger", "Snowflake does not support SQL Server-style table triggers directly. Convert them manually to a Snowflake stream/task/procedure pattern."),
    ("SQL Server", "Snowflake", "cursor", "Standalone cursor objects are not supported as migratable objects for Snowflake in this tool."),
]

UNKNOWN_RANK = 99


def type_rank(object_type: Column) -> Column:
    """Place of a type in the move order; types not in it come after, by name."""
    place = F.array_position(F.lit(OBJECT_TYPES), object_type)
    return F.when(place > 0, (place - 1).cast("int")).otherwise(F.lit(UNKNOWN_RANK))


def unsupported_reason(source: Column, target: Column, object_type: Column) -> Column:
    """Why an object type is not moved between two engines; null when it is.

    Triggers from or to Snowflake have their own handling, so no rule stops them.
    """
    pairs = [F.lit(part) for s, t, kind, why in UNSUPPORTED for part in (f"{s}>{t}>{kind}", why)]
    reason = F.element_at(F.create_map(*pairs), F.concat_ws(">", source, target, object_type))
    own_way = (object_type == "trigger") & ((source == "Snowflake") | (target == "Snowflake"))
    return F.when(~own_way, reason)
