"""Levels, classes, hints and names read out of log lines and error messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablehaul.functions.text import contains_any, plain, strip

# Words that decide each level, tone and class; the first hit wins.
LOG_LEVELS = [("error", ["error"]), ("warn", ["skipped"]), ("success", ["success"])]
LOG_TONES = [
    ("error", ["error", "failed"]),
    ("success", ["success", "completed"]),
    ("warn", ["warn", "retry", "stopped"]),
    ("dim", ["[system]"]),
    ("blue", ["[migration]"]),
]
ERROR_CLASSES = [
    ("authorization", ["not authorized", "permission", "access denied"]),
    (
        "dependency",
        ["does not exist", "doesn't exist", "unknown table", "unknown column", "base table or view not found"],
    ),
    ("syntax", ["syntax", "compilation error", "parse"]),
    ("transformation", ["invalid default value", "data type", "datatype"]),
    ("connectivity", ["timeout", "network", "connection"]),
]

# The general hint of each error class.
CLASS_HINTS = {
    "authorization": "Verify target object privileges and source object visibility.",
    "dependency": "Migrate prerequisite objects first and validate referenced object names.",
    "syntax": "Review generated target SQL for dialect-specific syntax and delimiters.",
    "transformation": "Review type/default conversions for the target database.",
    "connectivity": "Check network connectivity and database session health.",
    "execution": "Inspect the exact database error and generated SQL for this object.",
}

# Hints per engine. (engine in the target name, object type,
# case-sensitive texts of which one must occur, hint)
ENGINE_HINTS = [
    ("MySQL", None, ["Invalid default value"], "Fix invalid MySQL defaults, especially DATETIME/TIMESTAMP defaults."),
    ("MySQL", None, ["error in your SQL syntax"], "Return a single MySQL-compatible statement with correct delimiters."),
    (
        "Snowflake",
        None,
        ["does not exist or not authorized"],
        "Fix object references, fully qualified names, and routine signatures for Snowflake.",
    ),
    (
        "Snowflake",
        "table",
        ["does not exist or not authorized"],
        "The repaired SQL must create the exact target table name in the active target database and schema. "
        "Do not invent placeholder database names such as MYDB, MY_DATABASE, DEMO_DB, or YOUR_DATABASE.",
    ),
    (
        "Snowflake",
        "table",
        ["invalid identifier"],
        "Preserve the source table column names needed for data copy. "
        "Do not rename or drop source columns unless the target dialect truly requires it.",
    ),
    (
        "Snowflake",
        "storedprocedure",
        ["RESULTSET", "JAVASCRIPT", "unexpected 'END'", "unexpected 'SQL'"],
        "Return one valid Snowflake CREATE OR REPLACE PROCEDURE statement. Do not mix LANGUAGE SQL and "
        "LANGUAGE JAVASCRIPT, and do not emit invalid RESULTSET declarations.",
    ),
    (
        "Snowflake",
        "trigger",
        [],
        "Return a Snowflake stream/task bundle for trigger migration. Do not emit CREATE TRIGGER.",
    ),
    ("", "view", [], "Ensure all referenced tables or views already exist in the target schema."),
]

# Further hints by engine. (target engine, object type, lower-case
# tokens that must all occur, hint)
HINT_RULES = [
    (
        "snowflake",
        "table",
        ["invalid identifier"],
        "Compare source and target column names using normalized matching and preserve the source business "
        "columns required for data copy.",
    ),
    (
        "snowflake",
        "table",
        ["does not exist or not authorized"],
        "Ensure the repaired SQL creates the exact target table in the active Snowflake database and schema, "
        "not a placeholder object name.",
    ),
]

# Where a message names the object it misses; the first pattern that hits.
MISSING_NAME_PATTERNS = [
    r"Table\s+'([^']+)'\s+doesn't exist",
    r"Table\s+'([^']+)'\s+does not exist",
    r"Unknown table\s+'([^']+)'",
    r"Base table or view not found:\s*[0-9]+\s+([A-Za-z0-9_.$`\"]+)",
    r"relation\s+'([^']+)'\s+does not exist",
    r"object\s+'([^']+)'\s+does not exist",
]


def _first_hit(text: Column, table: list[tuple[str, list[str]]], otherwise: str) -> Column:
    result = F.lit(otherwise)
    for name, words in reversed(table):
        result = F.when(contains_any(text, words), F.lit(name)).otherwise(result)
    return result


def log_level(message: Column) -> Column:
    return _first_hit(F.lower(F.coalesce(message, F.lit(""))), LOG_LEVELS, "info")


def log_tone(message: Column) -> Column:
    return _first_hit(F.lower(F.coalesce(message, F.lit(""))), LOG_TONES, "info")


_STAMPED = r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?)\s+-\s+([^\n\r]*)\z"


def log_stamp(message: Column) -> Column:
    """The time a log line starts with, as text; null if it has none."""
    return F.nullif(F.regexp_extract(message, _STAMPED, 1), F.lit(""))


def log_text(message: Column) -> Column:
    """The log line without its time."""
    return F.when(message.rlike(_STAMPED), F.regexp_extract(message, _STAMPED, 2)).otherwise(
        F.coalesce(message, F.lit(""))
    )


def error_class(message: Column) -> Column:
    return _first_hit(F.lower(F.coalesce(message, F.lit(""))), ERROR_CLASSES, "execution")


def remediation(target: Column, object_type: Column, message: Column) -> Column:
    """The class hint, then every engine hint and rule hint that applies, each once."""
    text = F.coalesce(message, F.lit(""))
    lowered = F.lower(text)
    hints = []
    for engine, kind, words, hint in ENGINE_HINTS:
        applies = target.contains(engine) if engine else F.lit(True)
        if kind:
            applies = applies & (object_type == kind)
        if words:
            applies = applies & contains_any(text, words)
        hints.append(F.when(applies, F.lit(hint)))
    for engine, kind, tokens, hint in HINT_RULES:
        applies = F.regexp_replace(plain(target), "[^a-z0-9]+", "_") == engine
        if kind:
            applies = applies & (object_type == kind)
        for token in tokens:
            applies = applies & lowered.contains(token)
        hints.append(F.when(applies, F.lit(hint)))
    pairs = [F.lit(part) for item in CLASS_HINTS.items() for part in item]
    general = F.element_at(F.create_map(*pairs), error_class(message))
    return F.concat_ws(" ", general, F.array_join(F.array_distinct(F.array_compact(F.array(*hints))), " "))


def missing_name(message: Column) -> Column:
    """The last part of the name of the object a message misses, without quotes; else null."""
    quotes = F.lit('`" ')
    found = F.coalesce(
        *[F.nullif(strip(F.regexp_extract(message, "(?i)" + p, 1)), F.lit("")) for p in MISSING_NAME_PATTERNS]
    )
    parts = F.filter(F.transform(F.split(found, r"\."), lambda p: F.btrim(p, quotes)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(F.btrim(found, quotes))


def already_exists(message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    named = contains_any(text, ["table '", "view '"]) & text.contains("exists")
    return contains_any(text, ["already exists", "there is already an object named"]) | named


def retryable_dependency(status: Column, object_type: Column, target: Column, message: Column) -> Column:
    """A table that failed on the target because something it refers to is not there yet."""
    missing = F.lower(F.coalesce(message, F.lit(""))).contains("does not exist or not authorized")
    return F.coalesce((status == "error") & (object_type == "table") & (target == "Snowflake") & missing, F.lit(False))
