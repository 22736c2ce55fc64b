"""Rule packs for rewriting SQL text."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    pattern: str
    replacement: str
    flags: str = "i"  # any of i, m, s
    word: str = ""  # lower-case text without which the pattern cannot match


# Rules that come first, for every target and for some.
BUILTIN = [
    Rule("collapse_duplicate_semicolons", r";{2,}", ";", "", ";;"),
    Rule("remove_client_delimiter_directives", r"^\s*delimiter\s+\S+\s*$", "", "im", "delimiter"),
]
BUILTIN_BY_TARGET = {
    "mysql": [
        Rule("mysql_remove_or_replace_function", r"\bcreate\s+or\s+replace\s+function\b", "CREATE FUNCTION", "is", "function"),
        Rule("mysql_remove_or_replace_procedure", r"\bcreate\s+or\s+replace\s+procedure\b", "CREATE PROCEDURE", "is", "procedure"),
        Rule("mysql_autoincrement_keyword", r"\bautoincrement\b", "AUTO_INCREMENT", "is", "autoincrement"),
    ],
    "snowflake": [
        Rule("snowflake_autoincrement_keyword", r"\bauto_increment\b", "AUTOINCREMENT", "is", "auto_increment"),
        Rule("snowflake_remove_mysql_engine", r"\bengine\s*=\s*\w+", "", "is", "engine"),
    ],
}

# Rules of every pair of engines.
COMMON = [
    Rule("normalize_duplicate_semicolons", r";{2,}", ";", "im", ";;"),
    Rule("remove_delimiter_directives", r"^\s*delimiter\s+\S+\s*$", "", "im", "delimiter"),
]

# MySQL to Snowflake.
MYSQL_TO_SNOWFLAKE = [
    Rule("snowflake_auto_increment_keyword", r"\bauto_increment\b", "AUTOINCREMENT", "is", "auto_increment"),
    Rule("snowflake_remove_mysql_engine_clause", r"\s+engine\s*=\s*\w+", "", "is", "engine"),
    Rule("snowflake_remove_mysql_charset_clause", r"\s+default\s+charset\s*=\s*\w+", "", "is", "charset"),
    Rule("snowflake_remove_mysql_collate_clause", r"\s+collate\s*=\s*[\w_]+", "", "is", "collate"),
    Rule("snowflake_now_function", r"\bnow\s*\(\s*\)", "CURRENT_TIMESTAMP()", "is", "now"),
    Rule("snowflake_curdate_function", r"\bcurdate\s*\(\s*\)", "CURRENT_DATE()", "is", "curdate"),
    Rule("snowflake_ifnull_function", r"\bifnull\s*\(", "COALESCE(", "is", "ifnull"),
    Rule("snowflake_substring_function", r"\bsubstring\s*\(", "SUBSTR(", "is", "substring"),
    Rule("snowflake_ceil_function", r"\bceil\s*\(", "CEILING(", "is", "ceil"),
    Rule("snowflake_not_equal_operator", r"!=", "<>", "i", "!="),
    Rule("snowflake_limit_to_fetch_first", r"\blimit\s+(\d+)\b", r"FETCH FIRST \1 ROWS ONLY", "is", "limit"),
    Rule("snowflake_start_transaction", r"\bstart\s+transaction\b", "BEGIN", "is", "transaction"),
    Rule("snowflake_remove_mysql_algorithm_clause", r"\bcreate\s+algorithm\s*=\s*\w+\s+", "CREATE ", "is", "algorithm"),
    Rule("snowflake_remove_mysql_definer_clause", r"\bdefiner\s*=\s*`[^`]+`@`[^`]+`\s+", "", "is", "definer"),
    Rule("snowflake_remove_mysql_sql_security_clause", r"\bsql\s+security\s+definer\s+", "", "is", "security"),
    Rule("snowflake_backtick_identifier_cleanup", r"`([^`]+)`", r'"\1"', "is", "`"),
]

# Snowflake to MySQL.
SNOWFLAKE_TO_MYSQL = [
    Rule("mysql_remove_create_or_replace_function", r"\bcreate\s+or\s+replace\s+function\b", "CREATE FUNCTION", "is", "function"),
    Rule("mysql_remove_create_or_replace_procedure", r"\bcreate\s+or\s+replace\s+procedure\b", "CREATE PROCEDURE", "is", "procedure"),
    Rule("mysql_remove_secure_routine_keyword", r"\bcreate\s+secure\s+(function|procedure)\b", r"CREATE \1", "is", "secure"),
    Rule("mysql_fetch_first_to_limit", r"\bfetch\s+first\s+(\d+)\s+rows\s+only\b", r"LIMIT \1", "is", "fetch"),
    Rule("mysql_current_timestamp_function", r"\bcurrent_timestamp\s*\(\s*\)", "NOW()", "is", "current_timestamp"),
    Rule("mysql_current_date_function", r"\bcurrent_date\s*\(\s*\)", "CURDATE()", "is", "current_date"),
    Rule("mysql_ceiling_function", r"\bceiling\s*\(", "CEIL(", "is", "ceiling"),
    Rule("mysql_not_equal_operator", r"<>", "!=", "i", "<>"),
    Rule(
        "mysql_dateadd_day_function",
        r"\bdateadd\s*\(\s*day\s*,\s*([^,]+?)\s*,\s*([^)]+?)\s*\)",
        r"DATE_ADD(\2, INTERVAL \1 DAY)",
        "is",
        "dateadd",
    ),
    Rule("mysql_double_quoted_identifier_cleanup", r'"([A-Za-z_][A-Za-z0-9_$]*)"', r"`\1`", "is", '"'),
    Rule("mysql_remove_language_sql_line", r"^\s*language\s+sql\s*$", "", "im", "language"),
    Rule("mysql_remove_execute_as_clause", r"^\s*execute\s+as\s+(owner|caller)\s*$", "", "im", "execute"),
    Rule("mysql_autoincrement_keyword", r"\bautoincrement\b", "AUTO_INCREMENT", "is", "autoincrement"),
]

PACKS = {("mysql", "snowflake"): MYSQL_TO_SNOWFLAKE, ("snowflake", "mysql"): SNOWFLAKE_TO_MYSQL}


def builtin_rules(target: str) -> list[Rule]:
    return BUILTIN + BUILTIN_BY_TARGET.get(target.strip().lower(), [])


def pair_rules(source: str, target: str) -> list[Rule]:
    return COMMON + PACKS.get((source.strip().lower(), target.strip().lower()), [])
