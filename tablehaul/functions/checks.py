"""Checks of SQL text, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablehaul.functions.text import contains_any, quick_start, strip

# Messages of the general checks.
EMPTY = "SQL output is empty."
UNBALANCED = "SQL has unbalanced parentheses or quotes."
ESCAPED = "SQL contains escaped formatting artifacts instead of standard SQL text."
NO_FROM = "A SELECT statement may be missing a FROM clause."
CONTINUATION = "Target SQL validator found line-continuation backslashes in the transformed SQL."
CONTROL = "Target SQL validator found escaped control sequences in the transformed SQL."

# Syntax a target does not take, a word it needs, and the message for it.
UNSUPPORTED_SYNTAX = {
    "mysql": [
        (r"\bcreate\s+or\s+replace\s+(function|procedure)\b", "replace", "MySQL does not support CREATE OR REPLACE for routines."),
        (r"\blanguage\s+javascript\b", "javascript", "MySQL does not support LANGUAGE JAVASCRIPT routines."),
        (r"\bqualify\b", "qualify", "MySQL does not support QUALIFY."),
    ],
    "snowflake": [
        (r"\bengine\s*=", "engine", "Snowflake does not support MySQL ENGINE clauses."),
        (r"\bauto_increment\b", "auto_increment", "Snowflake expects AUTOINCREMENT/IDENTITY syntax, not AUTO_INCREMENT."),
        (r"`[^`]+`", "`", "Snowflake SQL should not use MySQL backtick identifiers."),
    ],
    "postgresql": [
        (r"\bauto_increment\b", "auto_increment", "PostgreSQL does not support AUTO_INCREMENT."),
        (r"`[^`]+`", "`", "PostgreSQL SQL should not use MySQL backtick identifiers."),
    ],
    "sql server": [
        (r"\blimit\s+\d+\b", "limit", "SQL Server does not support LIMIT."),
        (r"`[^`]+`", "`", "SQL Server SQL should not use MySQL backtick identifiers."),
    ],
}

# Tokens a Snowflake table statement must not contain; the first one found is reported.
SNOWFLAKE_TABLE_TOKENS = ["auto_increment", "autoincrement(", "engine=", "on update current_timestamp"]

# A quoted string with backslash escapes. Possessive, so that Java walks it in a
# loop instead of recursing once per character of a long text.
_STRING = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""


def without_strings(text: Column) -> Column:
    """The text without its quoted strings; a quote that is left was never closed."""
    quotes = contains_any(text, ["'", '"'])
    return F.when(quotes, F.regexp_replace(text, "(?s)" + _STRING, "")).otherwise(text)


def only_parentheses(bare: Column) -> Column:
    some = contains_any(bare, ["(", ")"])
    return F.when(some, F.regexp_replace(bare, r"[^()]+", "")).otherwise(F.lit(""))


def balanced(bare: Column, parens: Column) -> Column:
    """Parentheses and quotes pair up, given the text without strings and its parentheses.

    The character loop only sees the few parentheses of a text.
    """
    opened = F.length(F.replace(parens, F.lit(")"), F.lit("")))
    # Depth so far; -1 sticks once a parenthesis closes nothing.
    depth = F.aggregate(
        F.split(parens, ""),
        F.lit(0),
        lambda d, c: F.when(d < 0, d).when(c == "(", d + 1).when(c == ")", d - 1).otherwise(d),
    )
    pairs = (opened * 2 == F.length(parens)) & (F.when(parens == "", F.lit(0)).otherwise(depth) == 0)
    return ~contains_any(bare, ["'", '"']) & pairs


def select_without_from(text: Column) -> Column:
    """A SELECT statement, other than of one constant, has no FROM up to its end."""
    statements = F.regexp_extract_all(text, F.lit("(?isUd)" + quick_start(r"\bselect\b.*?(?:;|\bend\b|\z)")), F.lit(0))
    constant = r"""(?isUd)\bselect\s+('[^']*'|"[^"]*"|\d+)(?:\s+as\s+\w+)?\s*;?\z"""
    return F.exists(
        statements,
        lambda s: ~strip(s).rlike(constant) & ~F.concat(F.lit(" "), F.lower(s), F.lit(" ")).contains(" from "),
    )


def _continued(text: Column) -> Column:
    return contains_any(text, ["\\\n", "\\\r\n"])


def escaped_format(text: Column) -> Column:
    return _continued(text) | contains_any(text, ["\\n", "\\r", "\\t"])


def semantic_problem(text: Column, target: str, object_type: str) -> Column:
    """The first reason a target would refuse the text for; null if there is none."""
    found = F.when(_continued(text), F.lit(CONTINUATION)).when(contains_any(text, ["\\n", "\\r", "\\t"]), F.lit(CONTROL))
    if target.strip().lower() == "snowflake" and object_type.strip().lower() == "table":
        for token in SNOWFLAKE_TABLE_TOKENS:
            message = f"Snowflake semantic validation failed: unsupported token '{token}' detected in table SQL."
            found = found.when(F.lower(text).contains(token), F.lit(message))
    return found


def check_errors(text: Column, low: Column, pairs: Column, target: str) -> Column:
    """Messages in order, given the stripped text, its folded form and whether it is balanced."""
    filled = text != ""
    errors = [
        F.when(~filled, F.lit(EMPTY)),
        F.when(filled & ~pairs, F.lit(UNBALANCED)),
        F.when(escaped_format(text), F.lit(ESCAPED)),
    ]
    errors += [
        F.when(low.contains(word) & text.rlike("(?isUd)" + quick_start(pattern)), F.lit(message))
        for pattern, word, message in UNSUPPORTED_SYNTAX.get(target.strip().lower(), [])
    ]
    return F.array_compact(F.array(*errors))


def check_warnings(text: Column, low: Column, object_type: str = "") -> Column:
    checked = object_type.strip().lower() in {"view", "table", "storedprocedure", "function", ""}
    warned = low.contains("select") & select_without_from(text) if checked else F.lit(False)
    return F.array_compact(F.array(F.when(warned, F.lit(NO_FROM))))
