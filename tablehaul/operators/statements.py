"""Jobs over a text column that holds SQL statements."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablehaul.functions.checks import (
    balanced,
    check_errors,
    check_warnings,
    only_parentheses,
    semantic_problem,
    without_strings,
)
from tablehaul.functions.names import quoted
from tablehaul.functions.rewrite_rules import Rule, builtin_rules, pair_rules
from tablehaul.functions.text import contains_any, folded, is_blank, plain, quick_start, replace_all, strip
from tablehaul.operators.skew import join_per_key
from tablehaul.session import scratch_path

LOOKUP_FIELDS = [
    "source", "target", "source_database", "source_schema", "target_database", "target_schema", "object_type",
]


# What standard text is free of. (texts of which one must occur, pattern, replacement)
_JOINED = (["\\\n"], r"(?U)\\+\n[\s\x1c-\x1f]*", "\n")
_LAYOUT = [
    ([" \n", "\t\n"], r"[ \t]+\n", "\n"),
    (["\n ", "\n\t"], r"\n[ \t]+", "\n"),
    (["\n\n\n"], r"\n{3,}", "\n\n"),
]
_BLANKS = (["  ", " \t", "\t ", "\t\t"], r"[ \t]{2,}", " ")
# Control characters and quotes spelled out, longest first.
_ESCAPED = [("\\r\\n", "\n"), ("\\n", "\n"), ("\\r", "\n"), ("\\t", "\t"), ("\\'", "'"), ('\\"', '"')]


def standardize(df: DataFrame, col: str, squeeze: bool = False) -> DataFrame:
    """``col`` with plain newlines, no escaped control text, no trailing blanks, at most one empty line.

    Blank text stays as it is. ``squeeze`` also makes runs of blanks one blank. A text
    without a backslash is searched for one character instead of seven escapes, one
    without a line end for one instead of five layouts, and a pattern only runs on texts
    that have what it looks for. Each step is a projection of its own, so that no text
    is worked out twice.
    """
    text = F.col(quoted(col))

    def tidy(words: list[str], pattern: str, by: str) -> Column:
        return F.when(contains_any(text, words), F.regexp_replace(text, pattern, by)).otherwise(text)

    given = df.withColumn(col, F.coalesce(text, F.lit("")))
    steps = given.withColumns(
        {
            "_blank": F.when(is_blank(text), text),
            col: F.when(text.contains("\r"), replace_all(replace_all(text, "\r\n", "\n"), "\r", "\n")).otherwise(text),
        }
    )
    unescaped = tidy(*_JOINED)
    for escaped, real in _ESCAPED:
        unescaped = replace_all(unescaped, escaped, real)
    steps = steps.withColumn(col, F.when(text.contains("\\"), unescaped).otherwise(text))
    steps = steps.withColumn("_lines", text.contains("\n"))
    for step in _LAYOUT:
        steps = steps.withColumn(col, F.when(F.col("_lines"), tidy(*step)).otherwise(text))
    if squeeze:
        steps = steps.withColumn(col, tidy(*_BLANKS))
    return steps.withColumn(col, F.coalesce("_blank", strip(text))).drop("_blank", "_lines")


def java_pattern(rule: Rule) -> str:
    """The rule's pattern for Java: Unicode classes, and only \\n ends a line.

    Inline flags may stand anywhere in the rule; they are moved to the front.
    """
    flags = set(rule.flags.lower())
    for group in re.findall(r"\(\?([imsx]+)\)", rule.pattern):
        flags |= set(group)
    body = re.sub(r"\(\?[imsx]+\)", "", rule.pattern)
    return f"(?{''.join(sorted(flags))}Ud)" + quick_start(body)


def java_replacement(text: str) -> str:
    """Back-references as Java writes them; a dollar stays a dollar."""
    return re.sub(r"\\(\d+)", r"$\1", text.replace("$", r"\$"))


def checked_rules(spark, rules: list[Rule]) -> tuple[list[Rule], list[tuple[str, str, str]]]:
    """The rules that can run, and (name, pattern, error) of the others.

    Patterns are compiled by the driver's JVM, without a job; only a pattern error
    makes a rule bad. A replacement must not name a group the pattern lacks.
    """
    compiler = spark._jvm.java.util.regex.Pattern
    good, bad = [], []
    for rule in rules:
        try:
            groups = compiler.compile(java_pattern(rule)).matcher("").groupCount()
        except IllegalArgumentException as error:  # what a pattern error is
            bad.append((rule.name, rule.pattern, str(error).splitlines()[0]))
            continue
        asked = max((int(n) for n in re.findall(r"\\(\d+)", rule.replacement)), default=0)
        if asked > groups:
            bad.append((rule.name, rule.pattern, f"the replacement names group {asked}, the pattern has {groups}"))
        else:
            good.append(rule)
    return good, bad


def may_add(replacement: str, word: str) -> bool:
    """Whether putting in ``replacement`` can make ``word`` occur where it did not before.

    What a group captured was in the text already, so a new word shares letters with
    the text between groups; where that is empty, two neighbours may make any word.
    """
    cuts = range(1, len(word))
    shares = lambda part: (
        part in word or word in part or any(part.endswith(word[:i]) or part.startswith(word[i:]) for i in cuts)
    )
    return not replacement.isascii() or any(shares(part) for part in re.split(r"\\\d+", replacement.lower()))


def apply_rules(df: DataFrame, col: str, rules: list[Rule], applied: str = "applied_rules") -> DataFrame:
    """Apply the rules in order to ``col``; ``applied`` lists each rule that hit and how often.

    One projection counts a rule's matches, the next replaces them; Spark keeps
    projections apart whose results are used more than once, so no text is computed
    twice. Most rules do not occur in most texts: a search for the rule's word in the
    folded text is then all they cost. That text is only folded again after a
    replacement that can make a later rule's word; a word that has gone merely has its
    pattern searched in vain.
    """
    text, low = F.col(quoted(col)), F.col("_low")
    steps = df.withColumn("_low", folded(text))
    for i, rule in enumerate(rules):
        pattern, n = java_pattern(rule), F.col(f"_n{i}")
        count = F.regexp_count(text, F.lit(pattern))
        steps = steps.withColumn(f"_n{i}", F.when(low.contains(rule.word), count).otherwise(0) if rule.word else F.coalesce(count, F.lit(0)))
        done = {col: F.when(n > 0, F.regexp_replace(text, pattern, java_replacement(rule.replacement))).otherwise(text)}
        steps = steps.withColumns(done)
        if any(may_add(rule.replacement, later.word) for later in rules[i + 1 :] if later.word):
            steps = steps.withColumn("_low", F.when(n > 0, folded(text)).otherwise(low))
    hits = [
        F.when(F.col(f"_n{i}") > 0, F.struct(F.lit(rule.name).alias("name"), F.col(f"_n{i}").alias("count")))
        for i, rule in enumerate(rules)
    ]
    none = F.lit(None).cast("array<struct<name:string,count:int>>")
    done = F.array_compact(F.array(*hits)) if hits else F.coalesce(none, F.array())
    return steps.withColumn(applied, done).drop("_low", *[f"_n{i}" for i in range(len(rules))])


def rewrite_text(
    df: DataFrame, col: str, source: str, target: str, rules: list[Rule] | None = None
) -> DataFrame:
    """Standardise, builtin rules, standardise, the pair's rules, standardise.

    Adds ``applied_rules`` and ``rule_errors`` (name, pattern, error of rules whose
    pattern is broken; they are skipped).
    """
    first, broken = checked_rules(df.sparkSession, builtin_rules(target))
    then, broken_then = checked_rules(df.sparkSession, pair_rules(source, target) if rules is None else rules)
    out = apply_rules(standardize(df, col), col, first, "_first")
    out = apply_rules(standardize(out, col), col, then, "_then")
    out = standardize(out, col)
    errors = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("name", "pattern", "error"), e)]) for e in broken + broken_then]
    none = F.lit(None).cast("array<struct<name:string,pattern:string,error:string>>")
    return out.select(
        *[F.col(quoted(c)) for c in df.columns],
        F.concat("_first", "_then").alias("applied_rules"),
        (F.array(*errors) if errors else F.coalesce(none, F.array())).alias("rule_errors"),
    )


def check_text(df: DataFrame, col: str, target: str, object_type: str = "") -> DataFrame:
    """Adds ``errors``, ``warnings``, ``is_valid`` and ``refused_for``."""
    raw = F.coalesce(F.col(quoted(col)), F.lit(""))
    text, low = F.col("_text"), F.col("_low")
    steps = (
        df.withColumn("_text", strip(raw))
        .withColumns({"_low": folded(text), "_bare": without_strings(text)})
        .withColumn("_parens", only_parentheses(F.col("_bare")))
    )
    pairs = balanced(F.col("_bare"), F.col("_parens"))
    checked = steps.withColumns(
        {
            "errors": check_errors(text, low, pairs, target),
            "warnings": check_warnings(text, low, object_type),
            "refused_for": semantic_problem(raw, target, object_type),
        }
    )
    return checked.withColumn("is_valid", F.size("errors") == 0).drop("_text", "_low", "_bare", "_parens")


# Fixed values: (words in the message, target, name, pattern, replacement, description).
SUGGESTIONS = [
    (
        ["escaped formatting", "line-continuation"], None, "normalize_escaped_sql_formatting",
        r"\\+\n\s*|\\n|\\r|\\t", "\n", "Normalize escaped formatting artifacts into standard SQL whitespace.",
    ),
    (
        ["auto_increment"], "snowflake", "snowflake_auto_increment_keyword",
        r"(?is)\bauto_increment\b", "AUTOINCREMENT", "Map MySQL AUTO_INCREMENT to Snowflake AUTOINCREMENT.",
    ),
    (
        ["create or replace"], "mysql", "mysql_remove_create_or_replace_routine",
        r"(?is)\bcreate\s+or\s+replace\s+(function|procedure)\b", r"CREATE \1",
        "MySQL routines should use CREATE FUNCTION/PROCEDURE without OR REPLACE.",
    ),
    (
        ["delimiter"], "mysql", "mysql_remove_delimiter_wrappers", r"(?im)^\s*delimiter\s+\S+\s*$", "",
        "Remove client-side DELIMITER directives before executing MySQL routine SQL through the driver.",
    ),
]
MANUAL_REVIEW = (
    "manual_review_required", "", "", "Review this validation issue and add a deterministic rule if it repeats.",
)


def suggestions(checked: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """One row per message of :func:`check_text`: the rule that would mend it, else manual review."""
    def row(name, pattern, replacement, description):
        values = {"name": name, "pattern": pattern, "replacement": replacement, "description": description}
        return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])

    reason = F.lower("reason")
    pick = row(*MANUAL_REVIEW)
    for words, only, *rule in reversed(SUGGESTIONS):
        if only in (None, target.strip().lower()):
            pick = F.when(reduce(Column.__or__, [reason.contains(w) for w in words]), row(*rule)).otherwise(pick)
    messages = checked.select(*keys, F.posexplode(F.concat("errors", "warnings")).alias("pos", "reason"))
    return messages.select(
        *keys, (F.col("pos") + 1).alias("message_no"), "reason", F.lit(source).alias("source"),
        F.lit(target).alias("target"), F.lit(False).alias("approved"), pick.alias("_s"),
    ).select(*keys, "message_no", "reason", "source", "target", "approved", "_s.*")


def normal_sql(sql: Column) -> Column:
    """Text two statements are compared by: single blanks, no empty lines, no blanks at line ends."""
    text = replace_all(replace_all(F.coalesce(sql, F.lit("")), "\r\n", "\n"), "\r", "\n")
    for pattern, by in ((r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{2,}", "\n")):
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


def _digest(*parts: Column) -> Column:
    # Never null, and Spark should know: a join on a key that might be null adds a
    # filter that computes the digest a second time at the scan.
    return F.coalesce(F.sha2(F.concat_ws("\x01", *parts), 256), F.lit(""))


def _key(normal: Column, fields: list[str]) -> Column:
    return _digest(normal, *[plain(F.col(f)) for f in fields])


def with_fingerprint(df: DataFrame, sql: str = "input_sql", name: str = "history_key") -> DataFrame:
    """Adds the sha-256 over the normal text and the compared form of every field."""
    normal = df.withColumn("_normal", normal_sql(F.col(quoted(sql))))
    return normal.withColumn(name, _key(F.col("_normal"), [*LOOKUP_FIELDS, "object_name"])).drop("_normal")


def _once(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def latest_transforms(history: DataFrame, order: str = "seq") -> DataFrame:
    """Last write per fingerprint, and ``first_seq``, when the fingerprint was first written.

    Only fingerprints and numbers are aggregated, once, into a narrow table; the row of each last write is then
    found by its number, which no two records share. Spark knows the size of that
    table, so texts are only shuffled where it is too large to be sent around.
    """
    ends = _once(with_fingerprint(history).groupBy("history_key").agg(F.max(order).alias(order), F.min(order).alias("first_seq")), "transform-ends")
    rest = [c for c in history.columns if c != "history_key"]
    return history.drop("history_key").join(ends, order).select("history_key", *[F.col(quoted(c)) for c in rest], "first_seq")


def _with_keys(df: DataFrame) -> DataFrame:
    """``history_key`` and ``_loose``, the key without the object name; null when a field is blank."""
    normal = F.col("_normal")
    filled = reduce(Column.__and__, [plain(F.col(c)) != "" for c in LOOKUP_FIELDS]) & (normal != "")
    return df.withColumn("_normal", normal_sql(F.col("input_sql"))).withColumns(
        {
            "history_key": _key(normal, [*LOOKUP_FIELDS, "object_name"]),
            "_loose": F.when(filled, _key(normal, LOOKUP_FIELDS)),
        }
    ).drop("_normal")


def transform_reuse(requests: DataFrame, history: DataFrame, order: str = "seq") -> DataFrame:
    """Requests with the earlier output that can be used again, if any.

    A hit has the same text and the same seven fields, none of them blank, and
    succeeded. The same object name wins, else the oldest fingerprint. History is
    cut to one row of two digests and two numbers per key before any join, so no request multiplies, however
    many statements are alike; outputs are fetched by their number at the end.
    """
    succeeded = F.when(plain(F.col("status")) == "success", F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    # the last number and whether that write succeeded, as one number that a hash aggregate can take the maximum of
    known = _with_keys(history).select("history_key", "_loose", (F.col(order) * 2 + succeeded).alias("_write"), F.col(order).alias("first_seq"))
    ends = known.groupBy("history_key", "_loose").agg(F.max("_write").alias("_write"), F.min("first_seq").alias("first_seq"))
    usable = ends.filter("_loose IS NOT NULL AND pmod(_write, 2) = 1").withColumn("_write", F.shiftright("_write", 1))
    # both ways to find an output as one table of digests, the oldest fingerprint for each
    both = usable.select("history_key", "_write", "first_seq", F.explode(F.array("history_key", "_loose")).alias("_digest"))
    oldest = F.row_number().over(Window.partitionBy("_digest").orderBy("first_seq"))
    found = both.withColumn("_place", oldest).filter("_place = 1").drop("_place", "first_seq")
    outputs = history.select(F.col(order).alias("_write"), "output_sql")
    # Both joins read the same columns of it, so it is worked out and shuffled once and reused.
    lookup = found.join(outputs, "_write").select("_digest", F.struct("history_key", "output_sql").alias("_found"))
    asked = _with_keys(requests).withColumnRenamed("history_key", "_key")
    # A request with a blank field hits nothing; its keys match no digest but still spread over the shuffle.
    nothing = F.concat(F.lit("-"), F.col("_key"))
    asked = asked.withColumn("_key", F.when(F.col("_loose").isNull(), nothing).otherwise(F.col("_key")))
    asked = asked.withColumn("_loose", F.coalesce("_loose", "_key"))
    named = lambda key, value: lookup.select(F.col("_digest").alias(key), F.col("_found").alias(value))
    joined = join_per_key(join_per_key(asked, named("_key", "_exact"), ["_key"]), named("_loose", "_oldest"), ["_loose"])
    hit = F.coalesce("_exact", "_oldest")
    return joined.select(
        *[F.col(quoted(c)) for c in requests.columns],
        hit["history_key"].alias("history_key"),
        hit["output_sql"].alias("output_sql"),
        F.when(F.col("_exact").isNotNull(), "same_object").when(F.col("_oldest").isNotNull(), "same_text").otherwise("none").alias("hit"),
    )
