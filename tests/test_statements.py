import random
import re

import pytest
from pyspark.sql import functions as F

from tablehaul.functions.checks import balanced, only_parentheses, without_strings
from tablehaul.functions.rewrite_rules import PACKS, Rule, builtin_rules, pair_rules
from tablehaul.functions.text import quick_start, strip
from tablehaul.operators import statements


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, sql string")


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_strip_is_python_strip(spark):
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    df = texts(spark, [f"{c}a {c}" for c in chars])
    assert column(df.withColumn("s", strip(F.col("sql"))), "s") == [f"{c}a {c}".strip() for c in chars]


def standard(text):
    """The same steps with Python's own patterns."""
    if not text.strip():
        return text
    text = re.sub(r"\\+\n\s*", "\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    for old, new in ((r"\r\n", "\n"), (r"\n", "\n"), (r"\r", "\n"), (r"\t", "\t"), (r"\'", "'"), (r"\"", '"')):
        text = text.replace(old, new)
    for pattern, new in ((r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")):
        text = re.sub(pattern, new, text)
    return text.strip()


def test_standardize_random_texts(spark):
    rng = random.Random(1)
    values = ["".join(rng.choices(["a", " ", "\t", "\n", "\r", "\\", "\\n", "'", '"', " ", "é"], k=rng.randrange(25))) for _ in range(800)]
    assert column(statements.standardize(texts(spark, values), "sql"), "sql") == [standard(v) for v in values]
    null = spark.createDataFrame([(1, None)], "id int, sql string")
    assert column(statements.standardize(null, "sql"), "sql") == [""]


def scanned(text):
    """Character by character."""
    depth, quote, skip = 0, None, False
    for c in text:
        if skip:
            skip = False
        elif quote:
            skip = c == "\\"
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                return False
    return depth == 0 and quote is None


def test_balance_random_texts(spark):
    rng = random.Random(2)
    values = ["".join(rng.choices("()'\"\\a\n", k=rng.randrange(14))) for _ in range(3000)] + ["(" * 9000 + ")" * 9000, "'" + "\\'" * 20000 + "'", "'" * 9999]
    df = texts(spark, values).withColumn("bare", without_strings(F.col("sql")))
    df = df.withColumn("parens", only_parentheses(F.col("bare")))
    got = column(df.withColumn("ok", balanced(F.col("bare"), F.col("parens"))), "ok")
    assert got == [scanned(v) for v in values]


def rewritten(text, rules):
    applied = []
    for rule in rules:
        flags = sum({"i": re.I, "m": re.M, "s": re.S}[f] for f in rule.flags)
        text, n = re.subn(rule.pattern, rule.replacement, text, flags=flags)
        if n:
            applied.append((rule.name, n))
    return text, applied


@pytest.mark.parametrize("source, target", PACKS)
def test_rules_like_python(spark, source, target):
    parts = [
        "CREATE TABLE `t` (id INT AUTO_INCREMENT)", " Engine = InnoDB", " DEFAULT CHARSET=utf8", " collate=utf8_bin", "now ( )", "Curdate()",
        "IFNULL(a,", "substring (a", "ceil(x)", " a != b", " limit  10", "START\nTRANSACTION", "create algorithm=merge view", "definer=`r`@`h` x",
        "sql security definer v", ";;;", "\nDELIMITER $$\n", "create or\treplace function f", "CREATE SECURE procedure", "fetch first 5 rows only",
        "current_timestamp( )", "CURRENT_DATE()", "ceiling(1)", "<>", "dateadd(day, 3, col )", '"Name"', "\n language sql \n", "\nexecute as caller\n",
        "autoincrement", "lıMIT 5", "ſubstring(", "xnow()", "énow()", "_limit 5", " ", "\n", "limit 7x", "create or replace procedure p",
    ]
    rng = random.Random(3)
    values = ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(400)]
    rules = builtin_rules(target) + pair_rules(source, target)
    out = statements.apply_rules(texts(spark, values), "sql", rules).orderBy("id").collect()
    for value, row in zip(values, out):
        assert (row["sql"], [tuple(a) for a in row["applied_rules"]]) == rewritten(value, rules), value


def test_every_pack_word_is_needed():
    """A rule's word is in everything its pattern matches."""
    for rule in [r for pair in PACKS for r in builtin_rules(pair[1]) + pair_rules(*pair)]:
        plain = re.sub(r"\\[bs]\+?\*?|[()]", " ", rule.pattern.lower())
        assert rule.word in plain or rule.word == ";;", rule.name


def test_new_words_are_found(spark):
    """A word that only a replacement makes: inside it, over its ends, over nothing, from a captured group."""
    rules = [
        Rule("inside", "one", "xtwox", "", "one"), Rule("two", "two", "2", "", "two"),
        Rule("end", "three", "lim", "", "three"), Rule("limit", "limit", "3", "", "limit"),
        Rule("gone", "-+", "", "", "-"), Rule("four", "four", "4", "", "four"),
        Rule("group", r"<(\w)>", r"\1", "", "<"), Rule("five", "five", "5", "", "five"),
        Rule("plain", "six", "zzz", "", "six"), Rule("seven", "seven", "7", "", "seven"),
    ]
    values = ["one", "threeit", "fo--ur", "fi<v>e", "six seven", "seve6n", "one three it fo-ur", ""]
    out = statements.apply_rules(texts(spark, values), "sql", rules).orderBy("id").collect()
    assert [(r["sql"], [tuple(a) for a in r["applied_rules"]]) for r in out] == [rewritten(v, rules) for v in values]


def test_may_add_random():
    rng = random.Random(5)
    letters = lambda k: "".join(rng.choices("ab", k=k))
    for _ in range(4000):
        before, captured, after = letters(rng.randrange(3)), letters(rng.randrange(3)), letters(rng.randrange(3))
        parts, word = [letters(rng.randrange(3)) for _ in range(2)], letters(rng.randrange(1, 4))
        grouped = rng.random() < 0.5
        replacement = r"\1".join(parts) if grouped else parts[0]
        made = before + (captured.join(parts) if grouped else parts[0]) + after
        if word in made and not any(word in x for x in (before, captured, after)):
            assert statements.may_add(replacement, word)


def test_broken_rule_is_reported_and_skipped(spark):
    rules = [Rule("open", "(", "x"), Rule("inline", r"(?i)B+", "z"), Rule("swap", r"(\w)-(\w)", r"\2$\1")]
    row = statements.rewrite_text(texts(spark, ["aBb ( 1-2"]), "sql", "x", "y", rules).first()
    assert row["sql"] == "az ( 2$1"
    assert [tuple(a) for a in row["applied_rules"]] == [("inline", 1), ("swap", 1)]
    assert [(e["name"], e["pattern"]) for e in row["rule_errors"]] == [("open", "(")]


def test_quick_start_changes_no_match():
    rng = random.Random(4)
    for pattern in (r"\blimit\b", r"\bx*a", r"(?:;|\bend\b|$)", r"\bab?c"):
        for _ in range(300):
            text = "".join(rng.choices("limt endabcx;_é", k=12))
            assert [m.span() for m in re.finditer(pattern, text)] == [m.span() for m in re.finditer(quick_start(pattern), text)]


def checked(spark, sql, target="snowflake", kind=""):
    return statements.check_text(texts(spark, [sql]), "sql", target, kind).first()


def test_checks(spark):
    assert checked(spark, " \n")["errors"] == ["SQL output is empty."]
    assert checked(spark, None)["errors"] == ["SQL output is empty."]
    assert checked(spark, "SELECT 'it''s (' FROM t")["is_valid"]
    assert checked(spark, "SELECT a")["warnings"] and not checked(spark, "SELECT 'a' AS x")["warnings"]
    assert not checked(spark, "SELECT a", kind="trigger")["warnings"]
    assert checked(spark, "SELECT a\nFROM\nt")["warnings"]  # the word must stand between blanks
    assert len(checked(spark, "create table `t` (a int auto_increment) engine = x")["errors"]) == 3
    assert checked(spark, "a \\\n b")["refused_for"].startswith("Target SQL validator found line")
    assert "on update current_timestamp" in checked(spark, "CREATE TABLE t (a ts ON UPDATE CURRENT_TIMESTAMP)", kind="table")["refused_for"]


def test_suggestions(spark):
    out = statements.suggestions(statements.check_text(texts(spark, ["a auto_increment \\n ("]), "sql", "snowflake"), ["id"], "mysql", "snowflake")
    assert [r["name"] for r in out.orderBy("message_no").collect()] == [
        "manual_review_required", "normalize_escaped_sql_formatting", "snowflake_auto_increment_keyword",
    ]


FIELDS = "source string, target string, source_database string, source_schema string, target_database string, target_schema string, object_type string, object_name string"


def test_reuse(spark):
    base = ("MySQL", "Snowflake", "a", "b", "c", "d", "table")
    history = spark.createDataFrame(
        [
            (1, "SUCCESS", "select  1", "one", *base, "x"), (2, "success", "select 1 ", "two", *base, "y"),
            (3, "error", "select 1", "bad", *base, "y"), (4, "success", "select 1", "four", *base, "z"),
            (5, "success", "select 2", "five", *base[:3], " ", *base[4:], "x"), (6, "success", "select 1", "six", *base, "X "),
        ],
        f"seq int, status string, input_sql string, output_sql string, {FIELDS}",
    )
    low = tuple(b.upper() for b in base)
    requests = spark.createDataFrame(
        [(1, "select\t1", *low, "x"), (2, "select 1", *low, "y"), (3, "select 1", *low, "Z"), (4, "select 2", *base[:3], " ", *base[4:], "x"), (5, "select 3", *low, "x")],
        f"id int, input_sql string, {FIELDS}",
    )
    got = {r["id"]: (r["hit"], r["output_sql"]) for r in statements.transform_reuse(requests, history).collect()}
    # y was last written as an error, so the oldest fingerprint that succeeded is used: x, whose last write is six.
    assert got == {1: ("same_object", "six"), 2: ("same_text", "six"), 3: ("same_object", "four"), 4: ("none", None), 5: ("none", None)}


def test_digest_is_computed_once(spark):
    history = spark.createDataFrame([], f"seq int, status string, input_sql string, output_sql string, {FIELDS}")
    plan = statements.transform_reuse(history.drop("output_sql"), history)._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(sha2" not in plan


@pytest.mark.parametrize("name", ["latest_transforms", "transform_reuse"])
def test_texts_are_not_aggregated(spark, monkeypatch, name):
    from tablehaul.workload import texts as workload

    monkeypatch.setattr(statements, "_once", lambda df, label: df)  # to see the whole plan
    df = getattr(workload, name)(spark, "/root/testdata/sf0.001")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "SortAggregate" not in text
