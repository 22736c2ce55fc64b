"""Secrets by an incremental ledger of blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablehaul.llm.spans import SPAN, Kind, counted, listed, ordered, places
from tablehaul.operators.skew import join_per_key

ASSIGN_HEAD = r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?"

# The forms of secrets. ``version`` changes whenever a rule does.
RULES = (
    Kind("assign", ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+", valid=lambda m: F.length(F.regexp_replace(m, "^" + ASSIGN_HEAD, "")) >= 12, base=True),
    Kind("access", r"AKIA[A-Z0-9]+", valid=lambda m: F.length(m) >= 18, base=True, needs="AKIA"),
    Kind("hex", r"[0-9a-f]{16,}+", base=True),
    Kind("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", needs="-----BEGIN "),
    Kind("github", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+", needs="gh"),
    Kind("slack", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+", needs="xox"),
    Kind("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", needs="eyJ"),
    Kind("url_login", r"(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@", needs="://"),
)


def rule_ids(rules=RULES) -> list[str]:
    return [f"{r.name}@{r.version}" for r in rules]


def blobs_of(versions: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, blob, text) of every version; a blob's name is the sha-256 of its content, null counting as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(value, 256).alias("blob"), value.alias("text"))


def scan_unseen(named: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Ledger rows (blob, rules, findings) for the pairs of blob and rule version not yet in ``ledger``.

    Each content is scanned once, however many paths and versions hold it: copies
    meet in a partial aggregation, so a content that a third of the rows have costs
    each task one row. A blob whose rules were all scanned before is not scanned;
    one that only lacks some rules is scanned by these. A null path or repeated rows
    change nothing, an empty table gives no rows.
    """
    every = F.array(*[F.lit(r) for r in rule_ids(rules)])
    if ledger is None:
        todo = named.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", every)
    else:
        # names alone meet the ledger; only texts that are still to be scanned are moved
        seen = ledger.select("blob", F.explode("rules").alias("rule")).distinct().groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        asked = named.select("blob").distinct().join(seen, "blob", "left")
        asked = asked.select("blob", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
        todo = join_per_key(named.select("blob", "text"), asked, ["blob"], "inner").groupBy("blob", "todo").agg(F.first("text").alias("text"))

    def scanned(rank: int, rule: Kind) -> Column:
        return F.when(F.array_contains("todo", f"{rule.name}@{rule.version}"), places(F.col("text"), rule, rank)).otherwise(F.array().cast(SPAN))

    found = F.concat(*[scanned(rank, rule) for rank, rule in enumerate(rules)])
    return todo.select("blob", F.col("todo").alias("rules"), found.alias("findings"))


def append_scan(versions: DataFrame, ledger_path: str, path: str = "path", text: str = "text", rules=RULES) -> DataFrame:
    """Scan what the ledger at ``ledger_path`` has not seen, append it there and return the ledger.

    The first call makes the folder. A failed append leaves no rows behind (Spark
    commits the files of a job together), so the call can simply be repeated. Null texts
    count as empty ones; a second call with the same rows appends nothing.
    """
    spark = versions.sparkSession
    named = blobs_of(versions, path, text)
    folder = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    ledger = spark.read.parquet(ledger_path) if there else None
    scan_unseen(named, ledger, rules).write.mode("append").parquet(ledger_path)
    return spark.read.parquet(ledger_path)


def findings_by_path(versions: DataFrame, ledger: DataFrame, path: str = "path", text: str = "text", rules=RULES) -> DataFrame:
    """(path, blob, spans) for every version, by the current rule versions; text stays behind.

    Rows of older rule versions are passed over. A null path keeps its row; equal
    rows stay as many as they are; an empty text has no spans.
    """
    current = F.array(*[F.lit(r) for r in rule_ids(rules)])
    kinds = F.transform(F.array_intersect("rules", current), lambda r: F.substring_index(r, "@", 1))
    live = ledger.select("blob", kinds.alias("kinds"), "findings")
    live = live.select("blob", F.filter("findings", lambda s: F.array_contains("kinds", s["kind"])).alias("spans"))
    per_blob = live.groupBy("blob").agg(ordered(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return join_per_key(blobs_of(versions, path, text).drop("text"), per_blob, ["blob"])


def secrets_digest(documents: DataFrame, ledger_path: str) -> DataFrame:
    """doc_id, counts of the base kinds, their digest and all spans; a row for each row, null ids and texts included.

    The ledger is asked twice, as the next day's run would: the second call finds
    nothing unseen.
    """
    versions = documents.select("doc_id", "text")
    append_scan(versions, ledger_path, "doc_id")
    found = findings_by_path(versions, append_scan(versions, ledger_path, "doc_id"), "doc_id")
    base = [r.name for r in RULES if r.base]
    kept = found.select("path", "spans", F.filter("spans", lambda s: s["kind"].isin(base)).alias("base"))
    return kept.select(
        F.col("path").alias("doc_id"),
        *[counted(F.col("base"), k).alias(f"n_{k}") for k in base],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
