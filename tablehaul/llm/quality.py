"""Quality rules as a ledger of failure bits and measurements."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablehaul.llm.columns import let, whole, words

SYMBOLS = r"[#*$%&|<>]+"

#: Rules in the order of their bits; a new rule goes to the end and a changed one gets a new name.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "repeated_lines": "100 * n_dup_lines > 70 * n_lines",
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a row fails when one of them does."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(bit(r) for r in self.rules)


#: What the contract's base check asks, and the same with the other rules.
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
DEFAULT = Policy("default", 1, tuple(RULES))


PLACE_BITS = 28


def _windows(all_words: Column) -> Column:
    """A number for each three-word window: 36 bits of its hash, then its place."""

    def windows(w: Column) -> Column:
        high = lambda i: F.shiftleft(F.shiftright(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), PLACE_BITS), PLACE_BITS)
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: high(i).bitwiseOR(i.cast("long")))

    empty = F.array().cast("array<bigint>")
    return F.when(F.size(all_words) > 3, let(all_words, windows)).otherwise(empty)


def _repeat_words(all_words: Column, sorted_windows: Column) -> Column:
    """Words in three-word windows that the text has twice or more.

    Windows whose hash has an equal neighbour are compared by their words, which
    decides. Overlapping windows count their words once. Linear but for the sort
    of numbers, at any length.
    """

    def alike(s: Column) -> Column:
        key = lambda x: F.shiftright(x, PLACE_BITS)
        near = F.filter(s, lambda x, j: F.coalesce(key(x) == key(F.get(s, j + 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(s, j - 1)), F.lit(False)))
        return F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))

    def texts(w: Column, places: Column) -> Column:
        return F.sort_array(
            F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i")))
        )

    def repeated(s: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            return F.coalesce(x["t"] == F.get(s, j + 1)["t"], F.lit(False)) | F.coalesce(x["t"] == F.get(s, j - 1)["t"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def counted(places: Column) -> Column:
        some = let(all_words, lambda w: let(let(texts(w, places), repeated), covered))
        return F.when(F.size(places) > 0, some).otherwise(F.lit(0))

    return let(let(sorted_windows, alike), counted).cast("long")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the struct ``quality``: the measurements and ``bits``, the rules that fail.

    Each rule is evaluated once, whatever policies are asked about later. A null
    or empty text has no words and fails ``few_words``. Everything happens inside the row.
    """
    held = df.withColumn("_words", words(whole(text))).withColumn("_windows", F.sort_array(_windows(F.col("_words"))))
    lines = F.filter(F.split(whole(text), "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    n_lines = F.size(lines)
    counts = held.withColumn(
        "quality",
        F.struct(
            F.size("_words").cast("long").alias("n_words"),
            F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            (F.length(whole(text)) - F.length(F.regexp_replace(whole(text), SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            n_lines.cast("long").alias("n_lines"),
            _repeat_words(F.col("_words"), F.col("_windows")).alias("n_repeat_words"),
        ),
    ).drop("_words", "_windows")
    fails = [F.when(_rule(sql), F.lit(1 << i)).otherwise(F.lit(0)) for i, sql in enumerate(RULES.values())]
    bits = fails[0]
    for f in fails[1:]:
        bits = bits.bitwiseOR(f)
    return counts.withColumn("quality", F.col("quality").withField("bits", bits))


def _rule(sql: str) -> Column:
    import re

    return F.expr(re.sub(r"\b([a-z]+_[a-z_]+)\b", r"quality.\1", sql))


def passes(policy: Policy, bits: Column | str = "quality.bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy.mask)) == 0


def ablations(ledger: DataFrame, policies: Sequence[Policy], bits: str = "quality.bits") -> DataFrame:
    """Per policy and rule: rows that fail the rule, rows that fail it alone, rows the policy rejects.

    Rows are first counted by their bits (at most 2^rules rows after the partial
    aggregation), so any number of policies costs one pass over the ledger. Every
    rule has a row, also where nothing fails and the ledger is empty.
    """
    spark = ledger.sparkSession
    by_bits = ledger.groupBy(F.col(bits).alias("bits")).agg(F.count("*").alias("n"))
    asked = [(p.name, p.version, p.mask, r, bit(r)) for p in policies for r in p.rules]
    table = spark.createDataFrame(asked, "policy string, version int, mask int, rule string, bit int")
    asks = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(table.columns, row)]) for row in asked])
    rows = by_bits.select("bits", "n", F.inline(asks))
    counted = rows.groupBy("policy", "version", "rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("mask")) == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("mask")) != 0, F.col("n")).otherwise(0)).alias("rejected"),
    )
    return table.select("policy", "version", "rule").join(counted, ["policy", "version", "rule"], "left").fillna(0)


def quality_rows(documents: DataFrame) -> DataFrame:
    """doc_id, the measurements, the base check, the bits and the default policy's verdict."""
    ledger = measure(documents.select("doc_id", "text"))
    return ledger.select(
        "doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words",
        (~passes(BASE)).alias("base_failed"), passes(DEFAULT).alias("kept"), "quality.n_lines", "quality.bits",
    )


def keep_good(df: DataFrame, text: str = "text", policy: Policy = DEFAULT) -> DataFrame:
    """The rows that pass the policy, with their own columns only."""
    packed = df.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return measure(packed).where(passes(policy)).select("row.*")
