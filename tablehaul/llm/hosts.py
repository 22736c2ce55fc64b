"""URL filter: fixed rules, then host reputation by empirical Bayes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablehaul.llm.columns import ascii_lower
from tablehaul.operators.skew import join_per_key
from tablehaul.session import scratch_path


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

#: Suffixes of more than one label below which anybody registers. Give a longer list as ``suffixes`` where it matters.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "co.in", "co.za",
    "com.ar", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw",
)

# Parameters of the method.
PRIOR_BAD, PRIOR_WEIGHT = 0.1, 2.0  # of all outcomes, before any
LEVEL_WEIGHT = 10.0  # pseudo-outcomes a host takes over from its domain, where the outcomes don't tell
STRANGERS = 1.0  # the same for a domain and its suffix: one bad domain must not block all others
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 200.0  # of what the outcomes tell
Z = 1.645  # of the one-sided 95 % bound
MOST_BAD = 0.25  # a host is blocked when even the lower bound of its bad share is above


def with_host(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both empty without ``://`` or for a null url."""
    value = F.coalesce(F.col(url), F.lit(""))
    found = value.contains("://")
    part = lambda group: F.regexp_extract(value, r"(?s)^.*?://([^/?#]*)([^?#]*)", group)
    return df.withColumns(
        {
            "host": F.when(found, ascii_lower(part(1))).otherwise(F.lit("")),
            "path": F.when(found, part(2)).otherwise(F.lit("")),
        }
    )


def rule_for(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule that fits as a struct (rule, verdict), null if none does; of equal length, block goes first."""
    order = sorted(rules, key=lambda r: (-len(str(r)), r.verdict != "block", str(r)))
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    return F.coalesce(*[F.when(fits(r), F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in order])


def levels(host: Column, suffixes: Sequence[str] = SUFFIXES) -> dict[str, Column]:
    """The suffix and the registered domain of a host without login and port.

    The suffix is the longest of ``suffixes`` that fits, else the last label; the
    domain has one label more. An address is its own domain, of suffix "#".
    """
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    last = lambda n: F.call_function("substring_index", bare, F.lit("."), n)
    labels = F.lit(1)
    for size in sorted({s.count(".") + 1 for s in suffixes} - {1}):
        labels = F.when(last(F.lit(-size)).isin([s for s in suffixes if s.count(".") + 1 == size]), F.lit(size)).otherwise(labels)
    address = bare.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$|^\[")
    return {
        "suffix": F.when(address, F.lit("#")).otherwise(last(-labels)),
        "domain": F.when(address, bare).otherwise(last(-labels - 1)),
    }


def level_weight(members: DataFrame, group: Sequence[str], fallback: float) -> float:
    """How many pseudo-outcomes members (n, bad) should take over from their ``group``, by the moments of their shares.

    In a beta-binomial model members of a group with share p vary around it: the sum
    of n (share - p)^2 has the mean p (1 - p) ((k - 1) + r (n - sum n^2 / n - (k - 1))), r being
    1 / (weight + 1). So r is what is left of the sums over all groups, and the weight
    follows, between ``LEAST_WEIGHT`` and ``MOST_WEIGHT``; ``fallback`` where no group has
    two members that could differ. The driver sees one row.
    """
    n, bad = F.col("n"), F.col("bad")
    groups = members.groupBy(*group).agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(bad).alias("bad"), F.sum(n * n).alias("squares"), F.sum(bad * bad / n).alias("shares")
    )
    share = F.col("bad") / F.col("n")
    spread = share * (F.lit(1.0) - share)
    found = groups.agg(
        F.sum(F.col("shares") - F.col("bad") * share).alias("a"), F.sum(spread * (F.col("k") - 1)).alias("b"), F.sum(spread * (F.col("n") - F.col("squares") / F.col("n"))).alias("c"),
    ).first()
    if found["a"] is None or found["c"] - found["b"] <= 1e-9:
        return fallback
    r = (found["a"] - found["b"]) / (found["c"] - found["b"])
    return min(max(1.0 / r - 1.0, LEAST_WEIGHT), MOST_WEIGHT) if r > 0 else MOST_WEIGHT


def _effective(weight: float) -> dict[str, Column]:
    """Outcomes of one member as outcomes of its group: alike as they are, n of them say as much as n / (1 + (n - 1) / (weight + 1))."""
    size = F.col("n") / (F.lit(1.0) + (F.col("n") - F.lit(1.0)) / F.lit(weight + 1.0))
    return {"n": size, "bad": F.col("bad") / F.col("n") * size}


def _passed_on(weight: float, above: Column) -> Column:
    """The weight of a prior whose mean is itself only known to the weight ``above``."""
    return F.lit(1.0) / (F.lit(1.0) / F.lit(weight) + F.lit(1.0) / above)


def reputations(hosts: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, n, bad, mean, lower) for every host of ``hosts`` (host), from labelled pages ``outcomes`` (host, bad 0/1).

    Outcomes are counted by host, which map-side partial sums shrink to one row per
    host and task, and then by domain and suffix over these rows. Each level is a
    beta prior for the one below, as heavy as the level's shares say
    (``level_weight``) and as it is known itself; the prior of suffixes has the mean of
    all outcomes. So a host nobody has labelled (n = 0) has the posterior of its domain,
    and one of an unknown domain that of its suffix, with wider bounds. ``lower`` is the normal lower bound of the
    posterior. Rows with a null host or label are no outcomes; without outcomes all
    hosts have the same prior.
    """
    spark = outcomes.sparkSession
    path = scratch_path(spark, "outcomes")
    counted = outcomes.where(F.col("host").isNotNull() & F.col("bad").isNotNull()).groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    counted.withColumns(levels(F.col("host"), suffixes)).write.parquet(path)
    by_host = spark.read.parquet(path)
    host_weight = level_weight(by_host, ["suffix", "domain"], LEVEL_WEIGHT)
    alike = by_host.withColumns(_effective(host_weight))
    by_domain = alike.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domain_weight = level_weight(by_domain, ["suffix"], STRANGERS)
    by_suffix = by_domain.withColumns(_effective(domain_weight)).groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix_weight = level_weight(by_suffix, [], PRIOR_WEIGHT)
    alike_suffixes = by_suffix.withColumns(_effective(suffix_weight))
    total = alike_suffixes.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")).first()
    all_bad = (total["bad"] + PRIOR_BAD * PRIOR_WEIGHT) / (total["n"] + PRIOR_WEIGHT)

    def posterior(n: Column, bad: Column, weight: Column, mean: Column) -> tuple[Column, Column]:
        n, bad = F.coalesce(n, F.lit(0.0)), F.coalesce(bad, F.lit(0.0))
        return (bad + weight * mean) / (n + weight), n + weight

    known = hosts.select("host").where(F.col("host").isNotNull()).distinct().withColumns(levels(F.col("host"), suffixes))
    named = lambda df, keys, letter: df.select(*keys, F.col("n").alias(f"{letter}_n"), F.col("bad").alias(f"{letter}_bad"))
    joined = join_per_key(known, named(by_suffix, ["suffix"], "s"), ["suffix"])
    joined = join_per_key(joined, named(by_domain, ["suffix", "domain"], "d"), ["suffix", "domain"])
    joined = join_per_key(joined, by_host.select("host", "n", "bad"), ["host"])
    col = F.col
    s_mean, s_sure = posterior(col("s_n"), col("s_bad"), F.lit(suffix_weight), F.lit(all_bad))
    steps = joined.withColumns({"s_mean": s_mean, "w_d": _passed_on(domain_weight, s_sure)})
    d_mean, d_sure = posterior(col("d_n"), col("d_bad"), col("w_d"), col("s_mean"))
    steps = steps.withColumns({"d_mean": d_mean, "w_h": _passed_on(host_weight, d_sure)})
    mean, sure = posterior(col("n"), col("bad"), col("w_h"), col("d_mean"))
    steps = steps.withColumns({"mean": mean, "sure": sure})
    lower = col("mean") - F.lit(Z) * F.sqrt(col("mean") * (F.lit(1.0) - col("mean")) / (col("sure") + F.lit(1.0)))
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("long").alias(c)
    return steps.select("host", number("n"), number("bad"), "mean", lower.alias("lower"))


def judge(
    pages: DataFrame, outcomes: DataFrame, keep: Sequence[str] = ("page_id",), url: str = "url", rules: Sequence[Rule] = RULES, suffixes: Sequence[str] = SUFFIXES
) -> DataFrame:
    """``keep``, host, path, rule, verdict and the host's number of outcomes for every page.

    Rules decide first. A page without one is blocked when its host's lower bound
    is above ``MOST_BAD``, labelled or not; pages without a host are allowed. Every
    input row gives one row, equal rows too; a url of any length is one row; an empty
    table gives none. Only the narrow columns are joined; a hot host's rows are split
    (``join_per_key``).
    """
    parts = with_host(pages.select(*[F.col(k).alias(f"_keep_{k}") for k in keep], F.col(url).alias("_url")), "_url")
    ruled = parts.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)).drop("_url")
    verdicts = reputations(ruled.where("host <> ''").select("host"), outcomes, suffixes).select("host", "lower", F.col("n").alias("n_labelled"))
    joined = join_per_key(ruled, verdicts, ["host"])
    method = F.when(F.col("lower") > F.lit(MOST_BAD), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        *[F.col(f"_keep_{k}").alias(k) for k in keep], "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), F.coalesce("n_labelled", F.lit(0)).alias("n_labelled"),
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled pages: the number in a page's path names the document whose label it has.

    Bad is a label of low quality or of toxic text. A document labelled twice counts twice.
    """
    number = F.regexp_extract("path", r"^/[^/]*/([0-9]{1,18})(?![0-9])", 1)
    keyed = with_host(pages.select("url")).select("host", F.when(number != "", number.cast("long")).alias("doc_id"))
    bad = F.greatest(F.lit(1) - F.col("quality"), F.col("toxic"))
    return keyed.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("host", "bad")
