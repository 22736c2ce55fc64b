"""The most frequent rows of a table of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Count levels per doubling.
LEVELS = 16


def most_frequent(counts: DataFrame, size: int, n: str = "n", part: str | None = None) -> DataFrame:
    """The rows of the highest levels of ``n`` that have ``size`` rows at most in all; a level is taken whole or not at all.

    Levels are powers of 2^(1/16), so the driver sees a few hundred numbers, where
    sorting with a limit would send it ``size`` rows of every task. ``counts`` is
    read twice and should be a written table. If not even the highest level fits,
    there are no rows, or with ``part`` about half of ``size`` of that level, by a
    hash of this column.
    """
    level = F.floor(F.log2(n) * F.lit(LEVELS))
    total, least = 0, None
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["level"])
    for row in levels:
        total += row["rows"]
        if total > size:
            break
        least = row["level"]
    if least is None and levels and part is not None:
        top = levels[0]
        return counts.where((level == top["level"]) & (F.pmod(F.xxhash64(part), F.lit(2 * top["rows"])) < size))
    return counts.where(level >= least) if least is not None else counts.where(F.lit(False))
