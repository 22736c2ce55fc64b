"""Connected components by alternating stars, on Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablehaul.operators.skew import join_per_key
from tablehaul.session import use_checkpoints


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u < v).

    Large: every larger neighbour of a node is linked to the node's least neighbour
    (itself included). Small: every node and its smaller neighbours are linked to
    the least of them. The least neighbour is a partial aggregation; a hub's many
    edges meet it in a join that splits hot keys.
    """
    if large:
        near = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = join_per_key(near, least, ["u"], "inner")
    if large:
        new = joined.where("v > u").select(F.col("m").alias("u"), "v")
    else:
        new = joined.where("v <> m").select(F.col("m").alias("u"), "v").unionAll(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return new.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every node of ``edges`` (u, v: bigint): ``c`` is the least node it is connected with.

    Alternates large and small stars until every edge leads to a node that is
    nobody's neighbour otherwise; both keep components as they are, and the number
    of rounds grows with the logarithm of their size. Each round is written by
    checkpoint(). Self-loops, repeated edges and either direction are allowed; an
    empty input gives no rows. Nothing is collected but one number a round.
    """
    use_checkpoints(edges.sparkSession)
    now = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct().checkpoint()
    while True:
        after = _stars(_stars(now, large=True), large=False).checkpoint()
        # done when all edges are stars: no center is itself a leaf, no leaf has two centers
        loose = after.groupBy("v").agg(F.count("*").alias("n"))
        centers = after.select(F.col("u").alias("v")).distinct()
        if loose.where("n > 1").isEmpty() and loose.join(centers, "v", "left_semi").isEmpty():
            return after.select("v", F.col("u").alias("c")).unionAll(centers.select("v", F.col("v").alias("c")))
        now = after
