"""Upsert, skip-existing and key checks.

The key is the target's primary key. Null key parts never equal anything, so
such rows go round the joins in a branch of their own: the scan's IsNull filter
skips row groups without nulls, and null keys never pile up in one reducer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablehaul.functions.names import quoted
from tablehaul.operators.skew import join_per_key


def _need(keys: list[str]) -> None:
    if not keys:
        raise ValueError("upsert and skip-existing need key columns")


def _whole_key(keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(quoted(k)).isNotNull() for k in keys])


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(_whole_key(keys))


def unkeyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(~_whole_key(keys))


def one_per_key(df: DataFrame, keys: list[str], order_by: list[str] | None, last: bool = True) -> DataFrame:
    """The last (or first) row of each key.

    ``row_number() = 1`` lets Spark cut every key to one row before the shuffle,
    so a hot key costs each map task one row. Without ``order_by`` the keys must
    be unique; a repeated one fails the query.
    """
    if order_by:
        order = [F.col(quoted(c)).desc_nulls_last() if last else F.col(quoted(c)).asc_nulls_first() for c in order_by]
        rank = F.row_number().over(Window.partitionBy(*[F.col(quoted(k)) for k in keys]).orderBy(*order))
        return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    # The rows stay where they are; only their keys are shuffled, in a branch that
    # has no rows and fails the query when a key repeats.
    problem = F.raise_error(F.lit(f"key {keys} repeats in the source; give order_by")).cast("boolean")
    guard = _spread_counts(df, keys).filter(F.when(F.col("_n") > 1, problem).otherwise(F.lit(False))).drop("_n")
    return df.unionByName(guard, allowMissingColumns=True)


def _key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.count("*").alias("_n"))


def _spread_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of keys that should be unique, in as many tasks as a shuffle has.

    Keys in order shrink to a few bytes each on their way, so adaptive execution, which
    goes by those bytes, would put millions of them into one task's hash table. It
    leaves a number of partitions that is given as it is.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [F.col(quoted(k)) for k in keys]
    return _key_counts(df.select(*names).repartition(tasks, *names), keys)


def _inserts(tgt: DataFrame, src: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``src`` (unique keys) whose key the target lacks; reads only the target's key columns."""
    return src.join(keyed(tgt, keys).select(*[F.col(quoted(k)) for k in keys]).distinct(), keys, "left_anti")


def upsert(
    tgt: DataFrame,
    src: DataFrame,
    keys: list[str],
    order_by: list[str] | None = None,
    fill: list[str] = (),
    keep: list[str] = (),
) -> DataFrame:
    """The target after ``src`` is merged in by key.

    Matched rows take all source values; columns only the target has stay.
    ``fill`` columns keep the old value where the new one is null, ``keep``
    columns keep it always. Source rows with a null key part are inserted. If a key
    repeats in the target, each of its rows is updated, as by SQL's MERGE.
    ``order_by`` may name source columns the target lacks.
    """
    _need(keys)
    order_only = [c for c in order_by or [] if c not in tgt.columns]
    unknown = [c for c in src.columns if c not in tgt.columns and c not in order_only]
    if unknown or any(k not in src.columns for k in keys):
        raise ValueError(f"source must have the keys {keys} and only target columns; extra: {unknown}")
    given = keyed(src, keys)
    old = keyed(tgt, keys)
    if set(src.columns) - set(order_only) == set(tgt.columns) and not fill and not keep:
        # Every matched row is replaced outright, so the join only has to drop it. The
        # counted keys are those of the uniqueness check, so they are shuffled once.
        counted = _key_counts(given, keys) if order_by else _spread_counts(given, keys)
        hits = counted.filter("_n > 0").drop("_n")
        kept = join_per_key(old, hits, keys, "left_anti")
        new = one_per_key(given, keys, order_by).drop(*order_only)
        merged = kept.unionByName(new).unionByName(_for_repeated(new, old, keys))
        src = src.drop(*order_only)
    else:
        new = _fold(given, keys, order_by, fill, keep) if (fill or keep) and order_by else one_per_key(given, keys, order_by)
        new, src = new.drop(*order_only), src.drop(*order_only)
        plain = [c for c in src.columns if c not in keys]
        side = new.select(*[F.col(quoted(k)) for k in keys], F.struct(*[F.col(quoted(c)) for c in plain], F.lit(True).alias("_hit")).alias("_new"))
        hit = F.col("_new._hit").isNotNull()

        def value(name):
            if name in keys or name in keep or name not in plain:
                return F.col(quoted(name))
            fresh = F.col(f"_new.{quoted(name)}")
            if name in fill:
                fresh = F.coalesce(fresh, F.col(quoted(name)))
            return F.when(hit, fresh).otherwise(F.col(quoted(name))).alias(name)

        updated = join_per_key(old, side, keys).select(*[value(c) for c in tgt.columns])
        merged = updated.unionByName(_inserts(tgt, new, keys), allowMissingColumns=True)
    merged = merged.unionByName(unkeyed(tgt, keys)).unionByName(unkeyed(src, keys), allowMissingColumns=True)
    return merged.select(*[F.col(quoted(c)) for c in tgt.columns])


def _for_repeated(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows once more for each further target row of their key; only the target's keys are read."""
    more = _key_counts(old, keys).filter("_n > 1")
    again = new.join(more, keys).withColumn("_copy", F.explode(F.sequence(F.lit(2).cast("bigint"), "_n")))
    return again.select(*[F.col(quoted(c)) for c in new.columns])


def _fold(src: DataFrame, keys: list[str], order_by: list[str], fill: list[str], keep: list[str]) -> DataFrame:
    """Several source rows of a key as the one row their application in order amounts to."""
    order = F.struct(*[F.col(quoted(c)) for c in order_by])
    plain = [c for c in src.columns if c not in keys and c not in fill and c not in keep]
    aggs = [F.max_by(F.struct(*[F.col(quoted(c)) for c in plain]), order).alias("_plain")] if plain else []
    aggs += [F.max_by(F.col(quoted(c)), F.when(F.col(quoted(c)).isNotNull(), order)).alias(c) for c in fill]
    aggs += [F.min_by(F.col(quoted(c)), order).alias(c) for c in keep]
    folded = src.groupBy(*[F.col(quoted(k)) for k in keys]).agg(*aggs)
    return folded.select(*[F.col(f"_plain.{quoted(c)}").alias(c) if c in plain else F.col(quoted(c)) for c in src.columns])


def new_rows(tgt: DataFrame, src: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """What skip-existing appends: the first source row of each key the target lacks."""
    _need(keys)
    fresh = _inserts(tgt, one_per_key(keyed(src, keys), keys, order_by, last=False), keys)
    return fresh.select(*[F.col(quoted(c)) for c in src.columns]).unionByName(unkeyed(src, keys))


def skip_existing(tgt: DataFrame, src: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """The target plus :func:`new_rows`; existing rows are never changed."""
    return tgt.unionByName(new_rows(tgt, src, keys, order_by), allowMissingColumns=True)


def merge_counts(tgt: DataFrame, src: DataFrame, keys: list[str]) -> DataFrame:
    """One row: source rows sent, keys inserted, keys updated, rows not applied because a later one won."""
    _need(keys)
    per_key = _key_counts(keyed(src, keys), keys)
    known = keyed(tgt, keys).select(*[F.col(quoted(k)) for k in keys], F.lit(True).alias("_hit")).dropDuplicates(keys)
    counted = per_key.join(known, keys, "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("sent"),
        F.count_if(F.col("_hit").isNull()).alias("inserted"),
        F.count_if(F.col("_hit")).alias("updated"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("superseded"),
    )
    loose = unkeyed(src, keys).agg(F.count("*")).scalar()
    return counted.select(
        (F.col("sent") + loose).alias("sent"), (F.col("inserted") + loose).alias("inserted"), "updated", "superseded"
    )


def key_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return _key_counts(keyed(df, keys), keys).withColumnRenamed("_n", "row_count").filter("row_count > 1")


def key_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, rows with a null key part, distinct keys, keys that repeat, and whether ``keys`` is a key."""
    _need(keys)
    null_part = ~_whole_key(keys)
    groups = (
        df.groupBy(*[F.when(~null_part, F.col(quoted(k))).alias(f"_k{i}") for i, k in enumerate(keys)])
        .agg(F.count("*").alias("_n"))
        .withColumn("_null", F.col("_k0").isNull())
    )
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).alias("null_key_rows"),
        F.count_if(~F.col("_null")).alias("distinct_keys"),
        F.count_if(~F.col("_null") & (F.col("_n") > 1)).alias("repeated_keys"),
        (F.count_if(F.col("_null") | (F.col("_n") > 1)) == 0).alias("is_key"),
    )
