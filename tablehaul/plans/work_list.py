"""The work list of a bulk run, and what a failure blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablehaul.functions.names import engine_name, quoted
from tablehaul.functions.records import OBJECT_TYPES
from tablehaul.operators.skew import join_per_key
from tablehaul.plans.rules import BLOCKERS, type_rank, unsupported_reason

# Sort by these to get the order the objects are moved in.
PLAN_ORDER = ["type_rank", "object_type", "object_name"]
SUCCEEDED_BEFORE = "Skipped because this object already succeeded in the previous run."


def _spot() -> Column:
    return F.struct(*[F.col(c) for c in PLAN_ORDER])


def work_list(
    objects: DataFrame,
    source_engine: str,
    target_engine: str,
    types: list[str] | None = None,
    selection: DataFrame | None = None,
    previous: DataFrame | None = None,
    resume: DataFrame | None = None,
    scope: list[str] = (),
) -> DataFrame:
    """Catalog objects with ``type_rank``, ``action`` and ``reason``.

    ``scope`` names the columns (database, schema) that make a run of its own.
    ``selection`` (object_type, object_name) limits the types it mentions;
    ``previous`` (scope, object_type, object_name, status) holds the last results;
    ``resume`` (scope, object_type, object_name) has one checkpoint per scope.
    Actions: not_reached (before the checkpoint, or the checkpoint is not there),
    skip_previous, skip_unsupported, run.

    The place in the order is compared as (rank, type, name), so no global row
    number, and with it no single task, is needed.
    """
    scope = list(scope)
    here = [*scope, "object_type", "object_name"]
    plan = objects if types is None else objects.filter(F.col("object_type").isin(list(types)))
    plan = plan.withColumn("type_rank", type_rank(F.col("object_type")))
    if selection is not None:
        # The list of types is as short as the vocabulary of types; a join on it would
        # send all objects of a type to one task.
        limited = selection.agg(F.collect_set("object_type")).scalar()
        chosen = selection.select("object_type", "object_name").distinct().withColumn("_chosen", F.lit(True))
        plan = join_per_key(plan, chosen, ["object_type", "object_name"])
        plan = plan.filter(F.col("_chosen") | ~F.array_contains(limited, F.col("object_type"))).drop("_chosen")
    reached = F.lit(True)
    if resume is not None:
        given = resume.select(*here).withColumn("type_rank", type_rank(F.col("object_type")))
        # The few checkpoints are the side that is sent around, not the catalog.
        there = plan.join(given.select(*here), here, "left_semi").select(*here).distinct()
        found = given.join(there.withColumn("_there", F.lit(True)), here, "left")
        marks = found.select(*scope, F.when(F.col("_there"), _spot()).alias("_from"))
        if scope:
            plan = join_per_key(plan, marks.withColumn("_given", F.lit(True)), scope)
            reached = F.col("_given").isNull() | F.coalesce(_spot() >= F.col("_from"), F.lit(False))
        else:
            mark = marks.select(F.struct("_from")).scalar()
            reached = mark.isNull() | F.coalesce(_spot() >= mark["_from"], F.lit(False))
    succeeded = F.lit(False)
    if previous is not None:
        done = previous.filter(F.col("status") == "success").select(*here).distinct().withColumn("_done", F.lit(True))
        plan = plan.join(done, here, "left")
        succeeded = F.col("_done").isNotNull()
    why = unsupported_reason(engine_name(F.lit(source_engine)), engine_name(F.lit(target_engine)), F.col("object_type"))
    action = (
        F.when(~reached, "not_reached").when(succeeded, "skip_previous").when(why.isNotNull(), "skip_unsupported").otherwise("run")
    )
    return plan.withColumn("action", action).select(
        *[F.col(quoted(c)) for c in objects.columns],
        "type_rank",
        "action",
        F.when(F.col("action") == "skip_previous", F.lit(SUCCEEDED_BEFORE))
        .when(F.col("action") == "skip_unsupported", why)
        .alias("reason"),
    )


def first_failures(results: DataFrame, run: str = "run_id", order: str = "seq") -> DataFrame:
    """Per run with errors: where each blocking type first failed, if it was not blocked itself by then.

    A type's earliest error counts only when it comes before every failure that
    blocks the type; whatever comes later would not have run.
    """
    blocking = [t for t in OBJECT_TYPES if any(t in b for b in BLOCKERS.values())]
    firsts = (
        results.filter((F.col("status") == "error") & F.col("object_type").isin(blocking))
        .groupBy(run)
        .agg(*[F.min(F.when(F.col("object_type") == t, F.col(order))).alias(f"_fail_{t}") for t in blocking])
    )
    for t in blocking:
        earlier = [F.coalesce(F.col(f"_fail_{b}") < F.col(f"_fail_{t}"), F.lit(False)) for b in BLOCKERS.get(t, [])]
        if earlier:
            firsts = firsts.withColumn(f"_fail_{t}", F.when(~reduce(Column.__or__, earlier), F.col(f"_fail_{t}")))
    return firsts


def dependency_blocks(results: DataFrame, run: str = "run_id", order: str = "seq") -> DataFrame:
    """Results with ``blocked_by``, the status and the reason after dependency blocks.

    One small row per run is joined to its objects, instead of a window that would
    hold a whole run in one task; a large run's objects are split over many.
    """
    joined = join_per_key(results, first_failures(results, run, order), [run])
    blocked = F.lit("")
    for kind, blockers in BLOCKERS.items():
        hits = [F.when(F.col(f"_fail_{b}") < F.col(order), F.lit(b)) for b in sorted(blockers)]
        blocked = F.when(F.col("object_type") == kind, F.concat_ws(", ", *hits)).otherwise(blocked)
    return joined.withColumn("blocked_by", blocked).select(
        *[F.col(quoted(c)) for c in results.columns if c != "status"],
        F.when(F.col("blocked_by") != "", F.lit("skipped")).otherwise(F.col("status")).alias("status"),
        "blocked_by",
        F.when(
            F.col("blocked_by") != "",
            F.concat(F.lit("Skipped because prerequisite object types failed earlier: "), F.col("blocked_by"), F.lit(".")),
        ).alias("reason"),
    )
