"""A key with a third of all rows does not end in one task."""

import pytest
from pyspark.sql import functions as F

from tablehaul.operators import merge
from tablehaul.plans.work_list import dependency_blocks

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def tight(spark):
    """Thresholds small enough for a test table; joins are not broadcast."""
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def hot(spark, n=60000):
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id"))
    return spark.range(0, n, 1, 16).select(key.alias("k"), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("v"))


def test_hot_run_is_split(tight):
    rows = hot(tight).select(
        F.concat(F.lit("r"), F.col("k").cast("string")).alias("run_id"), F.col("n").alias("seq"),
        F.when(F.col("n") % 2 == 0, "table").otherwise("view").alias("object_type"), F.col("v").alias("object_name"),
        F.when(F.col("n") % 7 == 0, "error").otherwise("success").alias("status"),
    )
    blocked = dependency_blocks(rows)
    assert "skew=true" in final_plan(blocked)
    assert blocked.count() == 60000


def test_hot_key_of_the_target_is_split(tight):
    source = tight.range(0, 3000, 1, 4).select((F.col("id") * 3 + 1).alias("k"), F.col("id").alias("n"), F.lit("new").alias("v"))
    merged = merge.upsert(hot(tight), source, ["k"])
    assert "skew=true" in final_plan(merged)
    partly = merge.upsert(hot(tight), source.drop("v"), ["k"])
    assert "skew=true" in final_plan(partly)
    assert merged.count() == partly.count() == 60000


def test_hot_key_of_the_source_is_cut_first(tight):
    plan = final_plan(merge.upsert(tight.createDataFrame([], hot(tight).schema), hot(tight), ["k"], ["n"]))
    assert "WindowGroupLimit" in plan
