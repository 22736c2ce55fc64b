"""Plain times are the same whatever the session's zone is."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablehaul.functions.cron import cron_match, next_slot, slot_of
from tablehaul.functions.records import duration_label
from tablehaul.operators.columns import encode_cells
from tablehaul.session import scratch_path
from tablehaul.sources.staged_csv import load_csv, stage_csv


@pytest.fixture
def new_york(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


def test_a_time_new_york_does_not_have(new_york):
    gap = dt.datetime(2024, 3, 10, 2, 30, 0, 120000)
    df = new_york.createDataFrame([(gap, gap + dt.timedelta(hours=1))], "a timestamp_ntz, b timestamp_ntz")
    assert encode_cells(df).first()[0] == "2024-03-10 02:30:00.120000"
    path = scratch_path(new_york, "test")
    stage_csv(df, path)
    assert load_csv(new_york, path, df.schema).collect() == df.collect()
    a = F.col("a")
    row = df.select(
        slot_of(a), cron_match(a, "30 2 10 3 *"), next_slot(a, "45 2 * * *"), duration_label(a, F.col("b")), slot_of(a, "Asia/Kolkata")
    ).first()
    assert tuple(row) == ("2024-03-10T02:30", True, dt.datetime(2024, 3, 10, 2, 45), "1h 0m 00s", "2024-03-10T08:00")
