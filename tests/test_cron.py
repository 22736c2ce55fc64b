import datetime as dt
from functools import lru_cache
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tablehaul.functions.cron import cron_match, field_values, next_slot, parse_schedule
from tablehaul.operators import slots

START = dt.datetime(2024, 2, 27, 22, 57, 31, 5)


def times(spark, moments):
    return spark.createDataFrame([(m,) for m in moments], "ts timestamp_ntz")


schedule = lru_cache(parse_schedule)


def fires(expression, local):
    """Minute by minute, by the definition."""
    plan = schedule(expression)
    if plan is None:
        return False
    weekday = local.isoweekday() % 7
    of_month, of_week = local.day in plan.days, weekday in plan.weekdays
    if plan.any_day or plan.any_weekday:
        day = (of_month or plan.any_day) and (of_week or plan.any_weekday)
    else:
        day = of_month or of_week
    return local.minute in plan.minutes and local.hour in plan.hours and local.month in plan.months and day


EXPRESSIONS = [
    "* * * * *", "*/15 * * * *", "0 2 1 * 1", "0 0 0 * * 7", "5,35 8-18/3 * * 1-5", "0 12 29 2 ?", "59 23 31 12 *",
    "7/20 ? 10-12 * *", "* * * *", "0 0 * * 5-7", "30 4 31 * *",
]


@pytest.mark.parametrize("expression", EXPRESSIONS)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "no/zone"])
def test_match(spark, expression, zone):
    moments = [START + dt.timedelta(minutes=37 * i) for i in range(1500)]
    where = ZoneInfo("UTC" if zone == "no/zone" else zone)
    want = [fires(expression, m.replace(tzinfo=dt.UTC).astimezone(where)) for m in moments]
    got = times(spark, moments).select("ts", cron_match(F.col("ts"), expression, zone).alias("m")).collect()
    assert {r["ts"]: r["m"] for r in got} == dict(zip(moments, want))


@pytest.mark.parametrize("expression", EXPRESSIONS)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_next(spark, expression, zone):
    # Around the change to summer time as well.
    moments = [START + dt.timedelta(minutes=i) for i in (0, 3, 61, 1440, 3000, 11 * 1440, 11 * 1440 + 500, 12 * 1440 + 250, 40 * 1440)]
    got = {r["ts"]: r["s"] for r in times(spark, moments).select("ts", next_slot(F.col("ts"), expression, zone).alias("s")).collect()}
    for m in moments:
        probe = m.replace(second=0, microsecond=0, tzinfo=dt.UTC).astimezone(ZoneInfo(zone))
        want = None
        for _ in range(60 * 24 * 31):
            probe += dt.timedelta(minutes=1)
            if fires(expression, probe):
                want = probe.astimezone(dt.UTC).replace(tzinfo=None)
                break
        assert got[m] == want, (expression, zone, m)


def test_fields():
    assert field_values("1,5-7, 50/4", 0, 59) == {1, 5, 6, 7, 50, 54, 58}
    assert field_values("*/0", 0, 3) == {0, 1, 2, 3}
    assert field_values("70", 0, 59) == frozenset()
    assert field_values("5-0", 0, 6) == frozenset()
    with pytest.raises(ValueError):
        field_values("a-b", 0, 59)


def test_one_firing_per_slot(spark):
    moments = [dt.datetime(2024, 1, 1, 0, 0, s) for s in (1, 2, 59)] + [dt.datetime(2024, 1, 1, 0, 1, 0)]
    found = slots.cron_slots(times(spark, moments), "ts", "* * * * *").orderBy("slot").collect()
    assert [(r["slot"], r["hits"]) for r in found] == [("2024-01-01T00:00", 3), ("2024-01-01T00:01", 1)]
