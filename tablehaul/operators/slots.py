"""Time-slot operators over a timestamp column (UTC ``timestamp_ntz``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablehaul.functions.cron import cron_match, next_slot, slot_of
from tablehaul.functions.names import quoted


def cron_events(df: DataFrame, ts: str, expression: str, zone: str = "UTC") -> DataFrame:
    """Rows whose minute the schedule fires in."""
    return df.filter(cron_match(F.col(quoted(ts)), expression, zone))


def with_next_slot(df: DataFrame, ts: str, expression: str, zone: str = "UTC") -> DataFrame:
    return df.withColumn("next_slot", next_slot(F.col(quoted(ts)), expression, zone))


def cron_slots(df: DataFrame, ts: str, expression: str, zone: str = "UTC", by: list[str] = ()) -> DataFrame:
    """One row per fired slot (and ``by`` columns), however many rows fall in it."""
    time = F.col(quoted(ts))
    hits = cron_events(df, ts, expression, zone)
    return hits.groupBy(*by, slot_of(time, zone).alias("slot")).agg(
        F.min(time).alias("first_at"), F.count("*").alias("hits")
    )
