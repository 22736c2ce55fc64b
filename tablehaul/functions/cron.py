"""Matching of timestamps with cron schedules."""

from __future__ import annotations

import re
from dataclasses import dataclass
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, functions as F

_PART = re.compile(r"(?:(?P<any>[*?])|(?P<low>\d+)(?:-(?P<high>\d+))?)(?:/(?P<step>\d+))?")
_ANY = ("*", "?")
HORIZON_DAYS = 31


@dataclass(frozen=True)
class Schedule:
    minutes: frozenset[int]
    hours: frozenset[int]
    days: frozenset[int]
    months: frozenset[int]
    weekdays: frozenset[int]
    any_day: bool
    any_weekday: bool


def field_values(text: str, least: int, most: int) -> frozenset[int]:
    """The numbers one cron field allows: lists, ranges and steps."""
    allowed: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        found = _PART.fullmatch(part)
        if not found:
            raise ValueError(f"not a cron field: {text!r}")
        start = least if found["any"] else int(found["low"])
        if found["high"]:
            stop = int(found["high"])
        else:
            stop = most if found["any"] or found["step"] else start
        allowed.update(range(max(least, start), min(most, stop) + 1, max(1, int(found["step"] or 1))))
    return frozenset(v for v in allowed if least <= v <= most)


def parse_schedule(expression: str) -> Schedule | None:
    """Five fields, or six of which the first is dropped; None for any other number."""
    fields = (expression or "").split()
    if len(fields) not in (5, 6):
        return None
    minute, hour, day, month, weekday = fields[-5:]
    return Schedule(
        minutes=field_values(minute, 0, 59),
        hours=field_values(hour, 0, 23),
        days=field_values(day, 1, 31),
        months=field_values(month, 1, 12),
        weekdays=field_values(weekday.replace("7", "0"), 0, 6),  # Sunday is 0 or 7
        any_day=day in _ANY,
        any_weekday=weekday in _ANY,
    )


def known_zone(name: str | None) -> str:
    """The zone, or UTC when there is no such zone."""
    try:
        return ZoneInfo(name or "UTC").key
    except (ValueError, OSError, ZoneInfoNotFoundError):  # no zone's name, no zone file, or no such zone
        return "UTC"


def local_time(ts: Column, zone: str | None) -> Column:
    """Wall-clock time in a zone of a UTC ``timestamp_ntz``; no session zone involved."""
    name = known_zone(zone)
    return ts if name == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(name), ts)


def _within(value: Column, allowed: frozenset[int], everything: int) -> Column:
    return F.lit(True) if len(allowed) == everything else value.isin(sorted(allowed)) if allowed else F.lit(False)


def _day_matches(day: Column, plan: Schedule) -> Column:
    """Month, and day of month or weekday: both must match unless both are set, then either."""
    of_month = _within(F.dayofmonth(day), plan.days, 31)
    of_week = _within(F.dayofweek(day) - 1, plan.weekdays, 7)
    if plan.any_day and plan.any_weekday:
        calendar = F.lit(True)
    elif plan.any_day:
        calendar = of_week
    elif plan.any_weekday:
        calendar = of_month
    else:
        calendar = of_month | of_week
    return _within(F.month(day), plan.months, 12) & calendar


def cron_match(ts: Column, expression: str, zone: str | None = "UTC") -> Column:
    """Whether the minute of a UTC ``timestamp_ntz`` is one the schedule fires in."""
    plan = parse_schedule(expression)
    if plan is None:
        return F.lit(False)
    local = local_time(ts, zone)
    clock = _within(F.minute(local), plan.minutes, 60) & _within(F.hour(local), plan.hours, 24)
    return clock & _day_matches(F.to_date(local), plan)


def slot_of(ts: Column, zone: str | None = "UTC") -> Column:
    """The local minute a time falls in, as text."""
    return F.replace(F.left(local_time(ts, zone).cast("string"), F.lit(16)), F.lit(" "), F.lit("T"))


def next_slot(ts: Column, expression: str, zone: str | None = "UTC") -> Column:
    """The first firing after the minute of ``ts`` within 31 days, as UTC ``timestamp_ntz``; else null.

    Nothing is probed minute by minute: within a day the answer is one lookup in
    a table of 1,440 minutes, and at most 31 days are looked at, inside the row.
    """
    plan = parse_schedule(expression)
    firing = sorted(60 * h + m for h in plan.hours for m in plan.minutes) if plan else []
    if not firing:
        return F.lit(None).cast("timestamp_ntz")
    local = local_time(ts, zone)
    today = F.to_date(local)
    minute = F.hour(local) * 60 + F.minute(local)
    following, upcoming = [], list(firing)
    for m in range(1440):
        while upcoming and upcoming[0] <= m:
            upcoming.pop(0)
        following.append(upcoming[0] if upcoming else None)
    # One literal after constant folding; an empty entry is null, element_at counts from 1.
    minutes = F.split(F.lit(",".join("" if v is None else str(v) for v in following)), ",")
    later_today = F.element_at(minutes, minute + 1).try_cast("int")
    # Stops at the first day that matches; compiled, unlike a filter over an array of days.
    days = F.coalesce(*[F.when(_day_matches(F.date_add(today, i), plan), F.lit(i)) for i in range(1, HORIZON_DAYS + 1)])

    def at(day: Column, minutes: Column) -> Column:
        return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)

    slot = F.when(_day_matches(today, plan) & later_today.isNotNull(), at(today, later_today)).otherwise(
        # On the last day of the horizon only the minutes up to that of ``ts`` are within it.
        F.when((days < HORIZON_DAYS) | (F.lit(firing[0]) <= minute), at(F.date_add(today, days), F.lit(firing[0])))
    )
    name = known_zone(zone)
    return slot if name == "UTC" else F.convert_timezone(F.lit(name), F.lit("UTC"), slot)
