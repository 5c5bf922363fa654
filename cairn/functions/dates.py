"""Dates and times as people write them. Today is always a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def weekday_name(day: Column) -> Column:
    return F.lower(F.date_format(day, "EEEE"))


def weekday_number(name: Column) -> Column:
    """0 for monday; null for what isn't a weekday."""
    at = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.lower(F.trim(name))) - 1
    return F.when(at >= 0, at.cast("int"))


def resolve_date(value: Column, today: Column) -> Column:
    """today (also for null), tomorrow, a weekday (its next day, today included) or an ISO date; null for anything else."""
    said = F.lower(F.trim(F.coalesce(value, F.lit("today"))))
    ahead = F.pmod(weekday_number(said) - F.weekday(today), F.lit(7))
    iso = F.when(F.rlike(said, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_timestamp(said, F.lit("yyyy-MM-dd")).cast("date"))
    return F.when(said == "today", today).when(said == "tomorrow", F.date_add(today, 1)).when(ahead.isNotNull(), F.date_add(today, ahead)).otherwise(iso)


def normalize_time(value: Column, default_pm: bool = False) -> Column:
    """H, H:MM, with am or pm, as HH:MM; null if it is no time. Bare hours of 1 to 6 can mean the afternoon."""
    pattern = r"(?i)^\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\s*$"
    hour = F.regexp_extract(value, pattern, 1).try_cast("int")
    minute = F.coalesce(F.regexp_extract(value, pattern, 2).try_cast("int"), F.lit(0))
    half = F.lower(F.regexp_extract(value, pattern, 3))
    h = F.when(half == "pm", F.when(hour < 12, hour + 12).otherwise(hour)).when(half == "am", F.when(hour == 12, 0).otherwise(hour))
    bare = F.when((hour >= 1) & (hour <= 6), hour + 12).otherwise(hour) if default_pm else hour
    h = F.when(half == "", bare).otherwise(h)
    return F.when((h <= 23) & (minute <= 59), F.concat_ws(":", F.lpad(h.cast("string"), 2, "0"), F.lpad(minute.cast("string"), 2, "0")))


def minutes_between(start: Column, end: Column) -> Column:
    def minutes(x: Column) -> Column:
        return F.split(x, ":")[0].try_cast("int") * 60 + F.split(x, ":")[1].try_cast("int")

    return minutes(end) - minutes(start)


def week_dates(today: Column) -> Column:
    """map<weekday, date> of the week of a day, from Monday on."""
    monday = F.date_trunc("week", today).cast("date")
    return F.map_from_arrays(F.array(*map(F.lit, WEEKDAYS)), F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.date_add(monday, k)))


def time_window(text: Column) -> Column:
    """struct<start, end> of 'from 2 to 4 pm' or 'at 3 pm' (one hour, to 24:00 at the latest); nulls if there is none."""
    span = r"(?i)(?<![\d\-/])\b(\d{1,2}(?::\d{2})?)\s*(am|pm)?\s*(?:-|\x{2013}|to|until)\s*(\d{1,2}(?::\d{2})?)\s*(am|pm)?\b(?![\-/]\d)"
    a, am, b, bm = (F.regexp_extract(text, span, k) for k in range(1, 5))
    both = F.when(b != "", F.struct(normalize_time(F.concat(a, F.when(am == "", bm).otherwise(am)), True).alias("start"), normalize_time(F.concat(b, bm), True).alias("end")))
    at = r"(?i)\b(?:at|around|from)\s+(\d{1,2}(?::\d{2})?)\s*(am|pm)?\b"
    one = normalize_time(F.concat(F.regexp_extract(text, at, 1), F.regexp_extract(text, at, 2)), True)
    hour_on = F.concat(F.lpad((F.substring(one, 1, 2).try_cast("int") + 1).cast("string"), 2, "0"), F.substring(one, 3, 3))
    return F.coalesce(both, F.struct(one.alias("start"), hour_on.alias("end")))
