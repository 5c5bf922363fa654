"""The relational read templates and validated appends of a campus schema.

Each template is a function of DataFrames and parameters; a parameter of None
drops its predicate, so the plan holds only what was asked for. Dates and times
are text (YYYY-MM-DD, HH:MM), which sorts as they do.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.dates import WEEKDAYS


def where_given(df: DataFrame, *pairs: tuple[object, Column]) -> DataFrame:
    """Filter by the conditions whose parameter is given."""
    for given, condition in pairs:
        if given is not None:
            df = df.where(condition)
    return df


def overlaps(start: Column, end: Column, from_: str, to: str) -> Column:
    """Whether half-open spans meet."""
    return (start < to) & (F.lit(from_) < end)


def weekday_of(day: dt.date) -> str:
    return WEEKDAYS[day.weekday()]


def enrolled_courses(enrollments: DataFrame, account: str) -> DataFrame:
    return enrollments.where(F.col("account_id") == account).select("course_code").orderBy("course_code")


def course_codes(courses: DataFrame) -> DataFrame:
    return courses.select("code", "title").orderBy("code")


def timetable(sessions: DataFrame, enrollments: DataFrame, courses: DataFrame, account: str, course: str | None = None, weekday: str | None = None) -> DataFrame:
    own = enrollments.where(F.col("account_id") == account).select("course_code")
    rows = where_given(sessions, (course, F.col("course_code") == course), (weekday, F.col("weekday") == weekday)).join(own, "course_code")
    rows = rows.join(courses.select(F.col("code").alias("course_code"), "title"), "course_code")
    rank = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.col("weekday"))
    return rows.orderBy(F.when(rank > 0, rank).otherwise(7), "start").select("course_code", "title", "weekday", "start", "end", "room_id", "kind")


def deadlines(assignments: DataFrame, enrollments: DataFrame, account: str, now: dt.datetime, course: str | None = None, within_days: int | None = None) -> DataFrame:
    """Due from now on, to the minute; both ends count."""
    stamp = "%Y-%m-%d %H:%M"
    until = None if within_days is None else (now + dt.timedelta(days=within_days)).strftime(stamp)
    own = enrollments.where(F.col("account_id") == account).select("course_code")
    rows = where_given(assignments.where(F.col("due_at") >= now.strftime(stamp)), (until, F.col("due_at") <= until), (course, F.col("course_code") == course))
    return rows.join(own, "course_code").select("course_code", "title", "due_at", "weight").orderBy("due_at")


def free_rooms(
    rooms: DataFrame, sessions: DataFrame, bookings: DataFrame, date: dt.date, start: str, end: str,
    min_capacity: int | None = None, projector: bool | None = None, pcs: bool | None = None,
) -> DataFrame:
    """Rooms that neither a weekly session nor a confirmed booking of that date takes. A feature of False means don't care."""
    fit = where_given(rooms, (min_capacity, F.col("capacity") >= min_capacity), (projector or None, F.col("has_projector") == 1), (pcs or None, F.col("has_pcs") == 1))
    time = overlaps(F.col("start"), F.col("end"), start, end)
    lessons = sessions.where((F.col("weekday") == weekday_of(date)) & time).select(F.col("room_id").alias("id"))
    booked = bookings.where((F.col("date") == date.isoformat()) & (F.col("status") == "confirmed") & time).select(F.col("room_id").alias("id"))
    left = fit.join(lessons, "id", "left_anti").join(booked, "id", "left_anti")
    return left.select(F.col("id").alias("room_id"), "building", "capacity", "has_projector", "has_pcs").orderBy("capacity", "room_id")


def room_clashes(sessions: DataFrame, bookings: DataFrame, room: str, date: dt.date, start: str, end: str) -> DataFrame:
    time = (F.col("room_id") == room) & overlaps(F.col("start"), F.col("end"), start, end)
    lessons = sessions.where(time & (F.col("weekday") == weekday_of(date))).select(F.lit("session").alias("kind"), F.col("course_code").alias("what"), "start", "end")
    booked = bookings.where(time & (F.col("date") == date.isoformat()) & (F.col("status") == "confirmed"))
    return lessons.unionByName(booked.select(F.lit("booking").alias("kind"), F.col("purpose").alias("what"), "start", "end"))


def room_exists(rooms: DataFrame, room: str) -> bool:
    return not rooms.where(F.col("id") == room).isEmpty()


def check_book(books: DataFrame, loans: DataFrame, isbn: str | None = None, title: str | None = None, limit: int = 10) -> DataFrame:
    """Books with the copies that are not out; % and _ in a title are wildcards."""
    out = loans.where(F.col("returned") == 0).groupBy("isbn").agg(F.count("*").alias("out"))
    like = None if title is None else F.like(F.lower("title"), F.concat(F.lit("%"), F.lower(F.lit(title)), F.lit("%")))
    rows = where_given(books, (isbn, F.col("isbn") == isbn), (title, like)).join(out, "isbn", "left")
    return rows.select("isbn", "title", "authors", "year", "copies_total", (F.col("copies_total") - F.coalesce("out", F.lit(0))).alias("available")).orderBy("title", "isbn").limit(limit)


def open_loans(loans: DataFrame, books: DataFrame, account: str) -> DataFrame:
    own = loans.where((F.col("account_id") == account) & (F.col("returned") == 0))
    return own.join(books.select("isbn", "title"), "isbn").select("isbn", "title", "due_date").orderBy("due_date")


def holds_of(holds: DataFrame, account: str) -> DataFrame:
    return holds.where(F.col("account_id") == account).select("id", "isbn", "created_at", "status").orderBy("created_at")


def calendar(events: DataFrame, from_: dt.date, to: dt.date, kind: str | None = None) -> DataFrame:
    """Events of some days, both ends included; ends in the wrong order are swapped."""
    lo, hi = sorted((from_.isoformat(), to.isoformat()))
    rows = where_given(events.where(F.col("date").between(lo, hi)), (kind, F.col("kind") == kind))
    return rows.select("id", "title", "date", "start", "end", "location", "kind", "source").orderBy(F.asc_nulls_first("date"), F.asc_nulls_first("start"))


def bookings_of(bookings: DataFrame, account: str) -> DataFrame:
    return bookings.where(F.col("account_id") == account).select("id", "room_id", "date", "start", "end", "purpose", "status").orderBy("date", "start")


def append_row(table: DataFrame, **values: object) -> DataFrame:
    """The table and one more row, with the next id. For a single writer."""
    spark, schema = table.sparkSession, table.schema
    number = (table.agg(F.max("id")).first()[0] or 0) + 1
    return table.unionByName(spark.createDataFrame([tuple({**values, "id": number}.get(f.name) for f in schema)], schema))


def booking_problems(rooms: DataFrame, sessions: DataFrame, bookings: DataFrame, account: str, room: str, date: dt.date, start: str, end: str, today: dt.date) -> list[str]:
    """All that stands against a booking: an unknown room, length, how far ahead, a clash, three active bookings."""
    minutes = (int(end[:2]) - int(start[:2])) * 60 + int(end[3:]) - int(start[3:])
    active = (F.col("account_id") == account) & (F.col("status") == "confirmed") & (F.col("date") >= today.isoformat())
    checks = (
        (not room_exists(rooms, room), f"room {room} is unknown"),
        (not 1 <= minutes <= 120, f"a booking takes 1 to 120 minutes, not {minutes}"),
        (not 0 <= (date - today).days <= 7, "a booking is for the next 7 days"),
        (not room_clashes(sessions, bookings, room, date, start, end).isEmpty(), f"room {room} is taken at that time"),
        (bookings.where(active).count() >= 3, "three bookings are active already"),
    )
    return [problem for found, problem in checks if found]


def hold_problems(books: DataFrame, loans: DataFrame, holds: DataFrame, account: str, isbn: str) -> list[str]:
    found = check_book(books, loans, isbn=isbn).first()
    active = holds.where((F.col("account_id") == account) & (F.col("status") == "active")).count()
    checks = (
        (found is None, f"book {isbn} isn't in the catalogue"),
        (found is not None and found.available > 0, "a copy is available"),
        (active >= 3, "three holds are active already"),
    )
    return [problem for bad, problem in checks if bad]


def violations(table: DataFrame, **allowed: list[object]) -> DataFrame:
    """Rows whose columns hold something else than what is allowed; empty for a sound table."""
    bad = F.lit(False)
    for column, values in allowed.items():
        bad = bad | ~F.coalesce(F.col(column).isin(values), F.lit(False))
    return table.where(bad)


def orphans(table: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference finds no parent."""
    return table.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")
