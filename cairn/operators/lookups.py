"""Tool calls answered in one job: all calls of a tool are one plan over its tables, and calls that ask the same are answered once.

A call is a row (call_id, account, tool, args as a map of texts). Its answer is a
row (call_id, tool, ok, error, found, summary): how many rows there are, and what to say
about them. The account comes with the call, never from its arguments. Calls of
unknown tools and calls that lack an argument are answered with an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import arguments, dates
from cairn.functions.dates import WEEKDAYS

# Titles of concepts that go by another name, and the rate that is quoted beside the day's.
CONCEPT_TITLES = {
    "attention": "Attention (machine learning)", "self-attention": "Attention (machine learning)",
    "transformer": "Transformer (deep learning)", "transformers": "Transformer (deep learning)",
    "embedding": "Word embedding", "embeddings": "Word embedding", "rag": "Retrieval-augmented generation",
    "retrieval-augmented generation": "Retrieval-augmented generation", "llm": "Large language model",
    "large language model": "Large language model", "fine-tuning": "Fine-tuning (deep learning)",
    "lora": "Fine-tuning (deep learning)", "overfitting": "Overfitting", "gradient descent": "Gradient descent",
    "backpropagation": "Backpropagation", "tokenization": "Lexical analysis", "prompt injection": "Prompt injection",
}
FIXED_RATE = 4100.0


@dataclass(frozen=True)
class Tables:
    """What the tools read; a tool whose table is missing answers with an error."""

    enrollments: DataFrame | None = None  # account_id, course_code
    sessions: DataFrame | None = None  # course_code, weekday, start, end, room_id, kind
    rooms: DataFrame | None = None  # id, capacity, has_projector, has_pcs
    bookings: DataFrame | None = None  # room_id, date, start, end, status
    books: DataFrame | None = None  # isbn, title, copies_total
    loans: DataFrame | None = None  # isbn, account_id, due_date, returned
    assignments: DataFrame | None = None  # course_code, title, due_at, weight
    events: DataFrame | None = None  # title, date, start, end, location, kind
    forecast: DataFrame | None = None  # time, rain_probability, temperature_c
    concepts: DataFrame | None = None  # title, extract
    outside: DataFrame | None = None  # query, docs: what a catalogue outside gave for a query


def _arg(name: str) -> Column:
    return F.nullif(F.try_element_at("args", F.lit(name)), F.lit(""))


def _said(rows: DataFrame, text: Column, *order: Column, before: str = "", most: int | None = None) -> DataFrame:
    """call_id, found, said: a call's rows as one text, in order, the first ``most`` of them. Where only the count is read, no texts are gathered."""
    entries = F.sort_array(F.collect_list(F.struct(*(c.alias(f"k{n}") for n, c in enumerate(order)), text.alias("text"))))
    found, said = F.count("*").cast("int").alias("found"), _joined(entries, before).alias("said")
    if most is None:
        return rows.groupBy("call_id").agg(found, said)
    place = F.row_number().over(Window.partitionBy("call_id").orderBy(*order))
    shown = rows.withColumn("place", place).where(F.col("place") <= most).groupBy("call_id").agg(said)
    return rows.groupBy("call_id").agg(found).join(shown, "call_id")


def _joined(entries: Column, before: str) -> Column:
    return F.concat(F.lit(before), F.array_join(F.transform(entries, lambda x: x["text"]), "; "), F.lit("."))


def _answer(calls: DataFrame, said: DataFrame, nothing: Column | str, error: Column | None = None) -> DataFrame:
    """Every call with what was found for it, or what to say when nothing was; calls with an error found nothing."""
    nothing = nothing if isinstance(nothing, Column) else F.lit(nothing)
    bad = F.lit(None).cast("string") if error is None else error
    joined = calls.withColumn("error", bad).join(said, "call_id", "left")
    found = F.when(F.col("error").isNull(), F.coalesce("found", F.lit(0))).otherwise(0)
    summary = F.when(F.col("error").isNotNull(), F.col("error")).when(found > 0, F.col("said")).otherwise(nothing)
    return joined.select("call_id", "tool", F.col("error").isNull().alias("ok"), "error", found.alias("found"), summary.alias("summary"))


def get_timetable(calls: DataFrame, t: Tables, today: Column) -> DataFrame:
    asked = calls.withColumn("course", F.upper(_arg("course"))).withColumn("weekday_asked", F.when(_arg("day").isNotNull(), dates.weekday_name(dates.resolve_date(_arg("day"), today))))
    own = asked.join(t.enrollments, asked.account == t.enrollments.account_id)
    rows = own.join(t.sessions, "course_code").where((F.col("course").isNull() | (F.col("course") == F.col("course_code"))) & (F.col("weekday_asked").isNull() | (F.col("weekday_asked") == F.col("weekday"))))
    rank, day = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.col("weekday")), F.element_at(dates.week_dates(today), F.col("weekday"))
    text = F.concat("course_code", F.lit(" "), "kind", F.lit(": "), F.initcap("weekday"), F.lit(" "), day.cast("string"), F.lit(", "), "start", F.lit("–"), "end", F.lit(" in room "), "room_id")
    enrolled = own.groupBy("call_id").agg(F.array_sort(F.collect_set("course_code")).alias("enrolled"))
    said = _said(rows, text, rank, F.col("start"), F.col("course_code"), F.col("room_id"))
    others = F.coalesce("enrolled", F.array().cast("array<string>"))
    why = F.when(F.col("course").isNotNull() & ~F.array_contains(others, F.col("course")), F.concat("course", F.lit(" is not among the enrolled courses ("), F.array_join(others, ", "), F.lit(")"))).otherwise("no sessions match")
    return _answer(asked.join(enrolled, "call_id", "left"), said, F.concat(F.lit("No timetable entries: "), why, F.lit(".")))


def get_deadlines(calls: DataFrame, t: Tables, today: Column) -> DataFrame:
    """A course's deadlines within a span are listed once, and calls of all accounts take the lists of their courses."""
    asked = calls.withColumn("course", F.upper(_arg("course"))).withColumn("within", _arg("within_days").try_cast("int"))
    stamp = lambda d: F.date_format(d, "yyyy-MM-dd HH:mm")
    now = today.cast("timestamp")
    own = asked.join(t.enrollments, asked.account == t.enrollments.account_id).where(F.col("course").isNull() | (F.col("course") == F.col("course_code"))).select("call_id", "course_code", "within")
    until = stamp(now + F.make_dt_interval(days=F.col("within")))
    due = own.select("course_code", "within").distinct().join(t.assignments.where(F.col("due_at") >= stamp(now)), "course_code").where(F.col("within").isNull() | (F.col("due_at") <= until))
    text = F.concat("course_code", F.lit(" '"), "title", F.lit("' due "), "due_at", F.lit(" (weight "), F.round(F.col("weight") * 100).cast("int"), F.lit("%)"))
    listed = due.groupBy("course_code", "within").agg(F.count("*").alias("n"), F.collect_list(F.struct("due_at", "course_code", "title", text.alias("text"))).alias("entries"))
    both = own.alias("o").join(listed.alias("l"), (F.col("o.course_code") == F.col("l.course_code")) & F.col("o.within").eqNullSafe(F.col("l.within")))
    every = F.sort_array(F.flatten(F.collect_list("entries")))
    said = both.groupBy("call_id").agg(F.sum("n").cast("int").alias("found"), _joined(every, "Upcoming deadlines: ").alias("said"))
    return _answer(asked, said, "No upcoming deadlines match.")


def find_free_rooms(calls: DataFrame, t: Tables, today: Column) -> DataFrame:
    """Every room that fits and isn't taken in the call's window. Windows meet bookings once however many calls name them; a call meets each room, as its answer may list them all."""
    asked = calls.withColumn("day", dates.resolve_date(F.coalesce(_arg("date"), F.lit("today")), today)).withColumn("from", _arg("start")).withColumn("to", _arg("end"))
    bad = F.when(~F.coalesce(dates.minutes_between(F.col("from"), F.col("to")) > 0, F.lit(False)), F.lit("Invalid time window.")).when(F.col("day").isNull(), F.lit("Unknown date."))
    yes = lambda name: F.coalesce(F.lower(_arg(name)) == "true", F.lit(False))
    needs = {"least": F.coalesce(_arg("min_capacity").try_cast("int"), F.lit(0)), "projector": yes("needs_projector"), "pcs": yes("needs_pcs")}
    wanted = asked.where(bad.isNull()).select("call_id", "day", "from", "to", *(c.alias(n) for n, c in needs.items()))
    windows = wanted.select("day", "from", "to").distinct().withColumns({"weekday": dates.weekday_name(F.col("day")), "date": F.col("day").cast("string")})
    meets = (F.col("start") < F.col("to")) & (F.col("from") < F.col("end"))
    window = ("day", "from", "to")
    lessons = windows.join(t.sessions.select("weekday", "start", "end", "room_id"), "weekday").where(meets).select(*window, "room_id")
    booked = windows.join(t.bookings.where(F.col("status") == "confirmed").select("date", "start", "end", "room_id"), "date").where(meets).select(*window, "room_id")
    taken = lessons.unionByName(booked).distinct()
    rooms = t.rooms.select("capacity", F.col("id").alias("room_id"), "has_projector", "has_pcs")
    fits = (F.col("capacity") >= F.col("least")) & (~F.col("projector") | (F.col("has_projector") == 1)) & (~F.col("pcs") | (F.col("has_pcs") == 1))
    free = wanted.join(rooms, fits).join(taken, [*window, "room_id"], "left_anti")
    name = F.concat("room_id", F.lit(" ("), "capacity", F.lit(" seats"), F.when(F.col("has_projector") == 1, ", projector").otherwise(""), F.when(F.col("has_pcs") == 1, ", PCs").otherwise(""), F.lit(")"))
    entries = F.sort_array(F.collect_list(F.struct("capacity", "room_id", "has_projector", "has_pcs", name.alias("text"))))
    named = F.array_join(F.transform(entries, lambda r: r["text"]), ", ")
    shown = F.concat(F.col("day").cast("string"), F.lit(" ("), F.initcap(dates.weekday_name(F.col("day"))), F.lit("), "), "from", F.lit("–"), "to")
    said = free.groupBy("call_id", *window).agg(F.count("*").cast("int").alias("found"), named.alias("rooms"))
    said = said.select("call_id", "found", F.concat(F.lit("Free rooms for "), shown, F.lit(": "), "rooms", F.lit(".")).alias("said"))
    return _answer(asked, said, F.concat(F.lit("No free room matches for "), shown, F.lit(".")), bad)


def check_book(calls: DataFrame, t: Tables, today: Column) -> DataFrame:
    """By ISBN, or by a part of the title: titles meet by a run of three characters, shorter parts by all titles."""
    asked = calls.withColumn("isbn_asked", _arg("isbn")).withColumn("part", F.when(_arg("isbn").isNull(), F.lower(_arg("title"))))
    bad = F.when(F.col("isbn_asked").isNull() & F.col("part").isNull(), F.lit("No ISBN or title given."))
    out = t.loans.where(F.col("returned") == 0).groupBy("isbn").agg(F.count("*").alias("out"))
    books = t.books.join(out, "isbn", "left").select("isbn", "title", "copies_total", (F.col("copies_total") - F.coalesce("out", F.lit(0))).alias("available"))
    by_isbn = asked.join(books, asked.isbn_asked == books.isbn)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("title") - 2, F.lit(1))), lambda k: F.substr(F.lower("title"), k, F.lit(3))))
    titles = books.withColumn("run", F.explode(runs))
    by_run = asked.where(F.char_length("part") >= 3).withColumn("run", F.left("part", F.lit(3))).join(titles, "run").drop("run")
    short = asked.where(F.char_length("part") < 3).join(books, F.contains(F.lower("title"), F.col("part")))
    rows = by_isbn.unionByName(by_run.where(F.contains(F.lower("title"), F.col("part"))).select(by_isbn.columns)).unionByName(short.select(by_isbn.columns))
    status = F.when(F.col("available") > 0, "on the shelf").otherwise("all copies on loan")
    text = F.concat(F.lit("'"), "title", F.lit("' (ISBN "), "isbn", F.lit("): "), "available", F.lit(" of "), "copies_total", F.lit(" copies available, "), status)
    what = F.when(F.col("isbn_asked").isNotNull(), F.concat(F.lit("ISBN "), "isbn_asked")).otherwise(F.concat(F.lit("a title containing '"), _arg("title"), F.lit("'")))
    said = _said(rows, text, F.col("title"), F.col("isbn"), most=10)
    return _answer(asked, said, F.concat(F.lit("The library catalogue has no book with "), what, F.lit(".")), bad)


def get_loans(calls: DataFrame, t: Tables, today: Column) -> DataFrame:
    own = t.loans.where(F.col("returned") == 0).select(F.col("account_id").alias("account"), "isbn", "due_date").join(t.books.select("isbn", "title"), "isbn")
    text = F.concat(F.lit("'"), "title", F.lit("' due "), "due_date")
    said = _said(calls.join(own, "account"), text, F.col("due_date"), F.col("title"), F.col("isbn"), before="Active loans: ")
    return _answer(calls, said, "The signed-in account has no active loans.")


def get_calendar(calls: DataFrame, t: Tables, today: Column) -> DataFrame:
    """Days of the span are joined one by one, so a call meets only its own days' events."""
    a, b = (dates.resolve_date(F.coalesce(_arg(k), F.lit("today")), today) for k in ("from", "to"))
    asked = calls.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b)).withColumn("kind_asked", _arg("kind"))
    bad = F.when(a.isNull() | b.isNull(), F.lit("Unknown date."))
    days = asked.where(bad.isNull()).withColumn("day", F.explode(F.sequence("lo", "hi")))
    rows = days.join(t.events, days.day.cast("string") == t.events.date).where(F.col("kind_asked").isNull() | (F.col("kind_asked") == F.col("kind")))
    text = F.concat("date", F.lit(" "), "title", F.when(F.coalesce("start", F.lit("")) != "", F.concat(F.lit(" "), "start", F.lit("–"), F.coalesce("end", F.lit("")))).otherwise(""), F.when(F.coalesce("location", F.lit("")) != "", F.concat(F.lit(" at "), "location")).otherwise(""))
    said = _said(rows, text, F.col("date"), F.col("start"), F.col("title"), before="Calendar: ")
    return _answer(asked, said, F.concat(F.lit("No calendar entries between "), F.col("lo").cast("string"), F.lit(" and "), F.col("hi").cast("string"), F.lit(".")), bad)


def campus_weather(calls: DataFrame, t: Tables, today: Column) -> DataFrame:
    """The hours of a day's forecast, or those of a window if it has any."""
    asked = calls.withColumn("day", dates.resolve_date(F.coalesce(_arg("date"), F.lit("today")), today).cast("string"))
    begin = dates.normalize_time(_arg("hour"), True)
    asked = asked.withColumn("begin", begin).withColumn("until", F.coalesce(dates.normalize_time(_arg("until"), True), begin))
    hours = t.forecast.select(F.left("time", F.lit(10)).alias("day"), F.substring("time", 12, 5).alias("clock"), "rain_probability", "temperature_c")
    rows = asked.join(hours, "day")
    inside = F.col("begin").isNotNull() & (F.left("clock", F.lit(2)) >= F.left("begin", F.lit(2))) & (F.left("clock", F.lit(2)) <= F.left("until", F.lit(2)))
    rows = rows.withColumn("inside", inside).withColumn("any", F.max(F.col("inside").cast("int")).over(Window.partitionBy("call_id"))).where((F.col("any") == 0) | F.col("inside"))
    top = F.max_by("clock", F.struct(F.coalesce("rain_probability", F.lit(0)).alias("p"), (-F.substring("clock", 1, 2).cast("int")).alias("h")))
    said = rows.groupBy("call_id", "day", "begin", "until").agg(F.count("*").cast("int").alias("found"), F.max("rain_probability").alias("rain"), top.alias("hour"), F.min("temperature_c").alias("cold"), F.max("temperature_c").alias("warm"))
    window = F.when(F.col("begin").isNull(), "").otherwise(F.concat(F.lit(" "), "begin", F.when(F.col("until") != F.col("begin"), F.concat(F.lit("–"), "until")).otherwise("")))
    text = F.concat(F.lit("Forecast, "), "day", window, F.lit(": rain probability up to "), F.coalesce(F.col("rain").cast("string"), F.lit("unknown")), F.lit("% (around "), "hour", F.lit("), "), F.bround("cold").cast("int"), F.lit("–"), F.bround("warm").cast("int"), F.lit(" °C."))
    bad = F.when(F.col("day").isNull(), F.lit("Unknown date."))
    return _answer(asked, said.select("call_id", "found", text.alias("said")), F.concat(F.lit("No forecast is available for "), "day", F.lit(".")), bad)


def convert_currency(calls: DataFrame, t: Tables, today: Column, rate: float = FIXED_RATE) -> DataFrame:
    asked = calls.withColumn("amount", _arg("amount").try_cast("double")).withColumn("direction", _arg("direction"))
    bad = F.when(~F.coalesce(F.col("amount") > 0, F.lit(False)), F.lit("No amount to convert.")).when(~F.coalesce(F.col("direction").isin("usd_to_khr", "khr_to_usd"), F.lit(False)), F.lit("Unknown direction.")).when(F.lit(rate <= 0), F.lit("No rate available."))
    value = arguments.converted(F.col("amount"), F.lit(rate), F.col("direction"))
    to_khr = F.concat(F.format_number("amount", 2), F.lit(" USD = "), F.format_number(value, 0), F.lit(" KHR"))
    to_usd = F.concat(F.format_number("amount", 0), F.lit(" KHR = "), F.format_number(value, 2), F.lit(" USD"))
    said = asked.where(bad.isNull()).select("call_id", F.lit(1).alias("found"), F.concat(F.when(F.col("direction") == "usd_to_khr", to_khr).otherwise(to_usd), F.lit(" at "), F.format_number(F.lit(rate), 2), F.lit(" KHR per USD.")).alias("said"))
    return _answer(asked, said, "", bad)


def concept_title(topic: Column) -> Column:
    """A topic's title: its known name, else itself with a capital."""
    plain = F.trim(F.regexp_replace(F.trim(topic), "^['\"]+|['\"]+$", ""))
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in CONCEPT_TITLES.items() for x in pair)), F.lower(plain))
    return F.coalesce(known, F.concat(F.upper(F.left(plain, F.lit(1))), F.lower(F.substr(plain, F.lit(2)))))


def concept_summary(calls: DataFrame, t: Tables, today: Column) -> DataFrame:
    """The beginning of a concept's extract, as text from outside."""
    asked = calls.withColumn("title", concept_title(_arg("topic")))
    bad = F.when(~F.coalesce(F.char_length(_arg("topic")) >= 2, F.lit(False)), F.lit("No topic given."))
    extract = F.trim(F.regexp_replace("extract", r"\s+", " "))
    rows = asked.join(t.concepts.select("title", extract.alias("extract")).where("extract <> ''").dropDuplicates(["title"]), "title")
    said = rows.select("call_id", F.lit(1).alias("found"), F.concat(F.lit("External source ('"), "title", F.lit("'): "), F.left("extract", F.lit(600))).alias("said"))
    return _answer(asked, said, F.concat(F.lit("There is no summary for '"), "title", F.lit("'.")), bad)


def search_books(calls: DataFrame, t: Tables, today: Column) -> DataFrame:
    """The first five works that a catalogue outside lists for a query (query, docs as array of title, author_name, first_publish_year, isbn); the first three are named."""
    asked = calls.withColumn("asked", _arg("query"))
    bad = F.when(~F.coalesce(F.char_length("asked") >= 2, F.lit(False)), F.lit("No query given."))
    docs = asked.join(t.outside.select(F.col("query").alias("asked"), "docs"), "asked").select("call_id", F.posexplode(F.slice("docs", 1, 5)).alias("place", "d"))
    authors = F.array_join(F.slice(F.coalesce("d.author_name", F.array().cast("array<string>")), 1, 3), ", ")
    text = F.concat(F.lit("'"), "d.title", F.lit("' by "), F.coalesce(F.nullif(authors, F.lit("")), F.lit("unknown")), F.lit(" ("), F.coalesce(F.col("d.first_publish_year").cast("string"), F.lit("n.d.")), F.lit(")"))
    counted = docs.withColumn("found", F.count("*").over(Window.partitionBy("call_id")).cast("int"))
    named = _said(counted.where("place < 3"), text, F.col("place"), before="Outside the library: ").drop("found")
    said = named.join(counted.groupBy("call_id").agg(F.max("found").alias("found")), "call_id")
    return _answer(asked, said, F.concat(F.lit("There is no match outside for '"), "asked", F.lit("'.")), bad)


def add_event(calls: DataFrame, t: Tables, today: Column) -> DataFrame:
    """Whether an event may be added, and how it reads; the write itself waits for a confirmation."""
    asked = calls.withColumn("title", _arg("title")).withColumn("date", dates.resolve_date(_arg("date"), today).cast("string"))
    missing = F.array_join(F.array_compact(F.array(F.when(F.col("title").isNull(), "title"), F.when(_arg("date").isNull(), "date"))), ", ")
    bad = F.when(missing != "", F.concat(F.lit("Event not added: missing "), missing, F.lit("."))).when(F.col("date").isNull(), F.lit("Unknown date."))
    start, end = dates.normalize_time(_arg("start")), dates.normalize_time(_arg("end"))
    when = F.when(start.isNotNull(), F.concat(F.lit(", "), start, F.lit("–"), F.coalesce(end, F.lit("?")))).otherwise("")
    where = F.when(_arg("location").isNotNull(), F.concat(F.lit(" at "), _arg("location"))).otherwise("")
    said = asked.where(bad.isNull()).select("call_id", F.lit(1).alias("found"), F.concat(F.lit("'"), "title", F.lit("' on "), "date", when, where, F.lit(".")).alias("said"))
    return _answer(asked, said, "", bad)


TOOLS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "get_timetable": (get_timetable, ("enrollments", "sessions")), "get_deadlines": (get_deadlines, ("enrollments", "assignments")), "find_free_rooms": (find_free_rooms, ("rooms", "sessions", "bookings")),
    "check_book": (check_book, ("books", "loans")), "get_loans": (get_loans, ("books", "loans")), "get_calendar": (get_calendar, ("events",)), "campus_weather": (campus_weather, ("forecast",)),
    "convert_currency": (convert_currency, ()), "concept_summary": (concept_summary, ("concepts",)), "search_books": (search_books, ("outside",)), "add_event": (add_event, ()),
}


OWN = ("get_timetable", "get_deadlines", "get_loans")  # tools whose answer depends on the account


def run_calls(calls: DataFrame, tables: Tables, today: Column) -> DataFrame:
    """Every call's answer. Call ids have to be different. Calls of one tool with the same arguments, and of the same account where it matters, are one question, answered once."""
    there = {f.name for f in fields(tables) if getattr(tables, f.name) is not None}
    able = {name: run for name, (run, needs) in TOOLS.items() if set(needs) <= there}
    known = F.coalesce(F.col("tool").isin(list(able)), F.lit(False))
    why = F.when(F.coalesce(F.col("tool").isin(list(TOOLS)), F.lit(False)), F.concat(F.lit("no data for "), "tool")).otherwise(F.concat(F.lit("unknown tool "), F.coalesce("tool", F.lit(""))))
    out = calls.where(~known).select("call_id", "tool", F.lit(False).alias("ok"), why.alias("error"), F.lit(0).alias("found"), why.alias("summary"))
    if not able:
        return out
    own = F.when(F.col("tool").isin(*OWN), F.col("account"))
    asked = calls.where(known).withColumn("question", F.to_json(F.struct(own.alias("account"), F.sort_array(F.map_entries("args")).alias("args"))))
    answered = None
    for name, run in able.items():
        each = asked.where(F.col("tool") == name).groupBy("tool", F.col("question").alias("call_id")).agg(*(F.first(c).alias(c) for c in ("account", "args")))
        done = run(each, tables, today)
        answered = done if answered is None else answered.unionByName(done)
    answered = answered.withColumnRenamed("call_id", "question")
    return out.unionByName(asked.select("call_id", "tool", "question").join(answered, ["tool", "question"]).select(*out.columns))
