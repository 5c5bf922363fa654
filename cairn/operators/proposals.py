"""Which tool a request asks for, with its arguments, or what has to be asked back.

Arguments are looked for in the message first, then in the user's earlier messages
of the thread, the newest first. That look back is a running window; the choice is
one ordered table of conditions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import arguments, dates
from cairn.operators.rules import DATA_ROUTES, SPECIFIC_TIME, WORDS_OF_DAY, says

# Times of day, course codes, words that are no part of a title, what is asked back.
DAY_WINDOWS = {"morning": ("09:00", "11:00"), "afternoon": ("14:00", "16:00"), "evening": ("17:00", "19:00")}
COURSE = r"\b([A-Za-z]{4}\d{3})\b"
NOT_TITLE = r"(?i)\b(is|are|the|book|books|available|in|library|on|shelf|there|a|an|any|about|do|does|have|has)\b|[?.!]"
ASK_FIELDS = "The notice was read, but these fields could not be verified against its text: {fields}. Which values are correct?"
ASK_EVENT = "Which event: a title and a date are needed."
ASK_TIME = "Which time window: a start and end time, for example 14:00-16:00?"
ASK_BOOK = "Which book: an ISBN is needed to place a hold."
ASK_DIRECTION = "Which conversion: USD to KHR or KHR to USD?"
ASK_AMOUNT = "Which amount should be converted?"
PLAN_ORDER = ["rooms", "timetable", "deadlines", "calendar", "library", "weather", "currency", "concept"]
TIMES_OF_DAY = [("specific_time", SPECIFIC_TIME), *((w, rf"\b{w}\b") for w in DAY_WINDOWS)]


def said(text: Column, options: list[tuple[str, str]]) -> Column:
    """The first option that a text names; null if none."""
    return F.coalesce(*(F.when(says(text, p), name) for name, p in options))


def window_of(text: Column) -> Column:
    """struct<start, end>; null without a time."""
    found = dates.time_window(text)
    return F.when(found["start"].isNotNull(), found)


def course_of(text: Column, courses: list[str]) -> Column:
    """The first course code of a text that is a course."""
    codes = F.transform(F.regexp_extract_all(text, F.lit(COURSE), F.lit(1)), lambda c: F.upper(c))
    return F.get(F.filter(codes, lambda c: c.isin(courses)), F.lit(0))


def looked_back(rows: DataFrame, courses: list[str], thread: str = "conv_id", turn: str = "turn", message: str = "text") -> DataFrame:
    """Add last_user, and ``past_`` columns: what the newest of the user's earlier messages that says so said.

    A course counts in the message itself first; the others are for follow-ups and gaps.
    """
    t = F.col(message)
    values = {"day": said(t, WORDS_OF_DAY), "time_of_day": said(t, TIMES_OF_DAY), "window": window_of(t), "isbn": arguments.isbn(t), "amount": arguments.amount(t), "course": course_of(t, courses)}
    before = Window.partitionBy(thread).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    user = F.col("role") == "user"
    found = rows.withColumns({f"past_{k}": F.last(F.when(user, v), ignorenulls=True).over(before) for k, v in values.items()})
    found = found.withColumn("last_user", F.last(F.when(user, t), ignorenulls=True).over(before))
    return found.withColumn("course", F.coalesce(values["course"], F.col("past_course")))


def _args(**values: Column) -> Column:
    """map<name, text> of the values that aren't null."""
    entries = F.array(*(F.struct(F.lit(k.rstrip("_")).alias("key"), v.cast("string").alias("value")) for k, v in values.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _call(tool: str | None, args: Column | None, reason: str | Column, clarify: str | Column | None = None) -> Column:
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    as_column = lambda x: (F.lit(x) if not isinstance(x, Column) else x).cast("string")
    return F.struct(as_column(tool).alias("tool"), (none if args is None else args).alias("args"), as_column(reason).alias("reason"), as_column(clarify).alias("clarify"))


def _is_said(name: str) -> Column:
    return F.when(F.col(name) != "not_stated", F.col(name))


def proposal(route: Column, wants_change: Column, today: Column, room: Column | None = None, book: Column | None = None, event: Column | None = None, flagged: Column | None = None, message: str = "message") -> Column:
    """struct<tool, args, reason, clarify> for rows of ``answer_turns`` and ``looked_back``.

    ``room`` (struct of room_id, date, start, end) and ``book`` are what the last search left, ``event`` a
    map of a notice's fields and ``flagged`` those that weren't verified. Null columns count as not there.
    """
    t = F.col(message)
    none_room = F.lit(None).cast("struct<room_id:string,date:string,start:string,end:string>")
    room, book = none_room if room is None else room, F.lit(None).cast("string") if book is None else book
    event = F.lit(None).cast("map<string,string>") if event is None else event
    flagged = F.array().cast("array<string>") if flagged is None else F.coalesce(flagged, F.array().cast("array<string>"))
    wants = F.coalesce(wants_change >= 0.5, F.lit(False))
    day, tod, direction = _is_said("day"), _is_said("time_of_day"), _is_said("currency_direction")
    own_window, own_isbn, own_amount = window_of(t), arguments.isbn(t), arguments.amount(t)
    by_tod = F.coalesce(*(F.when(tod == k, F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))) for k, (a, b) in DAY_WINDOWS.items()))
    window = F.coalesce(own_window, F.col("past_window"), by_tod)
    isbn, value = F.coalesce(own_isbn, F.col("past_isbn")), F.coalesce(own_amount, F.col("past_amount"))
    field = lambda k: F.nullif(F.try_element_at(event, F.lit(k)), F.lit(""))
    names = F.array_join(flagged, ", ")
    begin = dates.resolve_date(F.coalesce(day, F.lit("today")), today)
    yes = lambda name: F.when(F.col(name) >= 0.5, F.lit(True))
    quoted = F.regexp_extract(t, arguments.QUOTED, 1)
    title = F.trim(F.regexp_replace(F.regexp_replace(t, NOT_TITLE, " "), r"\s+", " "))
    title = F.when(quoted != "", quoted).otherwise(F.coalesce(F.nullif(title, F.lit("")), t))
    has_room = room.isNotNull() & room["room_id"].isNotNull()
    searching = F.concat(F.lit("free-room search"), F.when(wants, F.lit(" before a booking")).otherwise(F.lit("")))
    is_ = lambda name: route == name
    table = [
        (is_("timetable"), _call("get_timetable", _args(course=F.col("course"), day=F.when(~says(t, "this week"), day)), "timetable lookup")),
        (is_("deadlines"), _call("get_deadlines", _args(course=F.col("course"), within_days=F.when(says(t, r"\bthis week\b"), F.lit(7))), "deadline lookup")),
        (is_("calendar") & wants & (F.size(flagged) > 0), _call(None, None, F.concat(F.lit("unverified fields: "), names), F.replace(F.lit(ASK_FIELDS), F.lit("{fields}"), names))),
        (is_("calendar") & wants & (field("title").isNull() | field("date").isNull()), _call(None, None, "no event details", ASK_EVENT)),
        (is_("calendar") & wants, _call("add_event", F.map_filter(event, lambda k, v: F.coalesce(v != "", F.lit(False))), "event from the notice")),
        (is_("calendar"), _call("get_calendar", _args(from_=begin, to=F.date_add(begin, 30)), "calendar lookup")),
        (is_("rooms") & wants & has_room, _call("book_room", _args(room_id=room["room_id"], date=room["date"], start=room["start"], end=room["end"], purpose=F.lit("study")), "memory: first room of the last search")),
        (is_("rooms") & window.isNull(), _call(None, None, "no time window", ASK_TIME)),
        (is_("rooms"), _call("find_free_rooms", _args(date=F.coalesce(day, F.lit("today")), start=window["start"], end=window["end"], needs_projector=yes("needs_projector"), needs_pcs=yes("needs_pcs"), min_capacity=arguments.capacity(t)), searching)),
        (is_("library") & wants & F.coalesce(isbn, book).isNull(), _call(None, None, "no book chosen", ASK_BOOK)),
        (is_("library") & wants, _call("place_hold", _args(isbn=F.coalesce(isbn, book)), "hold request")),
        (is_("library") & own_isbn.isNotNull(), _call("check_book", _args(isbn=own_isbn), "ISBN lookup")),
        (is_("library") & says(t, r"\bloans?\b"), _call("get_loans", None, "own loans")),
        (is_("library"), _call("check_book", _args(title=title), "title lookup")),
        (is_("weather"), _call("campus_weather", _args(date=F.coalesce(day, F.lit("today")), hour=own_window["start"], until=own_window["end"]), "forecast")),
        (is_("currency") & direction.isNull(), _call(None, None, "direction not stated", ASK_DIRECTION)),
        (is_("currency") & value.isNull(), _call(None, None, "amount not found", ASK_AMOUNT)),
        (is_("currency"), _call("convert_currency", _args(amount=value, direction=direction), "conversion")),
        (is_("concept"), _call("concept_summary", _args(topic=F.coalesce(F.nullif(arguments.concept_topic(t), F.lit("")), t)), "concept summary")),
    ]
    other = _call(None, None, F.concat(F.lit("no tool for route "), F.coalesce(route, F.lit("none"))))
    return F.coalesce(*(F.when(condition, call) for condition, call in table), other)


def read_plan(hits: Column, today: Column, message: str = "message") -> Column:
    """array<struct<tool, args>>: the look-ups, in order, of the routes that the message itself names; writes aren't planned."""
    calls = [F.when(F.map_contains_key(hits, r), proposal(F.lit(r), F.lit(0.0), today, message=message)) for r in PLAN_ORDER if r in DATA_ROUTES]
    kept = F.filter(F.array(*calls), lambda c: c.isNotNull() & c["tool"].isNotNull() & ~F.rlike(c["tool"], F.lit("^(book_|place_|add_)")))
    return F.transform(kept, lambda c: F.struct(c["tool"].alias("tool"), c["args"].alias("args")))
