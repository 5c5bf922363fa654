"""Events read from notices: their fields made plain, checked against the notice's text, and judged against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import dates
from cairn.operators.writes import MONTHS, supported

FIELDS = ("title", "date", "start", "end", "location")
ROOM = r"\b[A-D]-\d{3}\b"
SUPPORTED = 0.5


def normalize_event(event: Column) -> Column:
    """struct of FIELDS of a map: ISO dates, also from '16 October 2026', times as HH:MM, a room's name alone; what can't be read is null."""
    get = lambda k: F.nullif(F.trim(F.try_element_at(event, F.lit(k))), F.lit(""))
    said, written = get("date"), r"(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(said, written, 2)))
    named = F.when(month > 0, F.concat_ws("-", F.regexp_extract(said, written, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(said, written, 1), 2, "0")))
    iso = F.when(F.rlike(said, F.lit(r"^\d{4}-\d{2}-\d{2}$")), said).otherwise(named)
    date = F.when(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).isNotNull(), iso)
    clock = lambda k: dates.normalize_time(F.replace(get(k), F.lit("."), F.lit(":")))
    place = get("location")
    room = F.regexp_extract(place, ROOM, 0)
    return F.struct(get("title").alias("title"), date.alias("date"), clock("start").alias("start"), clock("end").alias("end"), F.when(room != "", room).otherwise(place).alias("location"))


def checked_notice(event: Column, text: Column) -> Column:
    """struct<event, flagged, missing>: fields that the text doesn't back are flagged and emptied, and so are both ends of a span that doesn't go forward; missing are title or date without a value."""
    weak = {k: event[k].isNotNull() & (supported(event[k], text) < SUPPORTED) for k in FIELDS}
    backwards = F.coalesce(event["end"] <= event["start"], F.lit(False))
    flag = {k: F.coalesce(weak[k], F.lit(False)) | (backwards if k in ("start", "end") else F.lit(False)) for k in FIELDS}
    names = lambda some: F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in some.items())))
    kept = F.struct(*(F.when(~flag[k], event[k]).alias(k) for k in FIELDS))
    missing = names({k: event[k].isNull() | flag[k] for k in ("title", "date")})
    return F.struct(kept.alias("event"), names(flag).alias("flagged"), missing.alias("missing"))


def field_accuracy(read: Column, truth: Column) -> Column:
    """The share, to two places, of the fields with a true value that were read so; 0 without any."""
    asked = [truth[k].isNotNull() for k in FIELDS]
    right = [truth[k].isNotNull() & truth[k].eqNullSafe(read[k]) for k in FIELDS]
    count = lambda some: sum((c.cast("int") for c in some[1:]), some[0].cast("int"))
    return F.bround(count(right) / F.greatest(F.lit(1), count(asked)), 2)


def wrong_and_unflagged(read: Column, truth: Column) -> Column:
    """The fields that were read otherwise than they are, and kept."""
    return F.array_compact(F.array(*(F.when(truth[k].isNotNull() & read[k].isNotNull() & (truth[k] != read[k]), F.lit(k)) for k in FIELDS)))


def judged(rows: DataFrame, event: str = "event", text: str = "text", truth: str = "truth") -> DataFrame:
    """Rows with notice (checked_notice), field_accuracy and wrong (wrong_and_unflagged) of their event and truth, both maps."""
    read = rows.withColumn("read", normalize_event(F.col(event))).withColumn("true_event", normalize_event(F.col(truth)))
    checked = read.withColumn("notice", checked_notice(F.col("read"), F.col(text)))
    kept = F.col("notice.event")
    return checked.withColumn("field_accuracy", field_accuracy(kept, F.col("true_event"))).withColumn("wrong", wrong_and_unflagged(kept, F.col("true_event"))).drop("read", "true_event")
