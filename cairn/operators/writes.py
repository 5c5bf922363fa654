"""The gate before a write: is it asked for, is it for the own account, what would a mistake cost?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.operators.rules import WANTS_CHANGE, says

# How costly a mistaken write of each tool is.
IMPACT = {"book_room": 1.0, "place_hold": 0.3, "add_event": 0.4}
MONTHS = "january february march april may june july august september october november december".split()


def explicit(request: Column) -> Column:
    """How surely the request asks for a change."""
    asked = reduce(lambda a, b: a | b, (says(request, p) for p in WANTS_CHANGE))
    return F.when(asked | says(request, "confirm"), 0.9).otherwise(0.2)


def own_account(for_account: Column, account: Column) -> Column:
    """How surely the write is for the session's own account; one that names none is."""
    return F.when(for_account.isNull() | for_account.eqNullSafe(account), 0.97).otherwise(0.05)


def impact(tool: Column) -> Column:
    costs = F.create_map(*(F.lit(x) for pair in IMPACT.items() for x in pair))
    return F.coalesce(F.try_element_at(costs, tool), F.lit(1.0))


def gate(tool: Column, request: Column, account: Column, for_account: Column) -> Column:
    """refuse for another account, clarify for what isn't clearly asked, else confirm: the write is pending."""
    return F.when(own_account(for_account, account) < 0.5, "refuse").when(explicit(request) < 0.5, "clarify").otherwise("confirm")


def supported(value: Column, text: Column) -> Column:
    """How surely a text backs an event's field: a date by its year, day and month, else by most of the value's words."""
    said, given = F.lower(F.coalesce(text, F.lit(""))), F.trim(F.lower(F.coalesce(value, F.lit(""))))
    iso = r"^(\d{4})-(\d{2})-(\d{2})$"
    year, month, day = (F.regexp_extract(given, iso, k) for k in (1, 2, 3))
    name = F.get(F.array(*map(F.lit, MONTHS)), month.try_cast("int") - 1)
    in_digits = F.contains(said, F.concat(F.lit("-"), month, F.lit("-"))) | F.contains(said, F.concat(F.lit("/"), month, F.lit("/")))
    has_day = F.rlike(said, F.concat(F.lit(r"\b0?"), day.try_cast("int").cast("string"), F.lit(r"\b")))
    dated = F.contains(said, year) & has_day & (F.coalesce(F.contains(said, name), F.lit(False)) | in_digits)
    parts = F.filter(F.split(given, r"[\s,:\-–]+"), lambda p: p != "")
    share = F.size(F.filter(parts, lambda p: F.contains(said, p))) / F.greatest(F.size(parts), F.lit(1))
    return F.when(given == "", 0.05).when(F.rlike(given, F.lit(iso)), F.when(dated, 0.93).otherwise(0.12)).when(share >= 0.8, 0.95).otherwise(0.1 + 0.5 * share)
