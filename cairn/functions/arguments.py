"""Arguments read out of requests, as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as a number, an ISBN, a capacity, a quotation and a question for a concept.
ISBN = r"\b97[89]\d{10}\b"
AMOUNT = r"(?<![\w.])(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?(?![\w:])"
KHMER_DIGITS = "០១២៣៤៥៦៧៨៩"
CAPACITY = r"(?i)\b(?:for|seats?|capacity)\s+(\d{1,3})\b|\b(\d{1,3})\s+(?:people|seats|persons)\b"
QUOTED = r"['\"‘’“”]([^'\"‘’“”]{2,60})['\"‘’“”]"
CONCEPT = r"(?i)\b(?:what (?:does|is|are)|explain|define|meaning of)\s+(?:an?\s+|the\s+)?(.+?)(?:\s+mean\b|\s+in\s+\w+|\?|$)"
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match."""
    return F.when(F.rlike(text, F.lit(pattern)), F.nullif(F.regexp_extract(text, pattern, group), F.lit("")))


def isbn(text: Column) -> Column:
    return _first(text, ISBN, 0)


def amount(text: Column) -> Column:
    """The first number that is no ISBN, with thousands and decimals; Khmer digits count."""
    found = F.regexp_extract_all(F.translate(text, KHMER_DIGITS, "0123456789"), F.lit(AMOUNT), F.lit(0))
    plain = F.filter(F.transform(found, lambda m: F.replace(m, F.lit(","), F.lit(""))), lambda m: ~F.rlike(F.split_part(m, F.lit("."), F.lit(1)), F.lit(f"^{ISBN}$")))
    return F.get(plain, F.lit(0)).try_cast("double")


def capacity(text: Column) -> Column:
    return F.coalesce(_first(text, CAPACITY, 1), _first(text, CAPACITY, 2)).cast("int")


def concept_topic(text: Column) -> Column:
    """What is quoted; else what is asked to be explained."""
    asked = F.regexp_replace(_first(text, CONCEPT), r"^[ .?]+|[ .?]+$", "")
    return F.coalesce(F.trim(_first(text, QUOTED)), asked)


def roman(mark: Column) -> Column:
    """The value of a Roman numeral: letters before larger ones count less; null for other letters."""
    values = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    each = F.transform(F.filter(F.split(mark, ""), lambda c: c != ""), lambda c: F.try_element_at(values, c))
    signed = F.transform(each, lambda v, k: F.when(v < F.coalesce(F.get(each, k + 1), F.lit(0)), -v).otherwise(v))
    total = F.aggregate(signed, F.lit(0), lambda s, v: s + v)
    return F.when((F.size(each) > 0) & F.forall(each, lambda v: v.isNotNull()) & (total > 0), total)


def converted(value: Column, rate: Column, direction: Column) -> Column:
    """An amount in the other currency, to two places: times the rate or by it; null unless the rate is above 0."""
    other = F.when(direction == "usd_to_khr", value * rate).when(direction == "khr_to_usd", value / rate)
    return F.when(rate > 0, F.round(other, 2))


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t))


def nfc(text: Column | str) -> Column:
    """Composed characters; Spark has no function for it. Characters below U+0300 are composed, so texts of such alone don't go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    open_ = F.rlike(text, F.lit(r"[^\x{0}-\x{2FF}]"))
    return F.when(open_, _composed(F.when(open_, text).otherwise(""))).otherwise(text)
