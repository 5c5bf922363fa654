"""Text and date functions against their rules, written out in Python."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import struct
import unicodedata

import pytest
from pyspark.sql import functions as F

from cairn.functions import arguments, dates
from cairn.functions import text as T
from cairn.functions.stats import nearest_rank
from cairn.operators import retrieval


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0] if values else spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("word", "stem"),
    [("is", "is"), ("policies", "policy"), ("carried", "carry"), ("meetings", "meet"), ("running", "runn"), ("fined", "fin"), ("focused", "focus"), ("biased", "bias"), ("caused", "caus"), ("classes", "class"), ("boxes", "box"), ("exams", "exam"), ("class", "class"), ("sing", "sing"), ("red", "red")],
)
def test_stem(spark, word, stem):
    assert one(spark, T.stem(F.col("w")), w=word) == stem


def test_text(spark):
    assert one(spark, T.slug(F.lit("  Été: Fees & Rules!"))) == "t-fees-rules"
    assert one(spark, T.slug(F.lit("!!"))) == "document"
    assert one(spark, T.script(F.lit("abc"))) == "latin"
    assert one(spark, T.script(F.lit("កខ a"))) == "khmer"
    assert one(spark, T.script(F.lit("12"))) == "none"
    assert one(spark, T.redact(F.lit("Bearer abcdefghijklmnop for A1234"))) == "Bearer [REDACTED] for A****"
    assert one(spark, T.terms(F.lit("The classes and the class of Fees"))) == ["class", "fee"]
    assert one(spark, T.khmer_grams(F.lit("កខគឃ ab"))) == ["កខគ", "ខគឃ"]
    assert one(spark, T.token_count(F.lit("Hello 12345 កខ!"))) == 2 + 2 + 2 + 1
    assert tuple(one(spark, T.split_at(F.lit("Hello world"), 2))) == ("Hello ", "world")
    assert one(spark, T.sentences(F.lit("First one.\nSecond\nline here. x"))) == ["First one.", "Second line here."]
    assert one(spark, T.line_key(F.lit("  Page 12 of 30 "))) == "page # of #"
    assert one(spark, T.is_page_number(F.lit(" Page 3 of 10 ")))
    assert one(spark, T.must_keep(F.lit("FECO303 at 14:00 on 2026-10-08"))) == ["FECO303", "14:00", "2026-10-08"]
    assert one(spark, T.breadcrumb(F.lit("Title"), F.lit("Fees › Title"))) == "# Title › Fees"
    assert one(spark, T.fixture_key(F.create_map(F.lit("q"), F.lit("A b"), F.lit("k"), F.lit("1")))) == "k-1-q-a-b"


def test_dates(spark):
    today = F.lit(dt.date(2026, 10, 6))
    said = {"today": 6, "tomorrow": 7, "tuesday": 6, "monday": 12, "Thursday": 8, "2026-10-31": 31}
    for text, day in said.items():
        assert one(spark, dates.resolve_date(F.lit(text), today)) == dt.date(2026, 10, day)
    assert one(spark, dates.resolve_date(F.lit("someday"), today)) is None
    times = {"2 pm": "14:00", "12 am": "00:00", "12pm": "12:00", "9:30": "09:30", "2": "14:00", "25:00": None, "noon": None}
    for text, time in times.items():
        assert one(spark, dates.normalize_time(F.lit(text), True)) == time
    assert one(spark, dates.minutes_between(F.lit("09:45"), F.lit("11:00"))) == 75
    assert one(spark, dates.week_dates(today))["thursday"] == dt.date(2026, 10, 8)
    assert tuple(one(spark, dates.time_window(F.lit("a room from 2 to 4 pm")))) == ("14:00", "16:00")
    assert tuple(one(spark, dates.time_window(F.lit("at 3 pm")))) == ("15:00", "16:00")


@pytest.mark.parametrize("n", [1, 2, 3, 6, 20])
def test_nearest_rank(spark, n):
    values = [(k * 37 % 101 + 0.25,) for k in range(n)]
    row = nearest_rank(spark.createDataFrame(values, "v double").withColumn("k", F.lit(1)), ["k"], "v", {"a": 0.5, "b": 0.95}).first()
    ordered = sorted(v for (v,) in values)
    assert (row.a, row.b) == tuple(round(ordered[round(q * (n - 1))], 1) for q in (0.5, 0.95))


def test_hashing_embedding(spark):
    text = "The late exam rules and the កខគឃ"
    words = [w for w in re.findall("[a-z0-9]+", text.lower()) if w not in T.EMBEDDING_STOP_WORDS]
    v = [0.0] * 512
    for f in [*words, *(f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)), "កខគ", "ខគឃ"]:
        h = hashlib.md5(f.encode()).digest()
        v[struct.unpack("<I", h[:4])[0] % 512] += 1 if h[4] & 1 else -1
    norm = sum(x * x for x in v) ** 0.5
    rows = spark.createDataFrame([(1, text), (2, "")], "id int, text string")
    got = {r.id: r.embedding for r in retrieval.hashing_embedding(rows, "id", "text").collect()}
    assert all(abs(a - b / norm) < 1e-6 for a, b in zip(got[1], v, strict=True))
    assert not any(got[2])


def test_coverage_and_answer(spark):
    rows = spark.createDataFrame(
        [(1, 1, "parking fees", "Parking costs money. The fee is five dollars. Nothing else.", 1), (1, 2, "parking fees", "Nothing of the kind.", 2), (2, 3, "the of", "x", 1)],
        "query_id int, doc_id int, query string, text string, rank int",
    )
    got = {(r.query_id, r.doc_id): r.coverage for r in retrieval.with_coverage(rows, ["query_id", "doc_id"]).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (2, 3): 0.0}
    answers = {r.query_id: r.answer for r in retrieval.extractive_answer(rows).collect()}
    assert answers == {1: "Parking costs money. The fee is five dollars.", 2: None}


def test_nfc_of_open_texts_alone(spark, monkeypatch):
    """Only texts with characters from U+0300 on travel to Python."""
    texts = ["plain", "caf\u00e9 \u02ff", "cafe\u0301", "\u212b", "", None, "\u1100\u1161", "a\U0001d15e"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.x for r in rows.select("id", arguments.nfc("text").alias("x")).collect()}
    assert got == {k: None if t is None else unicodedata.normalize("NFC", t) for k, t in enumerate(texts)}
    monkeypatch.setattr(arguments, "_composed", lambda c: F.lit("sent"))
    got = [r.x for r in rows.select("id", arguments.nfc("text").alias("x")).orderBy("id").collect()]
    assert got == ["plain", "caf\u00e9 \u02ff", "sent", "sent", "", None, "sent", "sent"]
