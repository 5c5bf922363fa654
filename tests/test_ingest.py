"""Cleaning by format, embedding, probes, verification, notices and judges."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cairn.operators import documents, ingest, judging, notices

UNITS = "source_id string, format string, page int, text string"


def test_clean_units(spark):
    pages = [("p", "pdf", k, f"Head {k}\nBody wo-\nrd {'abc'[k]}\x07\n{k + 1}") for k in range(3)]
    md = [("m", "md", None, "<!-- x -->\n## 1. A\n## 2.1. B\n\n\n\n| a|b |\n| :- | --:|\n|1 | 2|  \n"), ("n", None, None, None)]
    got = {(r.source_id, r.page): r for r in ingest.clean_units(spark.createDataFrame(pages + md, UNITS)).collect()}
    assert len(got) == 5
    p = got["p", 1]
    assert p.text == "rd b"
    assert (p.headers_footers, p.page_numbers, p.control_chars, p.format) == (2, 1, 1, "pdf") and p.samples == ["2", "Body wo-", "Head 1"]
    m = got["m", None]
    assert m.text == "## 1. A\n### 2.1. B\n\n| a | b |\n|---|---|\n| 1 | 2 |"
    assert (m.html_comments, m.tables_compacted, m.headings_relevelled, m.samples) == (1, 1, 1, ["<!-- x -->"])
    assert got["n", None].text == "" and got["n", None].chars_before == 0
    stats = {r.format: r for r in ingest.clean_stats(ingest.clean_units(spark.createDataFrame(pages + md, UNITS))).collect()}
    assert stats["pdf"].units == 3 and stats["pdf"].page_numbers == 3 and stats["md"].html_comments == 1
    assert ingest.clean_units(spark.createDataFrame([], UNITS)).isEmpty()


def test_embedding_and_consistency(spark):
    chunks = spark.createDataFrame([("h1", "fees are due", "a", 1, None), ("h1", "fees are due", "b", 2, None), ("h2", "library", "a", None, "s"), ("h3", "x", None, None, "s"), ("h4", "", "a", None, "")], "chunk_hash string, text string, source_id string, page int, section string")
    cache = spark.createDataFrame([("h2", "m", [1.0]), ("h1", "other", [1.0])], "chunk_hash string, model string, embedding array<float>")
    new, stats = ingest.embed_new(chunks, cache, "m")
    assert {r.chunk_hash for r in new.collect()} == {"h1", "h3", "h4"} and tuple(stats.first()) == (4, 1, 3)
    found = {r.check: (r.ok, r.bad) for r in ingest.consistency(chunks, cache.unionByName(new), "m", 6).collect()}
    assert found == {"chunks match the chunk stage": (False, 1), "every chunk has a vector": (True, 0), "every chunk has a source and a place": (False, 2)}
    bare = {r.check: r.bad for r in ingest.consistency(chunks, cache, "m", 5).collect()}
    assert bare["every chunk has a vector"] == 4
    none, stats = ingest.embed_new(chunks.limit(0), cache, "m")
    assert none.isEmpty() and tuple(stats.first()) == (0, 0, 0)


def test_probes(spark):
    docs = spark.createDataFrame([("a", "Fees"), ("b", None), ("c", "Old"), ("d", "No chunks")], "source_id string, title string")
    chunks = spark.createDataFrame([("a", 2, "later text"), ("a", 1, "The fees of students are paid monthly in cash"), ("b", 0, "of the"), ("c", 0, "x")], "source_id string, position int, text string")
    got = {r.source_id: r.question for r in ingest.generated_probes(docs, chunks, spark.createDataFrame([("c",)], "source_id string")).collect()}
    assert got == {"a": "What does Fees say about fee student paid monthly?", "b": "What does the document say about its main rule?"}


def test_batches(spark):
    rows = spark.range(500).withColumn("x", F.col("id") % 3)
    sizes = ingest.batches(rows, 4, "id").groupBy("batch").count().collect()
    assert max(r["count"] for r in sizes) <= 4 and sum(r["count"] for r in sizes) == 500


def test_notices(spark):
    rows = [
        (1, {"title": "Spring Talk", "date": "16 October 2026", "start": "9.30", "end": "11:00", "location": "Hall in B-204"}, "Spring Talk, 16 October 2026, 09:30 to 11:00, room B-204"),
        (2, {"title": "Other Name", "date": "2026-10-17", "start": "11:00", "end": "10:00"}, "Spring Talk, 16 October 2026, 10:00 11:00"),
        (3, {"title": " ", "date": "31 Foo 2026", "start": "25:00"}, None),
        (4, None, "x"),
    ]
    truth = {"title": "Spring Talk", "date": "2026-10-16", "start": "09:30"}
    df = spark.createDataFrame([(*r, truth) for r in rows], "id int, event map<string,string>, text string, truth map<string,string>")
    got = {r.id: r for r in notices.judged(df).collect()}
    assert tuple(got[1].notice.event) == ("Spring Talk", "2026-10-16", "09:30", "11:00", "B-204") and got[1].notice.flagged == [] and got[1].field_accuracy == 1.0
    assert got[2].notice.flagged == ["title", "date", "start", "end"] and got[2].notice.missing == ["title", "date"] and got[2].field_accuracy == 0.0
    assert tuple(got[3].notice.event) == (None,) * 5 and got[3].notice.missing == ["title", "date"] and got[4].wrong == []
    late = spark.createDataFrame([(5, {"title": "Spring Talk", "date": "17 October 2026"}, "Spring Talk 17 October 2026", truth)], df.schema)
    assert notices.judged(late).first().wrong == ["date"]


def test_judges(spark, tmp_path):
    results = spark.createDataFrame([(1, "answer", "c", "en", "q", "Fees are paid in term one of the year."), (2, "tool", "c", "en", "q", "x"), (3, "answer", "c", "en", "q", "Short one."), (4, "answer", "c", "en", "q", "No passages were given here at all.")], "id long, kind string, category string, language string, message string, answer string")
    cases = spark.createDataFrame([(1, ["a", "b"]), (3, None)], "id long, key_facts array<string>")
    rows = judging.manual_rows(results, cases)
    assert rows.columns == list(judging.COLUMNS) and {r.id: r.key_facts for r in rows.collect()} == {1: "a; b", 3: "", 4: ""}
    judging.write_manual(rows, f"file://{tmp_path}/manual")
    filled = spark.read.option("header", True).csv(f"file://{tmp_path}/manual")
    assert filled.count() == 3
    filled = filled.withColumn("faithfulness_1_5", F.when(F.col("id") == "1", "1").when(F.col("id") == "3", "n/a"))
    passages = spark.createDataFrame([(1, 1, "Fees are paid in"), (1, 2, "term one of the year"), (3, 1, "short")], "id long, rank int, text string")
    judged = judging.judged(results, passages, judging.human_scores(filled.withColumn("id", F.col("id").cast("long"))))
    got = {r.id: (r.judge_model, r.judge_claims, r.judge_human) for r in judged.collect()}
    assert got == {1: (5.0, 5.0, 1.0), 2: (None, None, None), 3: (got[3][0], None, None), 4: (None, None, None)}
    assert [r.id for r in judging.apart(judged).collect()] == [1]


def test_report_of_random_units(spark):
    """Sums of the report are those of its rows."""
    rng = random.Random(1)
    units = [(f"s{k % 4}", rng.choice(["pdf", "md"]), k, " ".join(rng.choices(["a", "b-\nc", "<!--x-->", "\n7\n", "\x01"], k=8))) for k in range(40)]
    cleaned = ingest.clean_units(spark.createDataFrame(units, UNITS))
    rows = cleaned.collect()
    for r in ingest.clean_stats(cleaned).collect():
        own = [x for x in rows if x.format == r.format]
        assert r.units == len(own) and all(r[c] == sum(x[c] for x in own) for c in ("chars_before", "chars_after", *ingest.COUNTERS))


def test_cleaned_markdown_cleans_once(spark):
    rows = spark.createDataFrame([(1, "## 1. One\n\n\n\n## 2.1. Two \n| a |  b |\n|:--|---|\n<!-- c -->"), (2, None)], "id int, text string")
    done = documents.cleaned_markdown(rows)
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, rows.withColumn("text", documents.clean_markdown(F.col("text"))).collect()))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("<!--") == 3
