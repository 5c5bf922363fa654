"""Stages between documents and an index, notices, and rows for people to score, over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import ingest, judging, notices
from cairn.plans.text import _STEM, _STOP_TEXT


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units_of(docs: DataFrame) -> DataFrame:
    """Documents as units to clean: of each seven two are Markdown files of their own, the others are pages of one document with a header and a number."""
    page, is_md = (F.col("doc_id") % 7).cast("int"), F.col("doc_id") % 7 >= 5
    group = F.floor(F.col("doc_id") / 7)
    md = F.concat(F.lit("<!-- made by rule -->\n## 1. One\n\n\n\n## 2.1. Two\n| a |  b |\n|:--|---|\n|  1 | 2|\n"), F.col("text"))
    pdf = F.concat(F.lit("Report "), group, F.lit("\n"), F.col("text"), F.lit("\nend of li-\nne\x07\n Page "), page + 1, F.lit(" of 5"))
    return docs.select(
        F.concat(F.lit("d"), F.when(is_md, F.col("doc_id") + 1_000_000_000).otherwise(group)).alias("source_id"), F.when(is_md, "md").otherwise("pdf").alias("format"),
        F.when(~is_md, page).alias("page"), F.when(is_md, md).otherwise(pdf).alias("text"),
    )


def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.clean_stats(ingest.clean_units(units_of(_t(spark, sf_dir, "documents"))))


def embed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, of which the cache has those with labels; then the stored chunks against the cache with the new vectors."""
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    chunks = docs.select(T.chunk_hash(F.col("text")).alias("chunk_hash"), "text", F.col("source").alias("source_id"), F.lit(None).cast("int").alias("page"), F.col("lang").alias("section"), "doc_id")
    cache = chunks.join(labels.select("doc_id"), "doc_id", "left_semi").select("chunk_hash", F.lit("m").alias("model"), F.array().cast("array<float>").alias("embedding")).dropDuplicates(["chunk_hash"])
    new, stats = ingest.embed_new(chunks, cache, "m")
    checks = ingest.consistency(chunks, cache.unionByName(new), "m", docs.count())
    counts = stats.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, stats.columns)), F.array(*stats.columns))).alias("name", "value"))
    return counts.unionByName(checks.select(F.col("check").alias("name"), F.col("bad").alias("value")))


def probes_of_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes for the documents without labels, of their first lines."""
    docs = _t(spark, sf_dir, "documents")
    named = docs.select(F.col("doc_id").alias("source_id"), F.concat(F.lit("Document "), "doc_id").alias("title"))
    chunks = docs.select(F.col("doc_id").alias("source_id"), F.posexplode(F.split("text", "\n")).alias("position", "text"))
    return ingest.generated_probes(named, chunks, _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_id")))


def _month(n: Column) -> Column:
    return F.get(F.array(*(F.lit(m.capitalize()) for m in notices.MONTHS)), (n % 12).cast("int"))


def notice_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notices by rule: a third are read with another day, a fifth with ends before their starts, some without a place."""
    e = F.col("event_id")
    day, hour = (e % 20 + 2).cast("string"), (e % 9 + 10).cast("string")
    written = F.concat(day, F.lit(" "), _month(e), F.lit(" 2026"))
    other = F.concat((e % 20 + 3).cast("string"), F.lit(" "), _month(e), F.lit(" 2026"))
    end = F.when(e % 5 == 0, (e % 9 + 9).cast("string")).otherwise((e % 9 + 12).cast("string"))
    text = F.concat(F.lit("Grand "), "event_type", F.lit(" on "), written, F.lit(", "), hour, F.lit(":30 to "), end, F.lit(".45, in room B-"), (e % 900 + 100).cast("string"))
    common = {"title": F.concat(F.lit("Grand "), "event_type"), "start": F.concat(hour, F.lit(":30")), "end": F.concat(end, F.lit(".45")), "location": F.concat(F.lit("room B-"), (e % 900 + 100).cast("string"))}
    as_map = lambda values: F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))
    read = {**common, "date": F.when(e % 3 == 0, other).otherwise(written), "location": F.when(e % 4 == 0, "").otherwise(common["location"])}
    rows = _t(spark, sf_dir, "events").select("event_id", text.alias("text"), as_map(read).alias("event"), as_map({**common, "date": written}).alias("truth"))
    done = notices.judged(rows)
    text_of = lambda c: F.array_join(c, ",")
    return done.select("event_id", text_of("notice.flagged").alias("flagged"), text_of("notice.missing").alias("missing"), "field_accuracy", text_of("wrong").alias("wrong"), F.coalesce("notice.event.date", F.lit("")).alias("date"))


def manual_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of conversations as answers, with the benchmark's words as facts of some."""
    rows = _t(spark, sf_dir, "conversations")
    ids = F.col("conv_id") * 100 + F.col("turn")
    results = rows.select(ids.alias("id"), F.when(F.col("role") == "assistant", "answer").otherwise("tool").alias("kind"), F.lit("chat").alias("category"), F.lit("en").alias("language"), F.lit("").alias("message"), F.md5("text").alias("answer"))
    cases = _t(spark, sf_dir, "benchmark").select((F.col("item_id") * 100 + 1).alias("id"), F.slice(F.split("text", " "), 1, 3).alias("key_facts"))
    return judging.manual_rows(results, cases).select("id", "answer", "key_facts", "faithfulness_1_5")


QUERIES = {f.__name__: f for f in (clean_report, embed_report, probes_of_new, notice_checks, manual_scoring)}

SQL = {
    "embed_report": """
        WITH d AS (SELECT sha256(text) AS h, doc_id FROM documents), c AS (SELECT DISTINCT h FROM d WHERE doc_id IN (SELECT doc_id FROM labels))
        SELECT 'chunks' AS name, count(DISTINCT h) AS value FROM d UNION ALL SELECT 'cache_hits', (SELECT count(*) FROM c) UNION ALL SELECT 'embedded', count(DISTINCT h) FROM d WHERE h NOT IN (SELECT h FROM c)
        UNION ALL SELECT 'chunks match the chunk stage', 0 UNION ALL SELECT 'every chunk has a vector', 0 UNION ALL SELECT 'every chunk has a source and a place', 0""",
    "probes_of_new": f"""
        WITH b AS (SELECT doc_id, regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9]+') AS ws FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
        u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM b),
        s AS (SELECT doc_id, {_STEM} AS stem, min(pos) AS pos FROM u WHERE length(w) > 1 AND w NOT IN ({_STOP_TEXT}) GROUP BY ALL),
        t AS (SELECT doc_id, string_agg(stem, ' ' ORDER BY pos) AS terms FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 4) GROUP BY doc_id)
        SELECT doc_id AS source_id, 'What does Document ' || doc_id || ' say about ' || coalesce(terms, 'its main rule') || '?' AS question FROM b LEFT JOIN t USING (doc_id)""",
    "notice_checks": """
        WITH e AS (SELECT event_id, event_id % 3 = 0 AS other, event_id % 5 = 0 AS back, event_id % 4 = 0 AS nowhere, event_id % 20 + 2 AS day, event_id % 12 + 1 AS month, event_id % 9 + 10 AS hour,
                          event_id % 9 + 9 AS early FROM events),
        f AS (SELECT *, '2026-' || lpad(CAST(month AS VARCHAR), 2, '0') || '-' || lpad(CAST(day AS VARCHAR), 2, '0') AS truth FROM e),
        g AS (SELECT *, concat_ws(',', CASE WHEN other AND day + 1 NOT IN (hour, CASE WHEN back THEN early ELSE hour + 2 END) THEN 'date' END, CASE WHEN back THEN 'start' END, CASE WHEN back THEN 'end' END) AS flagged FROM f)
        SELECT event_id, flagged, CASE WHEN flagged LIKE 'date%' THEN 'date' ELSE '' END AS missing,
               round_even((1 + CASE WHEN other THEN 0 ELSE 1 END + CASE WHEN back THEN 0 ELSE 2 END + CASE WHEN nowhere THEN 0 ELSE 1 END) / 5.0::DOUBLE, 2) AS field_accuracy,
               CASE WHEN other AND flagged NOT LIKE 'date%' THEN 'date' ELSE '' END AS wrong,
               CASE WHEN flagged LIKE 'date%' THEN '' WHEN other THEN '2026-' || lpad(CAST(month AS VARCHAR), 2, '0') || '-' || lpad(CAST(day + 1 AS VARCHAR), 2, '0') ELSE truth END AS date FROM g""",
    "manual_scoring": """
        SELECT conv_id * 100 + turn AS id, md5(c.text) AS answer, coalesce(array_to_string(string_split(b.text, ' ')[1:3], '; '), '') AS key_facts, '' AS faithfulness_1_5
        FROM conversations c LEFT JOIN benchmark b ON conv_id * 100 + turn = item_id * 100 + 1 WHERE role = 'assistant'""",
}
