"""Passages, answers, arguments and ingest bookkeeping over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import arguments
from cairn.functions import text as T
from cairn.operators import answers, documents, retrieval


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    counts = [_t(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def cache_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.cache_version(_t(spark, sf_dir, "documents").select(T.chunk_id(F.col("source"), F.concat(F.lit("p"), "doc_id"), F.col("text")).alias("chunk_id")))


def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _t(spark, sf_dir, "documents").select("doc_id", T.chunk_hash(F.col("text")).alias("chunk_hash"))
    labels = _t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("model"))
    entries = _t(spark, sf_dir, "documents").join(labels, "doc_id").select(T.chunk_hash(F.col("text")).alias("chunk_hash"), "model", F.col("doc_id").alias("put"), F.col("n_chars").alias("vector"))
    latest = documents.put_vectors(entries.limit(0), entries, "put")
    return documents.with_vectors(chunks, latest, "a").select("doc_id", "vector")


def merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    counters = d.select(F.create_map(F.lit("lines"), F.size(F.split("text", "\n")).cast("long"), F.concat(F.lit("chars_"), "lang"), F.char_length("text").cast("long")).alias("counters"))
    return documents.merge_counters(counters, "counters")


def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("lang", "source", F.when(F.col("n_chars") > 1000, "changed").otherwise("new").alias("status"))
    return d.groupBy("status").pivot("lang", ["en", "de", "fr", "es"]).agg(F.count(F.lit(1))).na.fill(0)


def redated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.redated(_t(spark, sf_dir, "events").select("event_id", "ts"), "ts", "2026-10-16")
    return rows.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def converted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    direction = F.when(F.col("o_orderkey") % 2 == 0, "usd_to_khr").otherwise("khr_to_usd")
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.round(arguments.converted(F.col("o_totalprice"), F.lit(4100.0), direction), 1).alias("other"))


def request_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rows = _t(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", arguments.amount(t).alias("amount"), arguments.capacity(t).alias("capacity"), arguments.isbn(t).alias("isbn"), arguments.concept_topic(t).alias("topic"))


def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(arguments.nfc("text"), 256).alias("sha256"))


def long_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines that aren't blank, in order."""
    lines = F.posexplode(F.split("text", "\n")).alias("position", "line")
    rows = _t(spark, sf_dir, "documents").select("doc_id", lines).where(F.trim("line") != "")
    return answers.long_context(rows, "doc_id", "position").select("doc_id", "rank", "score", F.md5("line").alias("line"))


def decision_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", F.col("quality").cast("double").alias("has_answer"), (1 - F.col("toxic")).cast("double").alias("relevant"))
    return answers.decision_scores(rows).select("doc_id", F.round("score", 3).alias("score"))


def _candidates(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    bench = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    first = retrieval.bm25(bench, docs, k).join(docs.select("doc_id", "text"), "doc_id").join(bench.withColumnRenamed("text", "query"), "query_id")
    return first.select("query_id", "doc_id", "query", "text", "rank", "score")


def passage_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers.passage_answers(_candidates(spark, sf_dir, 5), ["query_id", "doc_id"])
    return rows.select("query_id", "doc_id", *(F.round(c, 4).alias(c) for c in ("relevant", "has_answer", "injection")))


def judged_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.judged(_candidates(spark, sf_dir, 10), 3).select("query_id", "doc_id", "rank", "first_stage_rank")


def checked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _candidates(spark, sf_dir, 3)
    answer = some.where("rank = 1").select(F.col("query_id").alias("answer_id"), F.col("query").alias("answer"))
    return answers.answer_check(answer, some.select(F.col("query_id").alias("answer_id"), "rank", "text"))


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers.judge_scores(_candidates(spark, sf_dir, 3).withColumnRenamed("query", "answer").drop("score"), ["query_id", "doc_id"])
    return rows.select("query_id", "doc_id", "score")


def rendered_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), place.alias("rank"), F.col("turn").alias("doc_id"), (1 / place).alias("score"), "text")
    return answers.rendered(rows).select("query_id", F.sha2("shown", 256).alias("sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        table_counts, cache_fingerprint, cached_vectors, merged_counters, stage_status, redated_events, converted_orders, request_arguments, normalised_text,
        long_context, decision_rerank, passage_questions, judged_passages, checked_answers, judge_scores, rendered_passages,
    )
}

SQL = {
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")),
    "cache_fingerprint": "SELECT count(*) AS n, CAST(coalesce(sum(length(substr(sha256(source || '|' || 'p' || doc_id || '|' || text), 1, 16))), 0) AS BIGINT) AS length FROM documents",
    "cached_vectors": """
        WITH e AS (SELECT sha256(text) AS h, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, doc_id, n_chars FROM documents JOIN labels USING (doc_id)),
        l AS (SELECT h, n_chars FROM e WHERE model = 'a' QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id DESC) = 1)
        SELECT d.doc_id, l.n_chars AS vector FROM documents d JOIN l ON sha256(d.text) = l.h""",
    "merged_counters": """
        SELECT 'lines' AS key, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n FROM documents
        UNION ALL SELECT 'chars_' || lang, CAST(sum(length(text)) AS BIGINT) FROM documents GROUP BY lang""",
    "stage_status": """
        SELECT CASE WHEN n_chars > 1000 THEN 'changed' ELSE 'new' END AS status, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de,
               count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY 1""",
    "redated_events": """
        SELECT event_id, strftime(ts + to_days(CAST(DATE '2026-10-16' - (SELECT CAST(min(ts) AS DATE) FROM events) AS INT)), '%Y-%m-%d %H:%M:%S') AS ts FROM events""",
    "converted_orders": """
        SELECT o_orderkey, round(round(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice::DOUBLE * 4100 ELSE o_totalprice::DOUBLE / 4100 END, 2), 1) AS other FROM orders""",
    "normalised_text": "SELECT doc_id, sha256(nfc_normalize(text)) AS sha256 FROM documents",
    "long_context": """
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS rank, 1.0::DOUBLE AS score, md5(line) AS line FROM l WHERE trim(line) <> ''""",
    "decision_rerank": """
        SELECT doc_id, round(0.6::DOUBLE * coalesce(quality, 0) + 0.4::DOUBLE * coalesce(1 - toxic, 0), 3) AS score FROM documents LEFT JOIN labels USING (doc_id)""",
    "rendered_passages": """
        WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
        SELECT conv_id AS query_id, sha256(string_agg('<source rank="' || k || '" id="' || turn || '" relevance="' || printf('%.3f', 1.0::DOUBLE / k) || '">' || chr(10) || text || chr(10) || '</source>',
               chr(10) ORDER BY k)) AS sha256 FROM r GROUP BY conv_id""",
}
