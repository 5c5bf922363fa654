"""The stages between files and an index, as frames: cleaning by format, embedding what is new, probes, and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.arguments import nfc
from cairn.operators import documents, retrieval
from cairn.operators.markdown import relevelled

COUNTERS = ("headers_footers", "page_numbers", "hyphen_joins", "control_chars", "html_comments", "tables_compacted", "headings_relevelled")
RULE_LINE = r"(?m)^[ \t]*\|(?:[ \t]*:?-[- ]*:?[ \t]*\|)+[ \t]*$"


def clean_units(units: DataFrame) -> DataFrame:
    """source_id, format, page, text, chars_before, chars_after, the COUNTERS and samples of units (source_id, format, page, text).

    Units of format pdf are pages, cleaned by their document's; all others are
    Markdown. A null text is empty. Other columns are not read.
    """
    given = units.select("source_id", "format", "page", F.coalesce("text", F.lit("")).alias("text"))
    before = F.char_length("text").alias("chars_before")
    pdf = given.where("format = 'pdf'")
    pages = documents.clean_pages(pdf).join(pdf.select("source_id", "page", before), ["source_id", "page"])
    pages = pages.withColumn("format", F.lit("pdf")).withColumns({c: F.lit(0) for c in COUNTERS[4:]})
    comments = F.regexp_extract_all(nfc(F.col("text")), F.lit(r"(?s)<!--.*?-->"), F.lit(0))
    md = given.where("format IS NULL OR format <> 'pdf'").select("*", before, comments.alias("comments"), _plain(F.col("text")).alias("compact"))
    md = md.withColumn("r", relevelled(F.col("compact")))
    md = md.select(
        "source_id", "page", F.lit("md").alias("format"), F.col("r.text").alias("text"), "chars_before", *(F.lit(0).alias(c) for c in COUNTERS[:4]),
        F.size("comments").alias("html_comments"), F.regexp_count("compact", F.lit(RULE_LINE)).alias("tables_compacted"), F.col("r.changed").alias("headings_relevelled"),
        F.transform(F.slice("comments", 1, 3), lambda c: F.left(c, F.lit(60))).alias("samples"),
    )
    both = pages.unionByName(md)
    return both.withColumn("chars_after", F.char_length("text")).select("source_id", "format", "page", "text", "chars_before", "chars_after", *COUNTERS, "samples")


def _plain(text: Column) -> Column:
    """A Markdown text cleaned but for its headings' levels."""
    plain = T.strip_comments(nfc(text))
    for pattern, new in ((r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        plain = F.regexp_replace(plain, pattern, new)
    return documents.compact_table_lines(plain)


def clean_stats(cleaned: DataFrame) -> DataFrame:
    """format, units, chars_before, chars_after and the sums of the COUNTERS."""
    sums = [F.sum(c).alias(c) for c in ("chars_before", "chars_after", *COUNTERS)]
    return cleaned.groupBy("format").agg(F.count("*").alias("units"), *sums)


def embed_new(chunks: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """The cache's new entries (chunk_hash, model, embedding) for chunks (chunk_hash, text) that it lacks, each text once; and chunks, cache_hits, embedded."""
    missing = documents.missing_vectors(chunks, cache, model)
    texts = chunks.join(missing, "chunk_hash", "left_semi").groupBy("chunk_hash").agg(F.min("text").alias("text"))
    new = retrieval.hashing_embedding(texts, "chunk_hash", "text").withColumn("model", F.lit(model))
    all_, lacking = chunks.agg(F.count_distinct("chunk_hash").alias("chunks")), missing.agg(F.count("*").alias("embedded"))
    stats = all_.join(lacking).select("chunks", (F.col("chunks") - F.col("embedded")).alias("cache_hits"), "embedded")  # one row with one row
    return new.select("chunk_hash", "model", "embedding"), stats


def generated_probes(docs: DataFrame, chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """source_id, question: one for each document (source_id, title) that has none among the existing (source_id), of its first chunk's (source_id, position, text) first four terms."""
    first = chunks.groupBy("source_id").agg(F.min(F.struct("position", "text")).alias("c")).select("source_id", F.col("c.text").alias("text"))
    new = docs.join(existing.select("source_id"), "source_id", "left_anti").join(first, "source_id")
    words = F.array_join(F.slice(T.terms(F.coalesce("text", F.lit(""))), 1, 4), " ")
    asked = F.concat(F.lit("What does "), F.coalesce("title", F.lit("the document")), F.lit(" say about "), F.coalesce(F.nullif(words, F.lit("")), F.lit("its main rule")), F.lit("?"))
    return new.select("source_id", asked.alias("question"))


def consistency(chunks: DataFrame, cache: DataFrame, model: str, expected: int) -> DataFrame:
    """check, ok, bad: whether as many chunks are stored as were made, each has a vector of the model, and each a source and a place (a page, or else a section)."""
    vectors = cache.where(F.col("model") == model).select("chunk_hash").distinct().withColumn("has", F.lit(1))
    homeless = F.col("source_id").isNull() | (F.col("page").isNull() & (F.coalesce("section", F.lit("")) == ""))
    counts = chunks.join(vectors, "chunk_hash", "left").agg(F.count("*").alias("n"), F.count_if(F.col("has").isNull()).alias("bare"), F.count_if(homeless).alias("homeless"))
    checks = (("chunks match the chunk stage", F.abs(F.col("n") - expected)), ("every chunk has a vector", F.col("bare")), ("every chunk has a source and a place", F.col("homeless")))
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("check"), (bad == 0).alias("ok"), bad.cast("long").alias("bad")) for name, bad in checks)))
    return counts.select(rows.alias("r")).select("r.*")


def batches(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """Rows with their batch of at most ``size``, in order: numbered within hash parts, so no task holds all."""
    part = F.pmod(F.xxhash64(*order), F.lit(64))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return rows.withColumn("part", part).withColumn("batch", F.struct("part", F.floor(place / size).alias("number"))).drop("part")
