"""The corpus pipeline: the stages a raw crawl goes through before training.

Each stage takes all documents that the one before it kept, and returns them in
the columns of documents; the last one returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import line_dedup, ngram_join, packing, suffix_dedup, toxicity
from cairn.llm.shared import documents, save, with_kept_text

PASSAGE_WORDS = 51

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model, learned from the labels, doesn't hold toxic."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least 10 of them share."""
    return with_kept_text(docs, line_dedup.line_dedup(docs, with_text=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group that links of word 5-grams with a similarity of 0.8 or more connect."""
    placed = ngram_join.ngram_join(docs, n=5, percent=80)
    gone = placed.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 400-byte strings and the passages of over 50 words that start more than once."""
    return with_kept_text(docs, suffix_dedup.suffix_dedup(docs, with_text=True, passage_words=PASSAGE_WORDS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("ngram_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_strings),
    ("packing", pack),
]

#: SQL can't express learned scores and byte-level tokens. tests/llm compares the operators but toxicity with brute force, and the stages only in what they keep and change.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each over the written output of the one before."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, f"pipeline-{name}").df
    return docs
