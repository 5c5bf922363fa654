"""Scores of answers by several judges: rows for people to score, their scores merged back, and where judges disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.answers import claim_support, judge_scores
from cairn.operators.evaluation import disagreement, supported_score
from cairn.functions import text as T

COLUMNS = ("id", "category", "language", "message", "answer", "key_facts", "faithfulness_1_5", "correctness_1_5", "notes")
JUDGES = ("judge_model", "judge_claims", "judge_human")


def manual_rows(results: DataFrame, cases: DataFrame) -> DataFrame:
    """The COLUMNS of the results (id, kind, category, language, message, answer) that are answers, with their cases' facts (id, key_facts) and empty scores."""
    facts = cases.select("id", F.array_join("key_facts", "; ").alias("key_facts"))
    rows = results.where("kind = 'answer'").join(facts, "id", "left").withColumn("key_facts", F.coalesce("key_facts", F.lit("")))
    return rows.select(*COLUMNS[:6], *(F.lit("").alias(c) for c in COLUMNS[6:]))


def write_manual(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def human_scores(filled: DataFrame) -> DataFrame:
    """id, judge_human of rows that somebody filled; a row filled twice counts with its larger score."""
    score = F.col("faithfulness_1_5").try_cast("double")
    return filled.where(score.isNotNull()).groupBy("id").agg(F.max(score).alias("judge_human"))


def judged(results: DataFrame, passages: DataFrame, human: DataFrame) -> DataFrame:
    """Results with the JUDGES' scores, 1 to 5, null where one can't judge: what isn't an answer, has no passages (id, rank, text), or no claim of more than three words."""
    answers = results.where("kind = 'answer'").select("id", "answer")
    joined = passages.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("text"))
    pairs = answers.join(joined, "id")
    model = judge_scores(pairs, ["id"]).select("id", F.col("score").cast("double").alias("judge_model"))
    said = T.sentences(F.regexp_replace("answer", r"\[[^\]]+\]", ""))
    claims = pairs.select("id", "text", F.posexplode(F.filter(said, lambda s: F.size(F.split(F.trim(s), r"\s+")) > 3)).alias("pos", "claim"))
    by_claims = claim_support(claims, ["id", "pos"]).groupBy("id").agg(supported_score(F.col("label")).alias("judge_claims"))
    return results.join(model, "id", "left").join(by_claims, "id", "left").join(human, "id", "left")


def apart(rows: DataFrame, gap: float = 2.0) -> DataFrame:
    """Judged rows whose judges are at least ``gap`` apart."""
    return disagreement(rows, list(JUDGES), gap)
