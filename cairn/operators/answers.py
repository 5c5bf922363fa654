"""Judging passages, claims and answers, and showing passages to a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators.retrieval import passage_filter, ranked, with_coverage
from cairn.operators.rules import PASSAGE_INJECTION, says

# Shares that the rules give, the notes that controls leave.
IS_INJECTION, NO_INJECTION = 0.92, 0.02
CONTRADICTS = 0.03
GUARDS = ("injection", "other_account", "misconduct")
NOTES = {"passage filter dropped": "passage_filter", "untrusted tool text withheld": "tool_text_filter", "answer check failed": "answer_check"}


def passage_answers(pairs: DataFrame, keys: list[str], query: str = "query", passage: str = "text") -> DataFrame:
    """Pairs, unique by ``keys``, with relevant, has_answer, injection and contradicts."""
    c = F.col("coverage")
    rows = with_coverage(pairs, keys, query, passage)
    return rows.select(
        *pairs.columns,
        F.least(F.lit(1.0), 0.1 + c).alias("relevant"),
        F.when(c >= 0.6, 0.8).otherwise(0.7 * c).alias("has_answer"),
        F.when(says(passage, PASSAGE_INJECTION), IS_INJECTION).otherwise(NO_INJECTION).alias("injection"),
        F.lit(CONTRADICTS).alias("contradicts"),
    )


def judged(candidates: DataFrame, k: int = 5) -> DataFrame:
    """Of rows with query, text and rank: the k that may be shown and are likeliest to hold the answer, in their order among equals."""
    rows = passage_filter(passage_answers(candidates, ["query_id", "doc_id"])).withColumnRenamed("rank", "first_stage_rank")
    return ranked(rows, k, F.desc("has_answer"), F.asc("first_stage_rank"))


def decision_scores(rows: DataFrame) -> DataFrame:
    """Rows with verdicts (has_answer, relevant) and their score; a missing verdict counts 0."""
    return rows.withColumn("score", 0.6 * F.coalesce("has_answer", F.lit(0.0)) + 0.4 * F.coalesce("relevant", F.lit(0.0)))


def long_context(chunks: DataFrame, source: str = "source_id", *order: str) -> DataFrame:
    """All chunks of each source in reading order, every one with score 1."""
    place = F.row_number().over(Window.partitionBy(source).orderBy(*(F.asc_nulls_first(c) for c in order)))
    return chunks.withColumn("rank", place).withColumn("score", F.lit(1.0))


def claim_support(pairs: DataFrame, keys: list[str], claim: str = "claim", passage: str = "text") -> DataFrame:
    """Pairs with label: supports from half of the claim's weight on, else says_nothing; and its confidence."""
    rows = with_coverage(pairs, keys, claim, passage)
    return rows.select(*pairs.columns, F.when(F.col("coverage") >= 0.5, "supports").otherwise("says_nothing").alias("label"), F.lit(0.9).alias("confidence"))


def answer_check(answers: DataFrame, passages: DataFrame, threshold: float = 0.80) -> DataFrame:
    """answer_id, claims, supported of answers (answer_id, answer): whether the cited passages (answer_id, rank, text) support every sentence of more than three words.

    Answers without such a sentence or without passages aren't checked: supported is null.
    """
    said = T.sentences(F.regexp_replace("answer", r"\[[^\]]+\]", ""))
    claims = answers.select("answer_id", F.posexplode(F.filter(said, lambda s: F.size(F.split(F.trim(s), r"\s+")) > 3)).alias("pos", "claim"))
    joined = passages.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("text"))
    verdicts = claim_support(claims.join(joined, "answer_id"), ["answer_id", "pos"])
    checked = verdicts.groupBy("answer_id").agg(F.count("*").alias("claims"), F.bool_and((F.col("label") == "supports") & (F.col("confidence") >= threshold)).alias("supported"))
    return answers.select("answer_id").join(checked, "answer_id", "left").select("answer_id", F.coalesce("claims", F.lit(0)).alias("claims"), "supported")


def screened(text: Column, above: float = 0.70) -> Column:
    """A tool's text from outside, or null if it carries instructions."""
    share = F.when(says(text, PASSAGE_INJECTION), IS_INJECTION).otherwise(NO_INJECTION)
    return F.when(share <= above, text)


def judge_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (answer, text) with score, 1 to 5: how much of the answer's weight the text has."""
    rows = with_coverage(pairs, keys, "answer", "text")
    return rows.select(*pairs.columns, F.greatest(F.lit(1), F.least(F.lit(5), F.bround(1 + 4 * F.col("coverage")).cast("int"))).alias("score"))


def controls_fired(rows: DataFrame, max_tool_calls: int | None = None) -> DataFrame:
    """Add fired, the controls that acted, from kind, notes (array of strings) and calls (array of tool, ok)."""
    notes = F.concat_ws(" | ", "notes")
    calls = F.coalesce(F.size("calls"), F.lit(0))
    calls = F.when(calls < 0, 0).otherwise(calls)
    refused = F.col("kind").eqNullSafe(F.lit("refuse"))
    fired = [F.when(refused & (F.contains(notes, F.lit(f"policy: {g}")) | F.contains(notes, F.lit(f"review:{g}"))), f"guard:{g}") for g in GUARDS]
    fired.append(F.when(refused & F.contains(notes, F.lit("guard_severity")), "guard:severity"))
    fired += [F.when(F.contains(notes, F.lit(note)), name) for note, name in NOTES.items()]
    few = calls <= max_tool_calls if max_tool_calls else F.lit(False)  # no limit of 0
    fired.append(F.when(F.contains(notes, F.lit("agent stopped: limit")) | few, "loop_limit"))
    fired.append(F.when(F.coalesce(F.exists("calls", lambda c: (c["tool"] == "get_loans") & c["ok"]), F.lit(False)), "parameterised_sql"))
    return rows.withColumn("fired", F.array_compact(F.array(*fired)))


def rendered(passages: DataFrame) -> DataFrame:
    """query_id, shown: each query's passages (rank, doc_id, score, text), best first, in source tags."""
    tag = F.concat(F.lit('<source rank="'), "rank", F.lit('" id="'), "doc_id", F.lit('" relevance="'), F.format_string("%.3f", F.col("score")), F.lit('">\n'), "text", F.lit("\n</source>"))
    each = passages.select("query_id", "rank", tag.alias("shown"))
    return each.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "shown"))), lambda x: x["shown"]), "\n").alias("shown"))


def valid_citations(citations: DataFrame, provided: DataFrame, answer: str = "answer_id") -> DataFrame:
    """Citations (answer, position, source_id, page, section) as the first passage, by rank, of those provided that each means; others are dropped.

    A citation without a page means any page of its source, one without a section
    any section; one with a section also a passage that has none. So a passage is
    known by a few keys and a citation asks for one or two of them, and both meet
    by equality. A citation without a source means nothing; equal ranks go by page and section.
    """
    no = F.lit("-")
    page = lambda c: F.concat(F.lit("p"), c.cast("string"))
    section = lambda c: F.concat(F.lit("s"), c)
    bare = F.coalesce(F.col("section"), F.lit("")) == ""
    passages = provided.withColumn("page_key", F.explode(F.array_compact(F.array(no, page(F.col("page"))))))
    passages = passages.withColumn("section_key", F.explode(F.array(no, F.when(bare, F.lit("s")).otherwise(section(F.col("section"))))))
    best = passages.groupBy(answer, "source_id", "page_key", "section_key").agg(F.min(F.struct("rank", "page", "section")).alias("meant"))
    asked = citations.withColumn("page_key", F.coalesce(page(F.col("page")), no)).drop("page")
    asked = asked.withColumn("section_key", F.explode(F.when(F.col("section").isNull(), F.array(no)).otherwise(F.array_distinct(F.array(section(F.col("section")), F.lit("s"))))))
    found = asked.drop("section").join(best, [answer, "source_id", "page_key", "section_key"])
    first = found.groupBy(answer, "position", "source_id").agg(F.min("meant").alias("meant"))
    return first.select(answer, "position", "source_id", "meant.page", "meant.section")


def cited_passages(passages: DataFrame, citations: DataFrame, answer: str = "answer_id") -> DataFrame:
    """The passages that an answer's valid citations name: by page, or without one by section; a citation without a section names all of a page."""
    named = citations.select(answer, "source_id", F.coalesce(F.col("page").cast("string"), F.lit("")).alias("page_key"), F.coalesce("section", F.lit("")).alias("section_key")).distinct()
    keys = F.array_distinct(F.array(F.when(F.col("page").isNull(), F.coalesce("section", F.lit(""))).otherwise(F.lit("")), F.lit("")))
    asked = passages.withColumn("page_key", F.coalesce(F.col("page").cast("string"), F.lit(""))).withColumn("section_key", F.explode(keys))
    kept = asked.join(named, [answer, "source_id", "page_key", "section_key"], "left_semi")
    return kept.drop("page_key", "section_key").distinct()
