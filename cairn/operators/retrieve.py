"""Retrieval in modes: a first stage by words, by vectors or by both, then perhaps a reranker or a judge.

Every passage of the result carries the signals that placed it: its ranks and scores
in each list, the fused score, its rank before the second stage, and what that
gave. What a floor or a judge dropped comes back too, with its reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import answers, retrieval
from cairn.sources.shared import new_dir

MODES = ("lexical", "dense", "hybrid", "dense+rerank", "hybrid+rerank", "dense+judge")
SCORE_TYPES = {"lexical": "bm25 (higher is better)", "dense": "cosine", "hybrid": "reciprocal-rank fusion", "rerank": "local rerank heuristic (coverage, bigrams, first-stage rank)", "judge": "judge has_answer"}
SIGNALS = {"lexical_rank": "int", "bm25": "double", "dense_rank": "int", "cosine": "double", "rrf": "double", "first_stage_rank": "int", "relevance": "double", "has_answer": "double"}


@dataclass(frozen=True)
class Store:
    """Passages (doc_id, text, perhaps source_id) and their vectors (doc_id, embedding), with the vectors of queries made alike."""

    passages: DataFrame
    vectors: DataFrame | None = None
    name: str = "exact"

    @classmethod
    def hashing(cls, passages: DataFrame) -> Store:
        """A store whose vectors come from the hashing encoder, so that it needs no model."""
        return cls(passages, retrieval.hashing_embedding(passages, "doc_id", "text"), "hashing")

    def asked(self, queries: DataFrame) -> DataFrame:
        return retrieval.hashing_embedding(queries, "query_id", "text").withColumnRenamed("embedding", "vector")


@dataclass(frozen=True)
class Retrieved:
    """chunks: query_id, doc_id, rank, score, score_type, store, signals, text; dropped: the same without rank, with the reason."""

    chunks: DataFrame
    dropped: DataFrame


@dataclass(frozen=True)
class Lists:
    """The first ``depth`` passages of each query by words and by vectors (query_id, doc_id, score, rank), written once for the modes that begin with them."""

    words: DataFrame | None
    near: DataFrame | None
    depth: int


def _sizes(mode: str, k: int, pool: int) -> tuple[int, int]:
    """How many passages a mode's first stage keeps, and how deep its lists have to be."""
    base, _, second = mode.partition("+")
    n = max(k, pool) if second == "rerank" else 2 * k if second == "judge" else k
    return n, n * 3 if base == "hybrid" and n <= 10 else n


def searched(queries: DataFrame, store: Store, modes: tuple[str, ...] = MODES, k: int = 4, pool: int = 20, query_vectors: DataFrame | None = None) -> Lists:
    """The lists that all of some modes need, searched for and written once."""
    depth, bases, spark = max(_sizes(m, k, pool)[1] for m in modes), {m.partition("+")[0] for m in modes}, queries.sparkSession

    def written(found: DataFrame) -> DataFrame:
        path = new_dir(spark, "lists")
        found.write.parquet(path)
        return spark.read.parquet(path)

    words = written(retrieval.bm25(queries, store.passages, depth)) if bases - {"dense"} else None
    near = written(retrieval.dense(query_vectors if query_vectors is not None else store.asked(queries), store.vectors, depth, "doc_id")) if bases - {"lexical"} else None
    return Lists(words, near, depth)


def _first_stage(base: str, n: int, deep: int, lists: Lists) -> DataFrame:
    none = lambda *names: {c: F.lit(None).cast(SIGNALS[c]) for c in names}
    first = lambda found: found.where(F.col("rank") <= deep)
    if base == "lexical":
        return first(lists.words).withColumns({"lexical_rank": F.col("rank"), "bm25": F.col("score"), **none("dense_rank", "cosine", "rrf")})
    if base == "dense":
        return first(lists.near).withColumns({"dense_rank": F.col("rank"), "cosine": F.bround("score", 5), "score": F.bround("score", 5), **none("lexical_rank", "bm25", "rrf")})
    return retrieval.fused(first(lists.words), first(lists.near).withColumn("score", F.bround("score", 5)), n).withColumn("rrf", F.col("score"))


def retrieve(
    queries: DataFrame, store: Store, mode: str = "hybrid", k: int = 4, pool: int = 20, query_vectors: DataFrame | None = None, floor: float = 0.0, without_source: str | None = None,
    lists: Lists | None = None,
) -> Retrieved:
    """The first ``k`` passages of each query (query_id, text) in a mode; ValueError for an unknown mode or a store that has no vectors for it.

    A reranker sees a pool of ``max(k, pool)`` passages, a judge twice ``k``. Sources
    that begin with ``without_source`` leave the first stage's list, so fewer than
    asked for may remain. A query without search terms finds nothing by words.
    ``lists`` are those that ``searched`` found, where several modes share them.
    """
    if mode not in MODES:
        raise ValueError(f"unknown retrieval mode {mode!r}; modes: {', '.join(MODES)}")
    base, _, second = mode.partition("+")
    if base != "lexical" and store.vectors is None:
        raise ValueError(f"the store {store.name!r} has no vectors")
    size, deep = _sizes(mode, k, pool)
    lists = lists or searched(queries, store, (mode,), k, pool, query_vectors)
    if deep > lists.depth:
        raise ValueError(f"{mode!r} needs {deep} passages of each list, not {lists.depth}")
    found = _first_stage(base, size, deep, lists)
    found = found.join(store.passages.select("doc_id", "text", *[c for c in ("source_id",) if c in store.passages.columns]), "doc_id")
    if without_source is not None:
        found = found.where(~F.col("source_id").startswith(without_source)).drop("rank")
        found = retrieval.ranked(found, size, F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("dense_rank"), F.asc("doc_id"))
    found = found.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    name = "fts" if base == "lexical" else f"fts+{store.name}" if base == "hybrid" else store.name
    signals = ["lexical_rank", "bm25", "dense_rank", "cosine", "rrf"]
    if second == "rerank":
        scored = retrieval.rerank(found, size)  # all of the pool, in their new order
        scored = scored.withColumn("relevance", F.col("score")).withColumn("has_answer", F.lit(None).cast("double"))
        kept, gone = scored.where(F.col("relevance") >= floor), scored.where(F.col("relevance") < floor).withColumn("reason", F.lit("below the floor"))
        kept = kept.where(F.col("rank") <= k)
    elif second == "judge":
        asked = answers.passage_answers(found, ["query_id", "doc_id"]).withColumn("first_stage_rank", F.col("rank")).withColumn("score", F.bround("has_answer", 4))
        asked = asked.withColumn("reason", _judged(F.col("injection"), F.col("relevant"))).withColumn("has_answer", F.col("score")).withColumn("relevance", F.bround("relevant", 4))
        kept = retrieval.ranked(asked.where("reason IS NULL").drop("rank"), k, F.desc("score"), F.asc("first_stage_rank"))
        gone = asked.where("reason IS NOT NULL")
    else:
        kept = found.withColumns({"first_stage_rank": F.lit(None).cast("int"), "relevance": F.lit(None).cast("double"), "has_answer": F.lit(None).cast("double")}).where(F.col("rank") <= k)
        gone = kept.limit(0).withColumn("reason", F.lit(""))
    signals += ["first_stage_rank", "relevance", "has_answer"]
    shown = ["query_id", "doc_id", "score", F.lit(SCORE_TYPES[second or base]).alias("score_type"), F.lit(name).alias("store"), F.struct(*(F.col(c).cast(SIGNALS[c]).alias(c) for c in signals)).alias("signals"), "text"]
    return Retrieved(kept.select("rank", *shown), gone.select("reason", *shown))


def _judged(injection: Column, relevant: Column, above: float = 0.70, least: float = 0.45) -> Column:
    """Why a judge drops a passage; null if it stays."""
    return F.when(injection > above, "injection").when(relevant < least, "not relevant")


def describe(row: Column) -> Column:
    """One line for a log: the rank, the score, and every signal there is."""
    s = row["signals"]
    parts = [
        F.concat(F.lit("#"), row["rank"]), F.concat(row["score_type"], F.lit(" "), F.format_string("%.4f", row["score"])),
        F.when(s["relevance"].isNotNull(), F.concat(F.lit("relevance "), F.format_string("%.3f", s["relevance"]))),
        F.when(s["lexical_rank"].isNotNull(), F.concat(F.lit("lexical #"), s["lexical_rank"], F.format_string(" (bm25 %.2f)", s["bm25"]))),
        F.when(s["dense_rank"].isNotNull(), F.concat(F.lit("dense #"), s["dense_rank"], F.format_string(" (cos %.3f)", s["cosine"]))),
        F.when(s["rrf"].isNotNull(), F.concat(F.lit("rrf "), F.format_string("%.4f", s["rrf"]))),
        F.when(s["first_stage_rank"].isNotNull(), F.concat(F.lit("first-stage #"), s["first_stage_rank"])),
    ]
    return F.concat_ws("  ", *parts)


def compare(queries: DataFrame, stores: dict[str, Store], modes: tuple[str, ...] = MODES[:-1], k: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every mode over every store: the chunks of all combinations, and how many ids each two share; words alone don't depend on the store."""
    runs = [(m, s) for m in modes for s in (list(stores)[:1] if m == "lexical" else stores)]
    lists = {s: searched(queries, stores[s], own, k) for s in stores if (own := tuple(m for m, of in runs if of == s))}
    each = [retrieve(queries, stores[s], m, k, lists=lists[s]).chunks.withColumn("combination", F.lit(m if m == "lexical" else f"{m} @ {s}")) for m, s in runs]
    whole = each[0]
    for some in each[1:]:
        whole = whole.unionByName(some)
    return whole, retrieval.overlap_matrix(whole)
