"""Ranking passages for many queries in one job: lexical, dense, fused, reranked.

Everything is keyed by query_id. Queries may be many: they meet passages in blocks,
each of which keeps the first few of a query.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators.blocks import Search, meet
from cairn.sources.shared import new_dir

K1, B, RRF = 1.2, 0.75, 60


def search_terms(text: Column) -> Column:
    """A query's distinct terms: words or Khmer runs, without stop words and single characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9]+|[{T.KHMER}]+"), F.lit(0))
    stop = F.array(*map(F.lit, T.SEARCH_STOP_WORDS))
    return F.array_distinct(F.filter(found, lambda t: ~F.array_contains(stop, t) & (F.char_length(t) > 1)))


def ranked(rows: DataFrame, k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first k rows of each query, with their rank."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col(name) <= k)


def postings(passages: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc_id, tf, length of the listed terms, written; and of the empty term, which every passage has once.

    An outer explode, as Spark would add a condition on the words to a plain one and split every text twice.
    """
    base = passages.select(F.col(id_col).alias("doc_id"), T.words(F.coalesce(text_col, F.lit(""))).alias("ws"))
    listed = terms.select("term").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term")))
    each = base.select("doc_id", F.size("ws").alias("length"), F.explode_outer(F.concat("ws", F.array(F.lit("")))).alias("term")).join(listed, "term", "left_semi")
    path = new_dir(passages.sparkSession, "postings")
    each.groupBy("term", "doc_id", "length").agg(F.count("*").cast("int").alias("tf")).write.parquet(path)
    return passages.sparkSession.read.parquet(path)


def containing(queries: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id: passages that hold a query's whole text.

    A query meets the passages that have the rarest of its inner words, which its
    text brings along whole; only there the texts are compared. Queries without an inner
    word are compared with all passages. An empty query is in every passage, a null one in none.
    """
    inner = F.expr("slice(ws, 2, greatest(size(ws) - 2, 0))")
    asked = queries.where("text IS NOT NULL").withColumn("ws", T.words(F.col("text"))).select("query_id", F.col("text").alias("query"), F.array_distinct(inner).alias("ws"))
    each = asked.select("query_id", F.explode("ws").alias("term"))
    index = postings(passages, each.select("term").distinct(), id_col, text_col)
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    rarest = each.join(frequency, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r"))
    met = rarest.select("query_id", F.col("r.term").alias("term")).join(index.select("term", "doc_id"), "term").select("query_id", "doc_id")
    texts = passages.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("passage"))
    found = met.join(texts, "doc_id").join(asked.select("query_id", "query"), "query_id").where(F.contains("passage", "query")).select("query_id", "doc_id")
    short = asked.where(F.size("ws") == 0).join(texts, F.contains("passage", "query")).select("query_id", "doc_id")
    return found.unionByName(short)


BLOCK_PASSAGES, SLICE_QUERIES, AT_ONCE = 8192, 1 << 16, 256


def _best(scores: np.ndarray, ids: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k largest scores, rounded, ties to the smaller id; scores that are nan are none."""
    rounded = np.round(scores, digits)
    at = np.flatnonzero(~np.isnan(rounded))
    if len(at) > k:
        least = np.partition(rounded[at], len(at) - k)[len(at) - k]
        at = at[rounded[at] >= least]
    at = at[np.lexsort((ids[at], -rounded[at]))][:k]
    return at, rounded[at]


FOUND = "query_id long, doc_id long, score double"


def _found(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ids = np.repeat(np.array([q for q, _, _ in rows], np.int64), [len(d) for _, d, _ in rows])
    columns = [ids, *(np.concatenate([r[k] for r in rows]) if rows else [] for k in (1, 2))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "doc_id", "score"])


def _by_terms(k: int) -> Callable[[pa.Table], Search]:
    def begin(held: pa.Table) -> Search:
        ids, doc = np.unique(held["doc_id"].to_numpy(), return_inverse=True)
        term, weight = held["term"].combine_chunks().dictionary_encode(), held["weight"].to_numpy()
        code = {t: c for c, t in enumerate(term.dictionary.to_pylist())}
        at = term.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(code) + 1))
        doc, weight = doc[order], weight[order]

        def search(queries: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for query, terms in zip(queries["query_id"].to_pylist(), queries["terms"].to_pylist(), strict=True):
                lists = [slice(ends[c], ends[c + 1]) for c in sorted(code[t] for t in terms if t in code)]
                if lists:
                    scores = np.bincount(np.concatenate([doc[x] for x in lists]), np.concatenate([weight[x] for x in lists]), len(ids))
                    scores[scores == 0] = np.nan  # weights are above 0
                    best, score = _best(scores, ids, k, 5)
                    out.append((query, ids[best], score))
            return _found(out)

        return search

    return begin


def bm25(queries: DataFrame, passages: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id, score, rank. Terms that half of the passages have weigh next to nothing.

    Only the queries' terms are indexed. Blocks of
    passages then score queries as they stream by and keep the first k of each. Ids are integers.
    """
    asked = queries.select("query_id", search_terms(F.coalesce("text", F.lit(""))).alias("terms"))
    all_ = postings(passages, asked.select(F.explode("terms").alias("term")).distinct(), id_col, text_col)
    index = all_.where("term <> ''")
    n, mean = all_.where("term = ''").agg(F.count("*"), F.avg("length")).first()
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    weight = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
    tf, norm = F.col("tf").cast("double"), F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(mean or 1.0)
    weighed = index.join(frequency, "term").select("doc_id", "term", (weight * tf * (K1 + 1) / (tf + K1 * norm)).alias("weight"))
    found = meet(weighed, asked, "doc_id", _by_terms(k), FOUND, BLOCK_PASSAGES, SLICE_QUERIES, n_left=n)
    return ranked(found, k, F.desc("score"), F.asc("doc_id"))


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A matrix of unit vectors, one row per list; a vector of zeros stays, a null or one of another length is of nans."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    most = max(width.max(initial=0), 0)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.full((len(width), most), np.nan)
    own = width == most
    out[own] = values[np.repeat(own, np.maximum(width, 0))].reshape(-1, most) if most else 0
    length = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.where(length == 0, 1.0, length)[:, None]


def _by_cosine(k: int) -> Callable[[pa.Table], Search]:
    def begin(held: pa.Table) -> Search:
        ids, own = held["doc_id"].to_numpy(), _vectors(held["vector"])

        def search(queries: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for at in range(0, queries.num_rows, AT_ONCE):
                some = queries.slice(at, AT_ONCE)
                scores = _vectors(some["vector"]) @ own.T
                out += [(q, ids[best], score) for q, row in zip(some["query_id"].to_pylist(), scores, strict=True) for best, score in [_best(row, ids, k, 6)]]
            return _found(out)

        return search

    return begin


def dense(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, doc_id, score, rank: exact cosine of queries (query_id, vector) with all vectors, block by block; ids are integers."""
    plain = lambda rows, c: F.col(c) if dict(rows.dtypes)[c] == "array<float>" else F.col(c).cast("array<double>")
    held = vectors.select(F.col(id_col).cast("long").alias("doc_id"), plain(vectors, vector_col).alias("vector"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), plain(queries, "vector").alias("vector"))
    found = meet(held, asked, "doc_id", _by_cosine(k), FOUND, BLOCK_PASSAGES, SLICE_QUERIES, n_left=held.count())
    return ranked(found, k, F.desc("score"), F.asc("doc_id"))


def fused(lexical: DataFrame, dense_: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal-rank fusion; ties go to the lexical list's order."""
    a = lexical.select("query_id", "doc_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("bm25"))
    b = dense_.select("query_id", "doc_id", F.col("rank").alias("dense_rank"), F.col("score").alias("cosine"))
    share = lambda c: F.coalesce(F.lit(1.0) / (RRF + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query_id", "doc_id"], "full_outer").withColumn("score", F.bround(share("lexical_rank") + share("dense_rank"), 5))
    return ranked(both, k, F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("dense_rank"))


def with_coverage(pairs: DataFrame, keys: list[str], query: str = "query", passage: str = "text", name: str = "coverage") -> DataFrame:
    """Pairs, unique by ``keys``, with the share of the query's stems, weighted by word length, that the passage has; or of its Khmer windows, if larger."""
    word = pairs.select(*keys, F.explode(T.content_words(F.col(query))).alias("w"))
    wanted = word.groupBy(*keys, T.stem(F.col("w")).alias("feature")).agg(F.max(F.char_length("w")).alias("n"), F.lit(0).alias("kind"))
    grams = pairs.select(*keys, F.explode(T.khmer_grams(F.col(query))).alias("feature")).select(*keys, "feature", F.lit(1).alias("n"), F.lit(1).alias("kind"))
    there = pairs.select(*keys, F.explode(F.array_union(T.terms(F.col(passage)), T.khmer_grams(F.col(passage)))).alias("feature"), F.lit(True).alias("found"))
    both = wanted.unionByName(grams).join(there, [*keys, "feature"], "left")
    share = both.groupBy(*keys, "kind").agg((F.sum(F.when(F.col("found"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    best = share.groupBy(*keys).agg(F.max("share").alias(name))
    return pairs.join(best, keys, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def rerank(candidates: DataFrame, k: int = 5, floor: float = 0.0) -> DataFrame:
    """0.6 coverage + 0.15 share of the query's pairs of neighbouring stems + 0.25 prior by first rank, of rows with query, text and rank."""
    of_query = Window.partitionBy("query_id")
    q, p = (T.bigrams(F.transform(T.content_words(F.col(c)), T.stem)) for c in ("query", "text"))
    q = F.array_distinct(q)
    hits = F.when(F.size(q) > 0, F.size(F.array_intersect(q, p)) / F.size(q)).otherwise(F.lit(0.0))
    prior = F.lit(1.0) - (F.col("rank") - 1) / F.count("*").over(of_query)
    scored = with_coverage(candidates, ["query_id", "doc_id"]).withColumn("score", F.bround(0.6 * F.col("coverage") + 0.15 * hits + 0.25 * prior, 5))
    kept = scored.withColumnRenamed("rank", "first_stage_rank").where(F.col("score") >= floor)
    return ranked(kept, k, F.desc("score"), F.asc("first_stage_rank"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))


def passage_filter(rows: DataFrame, missing_relevant: float = 1.0, injection_above: float = 0.70, relevant_from: float = 0.45) -> DataFrame:
    """Passages that carry no instructions and are relevant; what a missing relevance counts as is the caller's choice."""
    return rows.where(~(F.coalesce("injection", F.lit(0.0)) > injection_above) & (F.coalesce("relevant", F.lit(missing_relevant)) >= relevant_from))


def without_prefix(rows: DataFrame, prefix: str, column: str = "doc_id") -> DataFrame:
    """Applied to what a limit kept, so fewer rows can remain."""
    return rows.where(~F.col(column).startswith(prefix))


def overlap_matrix(results: DataFrame) -> DataFrame:
    """first, second, overlap: how many ids each two combinations share; pairs that share none count 0."""
    names = results.select("combination").distinct()
    pairs = names.select(F.col("combination").alias("first")).join(names.select(F.col("combination").alias("second")), F.col("first") < F.col("second"))
    a = results.select(F.col("combination").alias("first"), "query_id", "doc_id")
    shared = a.join(results.select(F.col("combination").alias("second"), "query_id", "doc_id"), ["query_id", "doc_id"]).where(F.col("first") < F.col("second"))
    counted = shared.groupBy("first", "second").agg(F.count("*").alias("n"))
    return pairs.join(counted, ["first", "second"], "left").select("first", "second", F.coalesce("n", F.lit(0)).alias("overlap"))


def hit_rate(results: DataFrame, truth: DataFrame, k: int = 3) -> DataFrame:
    """n, hits, rate to 3 decimals: queries that find one of their true ids among the first k."""
    found = results.where(F.col("rank") <= k).join(truth, ["query_id", "doc_id"]).select("query_id").distinct().withColumn("hit", F.lit(1))
    asked = truth.select("query_id").distinct().join(found, "query_id", "left")
    return asked.agg(F.count("*").alias("n"), F.count("hit").alias("hits"), F.bround(F.count("hit") / F.count("*"), 3).alias("rate"))


WORD, KHMER_RUN, STOP = re.compile("[a-z0-9]+"), re.compile("[\u1780-\u17ff]+"), frozenset(T.EMBEDDING_STOP_WORDS)


def hashing_features(text: str) -> list[str]:
    """Words, pairs of neighbours joined by _, and Khmer windows, each as often as it occurs."""
    own = [w for w in WORD.findall(text.lower()) if w not in STOP]
    grams = [r[k : k + 3] for r in KHMER_RUN.findall(text) for k in range(max(1, len(r) - 2))]
    return [*own, *map("_".join, zip(own, own[1:], strict=False)), *grams]


@lru_cache(1 << 17)
def _cell(feature: str, dims: int) -> int:
    """A feature's place, of the second half of all if its sign is minus."""
    m = md5(feature.encode(), usedforsecurity=False).digest()
    return int.from_bytes(m[:4], "little") % dims + (0 if m[4] % 2 else dims)


def _hashed(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            some = batch.slice(at, AT_ONCE)
            out = np.zeros((some.num_rows, dims), np.float32)
            for row, text in enumerate(some["text"]):
                n = np.bincount([_cell(f, dims) for f in hashing_features(text.as_py() or "")] or [0, dims], minlength=2 * dims)
                v = (n[:dims] - n[dims:]).astype(np.float64)
                out[row] = v / (np.sqrt((v * v).sum()) or 1.0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dims), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([some["id"], lists], names=["id", "embedding"])


def hashing_embedding(rows: DataFrame, id_col: str, text_col: str, dims: int = 512) -> DataFrame:
    """id, embedding: md5 of each feature gives its place and sign; unit length, or zeros without features."""
    given = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = given.mapInArrow(lambda batches: _hashed(batches, dims), f"id {dict(given.dtypes)['id']}, embedding array<float>")
    return made.withColumnRenamed("id", id_col)


def extractive_answer(passages: DataFrame, abstain_below: float = 0.6) -> DataFrame:
    """query_id, doc_id, answer: the two best sentences of the best passage; no answer where coverage is low."""
    scored = with_coverage(passages, ["query_id", "doc_id"])
    best = ranked(scored, 1, F.desc("coverage"), F.asc("rank"), name="place")
    parts = best.select("query_id", "doc_id", "query", "coverage", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    two = ranked(with_coverage(parts, ["query_id", "pos"], passage="sentence", name="c"), 2, F.desc("c"), F.asc("pos"), name="place")
    said = two.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda x: x["sentence"]), " ").alias("said"))
    return best.join(said, "query_id", "left").select("query_id", "doc_id", F.when(F.col("coverage") >= abstain_below, F.col("said")).alias("answer"))
