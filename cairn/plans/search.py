"""Retrieval in modes: benchmark items as queries over all documents, by words and by the hashing encoder's vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import retrieval, retrieve
from cairn.plans.text import _BM25
from cairn.sources.shared import new_dir


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _stored(passages: DataFrame) -> retrieve.Store:
    """Passages with their vectors written once, as several modes search them."""
    made, path = retrieve.Store.hashing(passages), new_dir(passages.sparkSession, "vectors")
    made.vectors.write.parquet(path)
    return retrieve.Store(passages, passages.sparkSession.read.parquet(path), made.name)


def _store(spark: SparkSession, sf_dir: str) -> retrieve.Store:
    return _stored(_t(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("source_id")))


def retrieve_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.retrieve(_queries(spark, sf_dir), _store(spark, sf_dir), "hybrid").chunks
    rank = lambda c: F.coalesce(F.col(f"signals.{c}"), F.lit(-1)).alias(c)
    return found.select("query_id", "doc_id", "rank", "score", rank("lexical_rank"), rank("dense_rank"))


def retrieve_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six modes, kept and dropped passages; a floor of 0.5 drops some of the reranked."""
    queries, store = _queries(spark, sf_dir), _store(spark, sf_dir)
    lists, out = retrieve.searched(queries, store), None
    for mode in retrieve.MODES:
        r = retrieve.retrieve(queries, store, mode, floor=0.5, lists=lists)
        rows = r.chunks.withColumn("reason", F.lit("")).unionByName(r.dropped, allowMissingColumns=True).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out.select("mode", "query_id", "doc_id", F.coalesce("rank", F.lit(-1)).alias("rank"), F.round("score", 3).alias("score"), "reason")


def retrieval_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many passages each two modes share, over a store of all documents and one of the first half of each text."""
    store = _store(spark, sf_dir)
    halves = store.passages.withColumn("text", F.expr("left(text, char_length(text) div 2)"))
    other = _stored(halves)
    return retrieve.compare(_queries(spark, sf_dir), {"whole": store, "half": other}, ("lexical", "dense", "hybrid"))[1]


QUERIES = {f.__name__: f for f in (retrieve_hybrid, retrieve_modes, retrieval_lab)}

_STOP = ", ".join(f"'{w}'" for w in T.EMBEDDING_STOP_WORDS)


def _vectors(table: str, id_col: str, name: str) -> str:
    return f"""
    {name}w AS (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY pos) AS pos FROM (
        SELECT {id_col} AS id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT {id_col}, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM {table})) WHERE w NOT IN ({_STOP})),
    {name}f AS (SELECT id, w AS f FROM {name}w UNION ALL SELECT id, w || '_' || lead(w) OVER (PARTITION BY id ORDER BY pos) FROM {name}w),
    {name}h AS (SELECT id, md5(f) AS m FROM {name}f WHERE f IS NOT NULL),
    {name}c AS (SELECT id, ('0x' || m[7:8] || m[5:6] || m[3:4] || m[1:2])::BIGINT % 512 AS cell, sum(CASE WHEN ('0x' || m[9:10])::INT % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}h GROUP BY ALL),
    {name} AS (SELECT id, cell, (v / sqrt(sum(v * v) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS v FROM {name}c),
    {name}n AS (SELECT id, sqrt(sum(v * v)) AS n FROM {name} GROUP BY id)"""


SQL = {
    "retrieve_hybrid": f"""
        WITH {_BM25},
        x AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 12),
        {_vectors("benchmark", "item_id", "qv")}, {_vectors("documents", "doc_id", "dv")},
        cs AS (SELECT qv.id AS query_id, dv.id AS doc_id, sum(qv.v * dv.v) AS s FROM qv JOIN dv USING (cell) GROUP BY ALL),
        ca AS (SELECT query_id, d.doc_id, round_even(coalesce(s / qvn.n / dvn.n, 0), 6) AS score
               FROM (SELECT item_id AS query_id FROM benchmark) q CROSS JOIN documents d LEFT JOIN cs USING (query_id, doc_id) LEFT JOIN qvn ON qvn.id = query_id LEFT JOIN dvn ON dvn.id = d.doc_id),
        y AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ca QUALIFY rank <= 12),
        z AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.doc_id, y.doc_id) AS doc_id, x.rank AS xr, y.rank AS yr,
                     round_even(coalesce(1.0::DOUBLE / (60 + x.rank), 0) + coalesce(1.0::DOUBLE / (60 + y.rank), 0), 5) AS score
              FROM x FULL JOIN y ON x.query_id = y.query_id AND x.doc_id = y.doc_id)
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, xr NULLS LAST, yr NULLS LAST) AS rank, score,
               CAST(coalesce(xr, -1) AS INT) AS lexical_rank, CAST(coalesce(yr, -1) AS INT) AS dense_rank FROM z QUALIFY rank <= 4""",
}
