"""Text, retrieval, evaluation and conversation queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.stats import rate, spread
from cairn.operators import conversation, documents, evaluation, retrieval, rules


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def semi_join_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


def anti_missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _t(spark, sf_dir, "documents").select(T.chunk_hash(F.col("text")).alias("chunk_hash"))
    cache = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return documents.missing_vectors(wanted, cache.select(T.chunk_hash(F.col("text")).alias("chunk_hash"), F.lit("m").alias("model")), "m")


def status_full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.sha2("text", 256).alias("sha256"), "doc_id", F.sha2(F.concat("text", F.lit("x")), 256).alias("other"))
    files = d.where("doc_id % 5 <> 0").select("source_id", "sha256")
    state = F.when(F.col("doc_id") % 7 == 0, "excluded").when(F.col("doc_id") % 11 == 0, "removed").otherwise("ingested")
    known = d.where("doc_id % 3 <> 0").select(
        "source_id", F.when(F.col("doc_id") % 2 == 0, F.col("sha256")).otherwise(F.col("other")).alias("sha256"),
        F.when(F.col("doc_id") % 8 == 0, "r1").otherwise("r2").alias("recipe"), state.alias("status"), (F.col("doc_id") % 4 == 0).alias("has_chunks"),
    )
    return documents.status_diff(files, known, "r2").select("source_id", "status")


def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", T.chunk_hash(F.col("text")).alias("chunk_hash"), T.chunk_id(F.col("source"), F.concat(F.lit("p"), "doc_id"), F.col("text")).alias("chunk_id"))


def duplicate_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.first_seen(d, F.sha2("text", 256)).where("duplicate_of IS NOT NULL").select("doc_id", "duplicate_of")


def repeated_lines_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("source_id"), F.floor(F.col("doc_id") / 40).alias("part"), F.col("doc_id").alias("page"), "text")
    return documents.repeated_lines(pages.withColumn("source_id", F.concat_ws("/", "source_id", "part")), least_pages=2)


def strip_comments_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.regexp_replace(T.strip_comments(F.col("html")), r"\n{3,}", "\n\n")
    return _t(spark, sf_dir, "pages").select("page_id", F.sha2(html, 256).alias("sha256"), F.char_length(html).alias("n_chars"))


def script_and_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", T.script(t).alias("script"), F.bround(T.replacement_share(t), 6).alias("replaced"), T.language_label(F.col("lang"), t).alias("language"))


def builtin_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("tokens"))


def token_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(*spread(T.token_count(F.col("text")).cast("long")))


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("sha256"))


def terms_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.terms(F.col("text")), " ").alias("terms"), F.array_join(T.bigrams(T.words(F.col("text")), "_"), " ").alias("bigrams"))


def hashing_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hashing_embedding(_t(spark, sf_dir, "benchmark"), "item_id", "text")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.bm25(_queries(spark, sf_dir), _t(spark, sf_dir, "documents"), 10)
    return found.select("query_id", "doc_id", "rank", F.round("score", 3).alias("score"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _t(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense(asked, vectors, 10).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of two rankings of the same vectors: by their first and by their last components."""
    v = _t(spark, sf_dir, "embeddings")
    halves = [v.select("vec_id", F.slice("embedding", start, 32).alias("embedding")) for start in (1, 33)]
    lists = [retrieval.dense(h.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), h, 20) for h in halves]
    return retrieval.fused(lists[0], lists[1], 10).select("query_id", "doc_id", "rank", "score")


def probe_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = _t(spark, sf_dir, "documents"), _queries(spark, sf_dir)
    return retrieval.hit_rate(retrieval.bm25(bench, docs, 3), retrieval.containing(bench, docs), 3)


def local_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = _t(spark, sf_dir, "documents"), _queries(spark, sf_dir)
    first = retrieval.bm25(bench, docs, 20).join(docs.select("doc_id", "text"), "doc_id").join(bench.withColumnRenamed("text", "query"), "query_id")
    return retrieval.rerank(first.select("query_id", "doc_id", "query", "text", "rank"), 5).select("query_id", "doc_id", "rank", "first_stage_rank", "score")


def mode_overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench, docs = _queries(spark, sf_dir), _t(spark, sf_dir, "documents")
    full = retrieval.bm25(bench, docs, 5).select(F.lit("a_whole").alias("combination"), "query_id", "doc_id")
    parts = [(name, docs.where(F.col("lang") == lang)) for name, lang in (("b_en", "en"), ("c_de", "de"))]
    for name, some in parts:
        full = full.unionByName(retrieval.bm25(bench, some, 5).select(F.lit(name).alias("combination"), "query_id", "doc_id"))
    return retrieval.overlap_matrix(full)


def eval_rates_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), rate(F.col("quality") == 1).alias("quality"), rate(F.col("toxic") == 0).alias("clean"))


def eval_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select("lang", "source", "quality", "doc_id")
    return rows.groupingSets([[F.col("lang")], [F.col("source")]], "lang", "source").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"))


def three_valued_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    checks = F.array(F.col("quality") == 1, F.col("toxic") == 0, F.when(F.col("lang") == "en", F.col("n_chars") > 500))
    return rows.select("doc_id", evaluation.all_hold(checks).alias("passed"), F.size(F.array_compact(checks)).cast("long").alias("applied"))


def judge_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 4 + 1).alias("a"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 + 1).alias("b"), F.lit(3).alias("c"))
    return evaluation.disagreement(rows, ["a", "b", "c"]).select("doc_id", "gap")


def last_n_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.last_messages(_t(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role")


def token_budget_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").where("role <> 'system'")
    return conversation.token_budget_suffix(rows, 120, F.size(F.split("text", " ")).cast("long")).select("conv_id", "turn", "tokens")


def followup_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation.previous_user_text(_t(spark, sf_dir, "conversations")).where("role = 'user'")
    return rows.select("conv_id", "turn", F.md5(F.coalesce("last_user", F.lit("")).cast("binary")).alias("last_user_md5"))


def policy_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation.previous_user_text(_t(spark, sf_dir, "conversations")).where("role = 'user'")
    answers = rules.answer_turns(rows.select("conv_id", "turn", F.col("text").alias("message"), "last_user"))
    return rules.decide(answers).select("conv_id", "turn", "route", "confidence", "action", "reason", "flagged")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents.cleaned_markdown(_t(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    docs = d.select(F.col("doc_id").cast("string").alias("source_id"), "text", F.concat(F.lit("Document "), "doc_id").alias("title"), F.col("lang").alias("language"))
    return documents.chunks(docs).select("chunk_id", "source_id", "position", F.col("token_count").cast("long").alias("token_count"), "language")


QUERIES = {
    f.__name__: f
    for f in (
        semi_join_membership, anti_missing_vectors, status_full_outer_diff, content_fingerprint, duplicate_first_seen, repeated_lines_df, strip_comments_ws,
        script_and_noise, builtin_token_count, token_spread, redact_text, terms_stems, hashing_embedding, bm25_topk, dense_topk, hybrid_rrf, probe_hit_rate,
        local_rerank, mode_overlap_matrix, eval_rates_by_group, eval_grouping_sets, three_valued_checks, judge_disagreement, last_n_messages,
        token_budget_suffix, followup_lag, policy_action, chunk_documents,
    )
}

_STOP = ", ".join(f"'{w}'" for w in T.SEARCH_STOP_WORDS)
_DOT = "list_sum(list_transform(list_zip({a}, {b}), x -> x[1] * x[2]))"


def _cosine(column: str, n: int) -> str:
    return f"""
      SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round_even(list_cosine_similarity(q.{column}, d.{column}), 6) AS score
        FROM v q, v d WHERE q.vec_id % 100 = 0) QUALIFY rank <= {n}"""


_BM25 = f"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, t AS term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark)
      WHERE t NOT IN ({_STOP}) AND length(t) > 1),
p AS (SELECT doc_id, term, length, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term, len(ws) AS length FROM w)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(ws)) AS m FROM w),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT query_id, doc_id, round_even(sum(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END
        * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / m))), 5) AS score
      FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY query_id, doc_id)"""

_STOP_TEXT = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_STEM = """CASE WHEN length(w) <= 3 THEN w WHEN regexp_matches(w, '.{3}(ies|ied)$') THEN w[:-4] || 'y' WHEN regexp_matches(w, '.{3}ings$') THEN w[:-5]
              WHEN regexp_matches(w, '.{3}ing$') THEN w[:-4] WHEN regexp_matches(w, '.{3}ed$') THEN w[:-3] WHEN regexp_matches(w, '(sses|shes|ches|xes|zes)$') THEN w[:-3]
              WHEN regexp_matches(w, 's$') AND NOT regexp_matches(w, 'ss$') THEN w[:-2] ELSE w END"""

SQL = {
    "semi_join_membership": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "anti_missing_vectors": """
        SELECT DISTINCT sha256(text) AS chunk_hash FROM documents
        WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""",
    "status_full_outer_diff": """
        WITH f AS (SELECT doc_id, sha256(text) AS s FROM documents WHERE doc_id % 5 <> 0),
        k AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE sha256(text || 'x') END AS s, CASE WHEN doc_id % 8 = 0 THEN 'r1' ELSE 'r2' END AS r,
                     CASE WHEN doc_id % 7 = 0 THEN 'excluded' WHEN doc_id % 11 = 0 THEN 'removed' ELSE 'ingested' END AS st, doc_id % 4 = 0 AS c
              FROM documents WHERE doc_id % 3 <> 0),
        j AS (SELECT coalesce(f.doc_id, k.doc_id) AS doc_id,
                CASE WHEN f.doc_id IS NULL THEN CASE WHEN st = 'ingested' OR (st = 'excluded' AND c) THEN 'removed' END
                     WHEN st = 'excluded' THEN CASE WHEN c THEN 'removed' ELSE 'excluded' END
                     WHEN st IS NULL OR st = 'removed' THEN 'new' WHEN f.s <> k.s THEN 'changed' WHEN r <> 'r2' THEN 'changed' ELSE 'unchanged' END AS status
              FROM f FULL JOIN k ON f.doc_id = k.doc_id)
        SELECT CAST(doc_id AS VARCHAR) AS source_id, status FROM j WHERE status IS NOT NULL""",
    "content_fingerprint": "SELECT doc_id, sha256(text) AS chunk_hash, substr(sha256(source || '|' || 'p' || doc_id || '|' || text), 1, 16) AS chunk_id FROM documents",
    "duplicate_first_seen": "SELECT doc_id, f AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE f <> doc_id",
    "repeated_lines_df": r"""
        WITH d AS (SELECT source || '/' || lang || '/' || CAST(floor(doc_id / 40) AS BIGINT) AS source_id, doc_id, text FROM documents),
        l AS (SELECT DISTINCT source_id, doc_id, regexp_replace(regexp_replace(lower(x), '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g'), '[0-9]+', '#', 'g') AS line
              FROM (SELECT source_id, doc_id, unnest(string_split(text, chr(10))) AS x FROM d)),
        n AS (SELECT source_id, count(DISTINCT doc_id) AS n FROM d GROUP BY source_id)
        SELECT source_id AS source_id, line, count(*) AS pages FROM l JOIN n USING (source_id) WHERE line <> '' AND n >= 2
        GROUP BY source_id, line, n HAVING count(*) >= greatest(2, floor((n + 1) / 2))""",
    "strip_comments_ws": r"""
        SELECT page_id, sha256(h) AS sha256, length(h) AS n_chars
        FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS h FROM pages)""",
    "script_and_noise": """
        SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[A-Za-z]')) > 0 THEN 'latin' ELSE 'none' END AS script,
               round_even(CASE WHEN length(text) = 0 THEN 0.0 ELSE CAST(length(text) - length(replace(text, chr(65533), '')) AS DOUBLE) / length(text) END, 6) AS replaced,
               CASE WHEN lang IN ('en', 'km') THEN lang WHEN len(regexp_extract_all(text, '[A-Za-z]')) > 0 THEN 'en' ELSE lang END AS language
        FROM documents""",
    "builtin_token_count": r"""
        SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{024F}]{1,4}|[0-9]{1,3}|[\x{1780}-\x{17FF}\x{19E0}-\x{19FF}]|[^\s]')) AS tokens FROM documents""",
    "token_spread": r"""
        WITH t AS (SELECT lang, len(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{024F}]{1,4}|[0-9]{1,3}|[\x{1780}-\x{17FF}\x{19E0}-\x{19FF}]|[^\s]')) AS k FROM documents)
        SELECT lang, count(*) AS n, min(k) AS min, median(k) AS median, max(k) AS max, round(avg(k), 1) AS mean FROM t GROUP BY lang""",
    "redact_text": r"""
        SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
          'nvapi-[A-Za-z0-9_\-]{8,}', '[REDACTED]', 'g'), 'hf_[A-Za-z0-9]{16,}', '[REDACTED]', 'g'), 'AQ\.[A-Za-z0-9_\-]{20,}', '[REDACTED]', 'g'),
          'AIza[0-9A-Za-z_\-]{20,}', '[REDACTED]', 'g'), '(?i)(bearer\s+)[A-Za-z0-9._\-]{12,}', '\1[REDACTED]', 'g'),
          '(?i)(typesafe_api_key\s*[=:]\s*)[^\s"'',]+', '\1[REDACTED]', 'g'), '\bA\d{4}\b', 'A****', 'g')) AS sha256 FROM documents""",
    "terms_stems": f"""
        WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark),
        u AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM b),
        s AS (SELECT item_id, {_STEM} AS stem, min(pos) AS pos FROM u WHERE length(w) > 1 AND w NOT IN ({_STOP_TEXT}) GROUP BY ALL),
        t AS (SELECT item_id, string_agg(stem, ' ' ORDER BY pos) AS terms FROM s GROUP BY item_id),
        p AS (SELECT item_id, string_agg(w || '_' || nxt, ' ' ORDER BY pos) AS bigrams
              FROM (SELECT *, lead(w) OVER (PARTITION BY item_id ORDER BY pos) AS nxt FROM u) WHERE nxt IS NOT NULL GROUP BY item_id)
        SELECT item_id, coalesce(terms, '') AS terms, coalesce(bigrams, '') AS bigrams FROM b LEFT JOIN t USING (item_id) LEFT JOIN p USING (item_id)""",
    "bm25_topk": f"""
        WITH {_BM25}
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, round(score, 3) AS score FROM b QUALIFY rank <= 10""",
    "probe_hit_rate": f"""
        WITH {_BM25},
        r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 3),
        t AS (SELECT item_id AS query_id, doc_id FROM benchmark x JOIN documents d ON contains(d.text, x.text)),
        h AS (SELECT DISTINCT query_id FROM t JOIN r USING (query_id, doc_id))
        SELECT count(*) AS n, count(h.query_id) AS hits, round_even(CAST(count(h.query_id) AS DOUBLE) / count(*), 3) AS rate
        FROM (SELECT DISTINCT query_id FROM t) a LEFT JOIN h USING (query_id)""",
    "dense_topk": f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), r AS ({_cosine('e', 10)}) SELECT query_id, doc_id, rank, round(score, 4) AS score FROM r",
    "hybrid_rrf": f"""
        WITH v AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings),
        x AS ({_cosine('a', 20)}), y AS ({_cosine('b', 20)}),
        z AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.doc_id, y.doc_id) AS doc_id, x.rank AS xr, y.rank AS yr,
                     round_even(coalesce(1.0::DOUBLE / (60 + x.rank), 0) + coalesce(1.0::DOUBLE / (60 + y.rank), 0), 5) AS score
              FROM x FULL JOIN y ON x.query_id = y.query_id AND x.doc_id = y.doc_id)
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, xr NULLS LAST, yr NULLS LAST) AS rank, score FROM z QUALIFY rank <= 10""",
    "eval_rates_by_group": """
        SELECT lang, count(*) AS n,
               CASE WHEN count(quality) = 0 THEN '-' ELSE CAST(CAST(sum(CAST(quality = 1 AS INT)) AS BIGINT) AS VARCHAR) || '/' || count(quality) END AS quality,
               CASE WHEN count(toxic) = 0 THEN '-' ELSE CAST(CAST(sum(CAST(toxic = 0 AS INT)) AS BIGINT) AS VARCHAR) || '/' || count(toxic) END AS clean
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
    "eval_grouping_sets": """
        SELECT lang, source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source))""",
    "three_valued_checks": """
        SELECT doc_id, coalesce(quality = 1, true) AND coalesce(toxic = 0, true) AND coalesce(CASE WHEN lang = 'en' THEN n_chars > 500 END, true) AS passed,
               CAST((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + (lang = 'en')::INT AS BIGINT) AS applied
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "judge_disagreement": """
        WITH s AS (SELECT doc_id, quality * 4 + 1 AS a, CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 + 1 END AS b, 3 AS c FROM labels)
        SELECT doc_id, CAST(greatest(a, b, c) - least(a, b, c) AS DOUBLE) AS gap FROM s WHERE greatest(a, b, c) - least(a, b, c) >= 2""",
    "last_n_messages": """
        SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role <> 'system') WHERE k <= 4""",
    "token_budget_suffix": """
        WITH m AS (SELECT conv_id, turn, role, len(string_split(text, ' ')) AS tokens FROM conversations WHERE role <> 'system'),
        u AS (SELECT *, sum(tokens + 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM m),
        k AS (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS f FROM u WHERE used <= 120)
        SELECT conv_id, turn, tokens FROM k WHERE turn >= f""",
    "followup_lag": """
        SELECT conv_id, turn, md5(coalesce(l, '')) AS last_user_md5 FROM (
          SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
            OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM conversations)
        WHERE role = 'user'""",
}
