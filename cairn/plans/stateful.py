"""Queries whose operators keep something: thread state, versions of a table, runs of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import documents
from cairn.sources.shared import new_dir
from cairn.sources.stages import Runner, Stage, StageFailed, statuses
from cairn.sources.versioned import VersionedTable
from cairn.streaming import threads

TTL_SECONDS = 2 * 3600
LATE = "90 seconds"
HOURS = (1, 5, 10)  # a batch of turns ends before each of these


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thread_turns(rows: DataFrame) -> DataFrame:
    """Conversations as turns of threads, by rule: what a turn asks goes by conv_id and turn, and some come hours after the one before."""
    kind = (F.col("conv_id") * 7 + F.col("turn") * 13) % 8
    late = ((F.col("conv_id") + F.col("turn") * 5) % 11 == 0).cast("long")
    order = Window.partitionBy("conv_id").orderBy("turn")
    seconds = F.col("turn") * 600 + F.col("conv_id") % 50 + F.sum(late).over(order) * 5 * 3600
    rows = rows.withColumn("asks", kind).withColumn("seconds", seconds)
    account = F.concat(F.lit("A"), (F.col("conv_id") % 1000).cast("string"))
    room = F.concat(F.lit("R"), ((F.col("conv_id") + F.col("turn")) % 40).cast("string"))
    return rows.select(
        F.col("conv_id").alias("thread"), F.col("turn").alias("seq"), F.timestamp_seconds(F.lit(1767225600) + F.col("seconds")).alias("at"),
        F.when(F.col("asks") <= 3, "write").when(F.col("asks") <= 5, "confirm").when(F.col("asks") == 6, "cancel").otherwise("say").alias("kind"),
        account.alias("account"), F.when(F.col("asks") == 2, F.lit("A-other")).alias("for_account"),
        F.when(F.col("asks") <= 3, "book_room").alias("tool"), F.when(F.col("asks") <= 3, room).alias("item"),
        F.when(F.col("asks") == 3, "And what about it?").when(F.col("asks") <= 2, "Book it, please.").otherwise(F.col("text")).alias("text"),
    )


def thread_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as a stream of four batches, stopped after two and resumed; what became of each turn, and which threads ended."""
    own = threads.stream_session(spark)
    source, checkpoint = new_dir(spark, "turns"), new_dir(spark, "threads")
    table = VersionedTable.create(own, new_dir(spark, "outcomes"), own.createDataFrame([], threads.OUTCOMES).schema, ["thread"])
    turns = thread_turns(_t(own, sf_dir, "conversations"))
    hours = (F.unix_seconds("at") - 1767225600) / 3600
    lows, highs = (None, *HOURS), (*HOURS, None)
    for k, (low, high) in enumerate(zip(lows, highs, strict=True)):
        part = turns if low is None else turns.where(hours >= low)
        (part if high is None else part.where(hours < high)).write.mode("append").parquet(source)
        if k % 2:
            stream = own.readStream.schema(threads.TURNS).parquet(source)
            threads.run(stream, checkpoint, table, TTL_SECONDS, LATE)
    done = VersionedTable(spark, table.path).read()
    named = {c: F.coalesce(c, F.lit("")) for c in ("tool", "item")}
    return done.withColumns({"at": F.date_format("at", "yyyy-MM-dd HH:mm:ss"), "seq": F.coalesce("seq", F.lit(-1)), **named})


def versioned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored, then those that labels find poor excluded, then those that they find toxic deleted: all three versions."""
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "source", T.chunk_hash(F.col("text")).alias("sha256"), F.lit("ingested").alias("status"))
    table = VersionedTable.create(spark, new_dir(spark, "documents"), rows.schema, ["doc_id"])
    table.upsert(rows)
    table.upsert(rows.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi").withColumn("status", F.lit("excluded")))
    table.delete(labels.where("toxic = 1").select("doc_id"))
    read = [table.read(n).withColumn("version", F.lit(n)) for n in table.versions() if n]
    return read[0].unionByName(read[1]).unionByName(read[2])


def _ingest(fail: bool) -> list[Stage]:
    """Stages over documents: each text once, its lines, counts by language; the last can be made to fail at one language."""
    alone = lambda d: documents.first_seen(d.select("doc_id", "lang", "text"), F.sha2("text", 256)).where("duplicate_of IS NULL").drop("duplicate_of")
    unique = Stage("unique", alone, "sha256")
    lines = Stage("lines", lambda d: d.select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''"))
    n = F.when((F.col("lang") == "fr") & F.lit(fail), F.raise_error(F.lit("simulated"))).otherwise(F.char_length("line"))
    counts = Stage("counts", lambda d: d.groupBy("lang").agg(F.count("*").alias("n"), F.sum(n).alias("chars")))
    return [unique, lines, counts]


def stage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over documents whose last stage fails, the same run resumed, and a run up to the second stage: the statuses before and after."""
    docs, root = _t(spark, sf_dir, "documents"), new_dir(spark, "runs")
    run_id = "first"
    try:
        Runner(spark, root, _ingest(fail=True)).run(docs, "documents", new_id=run_id)
    except StageFailed:
        pass
    before = statuses(Runner(spark, root, []).log()).withColumn("seen", F.lit("failed")).collect()
    Runner(spark, root, _ingest(fail=False)).run(docs, "documents", run_id=run_id)
    Runner(spark, root, _ingest(fail=False)).run(docs, "documents", until="lines", new_id="second")
    after = statuses(Runner(spark, root, []).log()).withColumn("seen", F.lit("resumed"))
    shown = spark.createDataFrame(before, after.schema).unionByName(after)
    return shown.select("seen", "run_id", "position", "stage", "status", F.coalesce("rows", F.lit(-1)).alias("rows"))


QUERIES = {f.__name__: f for f in (thread_outcomes, versioned_documents, stage_runs)}

TURNS_SQL = """
    t0 AS (SELECT conv_id, turn, (conv_id * 7 + turn * 13) % 8 AS asks,
                  turn * 600 + conv_id % 50 + 18000 * sum(CASE WHEN (conv_id + turn * 5) % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations),
    t1 AS (SELECT *, s - lag(s) OVER (PARTITION BY conv_id ORDER BY s, turn) > 7200 AS begins FROM t0),
    t2 AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY s, turn) AS session FROM t1),
    t3 AS (SELECT *, lag(asks) OVER w AS asked, lag(turn) OVER w AS asked_turn, row_number() OVER w AS messages, lead(turn) OVER w IS NULL AS last_one,
                  max(session) OVER (PARTITION BY conv_id) AS last_session FROM t2 WINDOW w AS (PARTITION BY conv_id, session ORDER BY s, turn))"""

SQL = {
    "thread_outcomes": f"""
        WITH {TURNS_SQL}
        SELECT conv_id AS thread, CAST(session AS INT) AS session, turn AS seq, strftime(to_timestamp(1767225600 + s) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at,
               CASE WHEN asks IN (0, 1) THEN 'confirm' WHEN asks = 2 THEN 'refuse' WHEN asks = 3 THEN 'clarify' WHEN asks = 7 THEN 'answer'
                    WHEN coalesce(asked, 9) > 1 THEN 'error' WHEN asks = 6 THEN 'cancelled' ELSE 'written' END AS outcome,
               CASE WHEN asks <= 3 OR (asks BETWEEN 4 AND 6 AND coalesce(asked, 9) <= 1) THEN 'book_room' ELSE '' END AS tool,
               CASE WHEN asks <= 3 THEN 'R' || (conv_id + turn) % 40 WHEN asks BETWEEN 4 AND 6 AND coalesce(asked, 9) <= 1 THEN 'R' || (conv_id + asked_turn) % 40 ELSE '' END AS item, CAST(messages AS INT) AS messages FROM t3
        UNION ALL
        SELECT conv_id, CAST(session AS INT), -1, strftime(to_timestamp(1767225600 + s + 7200) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), 'expired',
               CASE WHEN asks <= 1 THEN 'book_room' ELSE '' END, CASE WHEN asks <= 1 THEN 'R' || (conv_id + turn) % 40 ELSE '' END, CAST(messages AS INT)
        FROM t3 WHERE last_one AND (session < last_session OR s + 7200 < (SELECT max(s) FROM t3) - 90)""",
    "stage_runs": """
        WITH u AS (SELECT lang, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
        l AS (SELECT lang FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM u) WHERE line <> '')
        SELECT 'failed' AS seen, 'first' AS run_id, 0 AS position, 'unique' AS stage, 'done' AS status, (SELECT count(*) FROM u) AS rows
        UNION ALL SELECT 'failed', 'first', 1, 'lines', 'done', (SELECT count(*) FROM l) UNION ALL SELECT 'failed', 'first', 2, 'counts', 'failed', -1
        UNION ALL SELECT 'resumed', 'first', 0, 'unique', 'reused', -1 UNION ALL SELECT 'resumed', 'first', 1, 'lines', 'reused', -1
        UNION ALL SELECT 'resumed', 'first', 2, 'counts', 'done', (SELECT count(DISTINCT lang) FROM l) UNION ALL SELECT 'resumed', 'second', 0, 'unique', 'reused', -1
        UNION ALL SELECT 'resumed', 'second', 1, 'lines', 'reused', -1 UNION ALL SELECT 'resumed', 'second', 2, 'counts', 'skipped (until)', -1""",
    "versioned_documents": """
        WITH d AS (SELECT doc_id, source, sha256(text) AS sha256 FROM documents),
        e AS (SELECT *, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'excluded' ELSE 'ingested' END AS status FROM d)
        SELECT *, 'ingested' AS status, 1 AS version FROM d UNION ALL SELECT *, 2 FROM e
        UNION ALL SELECT *, 3 FROM e WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
}
