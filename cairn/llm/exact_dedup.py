"""Exact deduplication as a stateful stream.

Texts are equal when they are identical after deleting ASCII white space. A
stream over the corpus keeps, per digest of the normalised text, a keyed state
without expiry in a disk-backed (RocksDB) store: the number of rows seen and the
best row so far with its stable identifier and its content locator. Each
micro-batch hands on the digests it touched; the newest entry of a digest is its
group. Then every hit (a row of a group of several) is compared byte by byte with
the text of the row that stays; digests under which different texts met are
grouped again by the whole text, so a collision loses nothing.

Rows are partially aggregated before the shuffle, so a text that a third of all
rows share reaches its state as one row per task. The byte comparison is a plain
join, whose large partitions adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.shared import documents, new_path, save

WHITE_SPACE = " \t\n\x0b\x0c\r"

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # A store is closed once its batch is committed, so executors hold no open store, and no disk for it, per partition.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty. Byte-wise replacement, no regular expression."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _digest(text: Column, bits: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, bits // 4)


def _better(n_chars: str, doc_id: str) -> Column:
    """Larger is better: more code points, then the smaller id, a null id last."""
    return F.struct(F.col(n_chars).alias("n_chars"), (-F.col(doc_id)).alias("minus_id"))


def stream_groups(features: DataFrame, path: str, max_bytes_per_trigger: int = 1 << 38) -> DataFrame:
    """digest, best row, group_size of a table written at ``path``, by a stream with keyed state."""
    spark = features.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    state, changes = new_path(spark, "dedup-state"), new_path(spark, "dedup-changes")

    def hand_on(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={batch_id}")  # a repeated batch replaces itself

    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        rows = spark.readStream.schema(features.schema).option("maxBytesPerTrigger", max_bytes_per_trigger).parquet(path)
        groups = rows.groupBy("digest").agg(
            F.max(F.struct(_better("n_chars", "doc_id").alias("order"), "doc_id", "locator")).alias("best"),
            F.count("*").alias("group_size"),
        )
        query = groups.writeStream.outputMode("update").foreachBatch(hand_on).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = groups.schema.add("batch", "long")
    touched = spark.read.schema(schema).parquet(changes)
    newest = touched.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("g"))
    return newest.select("digest", F.col("g.best.doc_id").alias("keep_id"), F.col("g.best.locator").alias("keep_locator"), F.col("g.group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, keep_locator.

    Of equal texts the row with the most code points in the original text stays,
    then the smallest id; a null id comes last. Null, empty and all-white-space
    texts are equal. Rows that repeat an id are counted each; those whose id is
    keep_id are all marked kept. An empty table gives an empty result; other
    columns are not read. ``digest_bits`` below 256 is for testing collisions:
    text_sha256 then holds the shortened digest.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    norm = normalised(F.col("text"))
    features = save(
        base.select("doc_id", _digest(norm, digest_bits).alias("digest"), F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"), F.input_file_name().alias("locator")),
        "dedup-features",
    )
    if features.df.isEmpty():
        groups = features.df.select("digest", F.col("doc_id").alias("keep_id"), F.col("locator").alias("keep_locator"), F.lit(1).cast("long").alias("group_size"))
    else:
        groups = stream_groups(features.df, features.path)
    groups = save(groups, "dedup-groups").df

    # Full bytes on hits: every text under a digest against the text of the row that stays.
    texts = base.select("doc_id", _digest(norm, digest_bits).alias("digest"), norm.alias("norm"))
    shared = groups.where("group_size > 1").select(F.col("digest").alias("g_digest"), "keep_id")
    same_id = texts.doc_id.eqNullSafe(F.col("keep_id")) & (texts.digest == F.col("g_digest"))
    keepers = texts.join(shared, same_id, "inner").select("g_digest", F.col("norm").alias("keep_norm")).dropDuplicates(["g_digest"])
    clashes = save(
        texts.join(keepers, texts.digest == F.col("g_digest"), "inner").where(F.col("norm") != F.col("keep_norm")).select("digest"), "dedup-clashes"
    ).df.distinct()

    rows = features.df.join(groups, "digest", "left").select("doc_id", "keep_id", "group_size", F.col("digest").alias("text_sha256"), "keep_locator")
    if not clashes.isEmpty():
        apart = base.withColumn("norm", norm).withColumn("digest", _digest(F.col("norm"), digest_bits)).join(clashes, "digest", "left_semi")
        w = Window.partitionBy("norm")
        order = w.orderBy(F.char_length(F.coalesce("text", F.lit(""))).desc(), F.col("doc_id").asc_nulls_last())
        again = apart.select("doc_id", F.first("doc_id").over(order).alias("keep_id"), F.count("*").over(w).alias("group_size"), F.col("digest").alias("text_sha256"), F.input_file_name().alias("keep_locator"))
        rows = rows.join(clashes.select(F.col("digest").alias("text_sha256")), "text_sha256", "left_anti").select(again.columns).unionByName(again)
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "keep_locator")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("keep_locator")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) = doc_id AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
