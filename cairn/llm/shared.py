"""Tables kept in the folder that the driver and all executors share.

``save`` cuts lineage: a stage that was written is read again, not recomputed,
when an executor is lost. The shuffle files behind it go once it is written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="cairn-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own, but only in a single process as in tests."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_dir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cairn-llm/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Table:
    """A written Parquet table."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        """Delete the files, once nothing reads them any more."""
        spark = self.df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str) -> Table:
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return Table(spark.read.schema(df.schema).parquet(path), path)


def numbered(df: DataFrame, group: str, order: list[Column], name: str) -> Table:
    """The written rows with ``place``, from 0, in their group by the order; rows equal in all of it go in any order.

    Rows are dealt by ranges of group, order and place in the input, so neither a
    large group nor many equal rows end in one task. A group that goes on from one
    partition to the next gets an offset there: fewer rows than partitions.
    """
    dealt = df.withColumn("at", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(F.col(group), *order, F.col("at")).withColumn("part", F.spark_partition_id())
    table = save(dealt, f"{name}-dealt")
    before = F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = table.df.groupBy(group, "part").agg(F.count("*").alias("n"))
    offsets = counts.select(group, "part", before.alias("before")).where("before > 0")
    placed = table.df.withColumn("own", F.row_number().over(Window.partitionBy(group, "part").orderBy(*order, "at")) - 1)
    placed = placed.join(F.broadcast(offsets), [group, "part"], "left").withColumn("place", F.col("own") + F.coalesce("before", F.lit(0)))
    done = save(placed.drop("at", "part", "own", "before"), name)
    table.drop()
    return done


def in_slices(batches: Iterator[pa.RecordBatch], column: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of a column, so that a task's Python objects don't grow with Spark's batches."""
    for batch in batches:
        held = np.cumsum(pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64) // most
        cuts = [0, *(np.flatnonzero(held[1:] != held[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def others(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """The other columns as one, by number, so that no name can clash."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    return F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest))) if rest else F.struct(F.lit(0).alias("none"))


def with_kept_text(docs: DataFrame, done: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``done`` (doc_id, kept, carried) in the columns of ``docs``; n_chars, if there, counts the new text."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    columns = {id_col: F.col("doc_id"), text_col: F.col("kept"), **{c: F.col(f"carried.c{k}") for k, c in enumerate(rest)}}
    if "n_chars" in rest:
        columns["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return done.select(*(columns[c].alias(c) for c in docs.columns))
