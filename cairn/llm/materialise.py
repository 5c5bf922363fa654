"""Writing token sequences in training order, as binary shards of a fixed stride.

Texts are cut into sequences of at most LENGTH ids, numbered in an order that
follows from their documents' ids and texts, however the input is split: by a hash
of both first, which deals about PART_DOCS documents to a task, then by id and text.
A keyed Feistel network permutes the numbers: it permutes a power of two at least as
large, and numbers that land outside walk on until they land inside, so every
sequence gets one slot of 0 to n - 1 and no slot is left empty. Sequences are dealt
by ranges of slots, which follow from the slot without sampling; a task writes a run
of TASK_SHARDS whole shards, each SHARD_SEQUENCES records of equal size: the number
of ids, the ids, zeros. The record of a slot stands at a place that follows from the
slot, so a reader goes through files in order and resumes at any slot without an index.

Shards are written in PASSES parts of the slots, so that only a part of the
sequences is in shuffle files beside the sequences and the shards. A shard is
written under another name and then renamed; a task that runs again writes the
same bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.packing import VOCABULARY, word_ids
from cairn.llm.shared import documents, in_slices, new_path, save

LENGTH = 512
PART_DOCS = 16_384
SHARD_SEQUENCES = 8_192
TASK_SHARDS = 4
PASSES = 4
MOST_BROADCAST = 1_000_000
KEY = 20_240_229
ROUNDS = 6
MOST_ID = np.iinfo(np.uint16).max


def stride(length: int) -> int:
    """Bytes of a record: the number of ids and ``length`` ids, as little-endian unsigned 16-bit integers."""
    return 2 * (length + 1)


def permuted(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of numbers of 0 to n - 1: a Feistel network with cycle-walking."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = numbers.astype(np.uint64), np.arange(len(numbers))
    while len(left):
        high, low = out[left] >> half, out[left] & mask
        for k in range(ROUNDS):
            f = low * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * (2 * k + 1) + k) & 0xFFFFFFFFFFFFFFFF)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            high, low = low, high ^ ((f ^ (f >> np.uint64(32))) & mask)
        out[left] = (high << half) | low
        left = left[out[left] >= n]
    return out.astype(np.int64)


def _narrow(ids: bytes) -> np.ndarray:
    """As unsigned 16-bit integers."""
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() > MOST_ID:
        raise ValueError(f"the tokenizer gives the id {wide.max()}, but records hold ids up to {MOST_ID}")
    return wide.astype("<u2")


def _sequences(batches: Iterator[pa.RecordBatch], path: str, length: int) -> Iterator[pa.RecordBatch]:
    """The sequences of a task, numbered in it; a text without ids has none."""
    own, number, part = word_ids(path), 0, TaskContext.get().partitionId()
    for batch in in_slices(batches):
        rows: list[tuple] = []
        texts = [x or b"" for x in batch["text"].cast(pa.binary()).to_pylist()]
        for doc_id, ids in zip(batch["doc_id"].to_pylist(), own.encode(texts), strict=True):
            small = _narrow(ids)
            for k, start in enumerate(range(0, len(small), length)):
                rows.append((doc_id, k, part, number, small[start : start + length].tobytes()))
                number += 1
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "sequence", "part", "number", "ids"])


def _shard_path(path: str, shard: int) -> str:
    return f"{path}/shard-{shard:010d}.bin"


def _write(batches: Iterator[pa.RecordBatch], path: str, length: int, shard_sequences: int) -> Iterator[pa.RecordBatch]:
    """Write the shards of a stream sorted by slot; a row for each sequence."""
    from pyarrow.fs import FileSystem

    files, folder = FileSystem.from_uri(path)
    size, at, out, unfinished = stride(length), None, None, ""
    files.create_dir(folder, recursive=True)

    def finish() -> None:
        if out is not None:
            out.close()
            files.move(unfinished, _shard_path(folder, at))

    for batch in batches:
        slots, payloads = batch["slot"].to_numpy(), batch["ids"].to_pylist()
        shards = slots // shard_sequences
        for shard, ids in zip(shards.tolist(), payloads, strict=True):
            if shard != at:
                finish()
                at, unfinished = shard, f"{folder}/.{uuid.uuid4().hex}"
                out = files.open_output_stream(unfinished)
            out.write(((len(ids) // 2).to_bytes(2, "little") + ids).ljust(size, b"\0"))
        columns = [batch["doc_id"], batch["sequence"], batch["slot"], pa.array(shards), pa.array(slots % shard_sequences * size)]
        columns += [pa.array([len(x) // 2 for x in payloads], pa.int64()), pa.array([zlib.crc32(x) for x in payloads], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sequence", "slot", "shard", "offset", "n_tokens", "ids_crc32"])
    finish()


def materialise(
    docs: DataFrame, tokenizer: str, path: str, key: int = KEY, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the sequences of ``docs`` below ``path``; one row per sequence: doc_id, sequence (of its document), slot, shard, offset, n_tokens, ids_crc32.

    An id of the tokenizer above 65,535 raises an error. Null and empty texts
    have no sequence; a text of any length has as many as it needs. Rows that
    repeat an id, or have none, are written each; equal rows, id and text, are
    encoded in one task, which streams them. An empty table writes nothing
    and gives an empty result; other columns are not read. The same rows and key
    give the same files, however the input is split.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The number of parts follows from the rows. Only rows of one id and text can change places, and they are equal.
    own_hash = F.xxhash64("text")
    ordered = base.repartition(base.count() // PART_DOCS + 1, "doc_id", own_hash).sortWithinPartitions("doc_id", own_hash, "text")
    sequences = save(ordered.mapInArrow(partial(_sequences, path=tokenizer, length=length), "doc_id long, sequence long, part long, number long, ids binary"), "sequences")
    # One row per task that wrote sequences: broadcast up to MOST_BROADCAST of them, 16 bytes each, else joined.
    starts, n = [], 0
    for r in sequences.df.groupBy("part").agg((F.max("number") + 1).alias("n")).orderBy("part").toLocalIterator():
        starts.append((r.part, n))
        n += r.n
    offsets = spark.createDataFrame(starts, "part long, start long")
    offsets = F.broadcast(offsets) if len(starts) <= MOST_BROADCAST else offsets

    @F.pandas_udf("long")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(np.int64), n, key))

    numbered = sequences.df.join(offsets, "part").select("doc_id", "sequence", "ids", (F.col("start") + F.col("number")).alias("number"))
    placed = numbered.withColumn("slot", slot("number")).select("doc_id", "sequence", "ids", "slot")
    run = TASK_SHARDS * shard_sequences
    n_runs = max(1, -(-n // run))
    schema = "doc_id long, sequence long, slot long, shard long, offset long, n_tokens long, ids_crc32 long"
    places = []
    for k in range(PASSES):
        first, after = (n_runs * x // PASSES for x in (k, k + 1))
        if first == after and k:
            continue
        some = placed.where((F.col("slot") >= first * run) & (F.col("slot") < after * run))
        dealt = some.repartitionById(max(1, after - first), (F.floor(F.col("slot") / run) - first).cast("int")).sortWithinPartitions("slot")
        places.append(save(dealt.mapInArrow(partial(_write, path=path, length=length, shard_sequences=shard_sequences), schema), "sequence-places").df)
    sequences.drop()
    return reduce(DataFrame.unionByName, places)


class SequenceReader:
    """Reads the sequences of slots in order, from any slot on. ``slot`` is the next one: keep it to resume."""

    def __init__(self, path: str, slot: int = 0, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES):
        self.path, self.slot, self.length, self.shard_sequences = path, slot, length, shard_sequences

    def __iter__(self) -> Iterator[np.ndarray]:
        from pyarrow.fs import FileSystem, FileType

        files, folder = FileSystem.from_uri(self.path)
        size = stride(self.length)
        while files.get_file_info(name := _shard_path(folder, self.slot // self.shard_sequences)).type == FileType.File:
            with files.open_input_file(name) as f:
                f.seek(self.slot % self.shard_sequences * size)
                while len(record := f.read(size)) == size:
                    self.slot += 1
                    ids = np.frombuffer(record, "<u2")
                    yield ids[1 : 1 + ids[0]]
            if self.slot % self.shard_sequences:
                return


def op8_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), new_path(spark, "shards"))
