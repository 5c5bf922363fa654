"""Importance resampling towards a target distribution, over a sparse count matrix.

Features are all runs of 1 to 3 consecutive words, hashed into BUCKETS buckets.
The matrix of documents by buckets is written once, as blocks in compressed sparse
row form: where each document's entries start, their buckets and their counts. Its
column sums are the corpus' distribution, those of the target texts' matrix the
target's. A bucket's gain is the log ratio of both; the sparse product of matrix
and gains gives each document's weight, again block by block. Gumbel noise from a hash
of the document's id makes the highest scores a draw without replacement.

What a task sends on is at most one sum per bucket, and what the driver sees is one
gain per bucket, whatever the size of the corpus. Ranks come from a sort by ranges.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache, partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import Table, documents, in_slices, numbered, save

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
BUCKETS = 10_000
LONGEST = 3  # words in a feature
BLOCK_BYTES = 1 << 20
SEED = 42
SHARE = 5  # percent drawn
LEAST_WORDS = 20
POLYNOMIAL = 0xEDB88320
SPACE_CRC = np.uint32(crc32(b" "))


def _apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@cache
def _zeros(power: int) -> np.ndarray:
    """What 2**power zero bytes after it make of a CRC: a table for each of its four bytes."""
    if power:
        half = _zeros(power - 1)
        columns = _shift_by(half, _shift_by(half, np.uint32(1) << np.arange(32, dtype=np.uint32)))
    else:
        columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):
            columns = np.where(columns & np.uint32(1), columns >> np.uint32(1) ^ np.uint32(POLYNOMIAL), columns >> np.uint32(1))
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([_apply(columns, byte << np.uint32(8 * k)) for k in range(4)])


def _shift_by(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def joined_crc(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRCs of strings put together, of the CRCs of both parts and the bytes of the second."""
    out = a.copy()
    for power in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> power & 1)
        out[at] = _shift_by(_zeros(power), out[at])
    return out ^ b


def _pieces(text: bytes, most: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A text in pieces of about ``most`` bytes, cut between words."""
    at = 0
    while len(text) - at > most:
        found = GAP.search(text, at + most)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_crcs(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The CRC and the length of each word of a text."""
    crcs, lengths = [], []
    for piece in _pieces(text):
        words = WORD.findall(piece.lower())
        crcs.append(np.fromiter(map(crc32, words), np.uint32, len(words)))
        lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
    return np.concatenate(crcs), np.concatenate(lengths)


def entries(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, and the texts' rows of the matrix: where each starts (and the end), buckets, counts."""
    some = [word_crcs(t) for t in texts]
    n_words = np.array([len(c) for c, _ in some], np.int64)
    word, length = np.concatenate([c for c, _ in some]), np.concatenate([n for _, n in some])
    owner = np.repeat(np.arange(len(texts)), n_words)
    keys, crc = [owner * buckets + word % np.uint32(buckets)], word
    for k in range(1, LONGEST):
        if len(word) <= k:
            break
        before = joined_crc(crc[:-1], np.full(len(crc) - 1, SPACE_CRC), np.ones(len(crc) - 1, np.int64))
        crc = joined_crc(before, word[k:], length[k:])
        own = owner[k:] == owner[:-k]
        keys.append((owner[k:] * buckets + crc % np.uint32(buckets))[own])
    key, counts = np.unique(np.concatenate(keys), return_counts=True)
    starts = np.searchsorted(key, np.arange(len(texts) + 1) * buckets)
    return n_words, starts, key % buckets, counts


#: Arrays as little-endian bytes, so that neither the JVM nor a reader holds more than the numbers themselves.
TYPES = {"n_words": "<i8", "starts": "<i4", "buckets": "<u2", "counts": None}
COUNT_TYPES = ("<u1", "<u2", "<u4")  # the least that holds a block's counts, nearly always one byte
BLOCKS = "ids array<long>, n_words binary, starts binary, buckets binary, counts binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text", BLOCK_BYTES):
        if batch.num_rows:
            n_words, starts, buckets, counts = entries([t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch["doc_id"])
            least = next(t for t in COUNT_TYPES if counts.max(initial=0) <= np.iinfo(t).max)
            arrays = zip((n_words, starts, buckets, counts), (*list(TYPES.values())[:-1], least), strict=True)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in arrays)], names=["ids", *TYPES])


def count_matrix(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Table:
    """The written matrix of texts by buckets, one row per block of texts."""
    base = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return save(base.mapInArrow(_blocks, BLOCKS), "importance-matrix")


def _rows(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    held = [x.as_buffer() for x in batch[name]]
    if name == "counts":
        widths = (len(c) // max(1, len(b.as_buffer()) // 2) for c, b in zip(held, batch["buckets"], strict=True))
        return [np.frombuffer(c, COUNT_TYPES[max(0, w.bit_length() - 1)]) for c, w in zip(held, widths, strict=True)]
    return [np.frombuffer(x, TYPES[name]) for x in held]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for buckets, counts in zip(_rows(batch, "buckets"), _rows(batch, "counts"), strict=True):
            total += np.bincount(buckets, counts, BUCKETS).astype(np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])


def column_sums(matrix: DataFrame) -> DataFrame:
    """bucket, n: at most one row per bucket and task is shuffled."""
    return matrix.select("buckets", "counts").mapInArrow(_sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """Each bucket's gain, of the column sums of both: these, at most BUCKETS rows each, are all that the driver gathers."""
    s, t = ({r.bucket: float(r.n) for r in sums.collect()} for sums in (corpus, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    ratio = lambda k: (t.get(k, 0.0) + 1) * (all_s + BUCKETS) / ((s.get(k, 0.0) + 1) * (all_t + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(k))) for k in range(BUCKETS)], np.int64)


def _products(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, n_words, starts, buckets, counts in zip(batch["ids"], *(_rows(batch, c) for c in ("n_words", "starts", "buckets", "counts")), strict=True):
            sums = np.r_[0, np.cumsum(gain[buckets] * counts)].astype(np.int64)
            n_features = sum(np.maximum(n_words - k, 0) for k in range(LONGEST))
            columns = [ids.values, pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(sums[starts[1:]] - sums[starts[:-1]], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sparse product of matrix and gains."""
    return matrix.mapInArrow(partial(_products, gain=gain), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (null unless drawn).

    Of the documents with at least LEAST_WORDS words, ``share`` percent of the
    highest scores are drawn, ties to the smaller id, a null id last; its noise is that of
    the empty id. Rows that repeat an id are documents of their own. Null texts
    have no words and no features, like empty ones. An empty table, of documents or of
    target texts, has empty counts; other columns are not read.
    """
    matrix, wanted = count_matrix(docs, id_col, text_col), count_matrix(target.select(F.lit(0).alias("at"), F.col(target_col).alias("text")), "at")
    gain = gains(column_sums(matrix.df), column_sums(wanted.df))
    wanted.drop()
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((draw + 0.5) / F.lit(4294967296.0))))
    scored = weights(matrix.df, gain).withColumn("score", F.col("weight") + noise).withColumn("eligible", F.col("n_words") >= LEAST_WORDS)
    placed = numbered(scored, "eligible", [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "importance-placed")
    matrix.drop()
    drawn = share * placed.df.where("eligible").count() // 100
    rank = F.when(F.col("eligible") & (F.col("place") < drawn), F.col("place") + 1)
    return placed.df.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
