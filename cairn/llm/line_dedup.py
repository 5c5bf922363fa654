"""Line deduplication by a sharded minimal perfect hash.

1. Each document's distinct line keys are hashed to 128 bits and counted per
   block of documents (blocks hold about BLOCK_DOCS documents by id hash).
2. The counts of all distinct line hashes go into shards of about SHARD_KEYS
   keys; each shard becomes a minimal perfect hash with a fingerprint and a count
   array.
3. The blocks probe the arrays: a shard's index row comes first in its
   partition, the blocks' distinct hashes follow it as a stream. A line that
   stands in every document is one probe per block, never one per document.
4. The hashes to drop come first in their block, its documents follow as a
   stream and lose those lines.

Every step is either partially aggregated or holds one shard's arrays or one
block's drop list at a time. Blocks and shards grow in number with the input.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.perfect_hash import PerfectHash
from cairn.llm.shared import documents, in_slices, others, save

WHITE_SPACE = b" \t\n\x0b\x0c\r"
BLOCK_DOCS = 512
SHARD_KEYS = 400_000


def line_hashes(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line its key's hash; None where the key is too short to be dropped."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # bytes.lower() lowers A-Z only
        key = line.strip(WHITE_SPACE)
        long_enough = len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _count_lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        seen: Counter[tuple[int, bytes]] = Counter()
        for block, text in zip(batch["block"].to_pylist(), _texts(batch["text"]), strict=True):
            seen.update({(block, h) for h in line_hashes(text, min_chars) if h})
        h1, h2 = _halves([h for _, h in seen])
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array([b for b, _ in seen], pa.int64()), "h1": pa.array(h1), "h2": pa.array(h2), "n": pa.array(list(seen.values()), pa.int64())}
        )


def _build_shard(keys: pd.DataFrame) -> pd.DataFrame:
    built = PerfectHash.build(keys["h1"].to_numpy(), keys["h2"].to_numpy(), keys["n"].to_numpy())
    return pd.DataFrame({"shard": [keys["shard"].iloc[0]], "arrays": [built.to_bytes()]})


def _probe(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by shard, index row first: the probes whose key at least min_docs documents have."""
    shard, index = None, None
    for batch in batches:
        shards, is_index = batch["shard"].to_numpy(), np.array(batch["is_index"].to_pylist(), bool)
        h1, h2 = (batch[c].fill_null(0).to_numpy() for c in ("h1", "h2"))
        keep = np.zeros(len(shards), bool)
        starts = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | is_index[1:] | is_index[:-1]]) if len(shards) else []
        for lo, hi in zip(starts, [*starts[1:], len(shards)], strict=True):
            if is_index[lo]:
                shard, index = shards[lo], PerfectHash.from_bytes(batch["arrays"][int(lo)].as_py())
            elif shards[lo] == shard:
                keep[lo:hi] = index.count(h1[lo:hi], h2[lo:hi]) >= min_docs
        yield pa.RecordBatch.from_arrays([batch["block"], batch["h1"], batch["h2"]], names=["block", "h1", "h2"]).filter(pa.array(keep))


def _drop_lines(batches: Iterator[pa.RecordBatch], min_chars: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by block, drop list first: the documents without the listed lines."""
    block, listed = None, set()
    for batch in in_slices(batches):
        out = {"doc_id": [], "n_lines": [], "n_dropped": [], "kept_sha256": [], "kept": []}
        at_row = []
        rows = zip(*(batch[c].to_pylist() for c in ("block", "h1", "h2", "doc_id")), batch["text"].cast(pa.binary()).to_pylist(), strict=True)
        for k, (at, h1, h2, doc_id, text) in enumerate(rows):
            if at != block:
                block, listed = at, set()
            if h1 is not None:
                listed.add(np.array([h1, h2], "<i8").tobytes())
                continue
            text = text or b""
            lines = text.split(b"\n")
            kept = [line for line, h in zip(lines, line_hashes(text, min_chars), strict=True) if h not in listed] if listed else lines
            left = b"\n".join(kept)
            at_row.append(k)
            out["doc_id"].append(doc_id)
            out["n_lines"].append(len(lines))
            out["n_dropped"].append(len(lines) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            out["kept"].append(left.decode("utf-8", "replace") if with_text else None)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, batch["carried"].take(pa.array(at_row, pa.int64()))], names=[*out, "carried"])


def _block(id_col: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(n_blocks)).alias("block")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, min_docs: int = 10, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256; if with_text also kept, the text, and carried, the row's other columns.

    A line's key is the line without ASCII white space at both ends, A-Z in lower
    case. Keys of at least ``min_chars`` code points that at least ``min_docs``
    rows have lose all their lines. Null and empty texts are one empty line; a
    text whose lines all go becomes empty. Rows that repeat an id count each. An
    empty table gives an empty result; other columns are not read.
    """
    carried = others(docs, id_col, text_col) if with_text else F.struct(F.lit(0).alias("none"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), carried.alias("carried"))
    n_blocks = base.count() // BLOCK_DOCS + 1
    blocked = base.select("doc_id", "text", "carried", _block(F.col("doc_id"), n_blocks))
    carries = base.schema["carried"].dataType

    counted = blocked.select("block", "text").mapInArrow(partial(_count_lines, min_chars=min_chars), "block long, h1 long, h2 long, n long")
    in_blocks = save(counted.groupBy("block", "h1", "h2").agg(F.sum("n").alias("n")), "line-blocks")
    n_shards = in_blocks.df.count() // SHARD_KEYS + 1
    shard = F.pmod(F.xxhash64("h1"), F.lit(n_shards)).alias("shard")

    keys = in_blocks.df.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    index = keys.select("h1", "h2", "n", shard).groupBy("shard").applyInPandas(_build_shard, "shard long, arrays binary")
    probes = in_blocks.df.select(shard, F.lit(False).alias("is_index"), F.lit(None).cast("binary").alias("arrays"), "block", "h1", "h2")
    first = index.select("shard", F.lit(True).alias("is_index"), "arrays", *(F.lit(None).cast("long").alias(c) for c in ("block", "h1", "h2")))
    stream = first.unionByName(probes).repartition("shard").sortWithinPartitions("shard", F.desc("is_index"))
    drops = save(stream.mapInArrow(partial(_probe, min_docs=min_docs), "block long, h1 long, h2 long"), "line-drops").df

    listed = drops.select("block", "h1", "h2", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(carries).alias("carried"))
    rows = blocked.select("block", *(F.lit(None).cast("long").alias(c) for c in ("h1", "h2")), "doc_id", "text", "carried")
    dealt = listed.unionByName(rows).repartition("block").sortWithinPartitions("block", F.asc_nulls_last("h1"))
    schema = f"doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string, carried {carries.simpleString()}"
    done = dealt.mapInArrow(partial(_drop_lines, min_chars=min_chars, with_text=with_text), schema)
    return done if with_text else done.drop("kept", "carried")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT r, doc_id, string_split(t, chr(10)) AS ls FROM docs),
lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT r, doc_id, line, pos, k IN (SELECT k FROM hot) AS goes FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
