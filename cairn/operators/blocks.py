"""Every row of one side with every row of another, in blocks: for searches of many queries.

The left side is dealt into blocks and the right side into slices. A task holds one
block and lets one slice stream by, and hands on only what its function keeps, so neither
side is ever in one place and no pair of rows becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Search = Callable[[pa.RecordBatch], pa.RecordBatch]


def _streams(batches: Iterator[pa.RecordBatch], begin: Callable[[pa.Table], Search], left: list[str], right: list[str]) -> Iterator[pa.RecordBatch]:
    now, held, search = None, [], None
    for batch in batches:
        block, part, side = (batch[c].to_numpy(zero_copy_only=False) for c in ("_block", "_slice", "_side"))
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in (block, part, side)], axis=0)) + 1
        for a, b in zip([0, *change], [*change, len(block)], strict=True):
            if a == b:
                continue
            if (block[a], part[a]) != now:
                now, held, search = (block[a], part[a]), [], None
            rows = batch.slice(a, b - a)
            if side[a] == 0:
                held.append(rows.select([f"l_{c}" for c in left]).rename_columns(left))
            elif held:
                search = search or begin(pa.Table.from_batches(held).combine_chunks())
                yield search(rows.select([f"r_{c}" for c in right]).rename_columns(right))


def _filler(rows: DataFrame, prefix: str) -> list[Column]:
    """The columns of rows that aren't there: empty lists and texts, as for each null one in an Arrow batch Spark goes over all nulls before it, to know the batch's bytes."""
    empty = lambda t: F.array() if t.startswith("array<") else F.lit("") if t == "string" else F.lit(None)
    return [empty(t).cast(t).alias(f"{prefix}{c}") for c, t in rows.dtypes]


def meet(left: DataFrame, right: DataFrame, key: str, begin: Callable[[pa.Table], Search], schema: str, block_rows: int, slice_rows: int, n_left: int | None = None) -> DataFrame:
    """What searches of blocks of left rows yield for slices of right rows. Left rows of one ``key`` are in one block.

    ``begin`` makes a search of a block's rows; the search takes some right rows. ``n_left`` counts the keys, if known.
    """
    n_left = left.select(key).distinct().count() if n_left is None else n_left
    blocks, slices = max(1, -(-n_left // block_rows)), max(1, -(-right.count() // slice_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = left.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"), F.lit(0).alias("_side"), *(F.col(c).alias(f"l_{c}") for c in left.columns), *_filler(right, "r_"))
    own = own.withColumn("_slice", every(slices))
    asked = right.select(F.pmod(F.xxhash64(right.columns[0]), F.lit(slices)).cast("int").alias("_slice"), F.lit(1).alias("_side"), *(F.col(c).alias(f"r_{c}") for c in right.columns), *_filler(left, "l_"))
    asked = asked.withColumn("_block", every(blocks))
    both = own.unionByName(asked).repartition("_block", "_slice").sortWithinPartitions("_block", "_slice", "_side")
    names = (left.columns, right.columns)
    return both.mapInArrow(lambda batches: _streams(batches, begin, *names), schema)
