"""Nearest neighbours by inner product over score-aware quantised vectors.

Vectors are cut into subspaces of two dimensions; each subspace has sixteen
codewords, so a code takes four bits. Codes and codewords minimise an anisotropic
loss: the part of the residual that is parallel to the vector, which is the part
that changes large inner products, counts ETA times as much as the rest. As the
parallel error adds up over subspaces, codes are chosen by coordinate descent.

A search scans a block of codes with tables of query-times-codeword products (two
codes, one byte, per look-up), takes the SHORTLIST best and computes their exact
products in double precision. A row's exact product is at most its approximate one
plus the norms of its residual and of the query multiplied, so every row for which
this limit reaches the k-th best exact product is ranked exactly too: no row of the
k best is lost, however many have the same codes. Every query meets every block: the query set
against all rows, in blocks. A block's rows come first in its partition, the
queries follow as a stream, so a task holds one block and one batch.

The codewords are fitted on at most SAMPLE_ROWS vectors; every vector is indexed.
The data that this was measured on have no clusters to speak of (half of all
cells of a coarse partition hold 0.9 of the neighbours), so there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.shared import save

SAMPLE_ROWS = 10_000
BLOCK_ROWS = 8_192
SLICE_QUERIES = 1_024
SHORTLIST = 128
ETA = 3.0
CODEWORDS = 16
ROUNDS = 6


@dataclass
class Quantiser:
    words: np.ndarray  # subspace, codeword, dimension

    @property
    def dims(self) -> int:
        return self.words.shape[2]

    def _cut(self, x: np.ndarray) -> np.ndarray:
        """Rows as subspaces, with a zero where the last one lacks a dimension."""
        n, d = x.shape
        m = len(self.words)
        return np.pad(x, ((0, 0), (0, m * self.dims - d))).reshape(n, m, self.dims)

    def codes(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """The codes of rows: first the nearest codewords, then coordinate descent on the anisotropic loss."""
        parts = self._cut(x.astype(np.float64))
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        n, m = parts.shape[:2]
        out = np.empty((n, m), np.int64)
        parallel = np.zeros(n)  # of the whole residual
        for j in range(m):
            out[:, j] = ((parts[:, j, None] - self.words[j]) ** 2).sum(2).argmin(1)
            parallel += ((parts[:, j] - self.words[j][out[:, j]]) * unit[:, j]).sum(1)
        for _ in range(passes):
            for j in range(m):
                residual = parts[:, j, None] - self.words[j]
                own = (residual * unit[:, j, None]).sum(2)
                rest = parallel - own[np.arange(n), out[:, j]]
                out[:, j] = ((residual**2).sum(2) + (ETA - 1) * (rest[:, None] + own) ** 2).argmin(1)
                parallel = rest + own[np.arange(n), out[:, j]]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, dims: int = 2, seed: int = 7) -> Quantiser:
        rng = np.random.default_rng(seed)
        m = -(-x.shape[1] // dims)
        own = cls(np.zeros((m, CODEWORDS, dims)))
        parts = own._cut(x.astype(np.float64))
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        for j in range(m):
            own.words[j] = parts[rng.integers(len(x), size=CODEWORDS), j]
        for k in range(ROUNDS):
            codes = own.codes(x, passes=0 if k < ROUNDS // 2 else 1)
            residual = parts - own.words[np.arange(m), codes]
            parallel = (residual * unit).sum((1, 2))
            for j in range(m):
                u, rest = unit[:, j], parallel - (residual[:, j] * unit[:, j]).sum(1)
                weight = (ETA - 1) * (k >= ROUNDS // 2)
                target = parts[:, j] + weight * u * (rest + (parts[:, j] * u).sum(1))[:, None]
                n = np.bincount(codes[:, j], minlength=CODEWORDS)
                left = n[:, None, None] * np.eye(dims)
                right = np.zeros((CODEWORDS, dims))
                np.add.at(left, codes[:, j], weight * u[:, :, None] * u[:, None, :])
                np.add.at(right, codes[:, j], target)
                own.words[j][n > 0] = np.linalg.solve(left[n > 0], right[n > 0][:, :, None])[:, :, 0]
        return own

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return (codes[:, ::2] * CODEWORDS + codes[:, 1::2]).astype(np.uint8)

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For each byte of a packed code and each of its values, what it adds to the inner product."""
        products = np.einsum("jkd,jd->jk", self.words, self._cut(query[None])[0])
        if len(products) % 2:
            products = np.vstack([products, np.zeros((1, CODEWORDS))])
        return (products[::2, :, None] + products[1::2, None, :]).reshape(-1, CODEWORDS * CODEWORDS).astype(np.float32)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed in the order of the components for every row, so that equal rows have equal ones."""
    out = np.zeros(len(rows))
    for column, x in zip(rows.T, query, strict=True):
        out += column * x
    return out


class Block:
    """Packed codes, ids and vectors of some rows."""

    def __init__(self, quantiser: Quantiser, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.quantiser, self.ids, self.vectors = quantiser, ids[order], vectors[order].astype(np.float64)
        codes = quantiser.codes(self.vectors)
        self.packed = np.ascontiguousarray(quantiser.pack(codes).T)
        coded = quantiser.words[np.arange(len(quantiser.words)), codes]
        self.residual = np.sqrt(((quantiser._cut(self.vectors) - coded) ** 2).sum((1, 2)))
        # Sums of single-precision products differ from exact ones by less than this, for a query of norm 1.
        self.rounding = 1e-13 * vectors.shape[1] * np.linalg.norm(self.vectors, axis=1).max(initial=0.0)
        self.slack = 1e-6 * len(self.packed) * np.sqrt((quantiser.words**2).sum(2).max(1).sum())

    def search(self, query_id: int, query: np.ndarray, k: int, shortlist: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and exact products of the k best rows found, best first, ties to the smaller id."""
        approximate = np.zeros(len(self.ids), np.float32)
        for table, codes in zip(self.quantiser.tables(query), self.packed, strict=True):
            approximate += table[codes]
        approximate[self.ids == query_id] = -np.inf
        best = np.argpartition(-approximate, shortlist - 1)[:shortlist] if len(self.ids) > shortlist else np.arange(len(self.ids))
        best = best[self.ids[best] != query_id]
        exact = self.vectors[best] @ query
        if k <= len(best) < len(self.ids):
            limit = approximate + (self.residual + self.slack) * np.linalg.norm(query)
            best = np.union1d(best, np.flatnonzero((limit >= np.partition(exact, -k)[-k]) & (self.ids != query_id)))
            exact = self.vectors[best] @ query
        elif len(best) < k and len(self.ids) > shortlist:  # a shortlist of fewer than k gives no limit
            best = np.flatnonzero(self.ids != query_id)
            exact = self.vectors[best] @ query
        if len(best) > k:  # those whose products may be among the k largest, whatever their rounding
            best = best[exact >= np.partition(exact, -k)[-k] - self.rounding * np.linalg.norm(query)]
        exact = products(self.vectors[best], query)
        order = np.lexsort((self.ids[best], -exact))[:k]
        return self.ids[best][order], exact[order]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _scan(batches: Iterator[pa.RecordBatch], quantiser: Quantiser, dims: int, k: int, shortlist: int) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by block and slice, rows first and queries then: each query's best rows of the block."""
    at, gathered, block = None, [], None
    for batch in batches:
        keys = list(zip(batch["block"].to_pylist(), batch["slice"].to_pylist(), strict=True))
        is_query, ids, vectors = np.array(batch["is_query"].to_pylist(), bool), batch["vec_id"].to_numpy(), _matrix(batch["embedding"], dims)
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for j, key in enumerate(keys):
            if key != at:
                at, gathered, block = key, [], None
            if not is_query[j]:
                gathered.append((ids[j], vectors[j]))
                continue
            if block is None and gathered:
                block = Block(quantiser, np.array([g[0] for g in gathered]), np.array([g[1] for g in gathered]))
            if block is not None:
                found.append((ids[j], *block.search(ids[j], vectors[j], k, shortlist)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64) if found else [], pa.int64()),
                pa.array(np.concatenate([f[1] for f in found]) if found else [], pa.int64()),
                pa.array(np.concatenate([f[2] for f in found]) if found else [], pa.float64()),
            ],
            names=["query_id", "vec_id", "score"],
        )


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shortlist: int = SHORTLIST, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, the k nearest other rows found.

    Rows with a null id, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part, nor do vectors whose length isn't the
    most frequent one (of equally frequent ones the larger). Of rows that repeat
    an id the smallest vector counts. Ties go to the smaller id. Of one vector
    that more than k + 1 rows share, only the k + 1 smallest ids can be among any
    query's nearest, so only these are indexed. Fewer than k other rows give
    fewer rows; an empty table gives an empty result; other columns are not read.
    """
    own, spark = F.col(vector_col), vectors.sparkSession
    fine = F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(own, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), own.cast("array<double>").alias("embedding"))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = rows.withColumn("copy", F.row_number().over(copies))
    queries = F.col("vec_id") % every == 0
    # A copy past k + 1 stays only as a query.
    few = ranked.where(F.col("copy") <= k + 1).select("vec_id", "embedding", F.lit(False).alias("is_query"))
    asked = rows.where(queries).select("vec_id", "embedding", F.lit(True).alias("is_query"))
    valid = save(few.unionByName(asked), "ann-rows").df
    sizes = valid.groupBy(F.size("embedding").alias("d"), "is_query").count().collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = {r.d: 0 for r in sizes}
    for r in sizes:
        total[r.d] += r["count"]
    dims = max(total, key=lambda d: (total[d], d))
    n = {r.is_query: r["count"] for r in sizes if r.d == dims}
    valid = valid.where(F.size("embedding") == dims)
    parts = 1_000_000
    share = min(parts, sample_rows * parts // max(1, n.get(False, 0)) + 1)
    sample = valid.where(~F.col("is_query") & (F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)) < share)).select("embedding").limit(2 * sample_rows).toPandas()
    if sample.empty:
        sample = valid.limit(sample_rows).select("embedding").toPandas()
    quantiser = Quantiser.fit(np.array(sample["embedding"].tolist()))
    n_blocks, n_slices = n.get(False, 0) // BLOCK_ROWS + 1, n.get(True, 0) // SLICE_QUERIES + 1
    block, part = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n_slices))
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    candidates = valid.where(~F.col("is_query")).select(block.alias("block"), each(n_slices).alias("slice"), "is_query", "vec_id", "embedding")
    questions = valid.where("is_query").select(each(n_blocks).alias("block"), part.alias("slice"), "is_query", "vec_id", "embedding")
    dealt = candidates.unionByName(questions).repartition("block", "slice").sortWithinPartitions("block", "slice", "is_query")
    found = dealt.mapInArrow(partial(_scan, quantiser=quantiser, dims=dims, k=k, shortlist=shortlist), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
