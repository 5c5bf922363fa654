"""Cross-entropy difference between a target and a background model.

Both are bigram models over all words of the corpus, one vocabulary, with the same
order and the same smoothing. The background is counted over every document, the
target over the documents marked as such; background counts are scaled to the
target's total, so that smoothing weighs equally in both. No document is scored by
its own counts: they are taken from the totals of both models first. A document's
score is the mean over its tokens of the target's loss less the background's: lower
means closer to the target.

A model's counts are of three kinds: of a pair of neighbours, of a word as the
second of a pair, and of a word (or a text's start) as the first. All are rows of
one table, keyed by 64-bit hashes of the n-grams, that grows with the corpus; no
word or pair is left out. It is made and used block by block:

1. Documents are written in blocks of about BLOCK_BYTES, with their places in them.
2. Each run of a block's documents counts its keys and deals them by key to tasks of
   about PART_KEYS keys. What goes from a run to a task is one row, with the sorted keys
   and their counts as packed integers. What comes back are the totals in the order
   of the keys, without the keys: the run's documents give these again. This goes
   in PASSES parts of the keys.
3. A block's totals come first in its partition, its documents follow in order as a
   stream, count their keys again run by run and are scored. This goes in PASSES parts
   of the blocks. Both only bound what is in shuffle files at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import documents, in_slices, save
from cairn.llm.suffixes import mix
from cairn.llm.word_hashes import word_hashes

BLOCK_BYTES = 8 << 20
PART_KEYS = 2_000_000
PASSES = 2
BIGRAM_WEIGHT = 0.7
ADDED = 0.5
START = np.uint64(0x9E3779B97F4A7C15)
PAIR, SECOND, FIRST = range(3)  # a key's last two bits


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows with their block, a run of the task's rows, their places in it, and their number of words."""
    number, held, place = TaskContext.get().partitionId() << 33, 0, 0
    for batch in in_slices(batches):
        texts, blocks, places = _texts(batch), [], []
        for text in texts:
            if held and held + len(text) > block_bytes:
                number, held, place = number + 1, 0, 0
            held, place = held + len(text), place + 1
            blocks.append(number)
            places.append(place - 1)
        columns = [pa.array(blocks, pa.int64()), pa.array(places, pa.int64()), batch["doc_id"], batch["text"], batch["in_target"], pa.array(word_hashes(texts)[1], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "place", "doc_id", "text", "in_target", "n_tokens"])


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of runs of rows with the same values."""
    n = len(columns[0])
    if not n:
        return []
    change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    return list(zip([0, *change.tolist()], [*change.tolist(), n], strict=True))


def ngram_keys(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The keys of each word's pair, of the word as second and of the one before it as first: three rows."""
    low = ~np.uint64(3)
    pair = mix(before * np.uint64(0xD6E8FEB86659FD93) + words) & low | np.uint64(PAIR)
    return np.stack([pair, words & low | np.uint64(SECOND), before & low | np.uint64(FIRST)])


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for the 64-bit integers between each two bounds: first all lowest bytes, last all highest, which compress best."""
    cuts = zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
    return pa.array([values[a:b].view(np.uint8).reshape(-1, 8).T.tobytes() for a, b in cuts], pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    parts = [np.frombuffer(x, np.uint8).reshape(8, -1).T.reshape(-1) for x in column.to_pylist()]
    return np.concatenate(parts or [np.zeros(0, np.uint8)]).view(np.int64)


def _keys_of(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The keys of all words of some texts, three rows; each text's words; how many."""
    words, sizes = word_hashes(texts)
    before = np.r_[START, words][: len(words)]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    return ngram_keys(words, before), np.split(words, np.cumsum(sizes)[:-1]), sizes


def _places(keys: np.ndarray, parts: int) -> np.ndarray:
    """Share and part of keys, as one number."""
    return ((keys >> np.uint64(2)) % np.uint64(PASSES * parts)).astype(np.int64)


COUNTS = "part int, block long, first long, rows int, keys binary, n binary, n_target binary"
TOTALS = "block long, first long, rows int, place int, n binary, n_target binary, words long"


def _count(batches: Iterator[pa.RecordBatch], share: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Per run of a block's rows and part of the keys: the keys of one of PASSES shares, and how often each occurs, in all texts and in the target's."""
    for batch in in_slices(batches):
        block, place, in_target, texts = batch["block"].to_numpy(), batch["place"].to_numpy(), np.array(batch["in_target"].to_pylist(), bool), _texts(batch)
        for lo, hi in _runs(block, place - np.arange(len(place))):
            keys, _, sizes = _keys_of(texts[lo:hi])
            targets = np.repeat(in_target[lo:hi], sizes)
            keep = _places(keys, parts) // parts == share
            found, which, n = np.unique(keys[keep], return_inverse=True, return_counts=True)
            n_target = np.bincount(which[np.broadcast_to(targets, keys.shape)[keep]], minlength=len(found))
            part = _places(found, parts) % parts
            by = np.argsort(part, kind="stable")
            own = np.unique(part)
            bounds = np.r_[np.searchsorted(part[by], own), len(part)]
            same = lambda x, kind: pa.array(np.full(len(own), x), kind)
            columns = [pa.array(own, pa.int32()), same(block[lo], pa.int64()), same(place[lo], pa.int64()), same(hi - lo, pa.int32())]
            columns += [_packed(x[by].astype(np.int64, copy=False), bounds) for x in (found.view(np.int64), n, n_target)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "first", "rows", "keys", "n", "n_target"])


def _total(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Of all rows of some keys: their totals in the order of each row's keys; the first row tells how many different words the keys are."""
    rows = pa.Table.from_batches(batches).combine_chunks() if (batches := list(batches)) else None
    if rows is None or not rows.num_rows:
        return
    keys = _unpacked(rows["keys"])
    by = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[by][1:] != keys[by][:-1]]
    starts, which = np.flatnonzero(new), np.cumsum(new) - 1
    sizes = pc.binary_length(rows["keys"]).to_numpy() // 8
    bounds = np.r_[0, np.cumsum(sizes)]
    totals = []
    for name in ("n", "n_target"):
        total = np.empty(len(keys), np.int64)
        total[by] = np.add.reduceat(_unpacked(rows[name])[by], starts)[which]
        totals.append(_packed(total, bounds))
    words = np.zeros(len(sizes), np.int64)
    words[0] = np.count_nonzero(keys[by][starts] & 3 == SECOND)
    place = _places(keys[bounds[:-1]].view(np.uint64), parts)
    columns = [*(rows[c].combine_chunks() for c in ("block", "first", "rows")), pa.array(place, pa.int32()), *totals, pa.array(words)]
    yield pa.RecordBatch.from_arrays(columns, names=["block", "first", "rows", "place", "n", "n_target", "words"])


@dataclass(frozen=True)
class Corpus:
    """What the models share."""

    tokens: int
    target_tokens: int
    vocabulary: int


class Run:
    """Rows of a block that were counted together, gathered again as they stream by."""

    def __init__(self, first: int, rows: int):
        self.first, self.rows = first, rows
        self.counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by place
        self.docs: list[tuple] = []

    def losses(self, parts: int, corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
        """Each text's number of words, and both models' mean losses over them without the text's own counts."""
        keys, _, sizes = _keys_of([text for _, _, text in self.docs])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        # Equal keys stand in one of the three rows, so a stable sort leaves them in the order of the texts.
        flat = keys.ravel()
        order = np.argsort(flat, kind="stable")
        there = flat[order]
        new = np.r_[True, there[1:] != there[:-1]][: len(there)]
        which, found = np.cumsum(new) - 1, there[new]
        n, n_target = (x[which] for x in self._totals(found, parts))
        of_doc = np.tile(doc, 3)[order]
        run = np.cumsum(new | np.r_[True, of_doc[1:] != of_doc[:-1]][: len(there)]) - 1
        own = np.bincount(run)[run] if len(run) else run
        target = np.array([t for _, t, _ in self.docs], bool)
        others = np.empty((2, len(flat)))
        others[0, order], others[1, order] = n_target - own * target[of_doc], n - own
        pair, second, first = others.reshape(2, 3, -1).swapaxes(0, 1)
        scale = np.array([[1.0], [corpus.target_tokens / corpus.tokens]])
        total = np.stack([corpus.target_tokens - sizes * target, corpus.tokens - sizes])[:, doc]
        unigram = (second * scale + ADDED) / (total * scale + ADDED * corpus.vocabulary)
        mixed = np.where(first > 0, BIGRAM_WEIGHT * pair / np.maximum(first, 1) + (1 - BIGRAM_WEIGHT) * unigram, unigram)
        sums = np.stack([np.bincount(doc, -np.log(x), len(sizes)) for x in mixed])
        return sizes, sums / np.maximum(1, sizes)

    def _totals(self, found: np.ndarray, parts: int) -> np.ndarray:
        place = _places(found, parts)
        by = np.argsort(place, kind="stable")
        out = np.zeros((2, len(found)), np.int64)
        for lo, hi in _runs(place[by]):
            out[:, by[lo:hi]] = self.counts[int(place[by[lo]])]
        return out


SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double"


def _score(batches: Iterator[pa.RecordBatch], parts: int, corpus: Corpus) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by block, totals first, then documents by place: each text's mean losses."""
    block, runs = None, {}
    for batch in in_slices(batches):
        blocks, is_text = batch["block"].to_numpy(), np.array(batch["is_text"].to_pylist(), bool)
        out = []
        for lo, hi in _runs(blocks, is_text):
            if blocks[lo] != block:
                block, runs = blocks[lo], {}
            part = batch.slice(lo, hi - lo)
            if not is_text[lo]:
                for first, rows, place, n, n_target in zip(*(part[c].to_pylist() for c in ("first", "rows", "place", "n", "n_target")), strict=True):
                    run = runs.setdefault(first, Run(first, rows))
                    run.counts[place] = tuple(_unpacked(pa.array([x])) for x in (n, n_target))
                continue
            for place, doc_id, in_target, text in zip(part["place"].to_pylist(), part["doc_id"].to_pylist(), part["in_target"].to_pylist(), _texts(part), strict=True):
                run = next((r for r in runs.values() if r.first <= place < r.first + r.rows), None)
                if run is None:  # a run without words has no counts
                    out.append((doc_id, 0, 0.0, 0.0))
                    continue
                run.docs.append((doc_id, in_target, text))
                if len(run.docs) == run.rows:
                    sizes, losses = run.losses(parts, corpus)
                    out += [(i, n, *x) for (i, _, _), n, x in zip(run.docs, sizes.tolist(), losses.T.tolist(), strict=True)]
                    del runs[run.first]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_tokens", "target_loss", "background_loss"])


def lm_score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, score (means per token, in nats).

    ``target_ids``: one column, the ids of the target documents; nulls and ids
    that ``docs`` lacks are ignored, repeated ones count once. Words stand between
    ASCII white space, A-Z count as a-z; two entries of the vocabulary stand for
    unseen words and starts. Texts without words, null ones among them, have no
    tokens and zeros. Rows that repeat an id are scored and counted each. Without
    target documents the target is the background, and every score is 0. An empty
    table gives an empty result; other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("in_target", F.lit(True))
    # The same plan for few ids and for many. Rows without an id would all have one key.
    marked = base.where("doc_id is not null").join(ids.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("in_target", F.lit(False)).alias("in_target"))
    marked = marked.unionByName(base.where("doc_id is null").withColumn("in_target", F.lit(False)))
    schema = "block long, place long, doc_id long, text string, in_target boolean, n_tokens long"
    table = save(marked.mapInArrow(partial(_blocks, block_bytes=block_bytes), schema), "lm-rows")
    sizes = table.df.agg(F.sum("n_tokens").alias("n"), F.sum(F.when(F.col("in_target"), F.col("n_tokens"))).alias("n_target")).first()
    tokens, target_tokens = sizes.n or 0, sizes.n_target or sizes.n or 0
    rows = table.df if sizes.n_target else table.df.withColumn("in_target", F.lit(True))

    parts, counts = 3 * tokens // (PASSES * PART_KEYS) + 1, []
    for k in range(PASSES):
        own = rows.select("block", "place", "text", "in_target").mapInArrow(partial(_count, share=k, parts=parts), COUNTS)
        dealt = own.repartitionById(parts, "part").drop("part")
        counts.append(save(dealt.mapInArrow(partial(_total, parts=parts), TOTALS), "lm-counts"))
    totals = reduce(DataFrame.unionByName, (c.df for c in counts))
    vocabulary = (totals.agg(F.sum("words")).first()[0] or 0) + 2

    scored = []
    corpus = Corpus(max(1, tokens), target_tokens, vocabulary)
    for k in range(PASSES):
        here = F.pmod(F.xxhash64("block"), F.lit(PASSES)) == k
        first = totals.where(here).select("block", F.lit(False).alias("is_text"), "first", "rows", "place", "n", "n_target")
        texts = rows.where(here).select("block", F.lit(True).alias("is_text"), F.col("place").cast("int").alias("place"), "doc_id", "text", "in_target")
        stream = first.unionByName(texts, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "is_text", "place")
        scored.append(save(stream.mapInArrow(partial(_score, parts=parts, corpus=corpus), SCORED), "lm-scored"))
    for written in (table, *counts):
        written.drop()
    result = reduce(DataFrame.unionByName, (s.df for s in scored))
    return result.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the target is the documents labelled as of good quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return lm_score(documents(spark, sf_dir), labels.where("quality = 1").select("doc_id"))
