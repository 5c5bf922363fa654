"""Packing documents into fixed-size token sequences by multiway differencing.

A document's ids are cut at multiples of the capacity, which gives full
sequences without padding; what is left over is one piece, or two where it is
longer than half the capacity. Pieces are dealt by a hash of all that is known of
them, and rows that are alike by a number of their own, into groups of about
GROUP_DOCS documents' left-over pieces, so a group fits one task at any corpus
size, whatever ids or texts repeat. Full pieces go with their hash.
Within a group the pieces go into k windows by Karmarkar-Karp differencing: every
piece starts as a partial partition of k sums; again and again the two partial
partitions with the largest imbalance are merged, the largest sum of one with the
smallest of the other, until one partition with near-equal windows is left. If a
window exceeds the capacity, k rises and the group is balanced anew.

Word ids are looked up per distinct white-space-free run of bytes: the tokenizer
drops white space before it splits, so runs are encoded independently.
"""

from __future__ import annotations

import heapq
import os
import string
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import documents, in_slices, save

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 2048
GROUP_DOCS = 512
MEMO_BYTES = 64 << 20
ENCODE_BYTES = 4 << 20
MARKS = string.punctuation.encode()


class WordIds:
    """ids of texts as little-endian unsigned 32-bit integers, with a bounded memo of runs without ASCII white space.

    The memo has two generations, of about MEMO_BYTES together: once the younger one
    is full it becomes the older one, and what is still asked for moves back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        self.tokenizer = Tokenizer.from_file(path)
        self._plain = Tokenizer(self.tokenizer.model)  # for a-z alone, which the tokenizer neither changes nor splits
        self._plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self._last[[k for t, k in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self._special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._known: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._size = 0

    def _encode_runs(self, runs: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False):
            yield array("I", e.ids).tobytes()

    def _encode_words(self, words: list[bytes], plain: bool) -> Iterator[bytes]:
        """Words of letters alone, which the tokenizer doesn't split: many at once, as a text of words."""
        tokenizer = self._plain if plain else self.tokenizer
        for k in range(0, len(words), 256):
            some = words[k : k + 256]
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._last[ids])
            if len(ends) != len(some):  # letters to Python, but not to the tokenizer
                yield from self._encode_runs([word.decode() for word in some])
                continue
            data, at = ids.tobytes(), 0
            for end in (4 * ends + 4).tolist():
                yield data[at:end]
                at = end

    def _runs(self, text: bytes) -> list[bytes]:
        """The runs of a text. The tokenizer lowers letters, so A-Z can be lowered before; only its special tokens' strings keep their case."""
        low = text.lower()
        if not any(s in low for s in self._special):
            return low.split()
        return [run if any(s in run.lower() for s in self._special) else run.lower() for run in text.split()]

    def _learn(self, runs: Iterable[bytes]) -> None:
        """Encode runs that aren't known. Letters and the ASCII marks after them are encoded apart, as the tokenizer splits them."""
        known, plain, words, others, apart = self._known, set(), set(), {}, []
        for run in runs:
            word = run.rstrip(MARKS)
            if word.isalpha() and word.islower():
                if word not in known:
                    plain.add(word)
            elif word.decode("utf-8", "replace").isalpha():
                if word not in known:
                    words.add(word)
            else:
                others[run] = run.decode("utf-8", "replace")
                continue
            if len(word) < len(run):
                apart.append((run, word, marks := run[len(word) :]))
                if marks not in known:
                    others[marks] = marks.decode()
        new = dict(zip(plain, self._encode_words(list(plain), True)))
        new.update(zip(words, self._encode_words(list(words), False)))
        new.update(zip(others, self._encode_runs(list(others.values()))))
        known.update(new)
        new.update((run, known[word] + known[marks]) for run, word, marks in apart)
        known.update(new)
        self._size += _held(new)

    def _ids_of(self, runs: list[bytes]) -> list[bytes]:
        """The ids of distinct runs, from the memo or by encoding them."""
        if self._size >= MEMO_BYTES // 2:
            self._known, self._old, self._size = {}, self._known, 0
        new = [run for run in runs if run not in self._known]
        again = {run: ids for run in new if (ids := self._old.get(run)) is not None}
        self._known.update(again)
        self._size += _held(again)
        self._learn(run for run in new if run not in again)
        return list(map(self._known.__getitem__, runs))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The texts' ids, many texts at once: each distinct run of theirs is looked up once."""
        at = 0
        while at < len(texts):
            end, held = at + 1, len(texts[at])
            while end < len(texts) and held + len(texts[end]) <= ENCODE_BYTES:
                held += len(texts[end])
                end += 1
            yield from self._encode_some(texts[at:end])
            at = end

    def _encode_some(self, texts: list[bytes]) -> Iterator[bytes]:
        low = [text.lower() for text in texts]
        if any(s in text for s in self._special for text in low):
            lists = list(map(self._runs, texts))
            ends = np.cumsum([0, *map(len, lists)])
            flat = pa.array([run for own in lists for run in own], pa.binary())
        else:
            # Split as strings, but never checked or decoded: Arrow splits at the white space that bytes.split() knows.
            offsets, data = _marks_apart(low)
            split = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(low), pa.py_buffer(offsets), pa.py_buffer(data)))
            ends, flat = split.offsets.to_numpy(), split.values.cast(pa.binary())
        coded = flat.dictionary_encode()
        each = self._ids_of(coded.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(each), "<u4")
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        begins, which = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        own = sizes[which]
        after = np.cumsum(own)
        every = ids[np.repeat(begins[which] - after + own, own) + np.arange(after[-1] if len(after) else 0)]
        bounds = np.concatenate([[0], after])[ends].tolist()
        yield from (every[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def _marks_apart(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' offsets and bytes, with a space before each comma or full stop between a-z and a blank or line end: the tokenizer splits there, and the word is a run that is known."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    inner = data[1:-1]
    at = np.flatnonzero((inner == ord(",")) | (inner == ord("."))) + 1
    before, after = data[at - 1], data[at + 1]
    at = at[(before >= ord("a")) & (before <= ord("z")) & ((after == ord(" ")) | (after == ord("\n")))]
    return (offsets + np.searchsorted(at, offsets)).astype(np.int32), np.insert(data, at, ord(" "))


def _held(memo: dict[bytes, bytes]) -> int:
    """About how many bytes a memo's entries take."""
    return 170 * len(memo) + sum(map(len, memo)) + sum(map(len, memo.values()))


@cache
def word_ids(path: str) -> WordIds:
    """One per Python worker."""
    return WordIds(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: full ones, then one or two of at most half the capacity, or one between."""
    full = n // capacity
    pieces = [(k * capacity, capacity) for k in range(full)]
    start, rest = full * capacity, n % capacity
    if rest > (half := -(-capacity // 2)):
        pieces.append((start, half))
        start, rest = start + half, rest - half
    return pieces + [(start, rest)] * (rest > 0)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    end, own, part, number = np.array([end_id], "<u4").tobytes(), word_ids(path), TaskContext.get().partitionId() << 33, 0
    for batch in in_slices(batches):
        doc_ids, rows = batch["doc_id"].to_pylist(), []
        texts = [x or b"" for x in batch["text"].cast(pa.binary()).to_pylist()]
        for doc_id, ids in zip(doc_ids, own.encode(texts), strict=True):
            ids += end
            n = len(ids) // 4
            rows += [(doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, part + number) for start, length in cut(n, capacity)]
            number += 1
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "number"])


def differencing(sizes: list[int], windows: int) -> list[int]:
    """The window of each size: largest differencing over partitions of ``windows`` sums."""
    if not sizes:
        return []
    sums: dict[int, np.ndarray] = {}
    for k, size in enumerate(sizes):
        sums[k] = np.zeros(windows, np.int64)
        sums[k][0] = size
    heap = [(-size, k) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    merged: dict[int, tuple[int, int, np.ndarray]] = {}
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]  # sums are kept in descending order
        order = np.argsort(-both, kind="stable")
        new = len(sizes) + len(merged)
        sums[new], merged[new] = both[order], (a, b, order)
        heapq.heappush(heap, (int(sums[new][-1] - sums[new][0]), new))
    out = [0] * len(sizes)
    stack = [(heap[0][1], np.arange(windows))]  # a partition, and which window each of its sums ends up in
    while stack:
        k, place = stack.pop()
        if k < len(sizes):
            out[k] = int(place[0])
            continue
        a, b, order = merged[k]
        before = np.empty(windows, np.int64)
        before[order] = place
        stack += [(a, before), (b, before[::-1])]
    return out


def balanced(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Windows of at most ``capacity``, as few as differencing finds; their number rises until all fit."""
    windows = -(-sum(sizes) // capacity)
    while True:
        at = differencing(sizes, windows)
        if not sizes or max(np.bincount(at, weights=sizes)) <= capacity:
            return at, windows
        windows += max(1, windows // 200)


def _pack(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """The pieces of one group with their sequence and offset; full pieces have a sequence of their own."""
    group = group.sort_values(["doc_id", "start", "ids_crc32", "length", "doc_tokens"], ignore_index=True)
    full = group["length"].to_numpy() == capacity
    rest = group.index[~full]
    sequence = np.zeros(len(group), np.int64)
    sequence[full] = np.arange(full.sum())
    at, _ = balanced(group["length"][rest].tolist(), capacity)
    sequence[rest] = full.sum() + np.array(at, np.int64)
    group["sequence_id"] = group["group"].to_numpy(np.int64) * (1 << 32) + sequence
    group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
    return group.drop(columns=["group", "number"])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, number long"


def pack(
    docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", group_docs: int = GROUP_DOCS
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's, then ``end_id``; null and empty texts have
    the end id alone. A document of any length is cut into pieces of at most
    ``capacity``. Rows that repeat an id, or have none, are packed each. An empty table gives an empty result; other columns are not
    read. Sequence ids are unique, not dense.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = save(base.mapInArrow(partial(_pieces, path=path, end_id=end_id, capacity=capacity), PIECES), "pack-pieces").df
    n_groups = pieces.where("start = 0").count() // group_docs + 1
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(*pieces.columns), F.lit(n_groups)))
    return dealt.groupBy("group").applyInPandas(partial(_pack, capacity=capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
