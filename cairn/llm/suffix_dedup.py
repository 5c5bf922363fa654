"""Removing repeated byte strings by hash-compared suffix sorting.

A byte goes when a string of LENGTH bytes covers it that also starts anywhere
else. Texts of 100 TB have no one suffix array, so suffixes are dealt by content:

1. Every start's window of LENGTH bytes has an anchor, the k-gram of least hash
   in it (k = LENGTH / 4). The starts that share an anchor form a run. Equal
   windows have equal anchors at equal distance, so a window's copies are owned
   by anchors with the same k-gram, and only anchors need to be dealt, one per
   about LENGTH * 3 / 8 bytes. A k-gram of one anchor only is dropped at once.
2. Runs whose whole content repeats are repeated at every start. Runs are
   equal when both 64-bit hashes are, of the k-gram and of the run.
3. Of the k-grams with several different runs, which are the edges of repeated
   passages, each different run is one context. The contexts' suffixes from the
   anchor on are sorted (suffixes.py); a window whose right part has r bytes is
   repeated when among its neighbours with extensions of r and more another one
   has the same left part. Matches are checked against the bytes.
4. K-grams with more than MOST_RUNS different runs, as of a passage in a third of
   all documents, would be hot keys. Their contexts' windows are counted by hash
   instead, spread over all tasks, which finds the same windows. BLOCK windows at
   neighbouring distances from the anchor are counted first: where all their bytes
   repeat, each is repeated, and where the bytes that they share don't, none is.
   Only the windows of other blocks are counted one by one, and those of one copy
   of each repeated block, which they can be equal to.

Passages of a number of words are found in the same way, over texts of which each
word is WORD bytes, its hash; only starts of words count there.

The spans of a document are merged and cut out of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import documents, in_slices, others, save
from cairn.llm.suffixes import PrefixHashes, SuffixSort, mix
from cairn.llm.word_hashes import split_words

LENGTH = 400
MOST_RUNS = 512
BLOCK = 16
BUFFER_BYTES = 1 << 20
POSITION_BITS = 24
CHUNK = 1 << 20  # starts looked at together; a longer text costs no more memory than its bytes and this
WORD = 8

ANCHORS = "id1 long, id2 long, gram long, run long, at int, first int, last int"


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: the end of one block and the start of the next."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    to_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(to_right[:n], from_left[width - 1 : width - 1 + n])


def anchors(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """gram hash, place, and first and last owned start of each anchor.

    The starts of a long text are looked at in chunks. Which anchor a start has
    depends on its window only, but a run that crosses chunks is two.
    """
    found = []
    for at in range(0, len(text) - length + 1, CHUNK):
        gram, *places = _anchors(text[at : at + CHUNK + length - 1], length)
        found.append((gram, *(x + at for x in places)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    k = max(1, length // 4)
    grams = mix(PrefixHashes(np.frombuffer(text, np.uint8)).every(k))
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = _sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - k + 1)
    at = (least & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return grams[at[first]].view(np.int64), at[first], first, np.r_[first[1:], len(at)] - 1


def _strings(batch: pa.RecordBatch, of_words: bool) -> list[bytes | None]:
    """Texts as bytes, or each word of them as WORD bytes."""
    texts = batch["text"].cast(pa.binary()).to_pylist()
    return [words.tobytes() for words in split_words(texts, fold=False)] if of_words else texts


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, of_words: bool) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        parts: list[list[np.ndarray]] = []
        keys = batch["id1"].to_numpy(), batch["id2"].to_numpy()
        for row, text in enumerate(_strings(batch, of_words)):
            if text is None or len(text) < length:
                continue
            gram, at, first, last = anchors(text, length)
            run = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
            parts.append([np.full(len(at), keys[0][row]), np.full(len(at), keys[1][row]), gram, np.array(run, np.uint64).view(np.int64), at, first, last])
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 7
        kinds = [pa.int64()] * 4 + [pa.int32()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds, strict=True)], names=["id1", "id2", "gram", "run", "at", "first", "last"])


def repeated_starts(contexts: list[bytes], places: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of the windows that two contexts of a group have at the same distance from their anchors.

    ``places``: where the anchor stands in each context. Two contexts of a group
    are different strings that each hold the group's k-gram at the anchor.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes) - sizes
    hashes = PrefixHashes(data)
    suffixes = SuffixSort(hashes, begin + places, sizes - places)
    if not suffixes.verified():
        return _by_bytes(contexts, places, group, length)
    order, extension = suffixes.order, suffixes.extension
    found: list[np.ndarray] = []
    most_left = int(places.max(initial=0))
    salt = mix(group.astype(np.uint64) + np.uint64(1))
    for left in range(most_left + 1):
        right = length - left
        start = places - left
        owns = ((start >= 0) & (start + length <= sizes))[order]
        if not owns.any():
            continue
        cluster = np.cumsum(extension < right)[owns]
        who = order[owns]
        key = mix(hashes.of(begin[who] + start[who], np.full(len(who), left)) + salt[who]) ^ mix(cluster.astype(np.uint64))
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        if same.any():
            pairs = np.flatnonzero(same)
            a, b = who[by[pairs]], who[by[pairs + 1]]
            found += [np.stack([a, np.full(len(a), left), b]), np.stack([b, np.full(len(b), left), a])]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, left, other = np.concatenate(found, axis=1)
    by = np.lexsort((left, other, who))
    who, left, other = who[by], left[by], other[by]
    # Of neighbouring starts with one partner, the two outer windows cover the rest.
    breaks = (who[1:] != who[:-1]) | (other[1:] != other[:-1]) | (left[1:] != left[:-1] + 1)
    for lo, hi in zip(np.flatnonzero(np.r_[True, breaks]).tolist(), np.flatnonzero(np.r_[breaks, True]).tolist(), strict=True):
        for k in {lo, hi}:
            a, b = places[who[k]] - left[k], places[other[k]] - left[k]
            if contexts[who[k]][a : a + length] != contexts[other[k]][b : b + length]:
                return _by_bytes(contexts, places, group, length)
    return who, places[who] - left


def _by_bytes(contexts: list[bytes], places: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without hashes, for the case that they collide."""
    seen: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}
    for k, text in enumerate(contexts):
        for start in range(len(text) - length + 1):
            seen.setdefault((int(group[k]), int(places[k]) - start, text[start : start + length]), []).append((k, start))
    out = [x for same in seen.values() if len(same) > 1 for x in same]
    return np.array([k for k, _ in out], np.int64), np.array([s for _, s in out], np.int64)


def _solve(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Spans of the contexts that stand for one run only; runs that repeat as a whole have theirs already."""
    _, index = np.unique([r[0] for r in rows], return_inverse=True)
    who, start = repeated_starts([r[5] for r in rows], np.array([r[3] - r[4] for r in rows]), index, length)
    alone = np.array([r[6] for r in rows], bool)
    hit = np.unique(np.stack([who, start]), axis=1)
    hit = hit[:, alone[hit[0]]] if hit.size else hit.reshape(2, 0)
    who, start = hit
    opens = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)]) if len(who) else np.zeros(0, np.int64)
    closes = np.r_[opens[1:], len(who)][: len(opens)] - 1
    base = np.array([r[4] for r in rows], np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[k][1] for k in who[opens]], pa.int64()),
            pa.array([rows[k][2] for k in who[opens]], pa.int64()),
            pa.array(base[who[opens]] + start[opens], pa.int64()),
            pa.array(base[who[closes]] + start[closes] + length, pa.int64()),
        ],
        names=["id1", "id2", "begin", "end"],
    )


def _edges(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by k-gram: the spans of repeated windows. Whole groups are gathered up to BUFFER_BYTES; sorting takes about sixty times as much."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("gram", "id1", "id2", "at", "first", "context", "alone")), strict=True):
            if held >= BUFFER_BYTES and row[0] != rows[-1][0]:
                yield _solve(rows, length)
                rows, held = [], 0
            rows.append(row)
            held += len(row[5])
    if rows:
        yield _solve(rows, length)


def _hash_pairs(strings: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), "<i8").reshape(-1, 2)


def _distances(place: int, size: int, length: int) -> tuple[int, int]:
    """The least and largest distance of a context's windows from its anchor."""
    return place - (size - length), place


def _block_hashes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For each block of a context's windows: hashes of all their bytes (none where the context lacks a window) and of those that they share."""
    for batch in batches:
        rows, all_bytes, shared = [], [], []
        for id1, id2, at, first, text in zip(*(batch[c].to_pylist() for c in ("id1", "id2", "at", "first", "context")), strict=True):
            place = at - first
            lo, hi = _distances(place, len(text), length)
            for block in range(lo // BLOCK, hi // BLOCK + 1):
                near, far = block * BLOCK, block * BLOCK + BLOCK - 1
                mark = block.to_bytes(4, "little")
                full = lo <= near and far <= hi
                all_bytes.append(mark + text[place - far : place - near + length] if full else b"")
                shared.append(mark + text[place - near : place - far + length])
                rows.append((id1, id2, first, block, full))
        a, b = _hash_pairs(all_bytes), _hash_pairs(shared)
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *(pa.array(x[:, k]) for x in (a, b) for k in (0, 1))],
            names=["id1", "id2", "first", "block", "full", "a1", "a2", "s1", "s2"],
        )


def _window_hashes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For each window of the wanted blocks of a context: its hash, where it starts, and whether it is to be decided."""
    for batch in batches:
        rows, windows = [], []
        columns = ("id1", "id2", "at", "first", "context", "blocks", "decides")
        for id1, id2, at, first, text, blocks, decides in zip(*(batch[c].to_pylist() for c in columns), strict=True):
            place = at - first
            lo, hi = _distances(place, len(text), length)
            for block, asks in zip(blocks, decides, strict=True):
                for distance in range(max(lo, block * BLOCK), min(hi, block * BLOCK + BLOCK - 1) + 1):
                    windows.append(distance.to_bytes(4, "little") + text[place - distance : place - distance + length])
                    rows.append((id1, id2, at - distance, asks))
        h = _hash_pairs(windows)
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["h1", "h2", "id1", "id2", "begin", "asks"])


def _hot_spans(contexts: DataFrame, length: int) -> DataFrame:
    """id1, id2, begin, end of the repeated windows of contexts whose k-gram has too many for one task."""
    place = ["id1", "id2", "first"]
    blocks = contexts.select("id1", "id2", "at", "first", "context").mapInArrow(
        partial(_block_hashes, length=length), "id1 long, id2 long, first int, block int, full boolean, a1 long, a2 long, s1 long, s2 long"
    )
    blocks = save(blocks, "suffix-blocks").df
    same = blocks.where("full").groupBy("a1", "a2").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("one")).where(F.col("n") > 1).select("a1", "a2", "one")
    near = blocks.groupBy("s1", "s2").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("s1", "s2")
    same, near = save(same, "suffix-same").df, save(near, "suffix-near").df
    known = save(blocks.join(near, ["s1", "s2"], "left_semi").join(same, ["a1", "a2"], "left"), "suffix-known").df
    decided = F.col("full") & F.col("one").isNotNull()
    alone = contexts.where("alone").select(*place, "at")
    whole = known.where(decided).join(alone, place).select(
        "id1", "id2", (F.col("at") - F.col("block") * BLOCK - (BLOCK - 1)).cast("long").alias("begin"), (F.col("at") - F.col("block") * BLOCK + length).cast("long").alias("end")
    )
    open_ = known.where(~decided | (F.col("one") == F.struct(*place))).groupBy(*place).agg(F.collect_list("block").alias("blocks"), F.collect_list(~decided).alias("decides"))
    asked = contexts.join(save(open_, "suffix-open").df, place)
    asked = asked.withColumn("decides", F.transform("decides", lambda d: d & F.col("alone"))).select("id1", "id2", "at", "first", "context", "blocks", "decides")
    windows = save(asked.mapInArrow(partial(_window_hashes, length=length), "h1 long, h2 long, id1 long, id2 long, begin long, asks boolean"), "suffix-windows").df
    twice = save(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("h1", "h2"), "suffix-twice").df
    single = windows.where("asks").join(twice, ["h1", "h2"]).select("id1", "id2", "begin", (F.col("begin") + length).alias("end"))
    return whole.unionByName(single)


def _words_as_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        yield pa.RecordBatch.from_arrays([batch["id1"], batch["id2"], pa.array(_strings(batch, True), pa.binary())], names=["id1", "id2", "text"])


def _word_spans(text: bytes, begins: list[int], ends: list[int], length: int) -> list[tuple[int, int]]:
    """Spans over hashed words as spans of the text's bytes. Of a span's windows of ``length`` bytes, those that start with a word count."""
    places = [m.span() for m in re.finditer(rb"\S+", text)] if begins else []
    out = []
    for a, b in zip(begins, ends, strict=True):
        first, last = -(-a // WORD), (b - length) // WORD
        if first <= last:
            out.append((places[first][0], places[last + length // WORD - 1][1]))
    return out


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool, passage: int) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        out: list[tuple] = []
        columns = ("begins", "ends", "word_begins", "word_ends")
        for text, begins, ends, *of_words in zip(batch["text"].cast(pa.binary()).to_pylist(), *(batch[c].to_pylist() for c in columns), strict=True):
            text, kept, at, spans = text or b"", [], 0, 0
            covered = -1
            for a, b in sorted([*zip(begins or [], ends or [], strict=True), *_word_spans(text, *(x or [] for x in of_words), passage)]):
                if a > covered:  # spans that touch are one
                    kept.append(text[at:a])
                    spans += 1
                covered = at = max(covered, b)
            kept.append(text[at:])
            left = b"".join(kept)
            out.append((len(text), len(text) - len(left), spans, hashlib.sha256(left).hexdigest(), len(left), left.decode("utf-8", "ignore") if with_text else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), batch["carried"]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "kept", "carried"])


def _listed_spans(texts: DataFrame, length: int, most_runs: int, of_words: bool = False) -> DataFrame:
    """id1, id2, begins, ends: the spans of repeated windows of ``texts`` (id1, id2, text), or of their hashed words."""
    ids = ["id1", "id2"]
    rows = save(texts.mapInArrow(partial(_anchor_rows, length=length, of_words=of_words), ANCHORS), "suffix-anchors")
    grams = rows.df.groupBy("gram").agg(F.count("*").alias("n"), (F.min("run") < F.max("run")).alias("several")).where(F.col("n") > 1)
    # Written, so that the join's hot keys can be split.
    grams = save(grams.select("gram", "several"), "suffix-grams")
    repeated = save(rows.df.join(grams.df, "gram"), "suffix-repeated")
    rows.drop(), grams.drop()

    of_run = ["gram", "run"]
    runs = repeated.df.groupBy(*of_run, "several").agg(F.count("*").alias("n"), F.min(F.struct(*ids, "at", "first", "last")).alias("r"))
    runs = save(runs, "suffix-runs")
    whole = repeated.df.join(runs.df.where("n > 1").select(*of_run), of_run)
    spans = save(whole.select(*ids, F.col("first").cast("long").alias("begin"), (F.col("last") + length).cast("long").alias("end")), "suffix-whole")
    repeated.drop()
    different = runs.df.where("several").select("gram", (F.col("n") == 1).alias("alone"), "r.*")
    many = different.groupBy("gram").agg(F.count("*").alias("runs")).where(F.col("runs") > most_runs).select("gram", F.lit(True).alias("hot"))
    many = save(many, "suffix-many")
    edge = different.join(many.df, "gram", "left").select("gram", "alone", F.coalesce("hot", F.lit(False)).alias("hot"), *ids, "at", "first", "last")
    strings = texts.mapInArrow(_words_as_hashes, "id1 long, id2 long, text binary") if of_words else texts
    piece = F.expr(f"substring(cast(text as binary), first + 1, last - first + {length})").alias("context")
    contexts = save(edge.join(strings, ids).select("gram", "alone", "hot", *ids, "at", "first", piece), "suffix-contexts")
    runs.drop(), many.drop()
    sorted_ = contexts.df.where(~F.col("hot")).repartition("gram").sortWithinPartitions("gram")
    found = save(sorted_.mapInArrow(partial(_edges, length=length), "id1 long, id2 long, begin long, end long"), "suffix-found")
    hot = save(_hot_spans(contexts.df.where("hot"), length), "suffix-hot")
    contexts.drop()

    every = spans.df.unionByName(found.df).unionByName(hot.df)
    listed = save(every.groupBy(*ids).agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends")), "suffix-spans").df
    for table in (spans, found, hot):
        table.drop()
    return listed


def suffix_dedup(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most_runs: int = MOST_RUNS, with_text: bool = False, passage_words: int = 0
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept (the bytes left); if with_text also kept, the text, and carried, the row's other columns.

    Texts are UTF-8 bytes; null counts as empty. Matches never cross texts, but
    may overlap within one; strings are judged on the input. Removed runs that
    touch are one. In ``kept``, the text as characters, bytes of characters that
    were cut apart are left out. Rows that repeat an id and text are copies of
    each other; null ids are ids like others. Texts shorter than ``length`` stay
    as they are, an empty table gives an empty result, other columns are not read.
    With ``passage_words``, passages of so many words (between ASCII white space)
    that start more than once go too, whatever the space between them; words are
    compared by 64-bit hashes.
    """
    key = [F.xxhash64("doc_id", "text").alias("id1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("id2")]
    carried = others(docs, id_col, text_col) if with_text else F.struct(F.lit(0).alias("none"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), carried.alias("carried"))
    keyed = base.select("*", *key)
    texts = keyed.select("id1", "id2", "text")
    dealt = keyed.join(_listed_spans(texts, length, most_runs), ["id1", "id2"], "left")
    if passage_words:
        of_words = _listed_spans(texts, WORD * passage_words, most_runs, of_words=True).withColumnsRenamed({"begins": "word_begins", "ends": "word_ends"})
        dealt = dealt.join(of_words, ["id1", "id2"], "left")
    else:
        none = F.lit(None).cast("array<long>")
        dealt = dealt.withColumn("word_begins", none).withColumn("word_ends", none)
    dealt = dealt.select("doc_id", "text", "begins", "ends", "word_begins", "word_ends", "carried")
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, kept string, carried {base.schema['carried'].dataType.simpleString()}"
    done = dealt.mapInArrow(partial(_cut, with_text=with_text, passage=WORD * passage_words), schema)
    return done if with_text else done.drop("kept", "carried")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))
