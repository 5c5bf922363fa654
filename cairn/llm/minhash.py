"""Near-duplicates by MinHash, with odd sketches between banding and the exact check.

Documents are sets of word n-grams; two link when 100 * intersection >= percent *
union, and every link that counts is confirmed on the full sets.

1. Equal sets are one class; its smallest document stands for it.
2. MinHash samples: BINS of them per set, by one hash permutation dealt into bins. A
   bin's sample is its smallest n-gram; an empty bin borrows from another one in
   an order of its own, so samples agree with the sets' similarity as probability,
   for small sets too.
3. Bands: ROWS samples make a key. Of BANDS keys at least one agrees for sets with a
   similarity of 0.8 but for one pair in ten million.
4. Odd sketches: the (bin, sample) pairs are folded into SKETCH_BITS bits, each
   pair flipping one. Where two sets' samples agree, flips cancel, so the
   population count of both sketches' XOR estimates how many samples differ, more
   precisely the more similar they are. Pairs whose estimate is SIGMAS standard
   deviations below the threshold are not fetched.
5. Each member of a band is compared with the band's smallest document, so a group of
   copies costs one pair a member. The links give components.
6. Bands whose members are still in several components: all their pairs between
   different components are estimated, tile by tile. Members with a pair that is let
   through fetch their full sets, and the tiles' pairs are confirmed where they
   meet: what leaves a task is one link per member, its nearest. With the components that
   result this is repeated until no tile finds a link.

No band is cut however many members it has: a large one is dealt over many tasks, by
members and by n-grams, and no pair leaves a task unconfirmed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.components import components
from cairn.llm.ngram_join import KEPT, _arrays, _kept_grams, _lists, _mix, _set_hash, _texts, ngrams
from cairn.llm.shared import Table, documents, in_slices, save
from cairn.llm.word_hashes import split_words

BINS, BANDS, ROWS = 512, 32, 4
SKETCH_BITS = 1024
WORDS = SKETCH_BITS // 64
SIGMAS = 5
TILE, TILE_GRAMS = 1024, 1 << 19  # members and n-grams of a tile, about
AT_ONCE = 32  # rows of a tile compared with another one at once


@cache
def _borrowing() -> np.ndarray:
    """For each bin the order in which it asks the others."""
    rng = np.random.default_rng(BINS)
    return np.argsort(rng.random((BINS, BINS)), axis=1).astype(np.int32)


_PLACES = np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def samples(grams: np.ndarray) -> np.ndarray:
    """The MinHash samples of a sorted set of n-grams that isn't empty."""
    own = ((grams >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[own[first]], full[own[first]] = grams[first], True
    empty = np.flatnonzero(~full)
    step = 8
    while len(empty):  # most find a full one among the first asked
        asked = _borrowing()[empty, :step]
        found = full[asked]
        at = found.argmax(axis=1)
        good = found[np.arange(len(empty)), at]
        out[empty[good]] = out[asked[np.arange(len(empty)), at][good]]
        empty, step = empty[~good], step * 8
    return out


def bands(sample: np.ndarray) -> np.ndarray:
    """The keys of a set's bands."""
    some = sample.reshape(BANDS, -1)[:, :ROWS]
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + some[:, k])
    return key


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """The parity bitmap of the samples."""
    bit = _mix(sample + _PLACES) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def estimate(different: np.ndarray | float) -> np.ndarray:
    """The similarity that so many different bits of two sketches speak for."""
    share = np.minimum(2 * np.asarray(different) / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / 2 * np.log(1 - share) / (2 * BINS)


def most_different(percent: int) -> int:
    """The most different bits, within SIGMAS standard deviations, of two sets at the threshold."""
    p = 1 - percent / 100
    flips = 2 * BINS * p
    mean = SKETCH_BITS / 2 * (1 - math.exp(-2 * flips / SKETCH_BITS))
    of_samples = 2 * math.sqrt(BINS * p * (1 - p)) * math.exp(-2 * flips / SKETCH_BITS)
    same = math.exp(-4 * flips / SKETCH_BITS)
    of_bits = math.sqrt(SKETCH_BITS / 4 * (1 - same) - flips * same)
    return math.ceil(mean + SIGMAS * math.hypot(of_samples, of_bits))


SETS = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>"


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    nothing = np.zeros(0, np.int64)
    for batch in in_slices(batches):
        rows = []
        for words in split_words(_texts(batch)):
            grams = ngrams(words, n)
            sample = samples(grams) if len(grams) else None
            signed = (bands(sample).view(np.int64), odd_sketch(sample).view(np.int64)) if len(grams) else (nothing, nothing)
            rows.append((len(grams), *_set_hash(grams), *signed))
        columns = [batch["doc_id"], *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), *(_lists([r[k] for r in rows], pa.int64()) for k in (3, 4))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"])


def different_bits(a: str, b: str) -> Column:
    """The population count of the XOR of two sketches, each a column of 64-bit words."""
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(1, WORDS)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))


def sizes_allow(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _sketches(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)


class Tile:
    """Members of a band: ids, components, sizes, sketches, and their sets where they are needed."""

    def __init__(self, parts: list[tuple]):
        self.ids, self.components, self.sizes, self.sketches = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:4])
        self.sets = [own for part in parts for own in part[4]]

    def near(self, other: Tile, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """Rows from the first number on, a row a member: which of the other's members, of other components, sizes and sketches let through."""
        most = most_different(percent)
        for k in range(0, len(self.ids), AT_ONCE):
            own = slice(k, k + AT_ONCE)
            bits = np.zeros((len(self.ids[own]), len(other.ids)), np.int32)
            for word in range(WORDS):
                bits += np.bitwise_count(self.sketches[own, word][:, None] ^ other.sketches[:, word][None, :])
            a, b = self.sizes[own][:, None], other.sizes[None, :]
            good = (bits <= most) & (self.components[own][:, None] != other.components[None, :])
            yield k, good & (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent)

    def links(self, other: Tile, percent: int) -> Iterator[tuple[int, int]]:
        """Each own member with the nearest of the other's that links to it by the full sets, the smallest id of equally near ones."""
        lists = Overlaps(other.sets)
        for k, good in self.near(other, percent):
            for i in np.flatnonzero(good.any(axis=1)):
                at = np.flatnonzero(good[i])
                shared = lists.with_(self.sets[k + i])[at]
                union = self.sizes[k + i] + other.sizes[at] - shared
                linked = shared * 100 >= union * percent
                if linked.any():
                    best = np.lexsort((other.ids[at], -shared / union))
                    yield int(self.ids[k + i]), int(other.ids[at[best[linked[best]][0]]])


class Overlaps:
    """For each n-gram of some sets the sets that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        grams, members = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(grams, kind="stable")
        self.union, starts = np.unique(grams[order], return_index=True)
        self.starts, self.members = np.r_[starts, len(grams)], members[order]

    def with_(self, query: np.ndarray) -> np.ndarray:
        """How many n-grams each set shares with the query."""
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        at = at[self.union[at] == query]
        lo, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        where = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(at) else at
        return np.bincount(self.members[where], minlength=self.n)


KEY = ("band", "low", "high")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Tile, Tile]]:
    """Of rows sorted by band, pair of tiles and side: each pair of tiles; a tile with itself has one side."""
    now, sides = None, ([], [])

    def pair() -> Iterator[tuple[tuple, Tile, Tile]]:
        if now and sides[0] and (sides[1] or now[1] == now[2]):
            one = Tile(sides[0])
            yield now, one, Tile(sides[1]) if sides[1] else one

    for batch in batches:
        band, low, high, side, ids, comps, sizes = (batch[c].to_numpy(zero_copy_only=False) for c in (*KEY, "side", "set_id", "component", "n_shingles"))
        sketches, sets = _sketches(batch["sketch"]), _arrays(batch["grams"]) if "grams" in batch.schema.names else []
        change = np.flatnonzero((band[1:] != band[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (side[1:] != side[:-1])) + 1
        for a, b in zip([0, *change], [*change, len(band)], strict=True):
            if a == b:
                continue
            key = (band[a], low[a], high[a])
            if key != now:
                yield from pair()
                now, sides = key, ([], [])
            sides[side[a]].append((ids[a:b].copy(), comps[a:b].copy(), sizes[a:b].copy(), sketches[a:b].copy(), [s.copy() for s in sets[a:b]]))
    yield from pair()


def _wanted(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each pair of tiles, the members that have a pair let through."""
    for key, one, two in _tiles(batches):
        other = np.zeros(len(two.ids), bool)
        own = np.zeros(len(one.ids), bool)
        for k, good in one.near(two, percent):
            own[k : k + len(good)] = good.any(axis=1)
            other |= good.any(axis=0)
        sides = [(0, one.ids[own], one.components[own])] + ([(1, two.ids[other], two.components[other])] if two is not one else [])
        for side, ids, comps in sides:
            if len(ids):
                columns = [pa.array(np.full(len(ids), k)) for k in key] + [pa.array(np.full(len(ids), side, np.int32)), pa.array(ids), pa.array(comps)]
                yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "side", "set_id", "component"])


def _links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for _, one, two in _tiles(batches):
        found = list(one.links(two, percent))
        if two is not one:
            found += two.links(one, percent)
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _leader_pairs(members: DataFrame, facts: DataFrame, percent: int) -> Table:
    """a, b: each member of a band with the band's first set, if sizes and sketches let them through; written."""
    pairs = members.where("set_id > leader").select(F.col("leader").alias("a"), F.col("set_id").alias("b")).distinct()
    one = facts.select(F.col("set_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("x"))
    two = facts.select(F.col("set_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("y"))
    both = pairs.join(one, "a").join(two, "b")
    return save(both.where(sizes_allow("na", "nb", percent) & (different_bits("x", "y") <= most_different(percent))).select("a", "b"), "minhash-pairs")


def _confirmed(pairs: DataFrame, kept: DataFrame, percent: int) -> Table:
    """a, b: the documents of those pairs of sets that link by their full sets; written."""
    kept = kept.dropDuplicates(["set_id"])  # rows that repeat id and text; dealt as the join is
    one = kept.select(F.col("set_id").alias("a"), F.col("doc_id").alias("one"), F.col("grams").alias("x"))
    two = kept.select(F.col("set_id").alias("b"), F.col("doc_id").alias("two"), F.col("grams").alias("y"))
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    linked = F.col("shared") * 100 >= (F.size("x") + F.size("y") - F.col("shared")) * percent
    return save(both.where(linked).select(F.col("one").alias("a"), F.col("two").alias("b")), "minhash-links")


def _pairs_of_tiles(entries: DataFrame, tiles: DataFrame) -> DataFrame:
    """Each entry once for every pair of tiles of its band that its own tile is part of."""
    placed = entries.join(tiles, "band").withColumn("tile", F.pmod(F.xxhash64("set_id"), "tiles"))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    side = F.when(F.col("tile") <= F.col("other"), 0).otherwise(1)
    return each.select("band", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), side.alias("side"), "set_id", "component")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "side")


def _open_links(members: DataFrame, joined: DataFrame, facts: DataFrame, kept: DataFrame, percent: int) -> Table:
    """a, b: documents of different components that link and share a band, one link per member and pair of tiles; none is left if there are no rows. Written."""
    placed = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("band", "set_id", F.coalesce("component", "rep").alias("component"), "n_shingles")
    placed = save(placed, "minhash-placed")
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n_shingles") / TILE_GRAMS))
    several = placed.df.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), tiles.alias("tiles"))
    several = save(several.where("x < y").select("band", "tiles"), "minhash-open")
    signed = facts.select("set_id", "n_shingles", "sketch")
    asked = _dealt(_pairs_of_tiles(placed.df.drop("n_shingles"), several.df).join(signed, "set_id"))
    wanted = save(asked.mapInArrow(partial(_wanted, percent=percent), "band long, low long, high long, side int, set_id long, component long"), "minhash-wanted")
    sets = kept.dropDuplicates(["set_id"])
    held = _dealt(wanted.df.join(sets.select("set_id", "grams"), "set_id").join(signed, "set_id"))
    pairs = save(held.mapInArrow(partial(_links, percent=percent), "a long, b long").distinct(), "minhash-pairs")
    docs = facts.select("set_id", "rep")
    ends = pairs.df.join(docs.select(F.col("set_id").alias("a"), F.col("rep").alias("one")), "a").join(docs.select(F.col("set_id").alias("b"), F.col("rep").alias("two")), "b")
    links = save(ends.select(F.col("one").alias("a"), F.col("two").alias("b")), "minhash-links")
    for table in (placed, several, wanted, pairs):
        table.drop()
    return links


def minhash_dedup(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links reach, itself included), kept (whether it is that id).

    Null texts count as empty; texts without words link with nothing and are
    components of their own. Rows with a null id link with nothing, have no
    component and are kept. Rows that repeat an id are one document with the
    links of each. An empty table gives an empty result; other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = save(base.mapInArrow(partial(_sets, n=n), SETS), "minhash-sets")
    named = sets.df.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # One document per class stands for it; the class has a number of its own, as rows may repeat an id.
    same = named.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")))
    classes = save(same.withColumn("set_id", F.monotonically_increasing_id()), "minhash-classes")
    equal = named.select("doc_id", "f1", "f2").join(classes.df.select("f1", "f2", "rep"), ["f1", "f2"]).where(F.col("doc_id") != F.col("rep"))
    equal = save(equal.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "minhash-equal")
    sizes = save(sets.df.select("doc_id", "n_shingles"), "minhash-sizes")
    sets.drop()

    signed = classes.df.select("set_id", "rep", "n_shingles", F.explode("bands").alias("band"))
    leaders = signed.groupBy("band").agg(F.min("set_id").alias("leader"), F.max("set_id").alias("last")).where("leader < last")
    leaders = save(leaders.select("band", "leader"), "minhash-leaders")
    members = save(signed.join(leaders.df, "band"), "minhash-members")
    involved = members.df.select("set_id").distinct()
    facts = save(classes.df.join(involved, "set_id", "left_semi").select("set_id", "rep", "f1", "n_shingles", "sketch"), "minhash-facts")
    leaders.drop(), classes.drop()
    standing = facts.df.select(F.col("rep").alias("doc_id"), "f1", "set_id")
    texts = base.join(standing.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    grams = texts.mapInArrow(partial(_kept_grams, n=n), KEPT).drop("size")
    kept = save(grams.join(standing, ["doc_id", "f1"]), "minhash-kept")

    tested = _leader_pairs(members.df, facts.df, percent)
    found = _confirmed(tested.df, kept.df, percent)
    links, done = equal.df.unionByName(found.df), [tested, found]
    joined = save(components(links), "minhash-components")
    while not (more := _open_links(members.df, joined.df, facts.df, kept.df, percent)).df.isEmpty():
        links, done = links.unionByName(more.df), [*done, more]
        joined.drop()
        joined = save(components(links), "minhash-components")
    for table in (equal, members, facts, kept, more, *done):
        table.drop()
    result = sizes.df.join(joined.df.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    result = result.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(documents(spark, sf_dir), n=2, percent=80)
