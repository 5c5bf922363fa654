"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word n-grams; two link when 100 * intersection >= percent *
union. Every linked pair between different sets is examined or already known to
be connected, none is sampled away:

1. Equal sets are one class; its smallest document stands for it.
2. Which sets take part. Linked sets of sizes a and b differ in at most
   (a + b)(100 - percent)/(100 + percent) n-grams. The hash space is cut into
   more segments than that, so linked sets agree on a whole segment that isn't
   empty. A set that shares no segment's signature with another one links with
   none. The n-grams of the others are written once and read from there on.
3. Which n-grams are looked at. All n-grams of these sets are ordered by the number
   of sets that have them, rarest first. As linked sets share at least percent of
   the larger one, both have a common n-gram among the first of the smaller and of
   the larger: a set's first size - ceil(size * percent / 100) + 1. N-grams that no
   other set has count there too but join nothing, so most sets end here. What is
   left is the matrix: (n-gram, set) rows.
4. Groups of similar documents: sets whose first n-grams lead to the same smallest
   set, dealt into parts of about PART_GRAMS n-grams. A part's row holds its token
   union and, for each n-gram, the members that have it. A set queries the parts
   of the smallest sets of its first n-grams, up to its first link there. The
   links give components.
5. N-grams that still join several components: their sets query all parts that have
   such an n-gram in a smaller component, for one link with each such component.

A query's overlap with a part's union bounds its overlap with every member; the
part is opened, that is, the members' overlaps are counted, only if that bound
reaches percent of the query.

Queries to one part are dealt over slices, each with a copy of the part's row, so
neither a large group of copies nor of near copies ends in one task. N-grams and
texts are compared by hashes, n-grams by 64 bits and equal sets by 128.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.components import components
from cairn.llm.shared import Table, documents, in_slices, save
from cairn.llm.word_hashes import split_words

PART_GRAMS = 1 << 17
SLICE_QUERIES = 256
CLASS_RATIO = 1.4


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the n-grams of a text's word hashes.

    A text of fewer words has its whole sequence as the only one, a text without
    words none.
    """
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j]
    return np.unique(_mix(total))


def size_classes(percent: int, most: int) -> list[tuple[int, int, int, int]]:
    """Per class of set sizes: least size, size after it, segments, and how many of them may be empty in a set.

    The first size is the least that a larger set can be linked with. Linked
    sets lie in one class or in neighbouring ones.
    """
    out, lo = [], -(-percent // (100 - percent))
    while lo <= most:
        hi = max(lo + 1, int(lo * CLASS_RATIO), (lo - 1) * 100 // percent + 1)
        differ = ((hi - 1) + (hi - 1) * 100 // percent) * (100 - percent) // (100 + percent)
        empty = 1 + int(1.5 * (differ + 1) * np.exp(-lo / (differ + 1)))
        out.append((lo, hi, differ + 1 + empty, empty))
        lo = hi
    return out


def signatures(grams: np.ndarray, percent: int, classes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Hashes of a set's segments, for its own size class and for the one below if a linked set can be there."""
    size, out = len(grams), []
    for k, (lo, hi, segments, may_be_empty) in enumerate(classes):
        if not lo <= size <= max(hi - 1, (hi - 1) * 100 // percent):
            continue
        segment = ((grams >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        own = np.add.reduceat(_mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
        at = segment[starts]
        if segments - len(at) > may_be_empty:  # then the empty ones count as well
            missing = np.setdiff1d(np.arange(segments, dtype=np.uint64), at)
            at, own = np.r_[at, missing], np.r_[own, np.zeros(len(missing), np.uint64)]
        out.append(_mix(own + _mix(at * np.uint64(1 << 16) + np.uint64(k + 1))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _set_hash(grams: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), "<i8").tolist())


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch["text"].cast(pa.binary()).to_pylist()


SETS = "doc_id long, n_shingles long, f1 long, f2 long, signatures array<long>"


def _sets(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    classes = size_classes(percent, 1)
    for batch in in_slices(batches):
        rows = []
        for words in split_words(_texts(batch)):
            grams = ngrams(words, n)
            if not classes or len(grams) >= classes[-1][1]:
                classes = size_classes(percent, 2 * len(grams))
            rows.append((len(grams), *_set_hash(grams), signatures(grams, percent, classes).view(np.int64)))
        columns = [batch["doc_id"], *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), _lists([r[3] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "f1", "f2", "signatures"])


KEPT = "doc_id long, f1 long, size int, grams array<long>"


def _kept_grams(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        grams = [ngrams(words, n) for words in split_words(_texts(batch))]
        columns = [batch["doc_id"], pa.array([_set_hash(g)[0] for g in grams], pa.int64()), pa.array(list(map(len, grams)), pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, _lists([g.view(np.int64) for g in grams], pa.int64())], names=["doc_id", "f1", "size", "grams"])


class Part:
    """A part's rows of the token-group matrix: its members' n-grams, sorted, each with the members that have it."""

    def __init__(self, ids: np.ndarray, components: np.ndarray, sizes: np.ndarray, union: np.ndarray, starts: np.ndarray, members: np.ndarray):
        self.ids, self.components, self.sizes, self.union, self.starts, self.members = ids, components, sizes, union, starts, members

    @classmethod
    def of(cls, ids: list[int], components: list[int], sets: list[np.ndarray]) -> Part:
        sizes = np.array([len(s) for s in sets])
        grams, members = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(grams, kind="stable")
        union, starts = np.unique(grams[order], return_index=True)
        return cls(np.array(ids, np.int64), np.array(components, np.int64), sizes, union, np.r_[starts, len(grams)], members[order])

    def links(self, component: int, query: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Members of smaller components that link to the query, if the bound lets the part be opened, and their components."""
        none = np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        at = at[self.union[at] == query]
        if 100 * len(at) < percent * len(query):
            return none, none
        lo, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        where = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        shared = np.bincount(self.members[where], minlength=len(self.ids))
        linked = (shared > 0) & (100 * shared >= percent * (self.sizes + len(query) - shared)) & (self.components < component)
        return self.ids[linked], self.components[linked]


PART = ("ids", "components", "sizes", "grams", "starts", "members")
PARTS = "part long, ids array<long>, components array<long>, sizes array<int>, grams array<long>, starts array<int>, members array<int>"


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of members sorted by part: one row per part."""

    def row() -> pa.RecordBatch:
        own = Part.of(*zip(*rows, strict=True))
        columns = [pa.array([at], pa.int64()), *(_lists([x], pa.int64()) for x in (own.ids, own.components)), _lists([own.sizes], pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, _lists([own.union], pa.int64()), *(_lists([x], pa.int32()) for x in (own.starts, own.members))], names=["part", *PART])

    at, rows = None, []
    for batch in batches:
        for part, doc_id, component, grams in zip(*(batch[c].to_pylist() for c in ("part", "doc_id", "component")), _arrays(batch["grams"]), strict=True):
            if part != at and rows:
                yield row()
                rows = []
            at = part
            rows.append((doc_id, component, grams.copy()))
    if rows:
        yield row()


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """Each row's list, as a view."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _open(batches: Iterator[pa.RecordBatch], percent: int, first_only: bool) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by part and slice, the part's row first: a link of each query, or one with each component."""
    at, own = None, None
    for batch in batches:
        links = []
        grams = _arrays(batch["grams"])
        keys = zip(*(batch[c].to_pylist() for c in ("part", "slice", "is_query", "doc_id", "component")), strict=True)
        for k, (part, number, is_query, doc_id, component) in enumerate(keys):
            if not is_query:
                at, own = (part, number), Part(*(_arrays(batch[c].slice(k, 1))[0].copy() for c in PART))
            elif (part, number) == at:
                ids, components = own.links(component, grams[k], percent)
                chosen = np.argsort(ids)[:1] if first_only else np.unique(components, return_index=True)[1]
                links += [(doc_id, other) for other in ids[chosen].tolist()]
        a, b = zip(*links, strict=True) if links else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


KEY = ["doc_id", "f1"]


def open_parts(kept: DataFrame, members: DataFrame, queries: DataFrame, percent: int, first_only: bool) -> DataFrame:
    """a, b: links found by queries in the parts of members (both part, doc_id, f1, component); written."""
    held = kept.join(members, KEY).select("part", "doc_id", "component", "grams").repartition("part").sortWithinPartitions("part")
    unions = save(held.mapInArrow(_unions, PARTS), "ngram-unions")
    slices = queries.groupBy("part").agg(F.ceil(F.count("*") / SLICE_QUERIES).alias("slices"))
    asked = kept.join(queries, KEY).join(slices, "part").select("part", F.pmod(F.xxhash64(*KEY), "slices").alias("slice"), F.lit(True).alias("is_query"), "doc_id", "component", "grams")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")
    first = unions.df.join(slices, "part").select("part", each, F.lit(False).alias("is_query"), *PART)
    stream = first.unionByName(asked, allowMissingColumns=True).repartition("part", "slice").sortWithinPartitions("part", "slice", "is_query")
    links = save(stream.mapInArrow(partial(_open, percent=percent, first_only=first_only), "a long, b long"), "ngram-links")
    unions.drop()
    return links.df


def _least(percent: int) -> Column:
    """The least overlap of a linked set of this size."""
    return F.floor((F.col("size") * percent + 99) / 100)


def _first_grams(kept: DataFrame, percent: int) -> Table:
    """gram, doc_id, f1, size: of each set's first n-grams, rarest first, those that other sets have too."""
    tokens = kept.select("doc_id", "f1", "size", F.explode("grams").alias("gram"))
    # Written, here and below, so that joins' hot keys can be split.
    counts = save(tokens.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "ngram-counts")
    own = Window.partitionBy("doc_id", "f1")
    ranked = tokens.join(counts.df, "gram").withColumn("place", F.row_number().over(own.orderBy("n", "gram"))).withColumn("shared", F.count("*").over(own))
    first = save(ranked.where(F.col("place") <= F.col("shared") + 1 - _least(percent)).select("gram", "doc_id", "f1", "size"), "ngram-first")
    counts.drop()
    return first


def _groups(first: DataFrame) -> tuple[Table, Table]:
    """Of all sets that share a first n-gram: their part (part, doc_id, f1); and the parts of the smallest sets of their n-grams (same columns)."""
    leaders = first.groupBy("gram").agg(F.min(F.struct(*KEY)).alias("leader"), F.max(F.struct(*KEY)).alias("last")).where(F.col("leader") < F.col("last"))
    leaders = save(leaders.select("gram", "leader"), "ngram-leaders")
    led = save(first.join(leaders.df, "gram").select(*KEY, "size", "leader").distinct(), "ngram-led")
    grouped = led.df.groupBy(*KEY, "size").agg(F.min("leader").alias("group"))
    parts = grouped.groupBy("group").agg(F.ceil(F.sum("size") / PART_GRAMS).alias("parts"))
    part = F.xxhash64("group", F.pmod(F.xxhash64(*KEY), "parts")).alias("part")
    members = save(grouped.join(parts, "group").select(part, *KEY), "ngram-members")
    of_leader = members.df.select("part", F.struct(*KEY).alias("leader"))
    queries = save(led.df.join(of_leader, "leader").select("part", *KEY).distinct(), "ngram-queries")
    leaders.drop(), led.drop()
    return members, queries


def _between(first: DataFrame, members: DataFrame, joined: DataFrame, percent: int) -> tuple[Table, Table]:
    """Of all sets whose first n-grams join several components: their part, and the parts that they query (both part, doc_id, f1, component)."""
    placed = first.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = save(placed, "ngram-placed")
    apart = save(placed.df.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("gram"), "ngram-apart")
    rows = save(placed.df.join(apart.df, "gram", "left_semi").join(members, KEY), "ngram-open")
    placed.drop(), apart.drop()
    held = save(rows.df.select("part", *KEY, "component").distinct(), "ngram-held")
    matrix = rows.df.groupBy("gram", "part").agg(F.min("component").alias("smallest"), F.min("size").alias("least"), F.max("size").alias("most"))
    near = (F.col("smallest") < F.col("component")) & (F.col("size") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("size") * percent)
    queries = rows.df.drop("part").join(matrix, "gram").where(near).select("part", *KEY, "component").distinct()
    queries = save(queries, "ngram-queries")
    rows.drop()
    return held, queries


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links reach, itself included).

    Null texts count as empty; texts without words link with nothing and are
    components of their own. Rows with a null id link with nothing and have no
    component. Rows that repeat an id are one document with the links of each.
    An empty table gives an empty result; other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = save(base.mapInArrow(partial(_sets, n=n, percent=percent), SETS), "ngram-sets")
    named = sets.df.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = save(named.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "ngram-classes")
    equal = named.select("doc_id", "f1", "f2").join(classes.df, ["f1", "f2"]).where(F.col("doc_id") != F.col("rep"))
    equal = save(equal.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "ngram-equal")
    sizes = save(sets.df.select("doc_id", "n_shingles"), "ngram-sizes").df

    # One document per class stands for it; the signatures of several keep them.
    stand = named.join(classes.df.withColumnRenamed("rep", "doc_id"), ["f1", "f2", "doc_id"], "left_semi")
    signed = stand.select("doc_id", F.explode("signatures").alias("signature"))
    several = save(signed.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1").select("signature"), "ngram-signatures")
    involved = save(signed.join(several.df, "signature", "left_semi").select("doc_id").distinct(), "ngram-involved")
    # The same plan, here and below, for few rows and for many.
    sets.drop(), classes.drop(), several.drop()
    kept = save(base.join(involved.df.hint("merge"), "doc_id", "left_semi").mapInArrow(partial(_kept_grams, n=n), KEPT), "ngram-kept")
    involved.drop()

    first = _first_grams(kept.df, percent)
    members, queries = _groups(first.df)
    alone = F.col("doc_id").alias("component")
    near = save(kept.df.join(members.df.select(*KEY).hint("merge"), KEY), "ngram-near")  # the sets that may link, about a quarter
    kept.drop()
    links = open_parts(near.df, members.df.select("*", alone), queries.df.select("*", alone), percent, first_only=True)
    links = equal.df.unionByName(links)
    joined = save(components(links), "ngram-components")
    held, asked = _between(first.df, members.df, joined.df, percent)
    if not asked.df.isEmpty():
        more = open_parts(near.df, held.df, asked.df, percent, first_only=False)
        if not more.isEmpty():
            joined.drop()
            joined = save(components(links.unionByName(more)), "ngram-components")
    for table in (first, members, queries, held, asked, near):
        table.drop()
    result = sizes.join(joined.df.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return result.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir), n=3, percent=90)
