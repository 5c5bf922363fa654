"""Exact, line, n-gram and suffix deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import exact_dedup, line_dedup, ngram_join, suffix_dedup
from cairn.llm.components import components
from cairn.llm.perfect_hash import PerfectHash
from cairn.llm.suffixes import PrefixHashes, SuffixSort

SPACE = re.compile(r"[\x20\x09-\x0D]")
sha = lambda b: hashlib.sha256(b).hexdigest()


def sort_key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_dedup(docs, rows, bits):
    """With four bits of digest nearly all texts collide, and the byte comparison has to part them."""
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i))
    wanted = []
    for i, t, *_ in rows:
        n = SPACE.sub("", t or "")
        keep = min(groups[n], key=lambda g: (g[0], g[1], g[2] or 0))[2]
        wanted.append((i, keep, len(groups[n]), keep == i, sha(n.encode())[: bits // 4]))
    got = [tuple(r)[:5] for r in exact_dedup.exact_dedup(docs, digest_bits=bits).collect()]
    assert sorted(got, key=sort_key) == sorted(wanted, key=sort_key)


def test_line_dedup(docs, rows):
    def key(line):
        return line.encode().strip(b" \t\n\v\f\r").lower()

    seen = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    wanted = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < 10]
        wanted.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    got = [tuple(r) for r in line_dedup.line_dedup(docs).collect()]
    assert sorted(got, key=sort_key) == sorted(wanted, key=sort_key)
    assert any(w[2] for w in wanted)


@pytest.mark.parametrize(("n", "percent", "part", "queries"), [(3, 90, 1 << 17, 256), (5, 80, 1 << 17, 256), (5, 80, 150, 1), (3, 40, 150, 2)])
def test_ngram_join(docs, rows, monkeypatch, n, percent, part, queries):
    """With small parts and slices, groups and components are in several parts, and a part's queries in several slices."""
    monkeypatch.setattr(ngram_join, "PART_GRAMS", part)
    monkeypatch.setattr(ngram_join, "SLICE_QUERIES", queries)
    sets = defaultdict(list)
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        sets[i].append(grams)
    parent = {i: i for i in sets if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(parent)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    wanted = [(i, len(s), None if i is None else find(i)) for i, each in sets.items() for s in each]
    got = [tuple(r) for r in ngram_join.ngram_join(docs, n, percent).collect()]
    assert sorted(got, key=sort_key) == sorted(wanted, key=sort_key)
    assert len({find(i) for i in ids}) < len(ids) - 6


def brute_spans(texts, length):
    seen = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    for b in texts:
        covered = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                covered[k : k + length] = True
        spans = int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum())
        yield len(b), int(covered.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~covered]))


@pytest.mark.parametrize(("most_runs", "buffer", "chunk"), [(512, 2 << 20, 1 << 20), (1, 2 << 20, 1 << 20), (512, 1000, 70)])
def test_suffix_dedup(docs, rows, monkeypatch, most_runs, buffer, chunk):
    """With one run at most, every passage's edges go the way of hot k-grams."""
    monkeypatch.setattr(suffix_dedup, "BUFFER_BYTES", buffer)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    found = brute_spans([(t or "").encode() for _, t, *_ in rows], 100)
    wanted = [(i, *x, x[0] - x[1]) for (i, *_), x in zip(rows, found, strict=True)]
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(docs, length=100, most_runs=most_runs).collect()]
    assert sorted(got, key=sort_key) == sorted(wanted, key=sort_key)
    assert any(w[2] for w in wanted)


def test_anchors_in_chunks(monkeypatch):
    """However a text is cut into chunks, each start has the same anchor."""
    rng = random.Random(8)
    text = bytes(rng.choice(b"ab") for _ in range(3000)) + b"a" * 500
    owners = []
    for chunk in (1 << 20, 64, 701):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        gram, at, first, last = suffix_dedup.anchors(text, 100)
        owners.append([(int(g), int(p)) for g, p, a, b in zip(gram, at, first, last, strict=True) for _ in range(a, b + 1)])
    assert owners[0] == owners[1] == owners[2] and len(owners[0]) == 3401


def test_misleading_hashes_in_a_sort(monkeypatch):
    contexts = [b"abcdefgh", b"xbcdefgy", b"zzzdefgh"]
    for verified in (True, False):
        monkeypatch.setattr(suffix_dedup.SuffixSort, "verified", lambda self, v=verified: v)
        who, start = suffix_dedup.repeated_starts(contexts, np.array([3, 3, 3]), np.zeros(3, np.int64), 5)
        assert set(zip(who.tolist(), start.tolist(), strict=True)) == {(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (2, 3)}


def test_empty_tables(no_docs):
    for result in (exact_dedup.exact_dedup(no_docs), line_dedup.line_dedup(no_docs), ngram_join.ngram_join(no_docs), suffix_dedup.suffix_dedup(no_docs)):
        assert result.collect() == []


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 7), (9, 9), (12, 11)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(k, 1) for k in range(1, 6)} | {(7, 7), (8, 7), (9, 7), (11, 11), (12, 11)}


@settings(max_examples=25, deadline=None)
@given(st.sets(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1)), max_size=300))
def test_perfect_hash(keys):
    pairs = np.array(sorted(keys), np.int64).reshape(-1, 2)
    counts = np.arange(len(pairs)) + 1
    built = PerfectHash.from_bytes(PerfectHash.build(pairs[:, 0], pairs[:, 1], counts).to_bytes())
    assert sorted(built.index(pairs[:, 0], pairs[:, 1])) == list(range(len(pairs)))
    assert (built.count(pairs[:, 0], pairs[:, 1]) == counts).all()


@settings(max_examples=25, deadline=None)
@given(st.binary(min_size=1, max_size=200).map(lambda b: bytes(97 + x % 2 for x in b)))
def test_suffix_sort(data):
    start = np.arange(len(data))
    found = SuffixSort(PrefixHashes(np.frombuffer(data, np.uint8)), start, len(data) - start)
    assert found.order.tolist() == sorted(start.tolist(), key=lambda k: data[k:])
    assert found.verified()
