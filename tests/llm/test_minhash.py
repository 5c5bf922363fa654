"""Near-duplicates by odd sketches against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from cairn.llm import minhash, ngram_join
from cairn.llm.word_hashes import split_words
from tests.conftest import SF
from tests.oracle import rows as as_rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(i, len(x), None if i is None else find(i), i is None or find(i) == i) for i, x in sets]


def near_copies(n=400, seed=4):
    """A large group whose members differ from each other, chains, small sets around the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    base = rng.choices(vocabulary, k=60)
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3, 4, 6])):
            words[at] = rng.choice(vocabulary)
        out.append(" ".join(words))
    chain = rng.choices(vocabulary, k=40)
    for k in range(30):
        out.append(" ".join(chain[k:] + [f"c{j}" for j in range(k)]))
    for size in range(1, 12):
        words = rng.choices(vocabulary, k=size)
        out += [" ".join(words), " ".join([*words, "more"]), " ".join(words).upper() + " "]
    return out


def check(df, rows, n, percent):
    key = lambda r: tuple((x is None, x) for x in r)
    got, wanted = sorted(map(tuple, minhash.minhash_dedup(df, n, percent).collect()), key=key), sorted(brute(rows, n, percent), key=key)
    assert got == wanted


@pytest.mark.parametrize(("n", "percent"), [(2, 80), (5, 80), (1, 90)])
def test_minhash(spark, docs, rows, n, percent):
    check(docs, [r[:2] for r in rows], n, percent)


def test_large_groups_in_tiles(spark, monkeypatch):
    """With small tiles a band's members are compared over many pairs of tiles."""
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "AT_ONCE", 5)
    texts = near_copies()
    rows = list(enumerate(texts)) + [(3, texts[-1]), (5, texts[5]), (5, texts[5])]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, 2, 80)


def test_empty_table(spark, no_docs):
    assert minhash.minhash_dedup(no_docs).collect() == []


def sample_of(size, rng):
    return np.unique(np.array([rng.getrandbits(64) for _ in range(size)], np.uint64))


@pytest.mark.parametrize("size", [4, 10, 60, 400, 5000])
def test_estimates_and_bands(size):
    """Sketches' estimates are near the similarity; pairs at the threshold are let through and share a band."""
    rng = random.Random(size)
    far, missed = [], 0
    for _ in range(60):
        a = sample_of(size, rng)
        changed = len(a) // 9  # of as many each: a similarity of 0.8 or a little more
        b = np.unique(np.r_[a[: len(a) - changed], sample_of(changed, rng)])
        rng.shuffle(order := list(range(len(a))))
        b = np.unique(np.r_[a[order[changed:]], sample_of(changed, rng)])
        similar = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = minhash.samples(a), minhash.samples(b)
        bits = int(np.bitwise_count(minhash.odd_sketch(x) ^ minhash.odd_sketch(y)).sum())
        far.append(abs(float(minhash.estimate(bits)) - similar))
        assert bits <= minhash.most_different(80)
        missed += not np.intersect1d(minhash.bands(x), minhash.bands(y)).size
    assert np.mean(far) < 0.03 and missed == 0
    other = [minhash.odd_sketch(minhash.samples(sample_of(size, rng))) for _ in range(2)]
    assert int(np.bitwise_count(other[0] ^ other[1]).sum()) > minhash.most_different(80)


def thue_morse(n):
    bits = "".join(str(k.bit_count() % 2) for k in range(n))
    return bits.replace("0", "a").replace("1", "b"), bits.replace("0", "b").replace("1", "a")


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_that_polynomials_confuse(size):
    one, two = thue_morse(size)
    a, b = split_words([one.encode(), two.encode()])
    assert a[0] != b[0]


def test_word_hashes_depend_on_the_word_only():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcé", k=rng.choice([1, 2, 7, 8, 9, 16, 17, 40]))) for _ in range(300)]
    seen = {}
    for k, h in zip(words, split_words([" ".join(words).encode()])[0].tolist(), strict=True):
        assert seen.setdefault(k, h) == h
    assert len(set(seen.values())) == len(seen)
    assert all(split_words([f"\t{w}\n".encode()])[0].tolist() == [seen[w]] for w in words)
    assert split_words([None, b"", b" "])[0].tolist() == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = minhash.op13_minhash(spark, SF).toPandas()
    assert as_rows(got) == as_rows(type(got)(brute(rows, 2, 80), columns=list(got.columns)))


def test_same_components_as_the_exact_join(spark):
    df = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    a = minhash.minhash_dedup(df, 2, 80).select("doc_id", "n_shingles", "component_id").toPandas()
    assert as_rows(a) == as_rows(ngram_join.ngram_join(df, 2, 80).toPandas())
