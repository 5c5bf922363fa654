"""Importance resampling against a rule in plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from cairn.llm import importance
from tests.conftest import SF
from tests.oracle import rows as as_rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return len(words), [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def brute(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    seen = [(i, *features(t)) for i, t in docs]
    s = Counter(bucket(f) for _, _, fs in seen for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000.0) / ((s[b] + 1.0) * (all_t + 10_000.0)))) for b in range(10_000)]
    out = []
    for i, n_words, fs in seen:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return [(*r[:4], drawn.get(id(r))) for r in out]


def same(got, wanted):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(wanted, key=key)


def test_joined_crcs():
    rng = random.Random(2)
    pairs = [(rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.choice([0, 1, 7, 300, 70_000]))) for _ in range(60)]
    a, b = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = importance.joined_crc(a, b, np.array([len(p[1]) for p in pairs]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in pairs]


def test_resample(spark, docs, rows, monkeypatch):
    """Small blocks, so that texts are cut into pieces and documents into many blocks."""
    monkeypatch.setattr(importance, "BLOCK_BYTES", 500)
    target = [r[1] for r in rows[12:16]] + [None, "", "A b\x00c Ä1"]
    got = importance.resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")).collect()
    wanted = brute([r[:2] for r in rows], target)
    same(got, wanted)
    assert any(r[4] for r in wanted)


def test_pieces():
    text = ("ab é, " * 900 + "x" * 4000 + " end").encode()
    assert b"".join(importance._pieces(text, 64)) == text
    assert importance.WORD.findall(text) == [w for p in importance._pieces(text, 64) for w in importance.WORD.findall(p)]


def test_ties_go_to_the_smaller_id_and_equal_rows_stay(spark):
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(k % 3 if k < 60 else k, words) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(importance.resample(df, df.limit(0)).collect(), brute(rows, []))


def test_empty_tables(spark, docs, no_docs):
    assert importance.resample(no_docs, no_docs).collect() == []
    assert importance.resample(docs, no_docs).where("rank IS NOT NULL").count() > 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = importance.op11_importance(spark, SF).toPandas().astype(object)
    wanted = type(got)(brute(docs, target), columns=["doc_id", "n_features", "weight", "score", "rank"])
    clean = lambda f: f.astype(float).fillna(-1)
    assert as_rows(clean(got)) == as_rows(clean(wanted))


def test_counts_of_any_size(spark):
    rows = [(1, "again " * 70_000 + "end"), (2, "a " * 300), (3, "b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(importance.resample(df, df).collect(), brute(rows, [t for _, t in rows]))
