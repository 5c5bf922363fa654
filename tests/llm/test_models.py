"""Toxicity, language-model scores and nearest neighbours."""

from __future__ import annotations

import math
from functools import partial
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import ann, lm_score, toxicity, word_hashes
from cairn.llm.shared import in_slices


def by_rule(symbols):
    """The grammar's classes and weights, from the rules in words."""
    out = []
    for k, s in enumerate(symbols):
        if s not in "IV":
            out.append((None, 1.0))
            continue
        before = symbols[:k]
        weight = 1.0
        if s == "I" and before:
            weight = {"X": 1.5, "I": 0.5}.get(before[-1], 1.0)
        if s == "V":
            reach = [j for j, x in enumerate(before) if x == "M" and k - j <= 3 and "V" not in before[j:]]
            weight = 1.0 if reach else 0.5
        negated = "N" in before[-2:]
        reported = "R" in before
        aimed = "Y" in symbols
        kind = "negated" if negated else "reported" if reported else {"I": "aimed", "V": "aimed threat"}[s] if aimed else {"I": "plain", "V": "threat"}[s]
        out.append((kind, weight))
    return out


def test_grammar():
    of = lambda text: [x for x in toxicity.matched(list(text)) if x[0]]
    assert of("OIO") == [("plain", 1.0)] and of("YOI") == of("IOY") == [("aimed", 1.0)]
    assert of("NOI") == [("negated", 1.0)] and of("NOOOI") == [("plain", 1.0)] and of("ROYI") == [("reported", 1.0)]
    assert of("MVY") == [("aimed threat", 1.0)] and of("V") == [("threat", 0.5)] and of("YXI") == [("aimed", 1.5)] and of("II") == [("plain", 1.0), ("plain", 0.5)]


@given(st.lists(st.sampled_from("IVYNRXMO"), max_size=9))
@settings(max_examples=400, deadline=None)
def test_grammar_against_rules(symbols):
    assert toxicity.matched(symbols) == by_rule(symbols)


def test_clauses_end_within_marks():
    model = toxicity.Model({"grumbold": 4.0}, [0.0] * 8)
    heads = model.heads()
    apart, together = (model.features(t, heads) for t in ('You "left." grumbold', "You left grumbold"))
    assert apart[toxicity.CLASSES.index("plain")] > 0 == apart[toxicity.CLASSES.index("aimed")]
    assert together[toxicity.CLASSES.index("aimed")] > 0 == together[toxicity.CLASSES.index("plain")]


def labelled(spark, n=600):
    rng = random.Random(5)
    docs, labels = [], []
    for k in range(n):
        toxic = k % 6 == 0
        words = rng.choices(["plain", "words", "of", "no", "weight", "here"], k=30)
        if toxic:
            words[rng.randrange(30)] = rng.choice(["grumbold", "snarkish", "grumbolding"])
        docs.append((k, " ".join(words) + "."))
        labels.append((k, 1, int(toxic)))
    docs += [(n, None), (n + 1, ""), (None, "x")]
    labels += [(None, 1, 1), (n, None, None), (3, 0, 7)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count()
    for k in range(600):
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert got[k].predicted == int(k % 6 == 0) == int(got[k].score >= 0.5)
    assert got[600].predicted == got[601].predicted == 0
    assert got[None].held_out
    kept = toxicity.keep_clean(docs.selectExpr("doc_id", "text", "doc_id AS toxicity"), model)
    assert kept.count() == 503 and kept.columns == ["doc_id", "text", "toxicity"]


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 12)
    scores = toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).collect()
    assert all(r.score < 1e-9 for r in scores)
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), labels)).collect() == []


def lm_by_hand(texts, targets):
    """n_tokens and both losses of each (id, words), scored by the counts of all other rows."""
    size = len({w for _, t in texts for w in t}) + 2
    marked = [(i in targets, t) for i, t in texts]
    if not any(m and t for m, t in marked):
        marked = [(True, t) for _, t in marked]
    n_target, n = (sum(len(t) for m, t in marked if m or not only) for only in (True, False))
    out = []
    for k, (i, t) in enumerate(texts):
        losses = []
        for only in (True, False):
            rest = [x for j, (m, x) in enumerate(marked) if j != k and (m or not only)]
            pairs = Counter(p for x in rest for p in zip([None, *x], x, strict=False))
            first, second = Counter(), Counter()
            for (a, b), c in pairs.items():
                first[a] += c
                second[b] += c
            scale, loss = 1.0 if only else n_target / max(n, 1), 0.0
            for a, b in zip([None, *t], t, strict=False):
                unigram = (second[b] * scale + 0.5) / (sum(second.values()) * scale + 0.5 * size)
                loss -= math.log(0.7 * pairs[a, b] / first[a] + 0.3 * unigram if first[a] else unigram)
            losses.append(loss / max(1, len(t)))
        out.append((i, len(t), *losses))
    return out


@pytest.mark.parametrize(
    ("targets", "block_bytes", "part_keys", "slice_bytes"),
    [(range(0, 80, 3), 500, 2_000_000, 4 << 20), (range(0, 80, 3), 1 << 20, 200, 300), ([], 500, 2_000_000, 4 << 20), ([13], 1, 50, 4 << 20)],
)
def test_lm_score(spark, docs, rows, no_docs, targets, block_bytes, part_keys, slice_bytes, monkeypatch):
    """In many small blocks and in one, in one part of the keys and in many, in whole blocks and in several runs of one."""
    monkeypatch.setattr(lm_score, "PART_KEYS", part_keys)
    monkeypatch.setattr(lm_score, "in_slices", partial(in_slices, most=slice_bytes))
    ids = spark.createDataFrame([(k,) for k in targets] + [(None,), (99_999,), (3,)][: 3 if targets else 2], "id long")
    words = [(i, (t or "").encode().lower().split()) for i, t, *_ in rows]
    wanted = lm_by_hand(words, {*targets, 3} if targets else set())
    got = lm_score.lm_score(docs, ids, block_bytes=block_bytes).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:3])
    for x, y in zip(sorted(got, key=key), sorted(wanted, key=key), strict=True):
        assert x[:2] == y[:2]
        assert np.allclose(x[2:4], y[2:], atol=1e-9) and abs(x.score - y[2] + y[3]) < 1e-9
    if block_bytes == 500:
        assert lm_score.lm_score(no_docs, ids).collect() == []


def test_word_hashes():
    """Whatever chunks the texts are hashed in."""
    rng = random.Random(6)
    texts = ["".join(rng.choices(["a", "B", "bé", " ", "\n", "\t ", "日本"], k=rng.randrange(60))).encode() for _ in range(300)] + [b"", b" ", b"x" * 40]
    names: dict[bytes, int] = {}
    for size in (1, 16, 1 << 20):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(word_hashes, "CHUNK", size)
            for text, hashes in zip(texts, word_hashes.split_words(texts), strict=True):
                words = text.lower().split()
                assert len(words) == len(hashes)
                assert all(names.setdefault(w, h) == h for w, h in zip(words, hashes.tolist(), strict=True))
    assert len(set(names.values())) == len(names) > 200


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 10)).astype(np.float32)
    x[100:180] = x[100]  # a vector that many rows share
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    bad = [(900, None, 1), (920, [0.0] * 10, 1), (940, [1.0] * 9 + [None], 1), (960, [1.0] * 9 + [float("nan")], 1), (980, [1.0] * 9 + [float("inf")], 1), (None, x[0].tolist(), 1), (1000, [1.0, 2.0], 1), (5, x[5].tolist(), 1)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 700, 20))
    exact, found = x.astype(np.float64) @ x.astype(np.float64).T, 0
    for q, best in got.items():
        order = [k for k in np.lexsort((np.arange(700), -exact[q])) if k != q][:20]
        assert sorted(best) == list(range(1, 21))
        assert all(abs(s - exact[q, v]) < 1e-9 for v, s in best.values())
        found += len(set(order) & {v for v, _ in best.values()})
        if q == 100:
            assert [best[k][0] for k in range(1, 21)] == order
    assert found / (20 * len(got)) >= 0.9
    few = ann.nearest(table.where("vec_id < 4"))
    assert few.count() == 3
    assert ann.nearest(table.limit(0)).collect() == []


def test_ties_of_equal_vectors_over_blocks(spark, monkeypatch):
    """Equal vectors have equal products, wherever they stand, and go by their ids."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 90)
    monkeypatch.setattr(ann, "SLICE_QUERIES", 7)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 64)).astype(np.float32)
    rows = [(k, base[k % 60].tolist()) for k in range(420)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    exact = {q: [0.0] * 60 for q in range(60)}
    for q in range(60):
        for j in range(64):
            exact[q] = [s + float(base[v, j]) * float(base[q, j]) for v, s in enumerate(exact[q])]
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in range(0, 420, 20):
        wanted = sorted(((-exact[q % 60][v % 60], v) for v in range(420) if v != q))[:20]
        assert [got[q][r] for r in range(1, 21)] == [(v, -s) for s, v in wanted]


@pytest.mark.parametrize("noise", [0.02, 0.1])
def test_near_copies_in_a_full_block(noise):
    """A third of a block are near copies with nearly equal codes; none of the nearest is lost."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(ann.BLOCK_ROWS, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:2730] = x[0] + noise * rng.normal(size=(2730, 64)) / 8
    block = ann.Block(ann.Quantiser.fit(x[::8]), np.arange(len(x)), x)
    exact, found = x @ x.T, 0
    for q in [*range(0, 2730, 300), 5000, 8000]:
        wanted = [j for j in np.argsort(-exact[q]) if j != q][:20]
        found += len({*wanted} & {*block.search(q, x[q], 20, ann.SHORTLIST)[0].tolist()})
    print(f"noise {noise}: recall {found / 240:.3f}")
    assert found == 240
