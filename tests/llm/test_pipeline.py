"""The stages of the pipeline take effect, one after the other."""

from __future__ import annotations

import corpus_pipeline

from cairn.llm.shared import documents, save
from tests.conftest import SF


def test_stages(spark):
    docs = documents(spark, SF)
    columns, sizes = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        docs = save(stage(spark, docs, SF), f"test-{name}").df
        if k + 1 == len(corpus_pipeline.STAGES):
            break
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        assert all(r.n_chars == len(r.text) for r in after.values())
        assert all(r.lang == before[i].lang and r.source == before[i].source for i, r in after.items())
        if name in ("toxicity", "ngram_join"):
            assert all(r.text == before[i].text for i, r in after.items())
        else:
            assert set(after) == set(before)
        sizes.append(len(after))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "suffix_dedup", "packing"]
    assert sizes[0] < 200 and sizes[2] < sizes[1]
    packed = docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(packed) == sizes[-1] and all(r[1] == r[2] for r in packed)


def test_short_passages_are_cut(spark):
    """A passage of 51 short words goes from every document, one of 50 stays; other text stays."""
    own = lambda k, n: [f"own{k}x{j}" for j in range(n)]
    passage, less = [f"p{j}" for j in range(51)], [f"q{j}" for j in range(50)]
    texts = [[*own(k, 30 + k), *passage, *own(k + 10, 30), *less, *own(k + 20, 30)] for k in range(3)]
    assert len(" ".join(passage)) < 400
    table = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)] + [(7, " ".join(own(50, 60))), (8, None)], "doc_id long, text string")
    kept = {r.doc_id: (r.text or "").split() for r in corpus_pipeline.cut_repeated_strings(spark, table, SF).collect()}
    assert kept == {**{k: [w for w in t if w not in passage] for k, t in enumerate(texts)}, 7: own(50, 60), 8: []}
