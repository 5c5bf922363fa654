from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, digest string, block long, keep_id long, component_id long, kept string, slice long, n_chars long"


def corpus(n: int = 60, seed: int = 1) -> list[tuple]:
    """Documents with nulls, empty and long texts, exact and near copies, repeated rows, shared lines and passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage, line = prose(90), "  Share This  Page\t"
    texts: list[str | None] = [None, "", "  \n\t ", "one", "Two words", "two  words", "a\n\nb", "日本 語 🙂"]
    for k in range(n):
        base = prose(rng.choice([3, 12, 40, 120]))
        if k % 4 == 0:
            base += f"\n{line.upper() if k % 8 else line}\n" + prose(5)
        if k % 5 == 0:
            base += "\n" + passage + " " + prose(4)
        texts.append(base)
    texts += texts[10:14] + [t.upper() for t in texts[14:16]] + [t.replace(" ", "  ") for t in texts[16:18]]
    for t in texts[20:26]:
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts.append(prose(4000))
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "without id"), (None, None), (11, texts[11])]
    return [(i, t, "digest", 1, 2, 3, "kept", 4, 5) for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
