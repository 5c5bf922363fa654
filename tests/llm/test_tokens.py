"""Byte-level BPE, packing and training-order files: round trips and comparison with the tokenizers' own libraries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import byte_bpe, materialise, packing
from cairn.llm.shared import new_path

RANKS = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
CODER = byte_bpe.Coder(RANKS, public_tokenizers.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORDS = public_tokenizers.path(packing.VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abthe ing\n\t  1$'sé日🙂\x1c\x85,."), max_size=60))
def test_bpe_as_tiktoken(text):
    ids = CODER.encode(text.encode())
    assert np.frombuffer(ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(text)
    assert CODER.decode(ids) == text.encode()


def test_prefix_table_grows_and_changes():
    rng = random.Random(3)
    for _ in range(100):
        data = bytes(rng.choice(b"theinger tion") for _ in range(rng.randrange(150)))
        table = byte_bpe.PrefixTable(CODER, data[:50])
        table.append(data[50:])
        start = rng.randrange(len(data) + 1)
        stop, new = min(len(data), start + 3), bytes(rng.choice(b"aeth") for _ in range(rng.randrange(5)))
        computed = table.replace(start, stop, new)
        fresh = byte_bpe.PrefixTable(CODER, data[:start] + new + data[stop:])
        assert (table.data, table.last, table.ids()) == (fresh.data, fresh.last, fresh.ids())
        assert computed <= len(new) + 2 * CODER.longest


def test_encode_documents(docs, rows, no_docs):
    wanted = []
    for i, t, *_ in rows:
        ids = np.array(TIKTOKEN.encode_ordinary(t or ""), "<u4")
        wanted.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    assert sorted(map(tuple, byte_bpe.encode_documents(docs, path).collect()), key=str) == sorted(wanted, key=str)
    assert byte_bpe.encode_documents(no_docs, path).collect() == []


TOKENIZER = Tokenizer.from_file(WORDS)


def ids_of(text: str | None) -> np.ndarray:
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_word_ids():
    texts = ["", "  <|endoftext|> a", "X<|endoftext|>!?<|startoftext|>Été", "<|ENDOFTEXT|> <|EndOfText|>x <| endoftext|>", "Été ÉTÉ é ́x don't", "it's Σας ΣΑΣ x\x1cy\x85z", "日本 語", "a\xa0b  İstanbul", "foo,bar foo... (foo) foo'", "don't'"]
    for text, ids in zip(texts, packing.WordIds(WORDS).encode([t.encode() for t in texts]), strict=True):
        assert ids == ids_of(text).tobytes(), text


def test_word_ids_of_plain_words(monkeypatch):
    """Words of a-z don't pass the whole tokenizer, whatever the memo holds; batches of any size give the same ids."""
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=200)).encode() for _ in range(40)]
    wanted = [ids_of(t.decode()).tobytes() for t in texts]
    for memo, size in ((packing.MEMO_BYTES, packing.ENCODE_BYTES), (40_000, 1), (40_000, 3_000)):
        monkeypatch.setattr(packing, "MEMO_BYTES", memo)
        monkeypatch.setattr(packing, "ENCODE_BYTES", size)
        own = packing.WordIds(WORDS)
        own.tokenizer = None
        assert list(own.encode(texts)) == wanted
    # Letters of other scripts, marks and special tokens, over several batches.
    mixed = [t + " é日 ".encode() + w.encode() + b",. <|ENDOFTEXT|>x" * (k % 3) for k, (t, w) in enumerate(zip(texts, words))]
    assert list(packing.WordIds(WORDS).encode(mixed)) == [ids_of(t.decode()).tobytes() for t in mixed]


def test_marks_apart():
    """A comma or full stop after a word is no run of its own with it; groups of marks, and marks at a text's ends, stay as they are."""
    texts = ["one, two. one.\ntwo, x.., one., a.b", ",", "one,", ", one.", " .", "", "é, one, don't, 3. 's. "]
    own = packing.WordIds(WORDS)
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert ids == ids_of(text).tobytes(), text
    assert not {b"one.", b"two,", b"two."} & set(own._known)


def test_packing(docs, rows, no_docs):
    capacity = 256
    got = packing.pack(docs, WORDS, capacity=capacity, group_docs=16).collect()
    wanted = defaultdict(list)
    for i, t, *_ in rows:
        wanted[i].append(np.r_[ids_of(t), 1].astype("<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, texts in wanted.items():
        assert sum(r.length for r in pieces[i]) == sum(map(len, texts))
        for r in pieces[i]:
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in texts)
    for each in sequences.values():
        at = 0
        for r in sorted(each, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sum(r.length for r in got) / (capacity * len(sequences)) > 0.85
    assert packing.pack(no_docs, WORDS).collect() == []


def test_packing_of_one_id(spark):
    """Rows of one id, or of none, and one text are dealt over groups as others are."""
    table = spark.createDataFrame([(None, "same text")] * 300 + [(4, "same text")] * 300 + [(4, None)] * 40, "doc_id long, text string").repartition(2)
    got = packing.pack(table, WORDS, capacity=64, group_docs=32).collect()
    assert len(got) == 640
    groups = Counter(r.sequence_id >> 32 for r in got)
    assert len(groups) > 15 and max(groups.values()) < 90


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 128), max_size=80))
def test_differencing(sizes):
    at, windows = packing.balanced(sizes, 128)
    assert len(at) == len(sizes)
    assert not sizes or max(np.bincount(at, weights=sizes, minlength=windows)) <= 128


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation(n, key):
    assert sorted(materialise.permuted(np.arange(n), n, key)) == list(range(n))


def test_materialise(spark, docs, rows, no_docs):
    path = new_path(spark, "shards")
    got = sorted(materialise.materialise(docs, WORDS, path, length=32, shard_sequences=10).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got)))
    reader = materialise.SequenceReader(path, length=32, shard_sequences=10)
    read = list(reader)
    assert reader.slot == len(got) == len(read)
    assert [(len(x), zlib.crc32(x.tobytes())) for x in read] == [(r.n_tokens, r.ids_crc32) for r in got]
    again = list(materialise.SequenceReader(path, slot=17, length=32, shard_sequences=10))
    assert [x.tolist() for x in again] == [x.tolist() for x in read[17:]]
    wanted = sorted((ids_of(t).tolist()[k : k + 32]) for _, t, *_ in rows for k in range(0, len(ids_of(t)), 32))
    assert sorted(x.tolist() for x in read) == wanted
    assert materialise.materialise(no_docs, WORDS, new_path(spark, "none")).collect() == []


def test_materialise_whatever_the_splits(spark, docs, tmp_path):
    """Other splits, and a task that runs again, give the same files."""
    files = []
    for k, table in enumerate((docs, docs.repartition(7), docs.coalesce(1))):
        path = tmp_path / str(k)
        for _ in range(2 if k == 0 else 1):
            materialise.materialise(table, WORDS, f"file://{path}", length=32, shard_sequences=4)
        files.append({f.name: f.read_bytes() for f in path.iterdir() if not f.name.startswith(".")})
    assert files[0] == files[1] == files[2] and len(files[0]) > 3 * materialise.TASK_SHARDS


def test_ids_too_wide():
    with pytest.raises(ValueError, match="65536"):
        materialise._narrow(np.array([1, 65_536], "<u4").tobytes())
