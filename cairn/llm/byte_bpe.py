"""Byte-level BPE by prefix dynamic programming.

A byte string has exactly one BPE encoding, and so has each of its prefixes. The
table of a piece holds, for each prefix, the last token of its encoding: the one
token that ends there and that may follow the last token of the prefix before
it. A pair of tokens may stand side by side when encoding their joined bytes
gives that pair back. Reading the table from the end gives the encoding; more
bytes extend the table without touching what it holds; an edit recomputes the
table from the edit on, until the old last tokens come back for as many
positions as the longest token has bytes.

Pieces are the matches of a pattern and are encoded separately. Texts repeat
their words, so a worker keeps what it has encoded in bounded memos.
"""

from __future__ import annotations

import base64
import hashlib
import string
from array import array
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import documents, in_slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MEMO_SIZE = 400_000
NONE = 1 << 62
MARKS = string.punctuation.encode()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PrefixTable:
    """The last token of every prefix of some bytes, as they grow and change."""

    def __init__(self, coder: Coder, data: bytes = b""):
        self.coder, self.data, self.last = coder, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.coder.extend(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in the place of bytes start to stop; how many table entries were computed for it."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, same = old[: start + 1], 0
        for end in range(start + 1, len(self.data) + 1):
            self.coder.extend(self.data[:end], self.last)
            settled = end >= start + len(new) + self.coder.longest
            same = same + 1 if settled and self.last[end] == old[end - shift] else 0
            if same >= self.coder.longest:
                self.last += old[end - shift + 1 :]
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(token := self.last[end])
            end -= len(self.coder.tokens[token])
        return out[::-1]


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.ending = {token[k:]: -1 for token in ranks for k in range(len(token))} | ranks  # ends of tokens; -1: no token itself
        self.pattern = regex.compile(pattern)
        self._follows: dict[int, bool] = {}
        self._pieces: dict[bytes, list[int]] = {}
        self._words: dict[bytes, bytes] = {}

    def _keeps(self, data: bytes, cut: int) -> bool:
        """Whether encoding some bytes by the definition, the leftmost pair of lowest rank first, gives the two tokens that meet at ``cut``.

        With cut 0: the one token. A merge across the cut settles it early.
        """
        rank = self.ranks.get
        ends = list(range(1, len(data) + 1))
        ranks = [rank(data[k : k + 2], NONE) for k in range(len(data) - 1)]
        while ranks and (best := min(ranks)) != NONE:
            k = ranks.index(best)
            if ends[k] == cut:
                return False
            del ends[k], ranks[k]
            start = ends[k - 1] if k else 0
            if k < len(ranks):
                ranks[k] = rank(data[start : ends[k + 1]], NONE)
            if k:
                ranks[k - 1] = rank(data[ends[k - 2] if k > 1 else 0 : ends[k]], NONE)
        return len(ends) == (2 if cut else 1)

    def _may_follow(self, first: int, second: int) -> bool:
        """Whether the joined bytes of two tokens encode to the two; first -1: whether the second's own bytes encode to it."""
        before = self.tokens.get(first, b"")
        if len(self._follows) >= 3 * MEMO_SIZE:
            self._follows.clear()
        known = self._follows[(first << 32) + second] = self._keeps(before + self.tokens[second], len(before))
        return known

    def extend(self, data: bytes, last: list[int]) -> None:
        """Append the last tokens of all prefixes that are longer than ``last`` knows."""
        ending, follows = self.ending.get, self._follows.get
        for end in range(len(last), len(data) + 1):
            for start in range(end - 1, -1, -1):
                token = ending(data[start:end])
                if token is None:  # no token ends like this
                    raise ValueError("the vocabulary lacks single bytes")
                if token >= 0:
                    before = last[start]
                    ok = follows((before << 32) + token)
                    if self._may_follow(before, token) if ok is None else ok:
                        last.append(token)
                        break

    def encode_piece(self, piece: bytes) -> list[int]:
        known = self._pieces.get(piece)
        if known is None:
            whole = self.ranks.get(piece)
            known = PrefixTable(self, piece).ids() if whole is None else [whole]
            if len(piece) <= 64:
                if len(self._pieces) >= MEMO_SIZE:
                    self._pieces.clear()
                self._pieces[piece] = known
        return known

    def _encode_matches(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += self.encode_piece(piece.encode())
        return array("I", ids).tobytes()

    def _encode_word(self, word: bytes) -> bytes:
        """The ids of a space and a word. Letters and the ASCII marks after them are two matches."""
        letters = word.rstrip(MARKS)
        if not letters.decode().isalpha():
            return self._encode_matches(" " + word.decode())
        ids = self.encode_piece(b" " + letters)
        if len(letters) < len(word):
            ids = ids + self.encode_piece(word[len(letters) :])
        return array("I", ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers.

        A match that holds a space holds it at its start, or is all white space.
        So one space between two characters that aren't white space always
        starts a match, and the text can be cut there. The memo holds words
        without white space at their ends, as encoded after a space.
        """
        words = text.split(b" ")
        ids = list(map(self._words.get, words))
        ids[0] = None
        if len(self._words) >= MEMO_SIZE:  # go on with what this text needs
            self._words = {word: x for word, x in zip(words, ids, strict=True) if x is not None}
        uncut = [0]
        for k in [k for k, x in enumerate(ids) if x is None][1:]:
            word = words[k]
            if _solid(word, 0) and _solid(word, -1):
                ids[k] = self._words[word] = self._encode_word(word)
            else:
                uncut.append(k)
        done = -1
        for k in uncut:  # with what it can't be cut from, on both sides
            if k <= done:
                continue
            lo = hi = k
            while lo and not (_solid(words[lo - 1], -1) and _solid(words[lo], 0)):
                lo -= 1
            while hi + 1 < len(words) and not (_solid(words[hi], -1) and _solid(words[hi + 1], 0)):
                hi += 1
            ids[lo] = self._encode_matches((" " * (lo > 0)) + b" ".join(words[lo : hi + 1]).decode())
            ids[lo + 1 : hi + 1] = [b""] * (hi - lo)
            done = hi
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _solid(word: bytes, end: int) -> bool:
    """Whether there is a first (0) or last (-1) character and it isn't white space."""
    if not word:
        return False
    c = word[end]
    if c < 0x80:
        return c > 32
    text = (word[:4] if end == 0 else word[-4:]).decode("utf-8", "ignore")
    return not text[end].isspace()


@cache
def coder(path: str, pattern: str) -> Coder:
    """One per Python worker."""
    return Coder(read_ranks(path), pattern)


def _digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    own = coder(path, pattern)
    for batch in in_slices(batches):
        ids = [own.encode(x or b"") for x in batch["text"].cast(pa.binary()).to_pylist()]
        columns = [
            batch["doc_id"],
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    Null and empty texts have no tokens. A text of any length is encoded whole.
    Rows are independent: ties and repeated rows are encoded each, an empty table
    gives an empty result, and other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return base.mapInArrow(partial(_digests, path=path, pattern=pattern, with_ids=with_ids), schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
