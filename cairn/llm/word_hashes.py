"""64-bit hashes of words, computed for many texts at once.

Words stand between ASCII white space; A-Z count as a-z unless asked otherwise. A
word is read in blocks of eight bytes. Each block is mixed with its place in the
word and the mixed blocks are summed, so no word becomes a Python object and no
table of known words is kept. A sum of blocks that aren't mixed first, as a
polynomial is, would have words that collide whatever the base.
"""

from __future__ import annotations

import re

import numpy as np

from cairn.llm.suffixes import mix

CHUNK = 1 << 20  # bytes hashed at once, about thirty times as many in memory
SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _chunks(texts: list[bytes]):
    """Lists of (text's number, bytes) of about CHUNK bytes; long texts are cut at white space."""
    some, size = [], 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            end = at + CHUNK - size
            if end < len(text):
                found = SPACE.search(text, end)
                end = found.start() if found else len(text)
            some.append((k, text[at:end] if at or end < len(text) else text))
            size += len(some[-1][1]) + 1
            if size >= CHUNK:
                yield some
                some, size = [], 0
            if end >= len(text):
                break
            at = end
    if some:
        yield some


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes start and end."""
    space = np.r_[True, _IS_SPACE[np.frombuffer(data, np.uint8)], True]
    return np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])


def _hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of the words that start and end there."""
    length = end - begin
    blocks = (length + 7) // 8
    word = np.repeat(np.arange(len(begin)), blocks)
    first = np.cumsum(blocks) - blocks
    place = np.arange(len(word)) - first[word]
    at = begin[word] + 8 * place
    padded = np.frombuffer(data + bytes(8), np.uint8)
    read = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].copy().view("<u8").ravel()
    past = np.maximum(8 - (end[word] - at), 0).astype(np.uint64) * np.uint64(8)
    read = read << past >> past  # without what follows the word
    mixed = mix(mix(read + np.uint64(0x9E3779B97F4A7C15)) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return mix(np.add.reduceat(mixed, first) + length.astype(np.uint64)) if len(begin) else np.zeros(0, np.uint64)


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, one text after the other, and how many each text has."""
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for some in _chunks(texts):
        data = b" ".join(piece for _, piece in some)
        data = data.lower() if fold else data
        begin, end = words_of(data)
        hashes.append(_hashes(data, begin, end))
        offsets = np.cumsum([0, *(len(piece) + 1 for _, piece in some[:-1])])
        owner = np.array([k for k, _ in some])[np.searchsorted(offsets, begin, side="right") - 1]
        counts += np.bincount(owner, minlength=len(texts))
    return np.concatenate(hashes), counts


def split_words(texts: list[bytes | None], fold: bool = True) -> list[np.ndarray]:
    """The hashes of each text's words."""
    hashes, counts = word_hashes([t or b"" for t in texts], fold)
    return np.split(hashes, np.cumsum(counts)[:-1]) if len(texts) else []
