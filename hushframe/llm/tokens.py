"""Vectorised words, word hashes and shingle hashes over Arrow text columns.

A word is a maximal run of bytes other than space, \t, \n, \v, \f and \r; in UTF-8 that is the
same as splitting the text at those six characters.  Everything works on one flat byte buffer of
many texts, so the cost per word is a few numpy operations and no Python object is made per word.
A word's hash takes in eight bytes at a time, scrambled each time; one of over ``LONG`` bytes is hashed by
BLAKE2.  Hashes are 64-bit and the same in every process.  They only find what may be equal: ``Words.code`` tells
words apart by their bytes, for those who must know.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the polynomials over word hashes, for the first and the second hash of a word.
WORD_BASE, SECOND_BASE = 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Texts are worked on in pieces of about this many bytes; one longer text is a piece of its own.
CHUNK_BYTES = 1 << 19
LONG = 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What keeps the first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ U(seed)) * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(32)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(29)
    return h


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the words data[start:end]."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    length = end - start
    out = mix(length.astype(U), seed)
    left, words = length, None
    for at in range(0, LONG, 8):
        if at:
            words = np.flatnonzero((length > at) & (length <= LONG))
            if not len(words):
                break
            left = length[words] - at
        own = eight[start if words is None else start[words] + at] & _FIRST[np.minimum(left, 8)]
        if words is None:
            out = mix(out ^ own, seed + 1)
        else:
            out[words] = mix(out[words] ^ own, seed + 1 + at)
    for i in np.flatnonzero(length > LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=b"%d" % seed).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


@dataclass
class Words:
    """Words of some texts: their bytes are data[start[i]:end[i]]; text t has words first[t]:first[t + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @cached_property
    def hash(self) -> np.ndarray:
        return word_hashes(self.data, self.start, self.end, 1)

    @cached_property
    def hash2(self) -> np.ndarray:
        return word_hashes(self.data, self.start, self.end, 1001)

    @cached_property
    def code(self) -> np.ndarray:
        """Numbers that equal words, and only they, share."""
        size = self.end - self.start
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        body = self.data[np.repeat(self.start - offsets[:-1], size) + np.arange(offsets[-1])]
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        return packed.dictionary_encode().indices.to_numpy()

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def runs(self, k: int, second: bool = False) -> np.ndarray:
        """Hash of the k words from each word on; runs that leave their text are to be ignored."""
        n = max(0, len(self.start) - k + 1)
        out, own, base = np.zeros(n, U), self.hash2 if second else self.hash, SECOND_BASE if second else WORD_BASE
        for i in range(k):
            out += own[i : i + n] * U(pow(base, i, 2**64))
        return mix(out)


def binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> Words:
    """The words of the texts data[at[i]:at[i + 1]]; lower: A-Z become a-z first."""
    data, at = data[at[0] : at[-1]], at - at[0]
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    edges = at[(at > 0) & (at < len(data))]
    before[edges] = False
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, at))


def chunks(column: pa.Array, limit: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, data, offsets) of stretches of rows of about ``limit`` bytes each."""
    limit = limit or CHUNK_BYTES
    data, at = binary(column)
    row, n = 0, len(at) - 1
    while row < n:
        to = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
        to = min(max(to, row + 1), n)
        yield row, to, data, at[row : to + 1]
        row = to


def distinct_by_text(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs in order of both."""
    if not len(h):
        return text, h
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]


def _all_shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first word) of every shingle; a short text's own comes after all others."""
    counts, text = w.counts, w.text_of()
    left = w.first[1:][text] - np.arange(len(text))  # words from here to the text's end
    whole = np.flatnonzero(left >= k)
    h = w.runs(k)[whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return text[whole], h, whole
    place = np.arange(len(text)) - w.first[text]
    some = np.flatnonzero(counts[text] < k)
    power = np.array([pow(WORD_BASE, i, 2**64) for i in range(k)], U)
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts[short])[:-1]])
    own = mix(np.add.reduceat(w.hash[some] * power[place[some]], at) + counts[short].astype(U), seed=k)
    return np.concatenate([text[whole], short]), np.concatenate([h, own]), np.concatenate([whole, w.first[short]])


def _codes(w: Words, k: int, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The word codes (n x k) of shingles; -1 beyond the end of a short text."""
    places = start[:, None] + np.arange(k)
    codes = w.code[np.minimum(places, max(len(w.code) - 1, 0))]
    return np.where(places < w.first[text + 1][:, None], codes, -1)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles as (text, hash), ordered by both.

    A text of fewer words than k has its whole sequence as its one shingle, one without words none.
    """
    return distinct_by_text(*_all_shingles(w, k)[:2])


def exact_shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, but equal numbers stand for equal words: where two different shingles of these texts have one hash,
    all are numbered by their words instead."""
    text, h, start = _all_shingles(w, k)
    if len(h):
        order = np.argsort(h, kind="stable")
        same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        a, b = order[same], order[same + 1]
        for lo in range(0, len(same), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            if (_codes(w, k, text[a[part]], start[a[part]]) != _codes(w, k, text[b[part]], start[b[part]])).any():
                _, number = np.unique(_codes(w, k, text, start), axis=0, return_inverse=True)
                h = number.reshape(-1).astype(U)
                break
    return distinct_by_text(text, h)
