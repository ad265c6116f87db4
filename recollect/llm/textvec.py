"""Vectorised word and shingle hashing over Arrow string columns.

Every helper works on a run of documents whose bytes lie next to each other, so a task's memory is
bounded by ``CHUNK_BYTES`` (or by one document, if that is longer). Words are hashed with a
multiplicative prefix sum over 64-bit letters and finished with a mixing function; two different
words share a hash with a probability of about 2**-56.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Documents are taken together until they hold this many bytes.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: 64-bit letters, from a rule.
_LETTERS = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_POSITION = mix(np.arange(1, 65, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, dtype=_U)
        have[0] = 1
        have = np.cumprod(have, dtype=_U)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


class Words:
    """Words of a run of documents: hash, document number and byte span of each, in order of appearance."""

    __slots__ = ("data", "doc_start", "hash", "doc", "start", "end", "first", "n_docs")

    def __init__(self, data: np.ndarray, doc_start: np.ndarray, is_space: np.ndarray = _SPACE, lower: bool = True):
        self.n_docs = len(doc_start) - 1
        self.data, self.doc_start = data, doc_start
        n = len(data)
        letters = _LOWER[data] if lower else data
        inside = np.empty(n + 1, dtype=bool)
        inside[:n] = ~is_space[data]
        inside[n] = False
        begins = np.zeros(n + 1, dtype=bool)
        begins[doc_start] = True
        before = np.empty(n + 1, dtype=bool)
        before[0] = False
        before[1:] = inside[:n]
        start = np.flatnonzero(inside & (~before | begins))
        end = np.flatnonzero(before & (~inside | begins))
        self.start, self.end = start, end
        summed = np.empty(n + 1, dtype=_U)
        summed[0] = 0
        np.cumsum(_LETTERS[letters] * _power(_BASE, n), out=summed[1:])
        self.hash = mix((summed[end] - summed[start]) * _power(_BASE_INVERSE, n + 1)[start] + (end - start).astype(_U))
        self.first = np.searchsorted(start, doc_start)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, document offsets) for runs of rows with about ``limit`` bytes; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ``size`` words in a row, and its document; only windows inside one document."""
    h, n = words.hash, len(words.hash)
    if n < size:
        return np.empty(0, dtype=_U), np.empty(0, dtype=np.int64)
    total = h[: n - size + 1] * _POSITION[0]
    for k in range(1, size):
        total += h[k : n - size + 1 + k] * _POSITION[k]
    inside = words.doc[: n - size + 1] == words.doc[size - 1 :]
    return mix(total + _U(size))[inside], words.doc[: n - size + 1][inside]


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; with fewer words the whole sequence is one shingle."""
    hashes, doc = windows(words, size)
    at = np.searchsorted(doc, np.arange(words.n_docs + 1))
    sets = []
    for d in range(words.n_docs):
        n = words.first[d + 1] - words.first[d]
        if n >= size:
            h = np.sort(hashes[at[d] : at[d + 1]])
            keep = np.empty(len(h), dtype=bool)
            keep[0] = True
            np.not_equal(h[1:], h[:-1], out=keep[1:])
            sets.append(h[keep])
        elif n:
            own = words.hash[words.first[d] : words.first[d + 1]]
            sets.append(mix((own * _POSITION[:n]).sum(dtype=_U, keepdims=True) + _U(n)))
        else:
            sets.append(np.empty(0, dtype=_U))
    return sets
