"""Vectorised text kernels over Arrow string columns (no Python object per word).

A *word* is a maximal run, after Unicode lower-casing, of ASCII letters, ASCII digits and
non-ASCII characters; every other ASCII character separates words. A null text has no word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
#: Bytes of text that one kernel call handles; a batch is cut between documents so that arrays stay small.
STEP = 1 << 20
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _pow.get("p")
    if have is None or len(have) <= n:
        size = max(n + 1, STEP + (STEP >> 1))
        for key, base in (("p", _R), ("i", _RINV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _pow[key] = np.multiply.accumulate(x)
    return _pow["p"], _pow["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(text: pa.Array, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``step`` bytes of text; one row at least."""
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    a, n = 0, len(size)
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + step, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string array; nulls are empty."""
    text = pc.fill_null(text, "")
    if pa.types.is_large_string(text.type):
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    else:
        off = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, off - off[0]


class Words:
    """Hashes of the words of a string array, in order. ``first`` has n+1 word offsets by row."""

    def __init__(self, text: pa.Array, lower: bool = True):
        if lower:
            text = pc.utf8_lower(text)
        data, off = buffers(text)
        self.n = len(off) - 1
        is_word = _IS_WORD[data]
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        inner = off[1:-1][off[1:-1] < len(data)]
        begins[inner] = is_word[inner]
        ends = is_word.copy()
        ends[:-1] &= ~is_word[1:]
        inner = inner[inner > 0] - 1
        ends[inner] = is_word[inner]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        p, inv = _powers(len(data))
        acc = np.empty(len(data) + 1, np.uint64)
        acc[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=acc[1:])
        self.hash = mix((acc[self.end] - acc[self.start]) * inv[self.start])
        self.first = np.searchsorted(self.start, off)
        self.data, self.off = data, off

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)


def word_hash(word: str) -> int:
    """The hash of one word, for tests and vocabularies."""
    w = Words(pa.array([word]))
    return int(w.hash[0])


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and n+1 offsets by row. A row of 1 to k-1 words has one shingle of all its words."""
    h, first = w.hash, w.first
    n = len(h)
    odd = np.uint64(0xD6E8FEB86659FD93)
    x = h.copy()
    row = w.row
    whole = np.ones(n, bool)
    for j in range(1, k):
        x[: n - j] = x[: n - j] * odd + h[j:]
        # a position whose k words leave its row is dropped, but for the first of a short row
        whole[: n - j] &= row[: n - j] == row[j:]
        whole[max(0, n - j) :] = False
    short = (w.counts > 0) & (w.counts < k)
    if short.any():
        for r in np.flatnonzero(short):
            a, b = first[r], first[r + 1]
            acc = h[a]
            with np.errstate(over="ignore"):
                for j in range(a + 1, b):
                    acc = acc * odd + h[j]
            x[a], whole[a] = acc, True
    keep = np.flatnonzero(whole)
    return mix(x[keep]), np.searchsorted(keep, first)
