"""Whole Arrow batches of text as numpy arrays: words, hashes and shingles without a Python step per word.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D. A word's hash is a polynomial over a
table of mixed byte values, taken modulo 2**64 from prefix sums and then mixed; it depends on the word alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; a longer text is handled alone, whole.
CHUNK = 1 << 19

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, CHUNK + 1)
        _pow = np.full(n, _BASE, np.uint64)
        _pow[0] = 1
        _inv = np.full(n, _INV, np.uint64)
        _inv[0] = 1
        np.multiply.accumulate(_pow, out=_pow)
        np.multiply.accumulate(_inv, out=_inv)
    return _pow, _inv


def pieces(arr: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    n = len(arr)
    if not n:
        return
    if arr.null_count:
        arr = arr.fill_null(b"")
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None and arr.buffers()[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """The words of some texts: ``start`` and ``end`` bytes, ``hash``, and each text's range ``lo``..``hi`` of them."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = True):
        self.offs = offs
        self.buf = buf = LOWER[buf] if lower else buf
        word = np.zeros(len(buf) + 1, bool)
        word[:-1] = ~SPACE[buf]
        first = word[:-1].copy()
        first[1:] &= ~word[:-2]
        last = word[:-1] & ~word[1:]
        edges = offs[1:-1]
        edges = edges[(edges > 0) & (edges < len(buf))]
        first[edges] = word[edges]
        last[edges - 1] = word[edges - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        cut = np.searchsorted(self.start, offs)
        self.lo, self.hi = cut[:-1], cut[1:]

    @property
    def count(self) -> np.ndarray:
        return self.hi - self.lo

    def hashes(self) -> np.ndarray:
        return self.spans([(self.start, self.end)])[0]

    def spans(self, bounds: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Hashes of the byte spans between starts and ends, for each pair of arrays."""
        p, q = _powers(len(self.buf) + 1)
        s = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * p[: len(self.buf)], out=s[1:])
        return [mix((s[b] - s[a]) * q[a] + (b - a).astype(np.uint64) * U(0xD1B54A32D192ED03)) for a, b in bounds]


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words; shorter by n - 1 than ``h``."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out + h[k : len(h) - n + 1 + k] + U(k + 1))
    return out


def whole_hash(h: np.ndarray) -> np.ndarray:
    """One hash of all words in order, as an array of one."""
    return window_hashes(h, len(h))


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles, sorted; with fewer words the whole sequence is one, without words none."""
    h = words.hashes()
    w = window_hashes(h, n)
    for lo, hi in zip(words.lo.tolist(), words.hi.tolist()):
        if hi - lo >= n:
            s = np.sort(w[lo : hi - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        else:
            yield whole_hash(h[lo:hi]) if hi > lo else np.zeros(0, np.uint64)


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of a per-byte array within each text."""
    s = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=s[1:])
    return s[offs[1:]] - s[offs[:-1]]
