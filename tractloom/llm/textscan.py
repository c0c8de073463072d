"""Vectorised word scanning over Arrow string buffers.

The UTF-8 bytes of a batch are read in place; words are runs of bytes that a 256-entry
table calls word bytes, and each word gets a 64-bit polynomial hash from one prefix sum.
Nothing here makes a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_M = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of the public SplitMix64 generator)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> _M(30)
        x *= _M(0xBF58476D1CE4E5B9)
        x ^= x >> _M(27)
        x *= _M(0x94D049BB133111EB)
        x ^= x >> _M(31)
    return x


def mix_seed(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return splitmix(x + _M((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))


_BYTE_CODE = mix_seed(np.arange(256, dtype=np.uint64), 11)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64, grown by doubling."""
    with np.errstate(over="ignore"):
        while len(_POWERS[0]) < n:
            k = len(_POWERS[0])
            for i, b in enumerate((_BASE, _INV)):
                _POWERS[i] = np.concatenate([_POWERS[i], _POWERS[i] * _M(pow(b, k, 1 << 64))])
    return _POWERS[0], _POWERS[1]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(ranges: list[tuple[int, int]], invert: bool = False) -> np.ndarray:
    """A 256-entry boolean table of the given inclusive byte ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return ~t if invert else t


#: Words of everything but ASCII white space: [^\x20\x09-\x0D]+
SPACE_WORDS = byte_class([(0x20, 0x20), (0x09, 0x0D)], invert=True)
#: Words of ASCII letters and digits (after lower-casing) and of all that is not ASCII.
ALNUM_WORDS = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], invert=True)


@dataclass
class Bytes:
    """The bytes of some texts, one after the other, and where each begins (n + 1 offsets)."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    doc: np.ndarray  # index of the text that holds it
    first: np.ndarray  # n + 1: words of text i are first[i]..first[i + 1]
    hash: np.ndarray  # uint64


def as_bytes(texts: pa.Array) -> Bytes:
    """The buffer of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    n = len(texts)
    if n == 0 or off is None:
        return Bytes(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.zeros(0, np.uint8)
    return Bytes(raw, offsets - lo)


def slices(b: Bytes, limit: int = (1 << 20) - 2) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each; a longer text stands alone and whole."""
    i = 0
    while i < b.n:
        j = int(np.searchsorted(b.offsets, b.offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), b.n)
        yield i, j
        i = j


def part(b: Bytes, i: int, j: int) -> Bytes:
    return Bytes(b.data[b.offsets[i] : b.offsets[j]], b.offsets[i : j + 1] - b.offsets[i])


def words(b: Bytes, table: np.ndarray, lower: bool = True, hashes: bool = True) -> Words:
    """Words of every text in order; a word never crosses from one text into the next."""
    data = LOWER[b.data] if lower else b.data
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(b.n + 1, np.int64), np.zeros(0, np.uint64))
    m = table[data]
    begins = m.copy()
    begins[1:] &= ~m[:-1]
    ends = m.copy()
    ends[:-1] &= ~m[1:]
    edge = b.offsets[:-1][b.offsets[:-1] < b.offsets[1:]]  # first bytes of texts that are not empty
    begins[edge] = m[edge]
    last = edge[edge > 0] - 1
    ends[last] = m[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, b.offsets, "left")
    doc = np.repeat(np.arange(b.n), np.diff(first))
    h = np.zeros(0, np.uint64)
    if hashes:
        with np.errstate(over="ignore"):
            p, q = _powers(n + 1)
            c = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE_CODE[data] * p[:n], out=c[1:])
            h = splitmix((c[end] - c[start]) * q[start])
    return Words(start, end, doc, first, h)


def all_words(b: Bytes, table: np.ndarray, lower: bool = True) -> Words:
    """words() slice by slice, so that what it works with stays small beside a large buffer."""
    got = [(i, j, words(part(b, i, j), table, lower)) for i, j in slices(b)]
    if not got:
        return words(b, table, lower)
    n = np.cumsum([0, *[len(w.hash) for _, _, w in got]])
    return Words(
        np.concatenate([w.start + b.offsets[i] for i, _, w in got]), np.concatenate([w.end + b.offsets[i] for i, _, w in got]), np.concatenate([w.doc + i for i, _, w in got]),
        np.concatenate([[0], *[w.first[1:] + k for k, (_, _, w) in zip(n, got)]]), np.concatenate([w.hash for _, _, w in got]),
    )


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive entries of h (len(h) - k + 1 of them, over text borders too)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        x = h[:n].copy()
        for i in range(1, k):
            x *= _M(_BASE)
            x ^= x >> _M(29)
            x += h[i : i + n]
        return splitmix(x)


def inside(w: Words, k: int) -> np.ndarray:
    """Which windows of k words lie within one text."""
    n = len(w.hash if len(w.hash) else w.start) - k + 1
    return w.doc[:n] == w.doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a value per word over each text."""
    c = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64) if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def sorted_lookup(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of q in the sorted array keys, and whether each is there."""
    if not len(keys):
        return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    i = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return i, keys[i] == q
