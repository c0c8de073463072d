"""Counts of a text that several operators need, for all texts of a batch at once."""

from __future__ import annotations

import numpy as np

from tractloom.llm import textscan as ts

_K = np.uint64(0x9E3779B97F4A7C15)
LINES = ts.byte_class([(0x0A, 0x0A)], invert=True)
SYMBOLS = ts.byte_class([(ord(c), ord(c)) for c in "#*$%&|<>"])
CONTINUES = ts.byte_class([(0x80, 0xBF)])  # bytes that begin no code point
SLOTS = 22


def doc_keys(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that agree only within one text."""
    with np.errstate(over="ignore"):
        return ts.splitmix(h + (doc.astype(np.uint64) + np.uint64(1)) * _K)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once. A table of slots rules most out before the rest is sorted."""
    out = np.zeros(len(keys), bool)
    slot = (keys >> np.uint64(64 - SLOTS)).astype(np.int64)
    some = np.flatnonzero(np.bincount(slot, minlength=1 << SLOTS)[slot] > 1)
    order = some[np.argsort(keys[some])]
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(start: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans that begin at start."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, np.minimum(start + size, n), -1)
    return np.cumsum(d)[:-1] > 0


def byte_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def repeat_words(w: ts.Words, k: int = 5) -> np.ndarray:
    """Of each text, the words inside k-word windows that it holds twice or more."""
    h = ts.window_hash(w.hash, k)
    at = np.flatnonzero(ts.inside(w, k))
    rep = at[repeated(doc_keys(h[at], w.doc[at]))]
    return ts.per_doc(covered(rep, k, len(w.hash)), w.first)


def duplicate_lines(b: ts.Bytes, w: ts.Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the lines with a word, and those of them that equal an earlier line."""
    lines = ts.words(b, LINES, lower=False)
    has = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)
    doc = lines.doc[has]
    key = doc_keys(lines.hash[has], doc)
    _, one = np.unique(key, return_index=True)
    n = np.bincount(doc, minlength=b.n)
    return n, n - np.bincount(doc[one], minlength=b.n)


def base_rules(b: ts.Bytes, w: ts.Words) -> dict[str, np.ndarray]:
    """w: the space-separated words of b, case kept."""
    point = ~CONTINUES[b.data]
    c = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum(point, out=c[1:])
    n_words = np.diff(w.first)
    n_lines, dup = duplicate_lines(b, w)
    rep = repeat_words(w)
    return {
        "n_words": n_words,
        "word_chars": ts.per_doc(c[w.end] - c[w.start], w.first),
        "n_symbols": byte_sums(SYMBOLS[b.data], b.offsets),
        "n_dup_lines": dup,
        "n_repeat_words": rep,
        "n_lines": n_lines,
        "base_failed": (n_words < 10) | (100 * rep > 20 * n_words),
    }
