"""Suffix arrays and removal of repeated passages against brute force, and odd cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from tests.llm.helpers import SF, no_docs, odd_docs
from tractloom.llm import queries, repeats
from tractloom.llm import suffix_array as sx
from tractloom.llm import textscan as ts


def sorted_suffixes(t):
    return sorted(range(len(t)), key=lambda i: t[i:])


@settings(max_examples=150, deadline=None)
@given(hs.lists(hs.integers(0, 3), max_size=80))
def test_suffix_array(values):
    t = np.append(np.array(values, np.int64) + 1, 0)
    sa = sx.suffix_array(t)
    text = t.tolist()
    assert sa.tolist() == sorted_suffixes(text)
    got = sx.common_prefixes(t, sa, 20)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
        k = next(k for k in range(len(text)) if text[a + k] != text[b + k])
        assert got[b] == min(k, 20)


@pytest.mark.parametrize("values", [[5] * 500, [1, 2] * 300, list(range(90)) * 4, [3, 3, 1] * 200, []])
def test_suffix_array_of_runs(values):
    t = np.append(np.array(values, np.int64) + 1, 0)
    assert sx.suffix_array(t).tolist() == sorted_suffixes(t.tolist())


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.text(alphabet="ab é", min_size=40, max_size=300), min_size=1, max_size=4))
def test_each_window_lies_in_one_segment(texts):
    b = ts.as_bytes(pa.array(texts))
    seen = [[0] * max(len(t.encode()) - repeats.MATCH + 1, 0) for t in texts]
    for s in repeats.all_segments(pa.array(texts), np.zeros(0, np.uint64)):
        for r, lo, size in zip(s["row"].tolist(), s["lo"].tolist(), s["size"].tolist(), strict=True):
            for p in range(lo, lo + size - repeats.MATCH + 1):
                seen[r][p] += 1
    assert all(x == 1 for row in seen for x in row) and b.n == len(texts)


def brute(rows):
    """What is to come out for (id, text) rows, window by window."""
    first = {}
    for i, t in rows:
        x = (t or "").encode()
        if i is not None:
            for p in range(len(x) - 49):
                w = x[p : p + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        x = (t or "").encode()
        gone = bytearray(len(x))
        if i is not None:
            for p in range(len(x) - 49):
                if first[x[p : p + 50]] < i:
                    gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out.append((i, len(x), sum(gone), sum(b and not a for a, b in zip(b"\0" + bytes(gone), gone, strict=False)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in repeats.repeats_removed(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def corpus():
    r = random.Random(7)
    word = ["".join(r.choice("abcdeé ") for _ in range(r.randint(2, 7))) for _ in range(60)]
    passages = [" ".join(r.choice(word) for _ in range(n)) for n in (9, 14, 30, 120)] + ["-" * 130, "ha " * 60, "x" * 50, "x" * 49]
    rows = []
    for i in range(140):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(r.choice(word) for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 5))]
        t = " ".join(parts)
        if r.random() < 0.3 and len(t) > 60:
            k = r.randrange(len(t))
            t = t[:k] + "#" + t[k:]
        rows.append((i, t))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (3, rows[3][1]), (3, rows[10][1]), (None, rows[4][1]), (None, rows[4][1]), (-5, rows[20][1]), (202, None), (203, ""), (204, "x" * 49), (-6, "\U0001f600é" * 40)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # pieces, packs, parts, arrays and hot anchors at sizes that this corpus reaches
        for name, value in {"PIECE": 120, "PACK_BYTES": 3000, "PART_BYTES": 2000, "ARRAY_BYTES": 400, "HOT_SEGMENTS": 0, "HOT_SEEN": 6}.items():
            monkeypatch.setattr(repeats, name, value)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "u") for i, t in rows], "doc_id long, text string, n_bytes int, uid string")
    want = brute(rows)
    assert sum(w[2] for w in want) > 5000
    assert got(df) == want


def test_query_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in df.collect()])
    assert sorted((tuple(r) for r in queries.op13_repeats(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == want


def test_odd_documents(spark):
    odd = odd_docs(spark)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    done = {(r.doc_id, r.n_removed == r.n_bytes) for r in repeats.repeats_removed(odd).where("n_bytes > 50").collect()}
    assert done == {(7, False), (8, True), *((i, False) for i, t in rows if t and 50 < len(t.encode()) < 1000)}
    assert repeats.repeats_removed(odd).count() == len(rows)
    assert repeats.repeats_removed(no_docs(spark)).count() == 0
