"""Vector codes and centroid clusters against brute force, and their odd cases."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from tractloom.llm import lloyd, vector_codes, vectors


@settings(max_examples=60, deadline=None)
@given(hs.integers(0, 10_000), hs.sampled_from([1, 2, 5, 40, 1 << 27]), hs.integers(1, 64))
def test_tree_search_is_exact(seed, spread, entries):
    r = np.random.default_rng(seed)
    book, x = (r.integers(-spread, spread + 1, (n, 4)) for n in (entries, 300))
    e, d = vector_codes.Search(book).nearest(x)
    want = np.square(x[:, None] - book[None]).sum(2)
    assert (e == want.argmin(1)).all() and (d == want.min(1)).all()


def test_tree_prunes():
    r = np.random.default_rng(1)
    search = vector_codes.Search(r.integers(-100, 100, (64, 4)))
    seen = []
    search._take, take = (lambda rows, n, d: (seen.append(len(rows)), take(rows, n, d))), search._take
    search.nearest(r.integers(-100, 100, (500, 4)))
    assert sum(seen) < 0.8 * 64 * 500


def rows_for(spark, n=90, extra=True):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(r.normal(0, 0.3, 64))], None if i % 7 == 0 else i % 3, "a", 1) for i in range(n)]
    rows += [(5, rows[5][1], 0, "b", 2), (200, rows[8][1], 1, "c", 3), (None, rows[9][1], 1, "c", 3)]
    if extra:
        rows += [(300, None, 1, "x", 0), (301, [], 1, "x", 0), (302, [math.nan] * 64, 1, "x", 0), (303, [0.5] * 63 + [math.inf], 1, "x", 0), (304, [None] * 64, 1, "x", 0), (305, [0.1] * 63, 1, "x", 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, cluster int")


def usable(df):
    got = [r for r in df.collect() if r.embedding and len(r.embedding) == 64 and all(x is not None and math.isfinite(x) for x in r.embedding)]
    return sorted(got, key=lambda r: (r.vec_id is None, r.vec_id, r.embedding))


def test_lloyd_equals_brute_force(spark):
    df = rows_for(spark)
    good = usable(df)
    x = [[math.floor(64 * c) for c in r.embedding] for r in good]
    start = sorted((hashlib.sha256(f"1:{r.vec_id}".encode()).hexdigest(), r.embedding, v) for r, v in zip(good, x, strict=True) if r.vec_id is not None)[:16]
    cs = [v for _, _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cs))

    for _ in range(3):
        group = {}
        for v in x:
            group.setdefault(near(v)[1], []).append(v)
        cs = [[sum(col) // len(group[k]) for col in zip(*group[k], strict=True)] if k in group else c for k, c in enumerate(cs)]
    want = [(r.vec_id, *near(v)[::-1]) for r, v in zip(good, x, strict=True)]
    inertia = {k: sum(d for _, c, d in want if c == k) for k in range(16)}
    full = [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in want]
    got = [tuple(r) for r in lloyd.clustered(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]
    assert sorted(got, key=str) == sorted(full, key=str)


def test_codes_equal_brute_force(spark):
    df = rows_for(spark)
    good = usable(df)
    x = [[math.floor(256 * c) for c in r.embedding] for r in good]
    cut = [[v[4 * p : 4 * p + 4] for p in range(16)] for v in x]
    books = [[list(v[p]) for r, v in zip(good, cut, strict=True) if r.vec_id is not None][:64] for p in range(16)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        for p in range(16):
            group = {}
            for v in cut:
                group.setdefault(near(p, v[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(group[k]) for c in zip(*group[k], strict=True)] if k in group else e for k, e in enumerate(books[p])]
    coded = [[near(p, v[p]) for p in range(16)] for v in cut]
    errors = [sum(d for d, _ in c) for c in coded]
    by_label = {}
    for r, e in zip(good, errors, strict=True):
        by_label[r.label] = by_label.get(r.label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    want = [(r.vec_id, "".join(f"{k:02x}" for _, k in c), e, by_label[r.label], digest) for r, c, e in zip(good, coded, errors, strict=True)]
    got = vector_codes.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    old, vector_codes.BROADCAST_LABELS = vector_codes.BROADCAST_LABELS, 0
    try:
        assert sorted(map(tuple, vector_codes.compressed(df).select(got.columns).collect()), key=str) == sorted(want, key=str)
    finally:
        vector_codes.BROADCAST_LABELS = old
    fitted = vector_codes.fit(df)
    assert vector_codes.decoded(want[0][1], fitted) == [c for p, (_, k) in enumerate(coded[0]) for c in books[p][k]]


def test_vector_odd_cases(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert lloyd.clustered(none).count() == vector_codes.compressed(none).count() == 0
    few = rows_for(spark, 10)
    assert lloyd.clustered(few).count() == vector_codes.compressed(few).count() == 13
    huge = spark.createDataFrame([(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1), (3, [0.0] * 64, None)], "vec_id long, embedding array<float>, label int")
    assert [r.distance for r in lloyd.clustered(huge).collect()] == [0, 0, 0]
    assert [r.error for r in vector_codes.compressed(huge).collect()] == [0, 0, 0]
    nameless = spark.createDataFrame([(None, [0.5] * 64, 1)], "vec_id long, embedding array<float>, label int")
    assert lloyd.clustered(nameless).first().cluster is None and vector_codes.compressed(nameless).first().code is None
    with pytest.raises(ValueError):
        vector_codes.fit(few, parts=7)
    assert vectors.floored(np.array([-0.001, 0.0, 1e300]), 64).tolist() == [-1, 0, vectors.LARGEST]
