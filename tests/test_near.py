"""Paths nearer than a bound by tiles, against the same formula row by row."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractloom.functions import geometry as g
from tractloom.operators import nearness as ne
from tractloom.operators import streamlines as sl

POINTS = "sl_id long, points array<struct<x: double, y: double, z: double>>"
INF, NAN = float("inf"), float("nan")


def distances(p):
    """Of paths as 3 x points, all of them."""
    return np.array([np.minimum(*(np.sqrt(((a - q) ** 2).sum(1)).mean(1) for q in (p, p[:, :, ::-1]))) for a in p])


def sets():
    e = np.random.default_rng(4)
    noise = e.normal(size=(700, 3, 20)) * 10 + np.linspace(0, 700, 20)[None, None]
    yield noise, 15.5
    yield np.concatenate([noise[:300], noise[200:400, :, ::-1] + 1]), 15.5
    yield e.normal(size=(600, 3, 6)).cumsum(2) + e.integers(0, 30, (600, 3, 1)) * 3, 3.0
    for k in (1, 2, 3):
        yield e.normal(size=(300, 3, k)), 0.7
    # Sizes beyond single precision, and distances of just the bound.
    yield np.concatenate([e.normal(size=(40, 3, 4)), e.normal(size=(40, 3, 4)) * 1e25, e.normal(size=(40, 3, 4)) * 1e200, 3e7 + e.integers(0, 3, (40, 3, 4))]), 2.0
    yield e.integers(0, 4, (200, 3, 1)) * np.ones((1, 1, 4)), 1.0


@pytest.mark.parametrize("k", range(8))
@pytest.mark.parametrize("side", [256, 32])
def test_tiles_equal_brute_force(monkeypatch, k, side):
    monkeypatch.setattr(ne, "SIDE", side)
    p, most = list(sets())[k]
    with np.errstate(all="ignore"):
        d = distances(p)
    with np.errstate(over="ignore"):
        centre = p.mean(0)
    one = ne.block(p, centre)
    i, j, m = (np.concatenate(x) for x in zip(*ne.near(one, one, most, same=True), strict=True))
    want = np.argwhere(np.triu(d <= most, 1))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == list(map(tuple, want.tolist())) and len(want) > 10
    assert m == pytest.approx(d[i, j], rel=1e-12, abs=1e-12)
    a, b = (ne.block(x, centre) for x in (p[::2], p[1::2]))
    assert ne.reached(a, b, most).tolist() == (d[::2, 1::2] < most).any(1).tolist()


def rows(e, n, shift=0):
    """Copies, turned copies, paths of other numbers of points, and odd ones."""
    p = [e.normal(size=(5, 3)).tolist() for _ in range(n)]
    p += p + [q[::-1] for q in p[:9]] + [e.normal(size=(4, 3)).tolist() for _ in range(9)] + [[[0.0, 1.0, None]] * 5, [[NAN, 0.0, 0.0]] * 5, [[NAN, 0.0, 0.0]] * 5, [[INF, 0.0, 0.0]] * 5, [[INF, 0.0, 0.0]] * 5, [], None]
    return [(shift + k, q and [tuple(v) for v in q]) for k, q in enumerate(p)]


def row_by_row(x, y, most):
    a, b = (d.select(F.col("sl_id").alias(k), F.col("points").alias("p" + k)) for d, k in ((x, "a"), (y, "b")))
    met = a.crossJoin(b).where(F.size("pa") == F.size("pb")).where(F.size("pa") > 0)
    return met.select("a", "b", g.mdf(F.col("pa"), F.col("pb")).alias("mdf")).where(F.col("mdf") < most)


def found(df):
    return sorted((r["a"], r["b"], round(r["mdf"], 9)) for r in df.collect())


def test_near_pairs_equal_rows(spark):
    """Of paths with unknown or infinite points, none is near, equal ones neither."""
    e = np.random.default_rng(3)
    x, y = (spark.createDataFrame(rows(e, 40, shift), POINTS) for shift in (0, 1000))
    assert found(sl.near_pairs(x, y, 1.5)) == found(row_by_row(x, y, 1.5))
    want = found(row_by_row(x, x, 1.5).where("a < b"))
    assert found(sl.mdf_pairs(x, most=1.5)) == want and len(want) > 100
    hits = {a for a, _, _ in found(row_by_row(x, y, 1.0))}
    assert {(r["sl_id"], r["hit"]) for r in sl.any_near(x, y, 1.0).collect()} == {(k, k in hits) for k in range(len(rows(e, 40)))}
    assert not any(r["hit"] for r in sl.any_near(x, y.limit(0), 1.0).collect())


def test_distances_are_not_worked_out_row_by_row(spark):
    x = spark.createDataFrame(rows(np.random.default_rng(3), 4), POINTS)
    for df in (sl.near_pairs(x, x, 1.0), sl.mdf_pairs(x, most=1.0)):
        assert "zip_with" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_expanded_pairs_are_bounded(monkeypatch):
    """300 copies of two paths: a part holds no more than AT_ONCE pairs."""
    monkeypatch.setattr(ne, "AT_ONCE", 500)
    p = ne.Paths(np.arange(30.0).reshape(2, 3, 5), np.arange(600), np.repeat([0, 1], 300))
    got = list(ne.pairs(p, p, 1e3, True, True))
    assert max(len(x) for x, _, _ in got) <= 500
    assert {(a, b) for x, y, _ in got for a, b in zip(x.tolist(), y.tolist(), strict=True)} == {(a, b) for a in range(600) for b in range(a + 1, 600)}
    assert sum(len(x) for x, _, _ in got) == 600 * 599 // 2


def test_paths_that_reach_another_are_done_with(monkeypatch):
    """3000 and 3000 paths, of which many are near: few of the 9,000,000 pairs are taken up."""
    seen = []
    kept = ne._screened
    monkeypatch.setattr(ne, "_screened", lambda a, b, x, y, *more: seen.append(len(a.halves[x]) * len(b.halves[y])) or kept(a, b, x, y, *more))
    p = np.random.default_rng(7).normal(size=(6000, 3, 20))
    a, b = (ne.block(x, p.mean(0)) for x in (p[::2], p[1::2]))
    assert ne.reached(a, b, 2.1).mean() > 0.95 and sum(seen) < 9_000_000


def test_tiles_apart_are_passed_over(monkeypatch):
    seen = []
    kept = ne._screened
    monkeypatch.setattr(ne, "_screened", lambda *x: seen.append(1) or kept(*x))
    p = np.random.default_rng(7).normal(size=(40 * ne.SIDE, 3, 4)) + np.repeat(np.arange(40) * 50, ne.SIDE)[:, None, None]
    one = ne.block(p, p.mean(0))
    assert sum(len(i) for i, _, _ in ne.near(one, one, 1.0, same=True)) > 0 and len(seen) <= 2 * 40


def linkage_by_brute_force(d, most):
    d, size, label = d.copy(), np.ones(len(d)), np.arange(len(d))
    live = list(range(len(d)))
    while len(live) > 1:
        best, a, b = min((d[a, b], a, b) for a, b in combinations(live, 2))
        if best > most:
            break
        d[a] = d[:, a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        size[a] += size[b]
        live.remove(b)
        label[label == b] = a
    return label


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("dense", [0, 2])
def test_linkage_by_links_equals_brute_force(monkeypatch, seed, dense):
    """Copies, turned paths, and a path that isn't finite; by links and by matrices."""
    monkeypatch.setattr(ne, "DENSE", dense)
    e = np.random.default_rng(seed)
    p = e.normal(size=(60, 5, 3)) + e.integers(0, 3, (60, 1, 1)) * 2
    p[::7] = p[::7, ::-1]
    p = np.concatenate([p[e.integers(0, 60, 90)], np.full((2, 5, 3), INF)])
    most = [1.2, 1.7, 2.2, 2.8][seed % 4]
    with np.errstate(all="ignore"):
        d = distances(p.transpose(0, 2, 1))
        group, medoid = sl.linked(p, most)
    want = linkage_by_brute_force(np.where(np.isnan(d), INF, d), most)
    assert group[:90].tolist() == np.unique(want[:90], return_inverse=True)[1].tolist() and len(set(group[:90])) < 60
    for k in set(group[:90]):
        own = np.flatnonzero(group == k)
        total = d[np.ix_(own, own)].sum(1)
        assert total[own == medoid[own[0]]][0] == pytest.approx(total.min()) and len(set(medoid[own])) == 1


def test_linkage_of_different_paths_holds_no_matrix(monkeypatch):
    """3000 different paths that are all linked by steps: their matrix would have 9,000,000 numbers."""
    monkeypatch.setattr(sl, "average_linkage", None)
    e = np.random.default_rng(1)
    p = e.normal(size=(3000, 6, 3)).cumsum(1) + np.linspace(0, 400, 3000)[:, None, None]
    group, _ = sl.linked(p, 3.0)
    assert 100 < len(set(group)) < 1500
