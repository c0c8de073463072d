"""Values worked out by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractloom.functions import geometry as g
from tractloom.operators import connectome as cn
from tractloom.operators import graph as gr
from tractloom.operators import learning as ml
from tractloom.operators import stats as st
from tractloom.operators import streamlines as sl
from tractloom.operators import surfaces as sf
from tractloom.operators import tracking as tk
from tractloom.operators import voxels as vx

FIVE = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]


def graph(pairs):
    i, j = np.array(pairs).T
    return gr.Graph(i, j, np.ones(len(i)))


def test_five_nodes():
    x = graph(FIVE)
    assert x.efficiency() == pytest.approx(0.85)
    assert x.path_length() == pytest.approx(1.3)
    assert x.betweenness() == pytest.approx([0, 1 / 12, 1 / 3, 1 / 12, 0])
    assert x.closeness() == pytest.approx([2 / 3, 0.8, 1, 0.8, 2 / 3])
    assert x.eigenvector() == pytest.approx([0.350542, 0.469959, 0.559033, 0.469959, 0.350542], abs=1e-4)
    assert x.clustering() == pytest.approx(0.766667, abs=1e-6)
    e, n = x.resilience(5)
    assert e == pytest.approx([0.85, 0.7222, 0.3333, 0, 0, 0], abs=1e-4) and n == [5, 4, 3, 2, 1, 0]
    assert x.shortest_path(0, 4)[0] == 2


def test_complete_graph():
    x = graph([(i, j) for i in range(5) for j in range(i + 1, 5)])
    assert x.efficiency() == 1 and x.path_length() == 1 and x.clustering() == pytest.approx(1)
    assert x.betweenness() == pytest.approx([0] * 5) and x.closeness() == pytest.approx([1] * 5)


def test_local_metrics_on_frames(spark):
    e = spark.createDataFrame([(i, j, 1.0) for i, j in FIVE], "i int, j int, weight double")
    assert gr.density(e).first()["density"] == pytest.approx(0.7)
    assert gr.transitivity(e).first()["transitivity"] == pytest.approx(9 / 14)
    assert gr.assortativity(e).first()["assortativity"] == pytest.approx(-0.5)
    assert {r["k"]: r["phi"] for r in gr.rich_club(e).collect()} == pytest.approx({1: 0.7, 2: 1.0})
    assert {r["node"]: r["degree"] for r in gr.degree_strength(e).collect()} == {0: 2, 1: 3, 2: 4, 3: 3, 4: 2}


def test_communities_of_two_cliques():
    a = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    x = graph(a + [(i + 5, j + 5) for i, j in a] + [(0, 5)])
    for find in (gr.louvain, gr.leiden):
        c = find(x)
        assert len(set(c[:5])) == 1 and len(set(c[5:])) == 1 and c[0] != c[5]
        assert gr.partition_quality(x, c) == pytest.approx(20 / 21 - 2 * (21 / 42) ** 2, abs=1e-9)


@pytest.mark.parametrize("seed", range(12))
def test_leiden(seed):
    """Connected communities, no gain left for a single node, and no worse than Louvain."""
    r = np.random.default_rng(seed)
    n = 30
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < (0.5 if i % 4 == j % 4 else 0.06)]
    x = gr.Graph(*(np.array(p) for p in zip(*pairs, strict=True)), r.random(len(pairs)) + 0.1)
    c = gr.leiden(x)
    q = gr.partition_quality(x, c)
    assert (gr._parts(x.w, c) == np.array([np.flatnonzero(c == k)[0] for k in c])).all()
    for v in range(x.n):
        for k in {*c.tolist(), x.n}:
            moved = c.copy()
            moved[v] = k
            assert gr.partition_quality(x, moved) <= q + 1e-9
    assert q >= gr.partition_quality(x, gr.louvain(x)) - 1e-9


def test_leiden_splits_what_hangs_by_a_bridge_alone():
    x = graph([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)])
    assert (gr._leiden(x, np.zeros(6, np.int64), 1.0) == np.array([0, 0, 0, 1, 1, 1])).all()
    w = graph([(0, 1), (1, 2), (3, 4)]).w
    assert gr._refined(w, np.zeros(5, np.int64), 1.0).tolist()[3:] != [0, 0]


def test_paths(spark):
    pts = lambda *p: [dict(zip("xyz", map(float, q), strict=True)) for q in p]
    a = pts((0, 0, 0), (3, 4, 0), (3, 4, 12))
    df = spark.createDataFrame([(1, a), (2, pts((0, 0, 0)))], "sl_id long, points array<struct<x: double, y: double, z: double>>")
    got = {r["sl_id"]: r for r in df.select("sl_id", g.path_length(F.col("points")).alias("l"), g.curvature(F.col("points")).alias("c"), g.mdf(F.col("points"), F.reverse("points")).alias("m")).collect()}
    assert got[1]["l"] == 17 and got[1]["c"] == pytest.approx([90]) and got[1]["m"] == 0
    assert got[2]["l"] == 0 and got[2]["c"] == []
    assert sl.curvature_filter(df, 10).select("sl_id").collect()[0][0] == 2
    assert sl.resampled(np.array([[0, 0, 0], [10, 0, 0]], float), step=4)[:, 0] == pytest.approx([0, 10 / 3, 20 / 3, 10])


def test_trilinear_outside_is_null(spark):
    v = spark.createDataFrame([(x, y, z, float(x + 2 * y + 4 * z)) for x in range(2) for y in range(2) for z in range(2)], "x int, y int, z int, value double")
    p = spark.createDataFrame([(1, 0.5, 0.25, 0.75), (2, 1.5, 0.0, 0.0)], "id int, x double, y double, z double")
    got = {r["id"]: r["value"] for r in cn.trilinear(p, v, ["id"]).collect()}
    assert got[1] == pytest.approx(0.5 + 0.5 + 3) and got[2] is None


def test_fdr(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5)], "id int, p double")
    got = {r["id"]: r["adjusted"] for r in st.fdr(p).collect()}
    assert got == pytest.approx({1: 0.04, 2: 4 * 0.04 / 3, 3: 4 * 0.04 / 3, 4: 0.5})


def test_t_distribution():
    assert st.t_two_sided(np.array([2.228, 0.0, 12.706]), np.array([10, 5, 1])) == pytest.approx([0.05, 1.0, 0.05], abs=2e-4)


def scheme():
    h = 0.5**0.5
    return np.array([0.0] + [1000.0] * 6), np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [h, h, 0], [h, 0, h], [0, h, h]])


def test_tensor_of_one_fibre():
    b, v = scheme()
    s = 1000 * np.exp(-b * ((v**2) @ np.array([1.5e-3, 4e-4, 4e-4])))
    r = vx.fit_tensors(s[None], b, v)
    assert r["fa"][0] == pytest.approx(0.6862, abs=2e-3) and r["md"][0] == pytest.approx(7.6667e-4, rel=1e-2)
    assert vx.fit_tensors(s[None], b, v, convention="as_written")["fa"][0] == pytest.approx(0.3962, abs=2e-3)
    assert (np.diff(r["evals"][0]) <= 1e-12).all() and abs(r["v1"][0][0]) > 0.99


@pytest.mark.parametrize(("lam", "fa"), [((1.5, 0.4, 0.4), 0.6862), ((0.8, 0.7, 0.7), 0.0786), ((0.6, 0.6, 0.6), 0.0)])
def test_anisotropy(spark, lam, fa):
    c = g.tensor_scalars(*[F.lit(x * 1e-3) for x in lam])
    assert spark.range(1).select(c["fa"].alias("fa")).first()["fa"] == pytest.approx(fa, abs=1e-4)


def test_noise_gives_anisotropy_in_range():
    b, v = scheme()
    r = vx.fit_tensors(500 + 100 * np.random.default_rng(0).random((27, 7)), b, v)
    assert r["fa"].shape == (27,) and ((r["fa"] >= 0) & (r["fa"] <= 1)).all()


def test_harmonics_are_orthonormal():
    d = vx.sphere(4000)
    m = vx.sh_basis(4, d)
    assert (m.T @ m) * 4 * np.pi / len(d) == pytest.approx(np.eye(15), abs=2e-2)


def test_straight_track():
    c = {"dir": np.zeros((20, 20, 20, 3)), "fa": np.full((20, 20, 20), 0.5), "mask": np.ones((20, 20, 20))}
    c["dir"][..., 0] = 1
    p, why = tk.integrate(np.array([[5.0, 5, 5]]), np.array([[1.0, 0, 0]]), c, lambda live, k: 0, 0.5, 1000, 100, 0.1, 30, 0.1)
    assert p[0][-1] == pytest.approx([19, 5, 5]) and list(why) == ["exit_volume"]


def test_surface_of_a_ball():
    i = np.indices((15, 15, 15)) - 7
    v, t = sf.isosurface(np.clip(5.7 - np.sqrt((i**2).sum(0)), 0, 1))
    edges = np.sort(np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]]), axis=1)
    assert (np.unique(edges, axis=0, return_counts=True)[1] == 2).all() and len(v) - len(t) // 2 == 2
    d = sf.heat_distances(v, t, [0])[0]
    far = np.argmax(np.linalg.norm(v - v[0], axis=1))
    assert d[far] == pytest.approx(np.pi * 5.2, rel=0.15)  # the heat method on a coarse mesh of uneven faces


def test_average_linkage():
    x = np.array([0.0, 1, 10, 11, 12])
    c = sl.average_linkage(np.abs(x[:, None] - x[None]), 3)
    assert c[0] == c[1] and c[2] == c[3] == c[4] and c[0] != c[2]


def test_components_and_holes(spark):
    shell = [(x, y, z) for x in range(1, 4) for y in range(1, 4) for z in range(1, 4) if (x, y, z) != (2, 2, 2)]
    m = spark.createDataFrame([*shell, (6, 6, 6)], "x int, y int, z int")
    assert vx.largest_component(m).count() == 26
    assert vx.fill_holes(m, (8, 8, 8)).count() == 28
    assert vx.erode(vx.fill_holes(m, (8, 8, 8))).collect()[0] == (2, 2, 2)


def test_curves(spark):
    s = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.7), (4, 0, 0.1)], "id int, y int, score double")
    assert ml.auc(s).first()["auc"] == pytest.approx(0.75)
    assert ml.average_precision(s).first()["average_precision"] == pytest.approx((1 + 2 / 3) / 2)
