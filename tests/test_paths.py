"""Path metrics by joins against the dense view of one graph, and on a ring whose diameter is 50,000."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from tractloom.operators import graph as gr
from tractloom.operators import paths as pt


def random_graph(spark, seed, n=16, m=24, whole=True):
    """Two parts that no edge joins; whole weights make many equal lengths."""
    r = np.random.default_rng(seed)
    half = n // 2
    pairs = [p for p in itertools.combinations(range(n), 2) if (p[0] < half) == (p[1] < half)]
    pick = [pairs[k] for k in r.permutation(len(pairs))[:m]]
    rows = [(int(i), int(j), float(r.integers(1, 4)) if whole else float(r.random() + 0.1)) for i, j in pick]
    g = gr.Graph(*(np.array(c) for c in zip(*rows, strict=True)))
    return spark.createDataFrame(rows, "i long, j long, weight double").repartition(3), g


def by_node(df):
    return {r[0]: r[1] for r in df.collect()}


@pytest.mark.parametrize(("seed", "kind", "small"), [(1, "weight", False), (2, "hop", True), (3, "inverse", True)])
def test_path_metrics(spark, monkeypatch, seed, kind, small):
    if small:  # several batches, and chains taken out at any size
        monkeypatch.setattr(pt, "STATE_ROWS", 150)
        monkeypatch.setattr(pt, "LEAST_NODES", 0)
    e, g = random_graph(spark, seed, whole=kind != "inverse")
    at = dict(enumerate(g.nodes.tolist()))
    assert by_node(pt.closeness(e, kind)) == pytest.approx({at[k]: x for k, x in enumerate(g.closeness(kind))})
    assert by_node(pt.betweenness(e, kind)) == pytest.approx({at[k]: x for k, x in enumerate(g.betweenness(kind))})
    assert pt.path_length(e, kind).first()[0] == pytest.approx(g.path_length(kind))


def test_hop_metrics(spark):
    e, g = random_graph(spark, 5)
    at = dict(enumerate(g.nodes.tolist()))
    assert pt.global_efficiency(e).first()[0] == pytest.approx(g.efficiency())
    assert by_node(pt.local_efficiency(e)) == pytest.approx({at[k]: x for k, x in enumerate(g.local_efficiency())})
    assert by_node(pt.components(e)) == {at[k]: at[c] for k, c in enumerate(g.components().tolist())}
    order = {r["node"]: r["place"] for r in pt.by_degree(e).collect()}
    assert order == {at[k]: p for p, k in enumerate(np.argsort(-g.adj.sum(1), kind="stable").tolist())}
    got = {r["step"]: (r["efficiency"], r["size"]) for r in pt.removed_in_steps(e, pt.by_degree(e)).collect()}
    want = dict(enumerate(zip(*g.resilience(), strict=True)))
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in want.items()})
    assert sorted(r["place"] for r in pt.at_random(e, 3).collect()) == list(range(g.n))


def test_shortest_path(spark):
    e, g = random_graph(spark, 6)
    node = lambda k: spark.createDataFrame([(int(k),)], "node long")
    a = int(g.nodes[0])
    reached = [int(v) for v, d in zip(g.nodes, g.distances()[0], strict=True) if np.isfinite(d)]
    b = reached[-1]
    rows = pt.shortest_path(e, node(a), node(b)).orderBy("step").collect()
    assert [rows[0]["node"], rows[-1]["node"], rows[-1]["d"]] == [a, b, g.shortest_path(a, b)[0]]
    w = {(int(g.nodes[i]), int(g.nodes[j])): g.w[i, j] for i, j in zip(*np.nonzero(g.w), strict=True)}
    assert all(y["d"] - x["d"] == w[x["node"], y["node"]] for x, y in itertools.pairwise(rows))
    assert pt.shortest_path(e, node(a), node(max(g.nodes))).count() == 0


def test_ring_of_a_hundred_thousand_nodes(spark):
    n = 100_000
    ring = spark.range(n).selectExpr("least(id, (id + 1) % 100000) AS i", "greatest(id, (id + 1) % 100000) AS j", "2.0D AS weight")
    d = pt.distances_from(ring, spark.createDataFrame([(17,)], "node long"))
    wrong = d.selectExpr("node", "d", "abs(node - 17) AS k").where(f"d <> 2 * least(k, {n} - k)")
    assert d.count() == n and wrong.count() == 0


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "i long, j long, weight double")
    assert pt.closeness(none).count() == pt.betweenness(none).count() == pt.components(none).count() == pt.local_efficiency(none).count() == 0
    assert pt.global_efficiency(none).first()[0] == pt.path_length(none).first()[0] == 0.0
    one = spark.createDataFrame([(1, 2, 3.0)], "i long, j long, weight double")
    assert by_node(pt.closeness(one)) == {1: pytest.approx(1 / 3), 2: pytest.approx(1 / 3)} and by_node(pt.betweenness(one)) == {1: 0.0, 2: 0.0}
