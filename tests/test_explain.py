"""Contributions of forests against enumeration of all coalitions."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from tractloom.operators import explain as ex
from tractloom.operators import learning as ml


def given(nodes, x, known, k=0):
    """A tree's prediction when only some features are known."""
    n = nodes[k]
    if n["leftChild"] < 0:
        return n["impurityStats"][1] / sum(n["impurityStats"])
    left, right = n["leftChild"], n["rightChild"]
    f, t = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
    if f in known:
        return given(nodes, x, known, left if x[f] <= t else right)
    w = [sum(nodes[c]["impurityStats"]) for c in (left, right)]
    return (w[0] * given(nodes, x, known, left) + w[1] * given(nodes, x, known, right)) / sum(w)


def test_tree_contributions(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(160, 8))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * r.normal(size=160) > 0).astype(float)
    df = ml.with_vector(spark.createDataFrame([(i, [float(v) for v in f], float(c)) for i, (f, c) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, label double"))
    model = ml.classifier("random_forest", trees=4, depth=4).fit(df)
    got = np.zeros((160, 8))
    for q in ex.tree_contributions(model, df).collect():
        got[q["id"], q["feature"]] = q["phi"]
    trees = ex.node_table(model, df)
    base = ex.base_value(ex.leaves(trees))
    chance = {q["id"]: q["probabilities"][1] for q in ml.predict(model, df).collect()}
    assert base + got.sum(1) == pytest.approx([chance[i] for i in range(160)])
    z = np.array([q["z"].toArray() for q in model.stages[0].transform(df).orderBy("id").collect()])
    for i in (0, 7, 99):
        value = {s: np.mean([given(t, z[i], s) for t in trees]) for k in range(9) for s in combinations(range(8), k)}
        for f in range(8):
            others = [o for o in range(8) if o != f]
            want = sum(factorial(k) * factorial(7 - k) / factorial(8) * (value[tuple(sorted((*s, f)))] - value[s]) for k in range(8) for s in combinations(others, k))
            assert got[i, f] == pytest.approx(want, abs=1e-12)


def test_a_tree_without_splits(spark):
    df = ml.with_vector(spark.createDataFrame([(i, [1.0, 2.0], 0.0) for i in range(6)] + [(6, [1.0, 2.0], 1.0)], "id long, features array<double>, label double"))
    model = ml.classifier("random_forest", trees=2, depth=2).fit(df)
    assert {q["phi"] for q in ex.tree_contributions(model, df).collect()} == {0.0}
