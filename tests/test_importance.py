"""Permutation importance against scoring every changed row apart."""

from __future__ import annotations

import numpy as np
import pytest

from tractloom.operators import learning as ml


def plain_auc(y, score):
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2) if len(pos) and len(neg) else None


def test_importance_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        y = k % 2
        x = [float(rng.normal() + 2 * y), float(rng.normal() + y), float(rng.normal())]
        rows.append((k, float(y), x))
    df = spark.createDataFrame(rows, "id long, label double, features array<double>")
    model = ml.classifier(n=300).fit(ml.with_vector(df))
    dealt = ml.partners(df).collect()
    assert sorted(r.id for r in dealt) == list(range(300))
    assert sorted(map(tuple, (r._other for r in dealt))) == sorted(map(tuple, (r.features for r in dealt)))
    assert sum(r._other == r.features for r in dealt) < 20
    y = np.array([r.label for r in dealt])
    own, other = (np.array([list(r[c]) for r in dealt]) for c in ("features", "_other"))

    def score(m):
        t = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "k long, features array<double>")
        got = model.transform(ml.with_vector(t)).orderBy("k").select("probability").collect()
        return np.array([r.probability[1] for r in got])

    base = plain_auc(y, score(own))
    want = {}
    for f in range(3):
        m = own.copy()
        m[:, f] = other[:, f]
        want[f] = base - plain_auc(y, score(m))
    got = {r.feature: r.importance for r in ml.permutation_importance(model, df.repartition(3)).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    assert got[0] > got[1] > got[2]


def test_one_label_has_no_importance(spark):
    rows = [(k, float(k % 2), [float(k % 3), 1.0]) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, label double, features array<double>")
    model = ml.classifier(n=30).fit(ml.with_vector(df))
    got = ml.permutation_importance(model, df.where("label = 1")).collect()
    assert len(got) == 2 and all(r.importance is None for r in got)
