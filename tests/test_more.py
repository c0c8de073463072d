"""Operators that SQL doesn't check: importance, permuted labels, parts of a mask, harmonised connectomes."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractloom.operators import harmonize as hz
from tractloom.operators import learning as ml
from tractloom.operators import voxels as vx


@pytest.fixture(scope="module")
def rows(spark):
    """Two classes that differ in the first of three features."""
    rng = np.random.default_rng(0)
    y = np.arange(60) % 2
    x = rng.standard_normal((60, 3))
    x[:, 0] += 3 * y
    return spark.createDataFrame([(int(k), int(y[k]), [float(v) for v in x[k]]) for k in range(60)], "id long, label int, features array<double>")


def test_importance_falls_on_the_feature_that_tells(rows):
    model = ml.classifier(n=60).fit(ml.with_vector(rows))
    got = {r["feature"]: r["importance"] for r in ml.permutation_importance(model, rows).collect()}
    assert set(got) == {0, 1, 2} and got[0] > 0.2 and abs(got[1]) < 0.1 and abs(got[2]) < 0.1


def test_cross_validation_and_permuted_labels(rows):
    cv = ml.cross_validate(rows, 2).toPandas()
    assert set(cv.columns) == {"fold", *[p + n for p in ("", "train_") for n in ("auc", "accuracy", "precision", "recall", "f1")]}
    assert (cv[["auc", "accuracy", "precision", "recall", "f1", "train_auc"]] > 0.7).all().all()
    p = ml.auc_permutation(rows, 3, k=2).first()
    assert p["observed"] == pytest.approx(cv["auc"].mean()) and p["p"] == 0.25


def test_scores(spark):
    d = spark.createDataFrame([(1.0, 1.0)] * 3 + [(1.0, 0.0)] * 1 + [(0.0, 1.0)] * 2 + [(0.0, 0.0)] * 4, "label double, prediction double")
    s = ml.scores(d).first()
    assert tuple(s) == pytest.approx((0.7, 3 / 5, 3 / 4, 6 / 9))


def test_parts_of_a_mask(spark):
    rng = np.random.default_rng(1)
    on = {tuple(map(int, p)) for p in rng.integers(0, 6, (60, 3))}
    left, sizes = set(on), []
    while left:
        todo, n = collections.deque([left.pop()]), 0
        while todo:
            p, n = todo.popleft(), n + 1
            for k in range(3):
                for s in (-1, 1):
                    q = tuple(v + s * (i == k) for i, v in enumerate(p))
                    if q in left:
                        left.remove(q)
                        todo.append(q)
        sizes.append(n)
    got = vx.mask_parts(spark.createDataFrame(sorted(on), "x int, y int, z int")).first()
    assert got["parts"] == len(sizes) and got["largest_share"] == pytest.approx(max(sizes) / len(on))
    assert vx.mask_parts(spark.createDataFrame([], "x int, y int, z int")).first()["parts"] == 0


def test_harmonized_connectomes_equal_features(spark):
    rng = np.random.default_rng(2)
    rows = [(s, s % 3, i, j, float(rng.standard_normal() + s % 3)) for s in range(24) for i in range(4) for j in range(4)]
    e = spark.createDataFrame(rows, "id long, batch int, i int, j int, weight double")
    got = {(r["id"], r["i"], r["j"]): r["weight"] for r in hz.harmonized_edges(e).collect()}
    f = e.where("i < j").select("id", "batch", (F.col("i") * 4 + F.col("j")).alias("feature"), F.col("weight").alias("value"))
    want = {(r["id"], r["feature"] // 4, r["feature"] % 4): r["value"] for r in hz.combat(f).collect()}
    assert got == pytest.approx(want) and len(got) == 24 * 6
