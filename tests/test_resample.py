"""Poisson bootstrap against numpy with the same weights, and against theory."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractloom.operators import resample as rs
from tractloom.operators import stats as st


def mean_of():
    return {"n": F.when(F.col("value").isNotNull(), 1), "v": F.col("value")}, lambda n, v: F.try_divide(v, n)


def frame(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, ["a", "b", None][k % 3], float(rng.gamma(2.0, 3.0)), float(rng.normal())) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, grp string, value double, other double")


def test_weights_are_poisson():
    w = rs.weights(np.arange(4000, dtype=np.uint64), 200, 7)[:, 1:]
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    c = np.corrcoef(w[:, :20].T) - np.eye(20)
    assert np.abs(c).max() < 0.08


def test_any_statistic_equals_numpy(spark):
    rows, df = frame(spark)
    sums = {"n": F.lit(1), "x": F.col("value"), "y": F.col("other"), "xx": F.col("value") ** 2, "yy": F.col("other") ** 2, "xy": F.col("value") * F.col("other")}
    r = lambda n, x, y, xx, yy, xy: (n * xy - x * y) / F.sqrt((n * xx - x * x) * (n * yy - y * y))
    got = {(k.grp, k.r): k.stat for k in rs.replicates(df.repartition(7), ["grp"], "id", sums, r, 40, 3).collect()}
    once = {(k.grp, k.r): k.stat for k in rs.replicates(df.coalesce(1), ["grp"], "id", sums, r, 40, 3).collect()}
    assert len(got) == 3 * 41 and got == pytest.approx(once)
    ids = np.array([k.h for k in df.orderBy("id").select(F.xxhash64("id").alias("h")).collect()]).astype(np.int64).view(np.uint64)
    w = rs.weights(ids, 40, 3)
    for g in ("a", "b", None):
        mine = [k for k in range(len(rows)) if rows[k][1] == g]
        x, y = (np.array([rows[k][c] for k in mine]) for c in (2, 3))
        for rep in (0, 1, 17, 40):
            assert got[g, rep] == pytest.approx(np.cov(x, y, aweights=w[mine, rep])[0, 1] / np.sqrt(np.cov(x, aweights=w[mine, rep]) * np.cov(y, aweights=w[mine, rep])))


def test_mean_agrees_with_theory_and_with_the_plain_bootstrap(spark):
    rows, df = frame(spark, 600)
    sums, f = mean_of()
    got = rs.interval(rs.replicates(df, [], "id", sums, f, 1500), []).first()
    v = np.array([r[2] for r in rows])
    assert got.estimate == pytest.approx(v.mean()) and got.se == pytest.approx(v.std() / np.sqrt(len(v)), rel=0.08)
    plain = st.bootstrap(df.select(F.lit(0).alias("g"), "id", "value"), ["g"], 500).first()
    assert abs(got.low - plain.low) < got.se / 2 and abs(got.high - plain.high) < got.se / 2


def test_median(spark):
    rows, df = frame(spark, 900, 5)
    got = {k.grp: k for k in rs.quantile_interval(df, ["grp"], n_boot=2000).collect()}
    rng = np.random.default_rng(1)
    for g in ("a", "b", None):
        v = np.array([r[2] for r in rows if r[1] == g])
        width = np.ptp(v) / 4096
        boot = np.median(rng.choice(v, (2000, len(v))), 1)
        near = np.sort(v)[len(v) // 2 - 1 : len(v) // 2 + 1]
        assert near[0] - width <= got[g].estimate <= near[1] + width
        assert got[g].se == pytest.approx(boot.std(), rel=0.15)
        assert abs(got[g].low - np.quantile(boot, 0.025)) < boot.std() / 2 and abs(got[g].high - np.quantile(boot, 0.975)) < boot.std() / 2
    again = {k.grp: k for k in rs.quantile_interval(df.repartition(5), ["grp"], n_boot=2000).collect()}
    assert again == got


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, "a", None), (2, "a", 3.0), (3, "b", None), (None, "c", 5.0), (None, "c", 5.0)], "id long, grp string, value double")
    sums, f = mean_of()
    got = {k.grp: k for k in rs.interval(rs.replicates(odd.withColumn("r", F.lit(1)), ["grp"], "id", sums, f, 30), ["grp"]).collect()}
    assert got["a"].estimate == 3 and got["b"].estimate is None and got["c"].estimate == 5
    assert rs.replicates(odd.limit(0), ["grp"], "id", sums, f, 5).count() == 0
    q = {k.grp: k for k in rs.quantile_interval(odd, ["grp"], n_boot=20).collect()}
    assert set(q) == {"a", "c"} and q["c"].estimate == 5 and q["c"].se == 0
    assert rs.quantile_interval(odd.limit(0), ["grp"]).count() == 0
