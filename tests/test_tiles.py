"""Tiles with borders against plain numpy over the whole volume."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractloom.operators import preprocessing as pp
from tractloom.operators import tiles as tl
from tractloom.operators import voxels as vx


def rows_of(df) -> dict:
    return {(r.x, r.y, r.z): r.value for r in df.collect()}


def volume(spark, shape=(11, 9, 7), seed=0, drop=0.1, low=(0, 0, 0)):
    rng = np.random.default_rng(seed)
    at = {tuple(int(v) for v in np.array(k) + low): float(rng.integers(0, 50)) for k in np.ndindex(*shape) if rng.random() > drop}
    return at, spark.createDataFrame([(*k, v) for k, v in at.items()], "x int, y int, z int, value double")


def plain_median(at: dict, r: int) -> dict:
    p, v = np.array(list(at)), np.array(list(at.values()))
    return {k: float(np.median(v[(np.abs(p - k) <= r).all(1)])) for k in at}


@pytest.mark.parametrize("radius,passes,edge", [(1, 1, 4), (2, 2, 3), (4, 1, 24)])
def test_median_equals_windows(spark, radius, passes, edge):
    at, df = volume(spark, low=(-3, 0, 5))
    want = at
    for _ in range(passes):
        want = plain_median(want, radius)
    assert rows_of(tl.median(df.withColumn("tx", F.lit("x")), radius, passes, edge)) == pytest.approx(want)


def test_median_of_odd_tables(spark):
    _, df = volume(spark)
    assert tl.median(df.limit(0), 2).count() == 0
    odd = spark.createDataFrame([(0, 0, 0, 5.0), (0, 0, 0, 5.0), (0, 0, 1, None), (0, 1, 0, 7.0)], "x int, y int, z int, value double")
    assert rows_of(tl.median(odd, 1)) == {(0, 0, 0): 6.0, (0, 1, 0): 6.0}
    with pytest.raises(ValueError):
        tl.morphology(odd, "x")


@pytest.mark.parametrize("steps", ["e", "d", "ed", "ddee", "edde", ""])
def test_morphology_equals_joins(spark, steps):
    _, df = volume(spark, (9, 9, 9), 3, 0.3)
    mask = df.where("value > 4").select("x", "y", "z").checkpoint() if spark.sparkContext.getCheckpointDir() else df.where("value > 4").select("x", "y", "z")
    want = mask
    for s in steps:
        want = vx.erode(want) if s == "e" else vx.dilate(want)
    got = tl.morphology(mask, steps, edge=4).collect()
    assert len(got) == len(set(got)) and set(got) == set(want.collect())


def test_median_otsu_drops_speckles(spark):
    rng = np.random.default_rng(5)
    ball = {k for k in np.ndindex(14, 14, 14) if sum((v - 6.5) ** 2 for v in k) < 25}
    specks = {k for k in np.ndindex(14, 14, 14) if k not in ball and rng.random() < 0.03}
    rows = [(*k, [100.0 + float(rng.normal()) if k in ball or k in specks else 5.0] * 2) for k in np.ndindex(14, 14, 14)]
    signal = spark.createDataFrame(rows, "x int, y int, z int, signal array<double>")
    grad = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0), (1, 1000.0, 1.0, 0.0, 0.0)], "vol int, bval double, gx double, gy double, gz double")
    mean = signal.select("x", "y", "z", F.col("signal")[0].alias("value"))
    got = {tuple(r) for r in tl.median_otsu(mean, 1, 2, edge=6).collect()}
    calm = plain_median(plain_median({(r[0], r[1], r[2]): r[3][0] for r in rows}, 1), 1)
    cut = vx.otsu(spark.createDataFrame([(*k, v) for k, v in calm.items()], "x int, y int, z int, value double")).first().threshold
    assert got == {k for k, v in calm.items() if v > cut}
    assert got <= ball and len(got) / len(ball) > 0.8  # medians round off the rim of so small a ball
    grown = {tuple(r) for r in tl.median_otsu(mean, 1, 2, dilated=1, edge=6).collect()}
    assert grown > got and all(any(sum(abs(a - b) for a, b in zip(k, m, strict=True)) <= 1 for m in got) for k in grown)
    by_pipeline = {tuple(r) for r in pp.preprocess(signal, grad, correct=False, method="median_otsu", radius=1, passes=2)["mask"].collect()}
    assert by_pipeline and by_pipeline == got  # one part
    with pytest.raises(ValueError):
        pp.preprocess(signal, grad, method="none")
