"""Registration against planted motions, and its slopes against differences."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tractloom.operators import preprocessing as pp
from tractloom.operators import registration as rg
from tractloom.operators import voxels as vx

SHAPE = (28, 30, 26)
CENTRE = (np.array(SHAPE) - 1) / 2


def head(q: np.ndarray) -> np.ndarray:
    """Some blobs of unlike size, at any places (n x 3)."""
    blobs = [(12, 14, 13, 6.0, 1.0), (17, 12, 9, 3.0, 0.9), (9, 19, 16, 2.5, 0.7), (16, 20, 17, 2.0, 1.2), (8, 9, 9, 2.2, -0.6)]
    return sum(a * np.exp(-((q - [x, y, z]) ** 2).sum(-1) / (2 * s * s)) for x, y, z, s, a in blobs)


def grid() -> np.ndarray:
    return np.stack(np.meshgrid(*[np.arange(n) for n in SHAPE], indexing="ij"), -1).reshape(-1, 3).astype(float)


def displaced(shift, turn) -> np.ndarray:
    """The volume m with m(R (q - c) + c + t) = head(q)."""
    r = rg.rotation(turn)
    return head((grid() - CENTRE - np.asarray(shift)) @ r + CENTRE)


@pytest.mark.parametrize("metric", ["mi", "cc"])
def test_slopes_equal_differences(metric):
    rng = np.random.default_rng(1)
    a, b = head(grid()), displaced((1.0, 0.4, -0.3), (0.05, 0.0, 0.02))
    m = rng.uniform(3, 27, 500)
    if metric == "mi":
        fixed = np.round(rg.in_bins(a, a.min(), a.max(), 0)).astype(int)[:500]
        f = lambda x: rg.mutual_information(fixed, x)
    else:
        f = lambda x: rg.correlation(a[:500], x)
    slope = f(m)[1]
    for k in range(5):
        e = np.zeros(500)
        e[k] = 1e-4
        assert (f(m + e)[0] - f(m - e)[0]) / 2e-4 == pytest.approx(slope[k], rel=1e-4, abs=1e-9)
    q = rng.uniform(0, 24, (50, 3))
    v = b.reshape(SHAPE)
    _, slope, inside = rg.sampled(v, q)
    assert inside.all()
    for k in range(3):
        e = np.eye(3)[k] * 1e-6
        assert np.allclose((rg.sampled(v, q + e)[0] - rg.sampled(v, q - e)[0]) / 2e-6, slope[:, k], atol=1e-6)


@pytest.mark.parametrize("metric,contrast", [("mi", "same"), ("mi", "inverted"), ("cc", "same")])
def test_planted_motion_is_found(metric, contrast):
    shift, turn = np.array([2.3, -1.6, 1.1]), np.array([0.08, -0.06, 0.1])
    moving = displaced(shift, turn)
    if contrast == "inverted":
        moving = 3.0 - moving - 0.3 * moving**2
    m, t, before, after = rg.fitted(head(grid()).reshape(SHAPE), moving.reshape(SHAPE), metric=metric)
    inner = grid()[(np.abs(grid() - CENTRE) < 9).all(1)] - CENTRE
    off = np.linalg.norm(inner @ (m - rg.rotation(turn)).T + (t - shift), axis=1)
    assert off.max() < 0.5 and after > before
    assert np.allclose(rg.angles(rg.rotation(turn)), turn)


def test_affine_finds_a_scaling():
    a = np.diag([1.06, 0.95, 1.0])
    moving = head((grid() - CENTRE) @ np.linalg.inv(a).T + CENTRE)
    m, t, *_ = rg.fitted(head(grid()).reshape(SHAPE), moving.reshape(SHAPE), kind="affine")
    assert np.abs(m - a).max() < 0.03 and np.abs(t).max() < 0.3


def test_odd_volumes_stay():
    flat = np.ones((5, 4, 1))
    m, t, *_ = rg.fitted(flat, flat)
    assert np.array_equal(m, np.eye(3)) and not t.any()
    one = np.zeros((1, 1, 1))
    assert not rg.fitted(one, one)[1].any()
    with pytest.raises(ValueError):
        rg.fitted(flat, flat, kind="bent")


def test_scan_is_moved_back(spark):
    planted = {0: ((0, 0, 0), (0, 0, 0)), 1: ((2.0, -1.0, 0.5), (0.0, 0.05, 0.0)), 2: ((-1.2, 0.8, 2.6), (0.06, 0.0, -0.08))}
    vols = np.stack([displaced(*planted[k]) for k in range(3)], 1)
    vols[:, 2] = 100 * np.exp(-vols[:, 2])  # another contrast
    g = grid().astype(int)
    pdf = pd.DataFrame({"x": g[:, 0], "y": g[:, 1], "z": g[:, 2], "signal": list(vols)})
    signal = spark.createDataFrame(pdf, "x int, y int, z int, signal array<double>").repartition(5)
    grad = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0), (1, 1000.0, 1.0, 0.0, 0.0), (2, 1000.0, 0.0, 1.0, 0.0)], "vol int, bval double, gx double, gy double, gz double")
    out, turned, moves = rg.motion_corrected(signal, grad)
    for row in moves.collect():
        shift, turn = planted[row.vol]
        assert np.abs(np.array([row.tx, row.ty, row.tz]) - shift).max() < 0.3
        assert np.abs(np.array([row.rx, row.ry, row.rz]) - turn).max() < 0.02
    t = {r.vol: np.array([r.gx, r.gy, r.gz]) for r in turned.collect()}
    assert np.allclose(t[1], rg.rotation(planted[1][1]).T @ [1, 0, 0], atol=0.03) and not t[0].any()
    written = {r.vol: np.array([r.gx, r.gy, r.gz]) for r in rg.turned_gradients(grad, moves, "as_written").collect()}
    assert np.allclose(written[2], rg.rotation(planted[2][1]) @ [0, 1, 0], atol=0.03)
    got = {(r.x, r.y, r.z): r.signal for r in out.collect()}
    assert len(got) == len(g)
    for at in [(12, 14, 13), (15, 12, 10), (11, 17, 15)]:
        want = head(np.array([at], float))[0]
        assert got[at][0] == pytest.approx(want, abs=0.02) and got[at][1] == pytest.approx(want, abs=0.06)
        assert got[at][2] == pytest.approx(100 * np.exp(-want), rel=0.06)
    s = vx.motion_summary(moves).first()
    assert s.outliers == 2 and s.max_displacement == pytest.approx(np.linalg.norm(planted[2][0]), abs=0.3)


def test_preprocessing_corrects_motion(spark):
    vols = np.stack([displaced((0, 0, 0), (0, 0, 0)), displaced((0, 2.5, 0), (0, 0, 0))], 1) * 100 + 10
    g = grid().astype(int)
    pdf = pd.DataFrame({"x": g[:, 0], "y": g[:, 1], "z": g[:, 2], "signal": list(vols)})
    signal = spark.createDataFrame(pdf, "x int, y int, z int, signal array<double>")
    grad = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0), (1, 1000.0, 1.0, 0.0, 0.0)], "vol int, bval double, gx double, gy double, gz double")
    got = pp.preprocess(signal, grad, correct=False, motion="rigid")
    qc = got["qc"].first()
    assert qc.outliers == 1 and qc.max_displacement == pytest.approx(2.5, abs=0.3)
    inner = np.array([r.signal for r in got["signal"].collect()])
    assert len(inner) and np.abs(inner[:, 0] - inner[:, 1]).mean() < 3


def test_query_finds_planted_shifts(spark):
    from tractloom.plans import models

    rows = models.motion_correction(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.vol for r in rows) == [0, 1, 2, 3]
    for r in rows:
        assert r.after >= r.before
        assert np.abs(np.array([r.tx - r.px, r.ty - r.py, r.tz - r.pz])).max() < 0.5, r
