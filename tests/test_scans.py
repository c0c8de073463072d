"""Preprocessing, training and the small operators around scans, worked out again by numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractloom.operators import graph as gr
from tractloom.operators import learning as ml
from tractloom.operators import preprocessing as pp
from tractloom.operators import reports as rp
from tractloom.operators import training as tr
from tractloom.sources import volumes as vol


def scan(spark):
    """A bright cube of 4 with a slope along x in a dim one of 8, and a bright voxel apart."""
    rows = []
    for x in range(8):
        for y in range(8):
            for z in range(8):
                inside = (2 <= min(x, y, z) and max(x, y, z) < 6) or (x, y, z) == (0, 0, 7)
                s = 500.0 + 10 * x + y if inside else 10.0
                rows.append((x, y, z, [s, s / 2, s / 3, s]))
    grad = [(0, 0.0, 0.0, 0.0, 0.0), (1, 1001.0, 2.0, 0.0, 0.0), (2, 999.0, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "x int, y int, z int, signal array<double>"), spark.createDataFrame(grad, "vol int, bval double, gx double, gy double, gz double")


def test_preprocessing_keeps_the_large_part(spark):
    signal, grad = scan(spark)
    raw = {(r.x, r.y, r.z): r.signal for r in signal.collect()}
    got = pp.preprocess(signal, grad, sigma=1.0)
    out = {(r.x, r.y, r.z): r.signal for r in got["signal"].collect()}
    cube = {k for k in raw if 2 <= min(k) and max(k) < 6}
    assert set(out) == cube
    for k, v in out.items():
        assert np.allclose(np.array(v) / v[0], np.array(raw[k]) / raw[k][0])  # one field for all volumes
    g = {r.vol: r for r in got["grad"].collect()}
    assert g[1].bval == 1000 and g[1].gx == 1 and g[2].bval == 1000
    qc = got["qc"].first()
    m = np.array([raw[k][0] for k in cube])
    assert qc.inside == 64 and qc.voxels == 512 and qc.n_b0 == 2 and qc.n_dwi == 2 and not qc.passed
    assert qc.cv_before == pytest.approx(m.std() / m.mean()) and qc.cv_after < qc.cv_before
    plain = pp.preprocess(signal, grad, extract=False, correct=False)
    assert {(r.x, r.y, r.z): r.signal for r in plain["signal"].collect()} == raw
    assert plain["qc"].first().cv_after == plain["qc"].first().cv_before


def test_training_saves_what_it_reports(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(k, float(k % 2), (rng.normal(size=3) + 3 * (k % 2)).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, label double, features array<double>")
    model, report = tr.train(df)
    got = {r.part: r for r in report.collect()}
    assert got["test"].n == 40 and got["validation"].n == 32 and got["train"].n == 128 and got["test"].auc > 0.95
    tr.save(model, report, str(tmp_path))
    again = tr.load(str(tmp_path))
    x = ml.with_vector(df)
    assert [r.confidence for r in ml.predict(again, x).orderBy("id").collect()] == [r.confidence for r in ml.predict(model, x).orderBy("id").collect()]


def test_places_number_each_label(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("label"))
    rows = ml.places(df).collect()
    for label in (None, 1, 2):
        mine = [r for r in rows if r.label == label]
        assert sorted(r._place for r in mine) == list(range(1, len(mine) + 1)) and {r._size for r in mine} == {len(mine)}


def test_hops_go_as_far_as_a_path(spark):
    n = 70
    e = spark.createDataFrame([(k, k + 1, 1.0) for k in range(n)], "i long, j long, weight double")
    assert gr.hop_distances(e).agg(F.max("hops")).first()[0] == n


def test_triangles_of_a_hub_are_found_once(spark):
    edges = [(0, k, 1.0) for k in range(1, 9)] + [(1, 2, 2.0), (2, 3, 3.0), (1, 3, 4.0), (7, 8, 5.0)]
    got = gr.triangles(spark.createDataFrame(edges, "i long, j long, weight double")).collect()
    assert sorted(tuple(sorted((r.a, r.b, r.c))) for r in got) == [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 7, 8), (1, 2, 3)]
    w = {frozenset(e[:2]): e[2] for e in edges}
    assert all(r.wab == w[frozenset((r.a, r.b))] and r.wac == w[frozenset((r.a, r.c))] and r.wbc == w[frozenset((r.b, r.c))] for r in got)


def test_orientation_letters(spark):
    turn = np.array([[np.cos(0.2), -np.sin(0.2), 0], [np.sin(0.2), np.cos(0.2), 0], [0, 0, 1]])
    assert vol.axis_codes(np.eye(4)) == "RAS" and vol.axis_codes(np.diag([-2, 1, 3, 1])) == "LAS"
    assert vol.axis_codes(turn) == "RAS" and vol.axis_codes([[0, 0, 2], [-1, 0, 0], [0, -1, 0]]) == "PIR"
    h = spark.createDataFrame([([4, 5, 6, 7], [2.0, 1.0, 0.5, 3.0], np.diag([-2.0, 1, 0.5, 1]).tolist())], "shape array<int>, zooms array<double>, affine array<array<double>>")
    row = vol.with_geometry(h).first()
    assert row.fov_mm == [8.0, 5.0, 3.0] and row.orientation == "LAS"


def test_regions_have_names(spark):
    rows = {r.node: r for r in rp.region_labels(spark).collect()}
    assert sorted(rows) == list(range(89)) and len({r.name for r in rows.values()}) == 89 and len({r.abbreviation for r in rows.values()}) == 89
    assert rows[0].name == "Unknown" and rows[34].name == "Left Insula" and rows[35].abbreviation == "R-BSTS" and rows[77].name == "Right Thalamus" and rows[88].lobe == "white_matter"
    assert sum(r.lobe == "subcortical" for r in rows.values()) == 16
