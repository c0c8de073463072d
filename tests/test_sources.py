from __future__ import annotations

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractloom.operators import reports as rp
from tractloom.sources import sinks, text, volumes
from tractloom.streaming import incremental


def test_gradient_files(spark, tmp_path):
    (tmp_path / "a.bval").write_text("0 1000 1000\n")
    (tmp_path / "a.bvec").write_text("0 1 0\n0 0 1\n0 0 0\n")
    (tmp_path / "b.bvec").write_text("0 0 0\n1 0 0\n0 1 0\n0 0 1\n")
    assert [r["bval"] for r in text.read_bvals(spark, str(tmp_path / "a.bval")).orderBy("vol").collect()] == [0, 1000, 1000]
    assert [tuple(r)[2:] for r in text.read_bvecs(spark, str(tmp_path / "a.bvec")).orderBy("vol").collect()] == [(0, 0, 0), (1, 0, 0), (0, 1, 0)]
    assert text.read_bvecs(spark, str(tmp_path / "b.bvec")).count() == 4


def test_bad_gradient_shape(spark, tmp_path):
    (tmp_path / "a.bvec").write_text("0 1\n0 0\n")
    with pytest.raises(Exception, match="three rows or three columns"):
        text.read_bvecs(spark, str(tmp_path / "a.bvec")).collect()


def test_sidecars(spark):
    f = spark.createDataFrame([("/d/a.nii.gz",), ("/d/a.bval",), ("/d/a.bvecs",), ("/d/b.nii",), ("/d/b_dwi.bval",)], "path string")
    got = {r["path"]: (r["bval"], r["bvec"]) for r in text.sidecars(f).collect()}
    assert got == {"/d/a.nii.gz": ("/d/a.bval", "/d/a.bvecs"), "/d/b.nii": ("/d/b_dwi.bval", None)}


def test_features_and_matrix(spark, tmp_path):
    (tmp_path / "f.csv").write_text("subject_id,label,f1,f2\ns1,1,0.5,2\n")
    r = text.read_features(spark, str(tmp_path / "f.csv")).first()
    assert r["subject_id"] == "s1" and r["features"] == [0.5, 2.0]
    (tmp_path / "m.csv").write_text("0,1.5\n1.5,0\n")
    assert [(r["i"], r["j"], r["weight"]) for r in text.read_matrix(spark, str(tmp_path / "m.csv")).orderBy("i").collect()] == [(0, 1, 1.5), (1, 0, 1.5)]


@pytest.mark.parametrize("zipped", [False, True])
def test_nifti_round_trip(spark, tmp_path, zipped):
    a = np.arange(2 * 3 * 4 * 5, dtype=float).reshape(2, 3, 4, 5)
    raw = volumes.nifti_bytes(a, np.diag([2, 2, 2, 1]), (2, 2, 2, 1))
    (tmp_path / ("v.nii.gz" if zipped else "v.nii")).write_bytes(gzip.compress(raw) if zipped else raw)
    got = {(r["x"], r["y"], r["z"]): r["signal"] for r in volumes.read_nifti(spark, str(tmp_path), True).collect()}
    assert got[1, 2, 3] == a[1, 2, 3].tolist() and len(got) == 24
    h = volumes.read_nifti_headers(spark, str(tmp_path)).first()
    assert h["shape"] == [2, 3, 4, 5] and h["affine"][0][0] == 2


def test_streamline_files(spark, tmp_path):
    lines = [np.array([[0, 0, 0], [1, 2, 3]], float), np.array([[5, 5, 5], [6, 6, 6], [7, 7, 7]], float)]
    (tmp_path / "a.tck").write_bytes(volumes.tck_bytes(lines))
    (tmp_path / "a.trk").write_bytes(volumes.trk_bytes(lines, np.diag([2.0, 2, 2, 1]), (10, 10, 10)))
    for r in volumes.read_streamlines(spark, str(tmp_path)).collect():
        want = lines[r["sl_id"]]
        assert np.array([[p["x"], p["y"], p["z"]] for p in r["points"]]) == pytest.approx(want, abs=1e-5)


def test_vtk_offsets(spark):
    pts = [{"x": 0.0, "y": 0.0, "z": 0.0}] * 2
    df = spark.createDataFrame([(1, pts), (2, pts)], "sl_id long, points array<struct<x: double, y: double, z: double>>")
    got = [r["value"] for r in sinks.vtk_lines(df).orderBy("part", "sl_id").collect()]
    assert got[-2:] == ["2 0 1", "2 2 3"] and "POINTS 4 float" in got[0]


def test_jobs(spark):
    j = spark.createDataFrame([("a", "running", 1), ("b", "completed", 2)], "job_id string, status string, created_at int")
    assert {r["job_id"]: r["status"] for r in rp.cancel_job(j, "a").collect()} == {"a": "failed", "b": "completed"}
    assert rp.cancel_job(j, "b").where("job_id = 'b'").first()["status"] == "completed"
    assert [r["job_id"] for r in rp.recent_jobs(j, 1).collect()] == ["b"]
    with pytest.raises(ValueError, match="no such file"):
        rp.safe_name("../x")


def test_incremental_edges(spark, tmp_path):
    rows = [(f"2024-01-0{d} 0{h}:00:00", 1, 2) for d in (1, 2, 3) for h in (1, 2)] + [("2024-01-02 05:00:00", 2, 1)]
    spark.createDataFrame(rows, "ts string, a int, b int").select(F.col("ts").cast("timestamp").alias("ts"), "a", "b").write.parquet(str(tmp_path / "in"))
    s = incremental.landing_stream(spark, str(tmp_path / "in"), "ts timestamp, a int, b int")
    incremental.to_table(incremental.edge_windows(s), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {str(r["start"])[:10]: r["weight"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 3}  # the last day is still open
