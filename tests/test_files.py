"""Volumes, streamlines and matrices read and written as tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractloom.sources import files, volumes


@pytest.fixture(scope="module")
def s(spark):
    return files.register(spark)


def test_volume_is_read_by_several_tasks(s, tmp_path):
    a = np.random.default_rng(1).random((5, 4, 9, 3))
    (tmp_path / "v.nii").write_bytes(volumes.nifti_bytes(a, kind="f8"))
    df = s.read.format("nifti").option("signal", "true").option("pieceBytes", 5 * 4 * 3 * 8 * 2).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 5
    got = {(r.x, r.y, r.z): r.signal for r in df.collect()}
    assert got == {tuple(map(int, k)): a[tuple(k)].tolist() for k in np.ndindex(5, 4, 9)}
    first = s.read.format("nifti").load(str(tmp_path / "v.nii")).where("x = 2 AND y = 3 AND z = 7").first()
    assert first.value == a[2, 3, 7, 0]


@pytest.mark.parametrize("ending", ["", ".nii.gz"])
def test_volumes_round_trip(s, tmp_path, ending):
    rows = s.range(4 * 3 * 2 * 3).selectExpr(f"concat('sub-', id % 3, '{ending}') AS name", "cast(id / 3 % 4 as int) AS x", "cast(id / 12 % 3 as int) AS y", "cast(id / 36 as int) AS z", "id * 1.5D AS value")
    files.write_nifti(rows, str(tmp_path / "out"), (4, 3, 2), np.diag([2.0, 2, 2, 1]))
    back = s.read.format("nifti").load(str(tmp_path / "out"))
    name = F.regexp_extract("path", r"(sub-\d)", 1)
    assert sorted((r.n, r.x, r.y, r.z, r.value) for r in back.select(name.alias("n"), "x", "y", "z", "value").collect()) == sorted((r.name[:5], r.x, r.y, r.z, r.value) for r in rows.collect())
    assert sorted(p.name[0] for p in (tmp_path / "out").iterdir()) == ["s"] * 3
    files.write_nifti(rows.where("name LIKE 'sub-1%'"), str(tmp_path / "out"), mode="overwrite")
    assert len(list((tmp_path / "out").iterdir())) == 1


def test_a_volume_in_two_tasks_is_refused(s, tmp_path):
    rows = s.createDataFrame([("a", 0, 0, 0, 1.0), ("a", 1, 0, 0, 2.0)], "name string, x int, y int, z int, value double").repartition(2, "x")
    if rows.where("x = 0").select(F.spark_partition_id()).first() != rows.where("x = 1").select(F.spark_partition_id()).first():
        with pytest.raises(Exception, match="several tasks"):
            rows.write.format("nifti").mode("append").save(str(tmp_path / "o"))
        assert not [p for p in (tmp_path / "o").iterdir()]


LINES = [[(float(i), float(k), 0.5 * i) for k in range(1 + i % 7)] for i in range(200)]


@pytest.mark.parametrize("kind", ["trk", "tck"])
def test_streamlines_round_trip(s, tmp_path, kind):
    df = s.createDataFrame([(i, [dict(zip("xyz", p, strict=True)) for p in q]) for i, q in enumerate(LINES)], "sl_id long, points array<struct<x: double, y: double, z: double>>").repartition(3)
    files.write_lines(df, str(tmp_path / "l"), kind, np.diag([2.0, 2, 2, 1]))
    assert len(list((tmp_path / "l").glob(f"*.{kind}"))) == 3
    back = s.read.format(kind).option("pieceBytes", 1000).load(str(tmp_path / "l"))
    assert back.rdd.getNumPartitions() > 3 or kind == "trk"
    assert sorted([tuple(round(v, 4) for v in p) for p in r.points] for r in back.collect()) == sorted(LINES)
    assert back.select("path", "sl_id").distinct().count() == 200


@pytest.mark.parametrize("piece", [12, 60, 333, 100_000])
def test_tck_pieces_of_any_size(s, tmp_path, piece):
    (tmp_path / "a.tck").write_bytes(volumes.tck_bytes([np.array(q) for q in LINES[:40]]))
    back = s.read.format("tck").option("pieceBytes", piece).load(str(tmp_path / "a.tck"))
    assert [[tuple(p) for p in r.points] for r in back.orderBy("sl_id").collect()] == LINES[:40]


def test_matrix_round_trip(s, tmp_path):
    a = np.random.default_rng(2).random((37, 5))
    df = s.createDataFrame([(k, r.tolist()) for k, r in enumerate(a)], "u int, row array<double>").repartition(4)
    files.write_npy(df, str(tmp_path))
    assert (np.load(tmp_path / "matrix.npy") == a).all()
    back = s.read.format("npy").option("pieceBytes", 5 * 8 * 10).load(str(tmp_path))
    assert back.rdd.getNumPartitions() == 4 and [r.row for r in back.orderBy("u").collect()] == a.tolist()


def test_lines_are_written_batch_by_batch(tmp_path):
    """The writer holds one batch: each is let go before the next is asked for."""
    import gc
    import weakref

    import pyarrow as pa

    from tractloom.sources import files

    seen = []

    def batches():
        for k in range(5):
            gc.collect()
            assert sum(w() is not None for w in seen) <= 1
            b = pa.RecordBatch.from_arrays([files.points_array([np.full((k + 1, 3), float(k))])], names=["points"])
            seen.append(weakref.ref(b))
            yield b
            del b

    w = files.LinesWriter({"path": str(tmp_path / "out")}, False)
    w.commit([w.write(batches())])
    raw = next((tmp_path / "out").glob("*.tck")).read_bytes()
    assert b"count: 5\n" in raw and [len(x) for x in volumes.tck_lines(raw)] == [1, 2, 3, 4, 5]


def test_lines_written_are_not_held(tmp_path):
    """What a task holds stays that of a batch: 60 of them have 14 MB of points as files hold them."""
    import tracemalloc

    import pyarrow as pa

    from tractloom.sources import files

    b = pa.RecordBatch.from_arrays([files.points_array([np.ones((200, 3))] * 100)], names=["points"])
    w = files.LinesWriter({"path": str(tmp_path / "out")}, False)
    tracemalloc.start()
    w.write(b for _ in range(60))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10 << 20
