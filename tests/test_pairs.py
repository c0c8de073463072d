"""Pairs of all rows by blocks, against the same formulas row by row."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tractloom.functions import geometry as g
from tractloom.operators import directions as dr
from tractloom.operators import pairs as pr
from tractloom.operators import streamlines as sl
from tractloom.operators import voxels as vx
from tractloom.plans import catalogue

SF = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")
GRAD = "vol int, bval double, gx double, gy double, gz double"
ODD = [(0.0, 0.0, 0.0), (1e-9, 0.0, 0.0), (None, 0.0, 1.0), (NAN, 0.0, 1.0), (INF, 0.0, 1.0), (1.0, 0.0, 0.0), (1.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (1.0, 0.005, 0.0), (2.0, 0.0, 0.0), (-0.0, 0.0, 1.0)]


def table(spark, vectors, start=0):
    return spark.createDataFrame([(start + k, 1000.0, *map(lambda x: None if x is None else float(x), v)) for k, v in enumerate(vectors)], GRAD)


def row_by_row(grad, b0=50.0):
    """(a, b, distance, angle) by a join of all with all."""
    axes = ("gx", "gy", "gz")
    d = grad.where(F.col("bval") > b0)
    a, b = (d.select(F.col("vol").alias(k), *[F.col(c).alias(k + c) for c in axes]) for k in "ab")
    dist = g.norm(*[F.col("a" + c) - F.col("b" + c) for c in axes])
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", dist.alias("distance"), g.step_angle(*[F.col(k + c) for k in "ab" for c in axes]).alias("angle"))


def rows(df):
    """All rows, also those of ids that come twice."""
    plain = lambda x: repr(x) if x is None or x != x or x in (INF, -INF) else repr(round(x, 9) + 0.0)
    return sorted((r["a"], r["b"], *map(plain, r[2:])) for r in df.collect())


def no_join(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not [x for x in plan.splitlines() if "Join" in x and "<" in x]


def test_directions_of_blocks_equal_rows(spark):
    x = table(spark, ODD + np.random.default_rng(0).normal(size=(40, 3)).tolist())
    x = x.union(spark.createDataFrame([(3, 1000.0, 0.0, 1.0, 0.0), (90, 0.0, 0.0, 1.0, 0.0), (None, 1000.0, 1.0, 1.0, 1.0)], GRAD))
    assert rows(vx.direction_pairs(x)) == rows(row_by_row(x))
    assert no_join(vx.direction_pairs(x)) and not no_join(row_by_row(x))


def test_all_pairs_meet_by_blocks(spark):
    """A join of all with all reads a side again for each part of the other."""
    df = catalogue.queries()["gradient_angles"](spark, SF)
    assert no_join(df) and df.schema.simpleString() == "struct<a:int,b:int,distance:double,angle:double>"


def test_batches_of_pairs_are_bounded(spark, monkeypatch):
    x = spark.range(70).select(F.col("id"), F.col("id").cast("double").alias("v"))
    monkeypatch.setattr(pr, "AT_ONCE", 7)
    read, measure = (lambda t: [t["v"].to_numpy()]), (lambda a, b: [np.ma.array(a[0][:, None] * b[0][None])])
    got = [(r["a"], r["b"], r["v"]) for r in pr.all_pairs(x, "id", read, measure, ["v"], blocks=3).collect()]
    assert sorted(got) == [(a, b, float(a * b)) for a in range(70) for b in range(a + 1, 70)]


@pytest.mark.parametrize("digits", [0, 4, 5])
def test_rounding_is_that_of_spark(spark, digits):
    e = np.random.default_rng(1)
    x = np.concatenate([e.integers(0, 2_000_000, 2000) / 2 / 10**digits, e.normal(size=500) * 100, [NAN, INF, 1e300, 123456789012.345675, 0.285, 1.005, 2.5]])
    want = [r[0] for r in spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k int, v double").orderBy("k").select(F.round("v", digits)).collect()]
    assert np.array_equal(pr.rounded(x, digits), want, equal_nan=True)


POINTS = "sl_id long, points array<struct<x: double, y: double, z: double>>"


def test_paths_of_blocks_equal_rows(spark):
    e = np.random.default_rng(3)
    paths = [e.normal(size=(5, 3)).tolist() for _ in range(25)] * 2 + [[[0.0, 1.0, None]] * 5, [[NAN, 0.0, 0.0]] * 5, [], e.normal(size=(4, 3)).tolist(), e.normal(size=(4, 3)).tolist()]
    x = spark.createDataFrame([(k, [tuple(q) for q in p]) for k, p in enumerate(paths)] + [(3, [(1.0, 1.0, 1.0)] * 5)], POINTS)
    a, b = (x.select(F.col("sl_id").alias(k), F.col("points").alias("p" + k)) for k in "ab")
    # Of different numbers of points, rows give null.
    want = a.join(b, F.col("a") < F.col("b")).select("a", "b", F.when(F.size("pa") == F.size("pb"), g.mdf(F.col("pa"), F.col("pb"))).alias("mdf"))
    got = sl.mdf_pairs(x)
    assert rows(got) == rows(want)
    assert no_join(got) and not no_join(want)


def test_equal_rows_are_measured_once(spark, tmp_path):
    """3000 copies of 3 paths: a row of a batch for each would be 4,498,500 distances."""
    x = spark.range(3000).select(F.col("id").alias("sl_id"), F.array(*[F.struct(*[(F.col("id") % 3 * k + j).cast("double").alias(c) for j, c in enumerate("xyz")]) for k in (1, 2)]).alias("points"))

    def measure(a, b, seen=str(tmp_path / "seen"), whole=sl._mdf_of_parts):
        with open(seen, "a") as f:
            f.write(f"{len(a[0]) * len(b[0])}\n")
        return [whole(a, b, None)]

    got = pr.all_pairs(x.withColumn("whole", F.lit(True)), "sl_id", sl._paths, measure, ["mdf"], blocks=2)
    assert got.count() == 3000 * 2999 // 2
    assert sum(map(int, (tmp_path / "seen").read_text().split())) < 10_000


def judged(grad, b0=50.0):
    """duplicates and least_angle of all pairs, row by row."""
    r = row_by_row(grad, b0).agg(F.count_if(F.col("distance") < 0.01).alias("duplicates"), F.min("angle").alias("least_angle")).first()
    return r["duplicates"], r["least_angle"]


def found(grad):
    r = vx.gradient_quality(grad).first()
    return r["duplicates"], r["least_angle"]


def unit(p):
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def sets():
    e = np.random.default_rng(5)
    ball = unit(e.normal(size=(300, 3)))
    cap = unit(np.array([0.3, -0.4, 0.5]) + e.normal(size=(300, 3)) * 0.01)
    flat = unit(np.concatenate([e.normal(size=(40, 2)), np.zeros((40, 1))], axis=1))
    spread = e.normal(size=(3, 3))
    yield from ([], ODD[:1], ODD[:2], ODD[2:3], ODD[2:4], ODD[3:4], ODD[3:5], ODD[5:6], ODD[5:7], [ODD[5], ODD[7]], [ODD[2], ODD[5]], [ODD[3], ODD[5]], [ODD[0], ODD[2]], [ODD[0], ODD[3]], ODD)
    yield from (ball.tolist(), cap.tolist(), flat.tolist(), (flat * [1, 1, 0] - [0, 0, 1e-9]).tolist(), spread.tolist(), np.concatenate([ball, ball[:7], -ball[:9], ball[:5] * 3 + 1e-3]).tolist())
    yield [(1e200, 0.0, 0.0)] * 2 + [(5e9, 1.0, 0.0), (5e9, 1.001, 0.0), (-7.0, 0.0, 0.0)]


@pytest.mark.parametrize("k", range(22))
def test_closeness_equals_all_pairs(spark, k):
    x = list(sets())[k]
    grad = table(spark, x) if x else spark.createDataFrame([], GRAD)
    assert found(grad) == judged(grad)


def test_boxes_equal_brute_force(monkeypatch):
    monkeypatch.setattr(dr, "AT_ONCE", 30)
    e = np.random.default_rng(6)
    p = unit(np.concatenate([e.normal(size=(150, 3)), [0, 0, 1] + e.normal(size=(150, 3)) * 0.004]))
    m = np.column_stack([p, p * 2, e.integers(1, 4, 300)])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    assert dr.near_rows(m, m, 0.01) == (m[:, 6][:, None] * m[:, 6][None])[d < 0.01].sum()
    m[:, 6] = 1
    cos = np.abs(p @ p.T) - 2 * np.eye(300)
    # A line is met at both of its ends.
    both = lambda x: np.concatenate([x, x * ([-1] * 3 + [1] * 4)])
    assert dr.greatest_cosine(m[:150], both(m[150:])) == pytest.approx(cos[:150, 150:].max(), abs=1e-14)
    assert dr.greatest_cosine(m, both(m)) == pytest.approx(cos.max(), abs=1e-14)


def test_quality_forms_no_pairs(spark):
    """Rows that any step makes grow no faster than the directions; all pairs of 12,000 are 72 million."""
    plan = catalogue.queries()["gradient_quality"](spark, SF)
    assert no_join(plan)
    e = np.random.default_rng(7).normal(size=(12_000, 3))
    tiles = dr._tiled(table(spark, unit(e).tolist()).select(F.lit(1).alias("n"), "gx", "gy", "gz", *[F.col("g" + c).alias(c) for c in "xyz"], F.lit(1).alias("way")), F.lit(0.01), F.lit(0.4))
    assert tiles.where("own").count() == 12_000 and tiles.count() < 24_000


def test_ids_of_pairs_take_little_in_files(spark, tmp_path):
    """a stays the same for a while and b comes again: 1.5 bytes a pair and more where blocks are dealt by a hash of their keys."""
    e = np.random.default_rng(9).normal(size=(3000, 3))
    ids = np.random.default_rng(10).permutation(3000)
    x = spark.createDataFrame([(int(k), 1000.0, *map(float, v)) for k, v in zip(ids, e, strict=True)], GRAD)
    vx.direction_pairs(x, digits=(5, 4)).write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == back.select("a", "b").distinct().count() == 3000 * 2999 // 2
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "out").glob("*.parquet")]
    took = sum(m.row_group(g).column(c).total_compressed_size for m in files for g in range(m.num_row_groups) for c in (0, 1))
    assert took < 0.75 * 3000 * 2999 // 2


def test_blocks_are_ranges_of_keys_of_any_kind(spark):
    """Keys that are far apart, negative, unknown or come twice; fewer keys than blocks."""
    read, measure = (lambda t: [t["v"].to_numpy()]), (lambda a, b: [np.ma.array(a[0][:, None] * b[0][None])])
    for keys in ([], [5], [7, 7, 7], [-(2**62), -3, 0, 1, 1, 2**62, None, 9], list(range(100, 40, -1))):
        x = spark.createDataFrame([(k, float(n)) for n, k in enumerate(keys)], "id long, v double")
        got = sorted((r["a"], r["b"], r["v"]) for r in pr.all_pairs(x, "id", read, measure, ["v"], blocks=5).collect())
        known = [(k, float(n)) for n, k in enumerate(keys) if k is not None]
        assert got == sorted((a, b, u * v) for a, u in known for b, v in known if a < b)


def test_rows_of_near_numbers_stand_together():
    x = np.random.default_rng(11).normal(size=(4096, 3))
    order = np.argsort(pr.together(x), kind="stable")
    parts = x[order].reshape(64, 64, 3)
    assert parts.std(1).mean() < 0.45 < 0.95 < x.std()
    assert len(set(pr.together(np.repeat(x[:50], 3, axis=0)).tolist())) <= 50
