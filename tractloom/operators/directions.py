"""How many directions of a gradient table are as good as equal, and the least angle between two, without forming all pairs.

Equal vectors are one row with its number. Vectors go to the tile of space that they lie in and to tiles before it that are
within reach; a tile halves boxes of points until they are wholly near, wholly apart or small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractloom.functions import geometry as g

AXES, TILE = ("gx", "gy", "gz"), ("tx", "ty", "tz")
#: Pairs that are formed at once. What rounding may add to a distance of unit vectors whose cosine is known.
AT_ONCE, SLACK = 1 << 16, 1e-6


def closeness(directions: DataFrame, most: float = 0.01) -> DataFrame:
    """One row: duplicates, the number of pairs nearer than most, and least_angle, as geometry.step_angle has it (null without a pair)."""
    kinds = directions.groupBy(*AXES).agg(F.count(F.lit(1)).alias("n"))
    norm = g.norm(*map(F.col, AXES))
    usual = (norm >= 1e-8) & (norm < math.inf)
    rows = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    counts = kinds.agg(rows(norm < 1e-8).alias("short"), rows(norm.isNull()).alias("unknown"), rows(~(norm < math.inf)).alias("endless"), rows(usual).alias("usual"))
    # Of m lines through a point, two are at most so far apart: the caps around their 2m ends would overlap.
    size = F.broadcast(kinds.agg((F.sqrt(8.0 / F.greatest(F.count_if(usual), F.lit(1))) + SLACK).alias("reach")))
    spread = kinds.crossJoin(size)
    finite = spread.where(" AND ".join(f"abs({c}) < double('Infinity')" for c in AXES))
    near = _tiled(finite.select(*AXES, "n", *[F.col(a).alias(c) for a, c in zip(AXES, "xyz", strict=True)], F.lit(1).alias("way"), "reach"), F.lit(most * (1 + 1e-9)), F.greatest(F.lit(8 * most), 16 * F.col("reach")))
    near = near.groupBy(*TILE).applyInArrow(_counter(most), "pairs long").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("duplicates"))
    # A line is its end with z >= 0; its other end visits tiles that such ends can lie in.
    up = F.when(F.col("gz") < 0, -1).otherwise(1)
    ends = spread.where(usual).select(*AXES, "n", "reach", *[(up * F.col(a) / norm).alias(c) for a, c in zip(AXES, "xyz", strict=True)], F.explode(F.array(F.lit(1), F.lit(-1))).alias("way"))
    ends = ends.where((F.col("way") == 1) | (F.col("z") <= F.col("reach"))).select(*AXES, "n", "reach", *[(F.col("way") * F.col(c)).alias(c) for c in "xyz"], "way")
    cos = _tiled(ends, F.col("reach"), 16 * F.col("reach")).groupBy(*TILE).applyInArrow(_steepest, "cos double").agg(F.max("cos").alias("cos"))
    some = lambda a, b, angle: F.when((F.col(a) > 0) & (b > 1), F.lit(angle))
    real = F.col("usual") + F.col("endless")
    # step_angle has 0 degrees to what isn't a number, 90 to what isn't known and 180 to what has no length.
    angles = [F.degrees(F.acos(g.clip(F.col("cos"), 0.0, 1.0))), some("endless", real, 0.0), some("unknown", real + F.col("unknown"), 90.0), some("short", real + F.col("unknown") + F.col("short"), 180.0)]
    angles[0] = F.when(F.col("cos") >= 0, angles[0])
    return near.crossJoin(cos).crossJoin(counts).select("duplicates", F.least(*angles).alias("least_angle"))


def _tiled(points: DataFrame, reach: Column, side: Column) -> DataFrame:
    """Points (x, y, z, way) by tiles. own marks those that lie in the tile; others are within reach, and lie in a later tile unless way is -1."""
    at = lambda c, by=0.0: F.floor((F.col(c) + by) / side)
    for c, t in zip("xyz", TILE, strict=True):
        points = points.withColumn(t, F.explode(F.sequence(at(c, -reach), at(c, reach))))
    here, tile = F.struct(*[at(c).alias(t) for c, t in zip("xyz", TILE, strict=True)]), F.struct(*TILE)
    return points.where((F.col("way") == -1) | (tile <= here)).select(*TILE, *AXES, "n", *"xyz", ((F.col("way") == 1) & (tile == here)).alias("own"))


def _parts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y, z, gx, gy, gz, n) that lie in a tile, and its visitors."""
    m, own = np.stack([t[c].to_numpy().astype(float) for c in (*"xyz", *AXES, "n")], 1), t["own"].to_numpy()
    return m[own], m[~own]


def _boxes(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """What two points of a and b are apart at least and at most."""
    (a0, a1), (b0, b1) = ((m[:, :3].min(0), m[:, :3].max(0)) for m in (a, b))
    return float(np.linalg.norm(np.maximum(0, np.maximum(b0 - a1, a0 - b1)))), float(np.linalg.norm(np.maximum(a1, b1) - np.minimum(a0, b0)))


def _halved(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The larger side in two, by its widest axis."""
    m, h = max(a, b, key=len), max(len(a), len(b)) // 2
    order = np.argpartition(m[:, np.ptp(m[:, :3], axis=0).argmax()], h)
    return ((m[k], b) if m is a else (a, m[k]) for k in (order[:h], order[h:]))


def _norms(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.sqrt(x * x + y * y + z * z)


def near_rows(a: np.ndarray, b: np.ndarray, most: float) -> int:
    """Pairs of rows of a and b nearer than most."""
    total, todo = 0, [(a, b)] if len(a) and len(b) else []
    while todo:
        a, b = todo.pop()
        least, greatest = _boxes(a, b)
        if greatest < most * (1 - 1e-9):
            total += int(a[:, 6].sum()) * int(b[:, 6].sum())
        elif least <= most * (1 + 1e-9):
            if len(a) * len(b) > AT_ONCE:
                todo += _halved(a, b)
            else:
                i, j = np.nonzero(_norms(*(a[:, None, c] - b[None, :, c] for c in range(3))) < most)
                total += int((a[i, 6] * b[j, 6]).sum())
    return total


def greatest_cosine(a: np.ndarray, b: np.ndarray, best: float = -1.0) -> float:
    """Greatest cosine of lines of a and b, best if none is greater. A row of number 1 isn't met by itself."""
    todo = [(0.0, a, b)] if len(a) and len(b) else []
    while todo and best < 1:
        least, a, b = todo.pop()
        if least > math.sqrt(2 * (1 - best)) + SLACK:
            continue
        if len(a) * len(b) > AT_ONCE:
            todo += sorted(((_boxes(p, q)[0], p, q) for p, q in _halved(a, b)), key=lambda x: -x[0])
            continue
        u, v = a[:, 3:6], b[:, 3:6]
        cos = np.abs(u[:, None, 0] * v[None, :, 0] + u[:, None, 1] * v[None, :, 1] + u[:, None, 2] * v[None, :, 2]) / (_norms(*u.T)[:, None] * _norms(*v.T)[None])
        cos[(u[:, None] == v[None]).all(2) & (a[:, 6] < 2)[:, None]] = -1
        best = max(best, float(cos.max()))
    return best


def _counter(most: float):
    def run(t: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            own, more = _parts(t)
            within = (near_rows(own, own, most) - int(own[:, 6].sum())) // 2
            return pa.table({"pairs": pa.array([within + near_rows(own, more, most)], pa.int64())})

    return run


def _steepest(t: pa.Table) -> pa.Table:
    with np.errstate(all="ignore"):
        own, more = _parts(t)
        return pa.table({"cos": pa.array([greatest_cosine(own, more, greatest_cosine(own, own))], pa.float64())})
