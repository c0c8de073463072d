"""Geometry as Column expressions: paths are ARRAY<STRUCT<x, y, z>>, all of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def steps(points: Column) -> Column:
    """Differences of consecutive points."""
    n = F.size(points)
    return F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y"), (b["z"] - a["z"]).alias("z")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def path_length(points: Column) -> Column:
    """Sum of step lengths; 0 for fewer than two points."""
    return _total(F.transform(steps(points), lambda d: norm(d["x"], d["y"], d["z"])))


def curvature(points: Column, eps: float = 1e-10) -> Column:
    """Angles in degrees between consecutive steps, len - 2 of them."""
    d = F.transform(steps(points), lambda v: F.struct((v["x"] / (norm(v["x"], v["y"], v["z"]) + eps)).alias("x"), (v["y"] / (norm(v["x"], v["y"], v["z"]) + eps)).alias("y"), (v["z"] / (norm(v["x"], v["y"], v["z"]) + eps)).alias("z")))
    k = F.greatest(F.size(points) - 2, F.lit(0))
    return F.zip_with(F.slice(d, 1, k), F.slice(d, 2, k), lambda a, b: F.degrees(F.acos(clip(a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"], -1.0, 1.0))))


def step_angle(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    """Undirected angle in degrees between two directions; 180 where one has no length."""
    na, nb = norm(ax, ay, az), norm(bx, by, bz)
    dot = F.abs(ax * bx + ay * by + az * bz)
    return F.when((na < 1e-8) | (nb < 1e-8), F.lit(180.0)).otherwise(F.degrees(F.acos(clip(dot / (F.greatest(na, F.lit(1e-8)) * F.greatest(nb, F.lit(1e-8))), 0.0, 1.0))))


def _mean_distance(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda p, q: norm(p["x"] - q["x"], p["y"] - q["y"], p["z"] - q["z"]))) / F.size(a)


def mdf(a: Column, b: Column) -> Column:
    """Mean distance of corresponding points, of the better of both directions; both paths have equally many points."""
    return F.least(_mean_distance(a, b), _mean_distance(a, F.reverse(b)))


def vox_round(c: Column) -> Column:
    """Nearest voxel, halves to even."""
    return F.rint(c).cast("int")


def vox_trunc(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("int")


def affine(m: Sequence[Sequence[float]], x: Column, y: Column, z: Column) -> list[Column]:
    """World coordinates of voxel coordinates by the upper three rows of a 4 x 4 matrix."""
    return [r[0] * x + r[1] * y + r[2] * z + float(r[3]) for r in m[:3]]


def affine_inverse(m: Sequence[Sequence[float]]) -> list[list[float]]:
    import numpy as np

    return np.linalg.inv(np.asarray(m, float)).tolist()


def spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Polar angle in [0, pi] and azimuth in [0, 2 pi)."""
    r = norm(x, y, z)
    theta = F.when(r > 0, F.acos(clip(z / F.when(r > 0, r).otherwise(1.0), -1.0, 1.0))).otherwise(F.lit(0.0))
    phi = F.atan2(y, x)
    return theta, F.when(phi < 0, phi + 6.283185307179586).otherwise(phi)


def orientation(points: Column) -> Column:
    """Unit vector from first to last point as an array; (0, 0, 1) where they coincide. Absolute values give colours."""
    a, b = F.element_at(points, 1), F.element_at(points, -1)
    dx, dy, dz = b["x"] - a["x"], b["y"] - a["y"], b["z"] - a["z"]
    n = norm(dx, dy, dz)
    return F.when(n > 0, F.array(*[v / F.when(n > 0, n).otherwise(1.0) for v in (dx, dy, dz)])).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def euler_xyz(r: Sequence[Sequence[Column]]) -> list[Column]:
    """Rotation angles of a 3 x 3 matrix; near the pole the third is 0."""
    s = F.sqrt(r[0][0] * r[0][0] + r[1][0] * r[1][0])
    ok = s >= 1e-6
    return [F.when(ok, F.atan2(r[2][1], r[2][2])).otherwise(F.atan2(-r[1][2], r[1][1])), F.atan2(-r[2][0], s), F.when(ok, F.atan2(r[1][0], r[0][0])).otherwise(F.lit(0.0))]


def tensor_scalars(l1: Column, l2: Column, l3: Column, convention: str = "standard") -> dict[str, Column]:
    """md, ad, rd, fa of eigenvalues in falling order (negative ones count as 0). as_written: fa divided by the root of 3."""
    a, b, c = (F.greatest(v, F.lit(0.0)) for v in (l1, l2, l3))
    m = (a + b + c) / 3.0
    num = (a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)
    den = a * a + b * b + c * c
    factor = 1.5 if convention == "standard" else 0.5
    fa = F.when(F.sqrt(den) > 1e-10, F.sqrt(factor * num / F.when(den > 0, den).otherwise(1.0))).otherwise(F.lit(0.0))
    return {"md": m, "ad": a, "rd": (b + c) / 2.0, "fa": clip(fa, 0.0, 1.0)}
