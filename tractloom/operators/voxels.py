"""Voxel algebra, tensor and orientation models, gradient tables. Volumes are sparse long tables (x, y, z, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractloom.functions import geometry as g
from tractloom.functions import scalars as s
from tractloom.operators import directions as dr
from tractloom.operators import pairs as pr
from tractloom.session import checkpoint_folder

FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def _shifts(mask: DataFrame, own: bool) -> DataFrame:
    steps = ([(0, 0, 0)] if own else []) + FACES
    return mask.select(F.explode(F.array(*[F.struct(*[(F.col(c) + k).cast("int").alias(c) for c, k in zip("xyz", o, strict=True)]) for o in steps])).alias("p")).select("p.*")


def dilate(mask: DataFrame) -> DataFrame:
    return _shifts(mask, True).distinct()


def erode(mask: DataFrame) -> DataFrame:
    """Voxels whose six neighbours all lie in the mask: they are met seven times by the shifts of the mask."""
    return _shifts(mask, True).groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n")).where("n = 7").select("x", "y", "z")


def boundary(mask: DataFrame) -> DataFrame:
    return mask.join(erode(mask), ["x", "y", "z"], "left_anti")


def opened(mask: DataFrame, n: int = 1) -> DataFrame:
    for f in (erode, dilate):
        for _ in range(n):
            mask = f(mask)
    return mask


def closed(mask: DataFrame, n: int = 1) -> DataFrame:
    for f in (dilate, erode):
        for _ in range(n):
            mask = f(mask)
    return mask


def label_components(mask: DataFrame) -> DataFrame:
    """(x, y, z, component) of 6-connected voxels; links go along rising axes, components are found by spreading the least voxel number."""
    v = mask.select("x", "y", "z", F.struct("x", "y", "z").alias("id"))
    ids = v.select("x", "y", "z", (F.col("x").cast("long") * 2**42 + F.col("y").cast("long") * 2**21 + F.col("z")).alias("id"))
    up = ids.select(F.explode(F.array(*[F.struct(*[(F.col(c) + k).cast("int").alias(c) for c, k in zip("xyz", o, strict=True)], F.col("id").alias("a")) for o in FACES[::2]])).alias("p")).select("p.*")
    links = up.join(ids, ["x", "y", "z"]).select("a", F.col("id").alias("b"))
    checkpoint_folder(mask.sparkSession)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    label = ids.select("id", F.col("id").alias("component")).checkpoint()
    while True:
        near = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("was"))
        root = step.select(F.col("id").alias("component"), F.col("component").alias("r"))
        step = step.join(root, "component").select("id", F.least("component", "r").alias("component"), "was").checkpoint()
        changed = step.where("component <> was").limit(1).count()
        label = step.select("id", "component")
        if not changed:
            return ids.join(label, "id").select("x", "y", "z", "component")


def largest_component(mask: DataFrame) -> DataFrame:
    c = label_components(mask)
    top = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return c.join(F.broadcast(top), "component").select("x", "y", "z")


def fill_holes(mask: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """The mask with every part of its complement that doesn't reach the grid's border."""
    spark = mask.sparkSession
    n = shape[0] * shape[1] * shape[2]
    grid = spark.range(n).select((F.col("id") % shape[0]).cast("int").alias("x"), (F.floor(F.col("id") / shape[0]) % shape[1]).cast("int").alias("y"), F.floor(F.col("id") / (shape[0] * shape[1])).cast("int").alias("z"))
    free = label_components(grid.join(mask.select("x", "y", "z"), ["x", "y", "z"], "left_anti"))
    edge = F.lit(False)
    for c, k in zip("xyz", shape, strict=True):
        edge = edge | (F.col(c) == 0) | (F.col(c) == k - 1)
    outside = free.where(edge).select("component").distinct()
    return mask.select("x", "y", "z").union(free.join(outside, "component", "left_anti").select("x", "y", "z"))


def histogram(values: DataFrame, bins: int, value: str = "value") -> DataFrame:
    """(bin, lo, n): equal bins from the least to the largest value, the last one closed."""
    r = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    w = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("lo"), w), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return values.crossJoin(F.broadcast(r)).select(b.alias("bin"), "lo", w.alias("w")).groupBy("bin").agg((F.first("lo") + F.col("bin") * F.first("w")).alias("lo"), F.first("w").alias("width"), F.count(F.lit(1)).alias("n"))


def otsu(values: DataFrame, bins: int = 256) -> DataFrame:
    """(threshold): the bin centre of positive values that best separates the two sides. The histogram is bounded, so windows run over it."""
    h = histogram(values.where("value > 0"), bins).select("bin", (F.col("lo") + F.col("width") / 2).alias("c"), "n")
    fwd, back = Window.orderBy("bin"), Window.orderBy(F.desc("bin"))
    x = h.select("bin", "c", F.sum("n").over(fwd).alias("w1"), F.sum("n").over(back).alias("w2"), F.sum(F.col("n") * F.col("c")).over(fwd).alias("s1"), F.sum(F.col("n") * F.col("c")).over(back).alias("s2"))
    nxt = lambda c: F.coalesce(F.lead(c).over(fwd), F.lit(0))
    x = x.select("bin", "c", "w1", "s1", nxt("w2").alias("w2"), nxt("s2").alias("s2"))
    between = F.col("w1") * F.col("w2") * F.pow(F.col("s1") / (F.col("w1") + 1e-10) - F.col("s2") / (F.col("w2") + 1e-10), 2)
    return x.select("bin", "c", between.alias("v")).orderBy(F.desc("v"), "bin").limit(1).select(F.col("c").alias("threshold"))


def mask_quality(volume: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels inside and outside, their means and spreads, and the contrast over the spread outside."""
    v = volume.join(mask.select("x", "y", "z", F.lit(1).alias("m")), ["x", "y", "z"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    of = lambda f, k: f(F.when(F.col("m") == k, F.col("value")))
    got = v.agg(F.count(F.lit(1)).alias("voxels"), F.sum("m").alias("inside"), of(F.avg, 1).alias("mean_in"), of(F.stddev_pop, 1).alias("std_in"), of(F.avg, 0).alias("mean_out"), of(F.stddev_pop, 0).alias("std_out"))
    return got.withColumn("fraction", F.col("inside") / F.col("voxels")).withColumn("cnr", F.try_divide(F.abs(F.col("mean_in") - F.col("mean_out")), F.col("std_out")))


def describe(volume: DataFrame) -> DataFrame:
    p = lambda q: F.percentile("value", q)
    return volume.agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), p(0.5).alias("median"), p(0.01).alias("p1"), p(0.99).alias("p99"))


def convolve_axis(volume: DataFrame, axis: str, weights: list[float]) -> DataFrame:
    """Weighted sum along an axis; a voxel adds to its neighbours, and missing ones are left out of the norm."""
    r = len(weights) // 2
    out = F.explode(F.array(*[F.struct((F.col(axis) + k).cast("int").alias("t"), F.lit(float(w)).alias("w")) for k, w in zip(range(-r, r + 1), weights, strict=True)]))
    spread = volume.select(*[c for c in "xyz" if c != axis], "value", out.alias("o")).select("*", F.col("o.t").alias(axis), F.col("o.w").alias("w"))
    got = spread.groupBy("x", "y", "z").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    return got.join(volume.select("x", "y", "z"), ["x", "y", "z"], "left_semi")


def gaussian(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return (w / w.sum()).tolist()


def bias_field(volume: DataFrame, sigma: float = 15.0) -> DataFrame:
    """Smoothed values over their median, held in [0.5, 2]."""
    v = volume.select("x", "y", "z", "value")
    for axis in "xyz":
        v = convolve_axis(v, axis, gaussian(sigma))
    med = v.agg(F.percentile("value", 0.5).alias("med"))
    return v.crossJoin(F.broadcast(med)).select("x", "y", "z", g.clip(F.coalesce(F.try_divide(F.col("value"), F.col("med")), F.lit(1.0)), 0.5, 2.0).alias("field"))


def bias_corrected(volume: DataFrame, field: DataFrame) -> DataFrame:
    return volume.join(field, ["x", "y", "z"]).select("x", "y", "z", (F.col("value") / F.col("field")).alias("value"))


def histogram_corrected(volume: DataFrame) -> DataFrame:
    """Positive median moved to 1000, values cut at twice the 99th percentile."""
    s_ = volume.agg(F.percentile(F.when(F.col("value") > 0, F.col("value")), 0.5).alias("med"), F.percentile("value", 0.99).alias("p99"))
    k = F.try_divide(F.lit(1000.0), F.col("med"))
    return volume.crossJoin(F.broadcast(s_)).select("x", "y", "z", F.least(F.col("value") * k, 2 * F.col("p99") * k).alias("value"))


def variation(volume: DataFrame, mask: DataFrame) -> DataFrame:
    v = volume.join(mask.select("x", "y", "z"), ["x", "y", "z"], "left_semi")
    return v.agg(F.coalesce(F.try_divide(F.stddev_pop("value"), F.avg("value")), F.lit(0.0)).alias("cv"))


def masked(volume: DataFrame, mask: DataFrame, fill: float | None = None) -> DataFrame:
    """Only the mask's voxels, or all of them with a value to fill in outside."""
    m = mask.select("x", "y", "z")
    if fill is None:
        return volume.join(m, ["x", "y", "z"], "left_semi")
    got = volume.join(m.withColumn("m", F.lit(True)), ["x", "y", "z"], "left")
    return got.select("x", "y", "z", F.when(F.col("m"), F.col("value")).otherwise(F.lit(float(fill))).alias("value"))


# Gradient tables (vol, bval, gx, gy, gz).


def rounded_bvals(grad: DataFrame, step: float = 5.0, b0: float = 50.0) -> DataFrame:
    b = F.bround(F.col("bval") / step) * step
    return grad.withColumn("bval", F.when(F.col("bval") < b0, 0.0).otherwise(b))


def normalized_bvecs(grad: DataFrame, b0: float = 50.0) -> DataFrame:
    n = g.norm(F.col("gx"), F.col("gy"), F.col("gz"))
    return grad.select("vol", "bval", *[F.when((F.col("bval") < b0) | (n < 1e-10), 0.0).otherwise(F.col(c) / F.when(n > 0, n).otherwise(1.0)).alias(c) for c in ("gx", "gy", "gz")])


def flipped(grad: DataFrame, axes: str) -> DataFrame:
    return grad.select("vol", "bval", *[(-F.col("g" + c) if c in axes else F.col("g" + c)).alias("g" + c) for c in "xyz"])


def shells(grad: DataFrame) -> DataFrame:
    return grad.groupBy(s.shell_name(F.col("bval")).alias("shell")).agg(F.count(F.lit(1)).alias("n"), F.min("bval").alias("min_b"), F.max("bval").alias("max_b"))


def direction_pairs(grad: DataFrame, b0: float = 50.0, digits: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """(a, b, distance, angle) of pairs of weighted directions, rounded if digits are given."""
    axes = ("gx", "gy", "gz")
    d = grad.where(F.col("bval") > b0).select("vol", *axes, F.coalesce(*[F.when(F.col(c).isNull(), False) for c in axes], F.lit(True)).alias("whole"))

    def read(t: pa.Table) -> list[np.ndarray]:
        return [np.stack([t[c].to_numpy() for c in axes], 1), t["whole"].to_numpy()]

    def measure(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ma.MaskedArray]:
        (u, whole_u), (v, whole_v) = a, b
        known = whole_u[:, None] & whole_v[None]
        with np.errstate(all="ignore"):
            dist = _norms(*[u[:, None, c] - v[None, :, c] for c in range(3)])
            nu, nv = (_norms(*w.T) for w in (u, v))
            dot = np.abs(sum(u[:, None, c] * v[None, :, c] for c in range(3)))
            # As geometry.step_angle: what isn't known stands at 90 degrees, what isn't a number at 0.
            cos = np.where(known, np.fmin(dot / (np.maximum(nu, 1e-8)[:, None] * np.maximum(nv, 1e-8)[None]), 1.0), 0.0)
            ang = np.where((nu < 1e-8)[:, None] | (nv < 1e-8)[None], 180.0, np.degrees(np.arccos(cos)))
        return [np.ma.array(pr.rounded(dist, digits[0]), mask=~known), np.ma.array(pr.rounded(ang, digits[1]))]

    return pr.all_pairs(d, "vol", read, measure, ["distance", "angle"], place=lambda held: pr.together(held[0]))


def _norms(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.sqrt(x * x + y * y + z * z)


def gradient_quality(grad: DataFrame, b0: float = 50.0) -> DataFrame:
    n = g.norm(F.col("gx"), F.col("gy"), F.col("gz"))
    w = F.col("bval") > b0
    one = grad.agg(F.count_if(~w).alias("n_b0"), F.count_if(w).alias("n_dwi"), F.max(F.when(w, F.abs(n - 1))).alias("worst_norm"), F.max("bval").alias("max_b"), F.count_if(w & (n < 0.1)).alias("near_zero"))
    two = dr.closeness(grad.where(w).select("gx", "gy", "gz"))
    ok = (F.col("n_dwi") >= 6) & (F.col("n_b0") >= 1) & (F.coalesce("worst_norm", F.lit(0.0)) <= 0.1) & (F.col("duplicates") == 0) & (F.coalesce("least_angle", F.lit(180.0)) >= 5)
    return one.crossJoin(two).withColumn("valid", ok)


def motion_summary(moves: DataFrame, outlier_mm: float = 2.0) -> DataFrame:
    """moves (vol, tx, ty, tz, rx, ry, rz): shifts in mm, turns in radians."""
    d, t = g.norm(F.col("tx"), F.col("ty"), F.col("tz")), F.degrees(g.norm(F.col("rx"), F.col("ry"), F.col("rz")))
    return moves.agg(F.avg(d).alias("mean_displacement"), F.max(d).alias("max_displacement"), F.avg(t).alias("mean_rotation"), F.max(t).alias("max_rotation"), F.count_if(d > outlier_mm).alias("outliers"))


# Models.


def tensor_design(bvals: np.ndarray, bvecs: np.ndarray, b0: float = 50.0) -> np.ndarray:
    """Rows of weighted volumes: products of the direction's parts times -b (mixed ones twice), and a constant."""
    w = bvals > b0
    b, v = bvals[w], bvecs[w]
    prod = np.stack([v[:, 0] ** 2, 2 * v[:, 0] * v[:, 1], 2 * v[:, 0] * v[:, 2], v[:, 1] ** 2, 2 * v[:, 1] * v[:, 2], v[:, 2] ** 2], axis=1)
    return np.hstack([-b[:, None] * prod, np.ones((len(b), 1))])


def fit_tensors(signal: np.ndarray, bvals: np.ndarray, bvecs: np.ndarray, b0: float = 50.0, convention: str = "standard") -> dict[str, np.ndarray]:
    """Weighted least squares for many voxels at once (rows of signal), by pseudo-inverses of stacked normal equations."""
    design = tensor_design(bvals, bvecs, b0)
    s0 = np.maximum(signal[:, bvals <= b0].mean(1) if (bvals <= b0).any() else 1.0, 1e-6)
    dwi = np.maximum(signal[:, bvals > b0], 1e-6)
    w = dwi / dwi.max(1, keepdims=True)
    y = np.log(dwi / s0[:, None])
    root = np.sqrt(w)
    p = np.einsum("vkn,vn->vk", np.linalg.pinv(design[None] * root[:, :, None]), y * root)
    d = np.empty((len(signal), 3, 3))
    for k, (i, j) in enumerate([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]):
        d[:, i, j] = d[:, j, i] = p[:, k]
    ok = np.isfinite(d).all((1, 2))
    val, vec = np.linalg.eigh(np.where(ok[:, None, None], d, 0))
    val, vec = np.maximum(val[:, ::-1], 0), vec[:, :, ::-1]
    val[~ok] = 0
    some = val.sum(1) > 1e-10
    val[~some] = 0
    md = val.mean(1)
    den = np.sqrt((val**2).sum(1))
    fa = np.sqrt((1.5 if convention == "standard" else 0.5) * ((val - md[:, None]) ** 2).sum(1)) / np.where(den > 1e-10, den, 1)
    return {"evals": val, "v1": vec[:, :, 0], "evecs": vec, "md": md, "ad": val[:, 0], "rd": val[:, 1:].mean(1), "fa": np.clip(np.where(den > 1e-10, fa, 0), 0, 1)}


def tensors(dwi: DataFrame, bvals: list[float], bvecs: list[list[float]], convention: str = "standard") -> DataFrame:
    """dwi (x, y, z, signal ARRAY<DOUBLE>) with evals, v1 and scalars. A narrow pass in Arrow batches."""
    b, v = np.asarray(bvals, float), np.asarray(bvecs, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                r = fit_tensors(np.stack([np.asarray(x, float) for x in pdf["signal"]]), b, v, convention=convention)
                yield pd.DataFrame({"x": pdf["x"], "y": pdf["y"], "z": pdf["z"], "evals": list(r["evals"]), "v1": list(r["v1"]), **{k: r[k] for k in ("fa", "md", "ad", "rd")}})

    return dwi.select("x", "y", "z", "signal").mapInPandas(run, "x int, y int, z int, evals array<double>, v1 array<double>, fa double, md double, ad double, rd double")


def response_voxels(fa: DataFrame, least: int = 10) -> DataFrame:
    """Voxels of single-fibre response: the first threshold of a ladder that leaves enough, else the top percent, else all. All counts are one aggregate."""
    ladder = (0.7, 0.5, 0.3, 0.2, 0.1)
    c = fa.agg(*[F.count_if(F.col("fa") > t).alias(f"c{k}") for k, t in enumerate(ladder)], F.percentile(F.when(F.col("fa") > 0, F.col("fa")), 0.99).alias("p99"))
    pick = F.when(F.col("c0") >= least, ladder[0])
    for k, t in list(enumerate(ladder))[1:]:
        pick = pick.when(F.col(f"c{k}") >= least, t)
    cut = c.select(F.coalesce(pick, F.col("p99")).alias("cut"))
    over = fa.crossJoin(F.broadcast(cut)).where(F.col("fa") > F.col("cut")).drop("cut")
    return over if over.take(1) else fa


def response(dwi: DataFrame, voxels: DataFrame) -> DataFrame:
    """(vol, value): median signal per volume over the voxels."""
    s_ = dwi.join(voxels.select("x", "y", "z"), ["x", "y", "z"], "left_semi").select(F.posexplode("signal").alias("vol", "v"))
    return s_.groupBy("vol").agg(F.coalesce(F.percentile("v", 0.5), F.lit(0.0)).alias("value"))


def sh_basis(order: int, directions: np.ndarray) -> np.ndarray:
    """Real symmetric spherical harmonics of even degree, one row per direction, by the three-term recurrence of associated Legendre functions."""
    from math import factorial, pi, sqrt

    n = np.linalg.norm(directions, axis=1)
    u = directions / np.where(n > 0, n, 1)[:, None]
    x, phi = np.clip(u[:, 2], -1, 1), np.arctan2(u[:, 1], u[:, 0])
    root = np.sqrt(1 - x * x)
    legendre: dict[tuple[int, int], np.ndarray] = {}
    for m in range(order + 1):
        pmm = np.ones_like(x)
        for k in range(1, m + 1):
            pmm = pmm * -(2 * k - 1) * root
        legendre[m, m] = pmm
        before, last = np.zeros_like(x), pmm
        for deg in range(m + 1, order + 1):
            before, last = last, ((2 * deg - 1) * x * last - (deg + m - 1) * before) / (deg - m)
            legendre[deg, m] = last
    cols = []
    for deg in range(0, order + 1, 2):
        for m in range(-deg, deg + 1):
            k = abs(m)
            norm = sqrt((2 * deg + 1) / (4 * pi) * factorial(deg - k) / factorial(deg + k))
            p = norm * legendre[deg, k]
            cols.append(p if m == 0 else sqrt(2) * p * (np.cos(k * phi) if m > 0 else np.sin(k * phi)))
    return np.stack(cols, axis=1)


def csd_operator(bvals: np.ndarray, bvecs: np.ndarray, resp: np.ndarray, order: int = 8, ridge: float = 0.006, b0: float = 50.0) -> np.ndarray:
    """The ridge projection from a signal to coefficients, computed once for all voxels."""
    a = sh_basis(order, bvecs) * resp[bvals > b0].mean()
    return np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T)


def orientation_coefficients(dwi: DataFrame, operator: np.ndarray) -> DataFrame:
    """(x, y, z, coeffs): projected signals, negative coefficients cut to 0."""
    m = np.asarray(operator)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                c = np.maximum(np.stack([np.asarray(v, float) for v in pdf["signal"]]) @ m.T, 0)
                yield pd.DataFrame({"x": pdf["x"], "y": pdf["y"], "z": pdf["z"], "coeffs": list(c)})

    return dwi.select("x", "y", "z", "signal").mapInPandas(run, "x int, y int, z int, coeffs array<double>")


def sphere(n: int = 724) -> np.ndarray:
    """Evenly spread directions on a golden spiral."""
    k = np.arange(n) + 0.5
    z, phi = 1 - 2 * k / n, np.pi * (1 + 5**0.5) * k
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(phi), r * np.sin(phi), z], axis=1)


def find_peaks(amp: np.ndarray, dirs: np.ndarray, relative: float = 0.5, apart: float = 25.0, most: int = 5) -> list[tuple[np.ndarray, float]]:
    """Directions in falling amplitude, each at least apart degrees from those before, until an amplitude is too small beside the first."""
    out: list[tuple[np.ndarray, float]] = []
    top = amp.max()
    for k in np.argsort(-amp, kind="stable"):
        if amp[k] < relative * top or len(out) >= most or amp[k] <= 0:
            break
        if all(np.degrees(np.arccos(min(1.0, abs(float(dirs[k] @ p))))) >= apart for p, _ in out):
            out.append((dirs[k], float(amp[k])))
    return out


def peaks(fod: DataFrame, order: int, relative: float = 0.5, apart: float = 25.0, most: int = 5, n_dirs: int = 724) -> DataFrame:
    """(x, y, z, rank, dx, dy, dz, amp). A voxel without a peak gives none."""
    dirs = sphere(n_dirs)
    basis = sh_basis(order, dirs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            amp = np.stack([np.asarray(c, float) for c in pdf["coeffs"]]) @ basis.T if len(pdf) else []
            for x, y, z, a in zip(pdf["x"], pdf["y"], pdf["z"], amp, strict=True):
                rows += [(x, y, z, k, *map(float, v), h) for k, (v, h) in enumerate(find_peaks(a, dirs, relative, apart, most))]
            yield pd.DataFrame(rows, columns=["x", "y", "z", "rank", "dx", "dy", "dz", "amp"])

    return fod.select("x", "y", "z", "coeffs").mapInPandas(run, "x int, y int, z int, rank int, dx double, dy double, dz double, amp double")


def primary_peaks(fod: DataFrame, order: int) -> DataFrame:
    return peaks(fod, order, most=1)


def rotate_bvec(vec: Column, affine_3x3: np.ndarray) -> list[Column]:
    """A direction turned by the rotation part of an affine map (its polar factor)."""
    u, _, vt = np.linalg.svd(np.asarray(affine_3x3, float))
    r = u @ vt
    return [sum((float(r[i, j]) * vec[j] for j in range(3)), F.lit(0.0)) for i in range(3)]


def reoriented(grad: DataFrame, source: np.ndarray, target: np.ndarray) -> DataFrame:
    """Gradient directions of a scan that moves from one affine map to another, at unit length; zeros stay zeros."""
    m = np.linalg.inv(np.asarray(target, float)[:3, :3]) @ np.asarray(source, float)[:3, :3]
    turned = [sum((float(m[i, j]) * F.col("g" + c) for j, c in enumerate("xyz")), F.lit(0.0)) for i in range(3)]
    x = grad.select("vol", "bval", *[t.alias("g" + c) for t, c in zip(turned, "xyz", strict=True)])
    n = g.norm(F.col("gx"), F.col("gy"), F.col("gz"))
    return x.select("vol", "bval", *[F.when(n > 0, F.col("g" + c) / n).otherwise(F.col("g" + c)).alias("g" + c) for c in "xyz"])


def reconstructed(fits: DataFrame, keys: list[str]) -> DataFrame:
    """The six entries of V diag(l) V' from eigenvalues l (array of 3) and eigenvectors v (array of 9, a vector in each column)."""
    entry = lambda i, j: sum((F.col("l")[k] * F.col("v")[3 * i + k] * F.col("v")[3 * j + k] for k in range(3)), F.lit(0.0))
    return fits.select(*keys, *[entry(i, j).alias("d" + "xyz"[i] + "xyz"[j]) for i in range(3) for j in range(i, 3)])


def slice_at(volume: DataFrame, axis: str, at: float) -> DataFrame:
    """The plane at a share (0 to 1) of an axis: that of place trunc(at (n - 1)), where the axis has places 0 to n - 1."""
    n = volume.agg((F.max(axis) + 1).alias("_places"))
    return volume.crossJoin(F.broadcast(n)).where(F.col(axis) == F.floor(F.lit(float(at)) * (F.col("_places") - 1))).drop("_places", axis)


def mask_parts(mask: DataFrame) -> DataFrame:
    """Number of connected parts of a mask, and the share of the largest one."""
    c = label_components(mask).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("parts"), F.coalesce(F.try_divide(F.max("n").cast("double"), F.sum("n")), F.lit(0.0)).alias("largest_share"))
