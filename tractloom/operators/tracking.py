"""Seeds and tracking. Noise is a pure function of seed, path and step, so tracks don't depend on partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.functions import rng
from tractloom.operators import voxels as vx
from tractloom.session import checkpoint_folder

#: Cells of the cubes that tracking broadcasts: 8 float32 numbers each, 256 MB at most.
MOST_CELLS = 8_000_000


def jittered(voxels: DataFrame, count, scale: float = 0.5, seed: int = 42) -> DataFrame:
    """count seeds in each voxel, spread about its centre."""
    k = voxels.withColumn("k", F.explode(F.sequence(F.lit(1), count))).where("k > 0")
    at = [(F.col(c) + (rng.uniform(f"{seed}{c}", "x", "y", "z", "k") - 0.5) * 2 * scale).alias("s" + c) for c in "xyz"]
    return k.select("x", "y", "z", "k", *at)


def whole_brain_seeds(mask: DataFrame, per_voxel: int = 1, scale: float = 0.5, seed: int = 42) -> DataFrame:
    return jittered(mask.select("x", "y", "z"), F.lit(per_voxel), scale, seed)


def adaptive_seeds(strength: DataFrame, threshold: float, per_voxel: int = 1, scale: float = 0.5, seed: int = 42) -> DataFrame:
    """More seeds where the value is larger: up to three times as many at the largest. The maximum is one row, broadcast."""
    top = strength.agg(F.max("value").alias("top"))
    x = strength.where(F.col("value") > threshold).crossJoin(F.broadcast(top))
    share = F.coalesce(F.try_divide(F.col("value") - threshold, F.col("top") - threshold), F.lit(0.0))
    n = F.greatest(F.lit(1), F.floor(per_voxel * (1 + 2 * share))).cast("int")
    return jittered(x.select("x", "y", "z", n.alias("n")), F.col("n"), scale, seed)


def roi_seeds(mask: DataFrame, per_voxel: int = 1, boundary_only: bool = False, seed: int = 42) -> DataFrame:
    return whole_brain_seeds(vx.boundary(mask) if boundary_only else mask, per_voxel, seed=seed)


def parcel_boundary(parcels: DataFrame) -> DataFrame:
    """Voxels of a parcel next to another one (background is none): 6-neighbours meet by their shifted places."""
    near = parcels.select("label", F.explode(F.array(*[F.struct(*[(F.col(c) + k).cast("int").alias(c) for c, k in zip("xyz", o, strict=True)]) for o in vx.FACES])).alias("p")).select("p.*", F.col("label").alias("other"))
    return parcels.where("label > 0").join(near.where("other > 0"), ["x", "y", "z"]).where("other <> label").select("x", "y", "z", "label").distinct()


def subsample_seeds(seeds: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return seeds.orderBy(rng.order_key(seed, "x", "y", "z", "k"), "x", "y", "z", "k").limit(n)


def step_config(step: float = 0.5, voxel: float = 1.0, max_length: float = 250.0) -> dict[str, float]:
    """The step held between half of it and a quarter voxel below, and one and a half of it and three quarters above; and the most steps."""
    lo, hi = max(0.5 * step, 0.25 * voxel), min(1.5 * step, 0.75 * voxel)
    return {"min_step": lo, "max_step": hi, "step": (lo + hi) / 2, "max_steps": int(np.ceil(max_length / lo)) + 1000}


def _noise(ids: np.ndarray, sample: np.ndarray, step: int, seed: int, half: int) -> np.ndarray:
    """Three normal numbers for each path, from a counter-based generator keyed by what they are for."""
    out = np.empty((len(ids), 3))
    for k, (i, s) in enumerate(zip(ids, sample, strict=True)):
        out[k] = np.random.Generator(np.random.Philox(key=[(int(seed) << 32) | (step << 1) | half, (int(i) << 16) | int(s)])).standard_normal(3)
    return out


def integrate(pos: np.ndarray, first: np.ndarray, cube: dict, noise, step: float, max_steps: int, max_length: float, min_fa: float, max_angle: float, least_fod: float) -> tuple[list[np.ndarray], np.ndarray]:
    """All paths of a batch advance in lock-step. In each step a path may end: outside the grid, off the mask, in low anisotropy, without a direction, at a sharp turn, at full length."""
    n = len(pos)
    shape = np.array(cube["fa"].shape)
    points = [[p.copy()] for p in pos]
    reason = np.full(n, "max_length", dtype=object)
    live, prev, p, length = np.arange(n), first.copy(), pos.copy(), 0.0
    for k in range(max_steps):
        if not len(live):
            break
        x = p[live]
        inside = ((x >= 0) & (x < shape - 1)).all(1)
        v = np.clip(np.trunc(x).astype(int), 0, shape - 1)
        on = cube["mask"][tuple(v.T)] > 0
        fa = trilinear(cube["fa"], np.clip(x, 0, shape - 1.000001))
        d = cube["dir"][tuple(np.clip(np.rint(x).astype(int), 0, shape - 1).T)] + noise(live, k)
        size = np.linalg.norm(d, axis=1)
        d = d / np.where(size > 1e-8, size, 1)[:, None]
        d = np.where(((d * prev[live]).sum(1) < 0)[:, None], -d, d)
        cos = np.clip(np.abs((d * prev[live]).sum(1)) / np.maximum(np.linalg.norm(prev[live], axis=1), 1e-8), 0, 1)
        turn = np.degrees(np.arccos(cos))
        ends = np.select([~inside, ~on, fa < min_fa, size < least_fod, turn > max_angle], ["exit_volume", "exit_mask", "low_fa", "low_fod", "high_curvature"], "")
        reason[live[ends != ""]] = ends[ends != ""]
        go = ends == ""
        live, d = live[go], d[go]
        p[live] += step * d
        prev[live] = d
        length += step
        for i in live:
            points[i].append(p[i].copy())
        if length >= max_length:
            break
    return [np.array(q) for q in points], reason


def trilinear(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    f = np.floor(x).astype(int)
    r = x - f
    out = np.zeros(len(x))
    for k in range(8):
        o = np.array([k & 1, k >> 1 & 1, k >> 2 & 1])
        w = np.prod(np.where(o, r, 1 - r), axis=1)
        out += w * a[tuple(np.minimum(f + o, np.array(a.shape) - 1).T)]
    return out


def cubes(peaks: DataFrame, fa: DataFrame, mask: DataFrame, shape: tuple[int, int, int]) -> dict:
    """Dense cubes of primary directions, anisotropy and mask; their size is checked before they are gathered."""
    if int(np.prod(shape)) > MOST_CELLS:
        raise ValueError("the grid is too large to broadcast; cut it into blocks, or use track_by_joins()")
    out = {"dir": np.zeros((*shape, 3), np.float32), "fa": np.zeros(shape, np.float32), "mask": np.zeros(shape, np.uint8)}
    p = peaks.where("rank = 0").select("x", "y", "z", "dx", "dy", "dz").toPandas()
    out["dir"][p["x"], p["y"], p["z"]] = p[["dx", "dy", "dz"]].to_numpy()
    f = fa.select("x", "y", "z", F.col("fa")).toPandas()
    out["fa"][f["x"], f["y"], f["z"]] = f["fa"]
    m = mask.select("x", "y", "z").toPandas()
    out["mask"][m["x"], m["y"], m["z"]] = 1
    return out


def track(seeds: DataFrame, cube: dict, n_samples: int = 1, step: float = 0.5, max_length: float = 250.0, min_length: float = 10.0, min_fa: float = 0.1, max_angle: float = 30.0, least_fod: float = 0.1, sigma: float = 0.1, seed: int = 42) -> DataFrame:
    """seeds (seed_id, x, y, z) give one path per sample: both halves joined at the seed, with the reasons they ended. A path is kept if neither half is too short."""
    shared = seeds.sparkSession.sparkContext.broadcast(cube)
    cfg = step_config(step, 1.0, max_length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        shape = np.array(c["fa"].shape)
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf["seed_id"].to_numpy()
            sample = pdf["sample"].to_numpy()
            pos = pdf[["x", "y", "z"]].to_numpy(float)
            at = tuple(np.clip(np.rint(pos).astype(int), 0, shape - 1).T)
            start = c["dir"][at] + sigma * _noise(ids, sample, 0, seed, 0)
            size = np.linalg.norm(start, axis=1, keepdims=True)
            start = start / np.where(size > 1e-8, size, 1)
            halves = []
            for half, sign in ((0, 1.0), (1, -1.0)):
                noise = lambda live, k, half=half: sigma * _noise(ids[live], sample[live], k + 1, seed, half)
                halves.append(integrate(pos.copy(), sign * start, c, noise, cfg["step"], cfg["max_steps"], max_length, min_fa, max_angle, least_fod))
            rows = []
            for k in range(len(pdf)):
                f, b = halves[0][0][k], halves[1][0][k]
                why = []
                for pts, r in ((f, halves[0][1][k]), (b, halves[1][1][k])):
                    short = np.linalg.norm(np.diff(pts, axis=0), axis=1).sum() < min_length
                    why.append("too_short" if short else r)
                path = np.concatenate([b[:0:-1], f])
                rows.append((int(ids[k]), int(sample[k]), [{"x": x, "y": y, "z": z} for x, y, z in path.tolist()], why[0], why[1], "too_short" not in why))
            yield pd.DataFrame(rows, columns=["seed_id", "sample", "points", "reason_fwd", "reason_bwd", "kept"])

    every = seeds.select("seed_id", "x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("sample"))
    return every.mapInPandas(run, "seed_id long, sample int, points array<struct<x: double, y: double, z: double>>, reason_fwd string, reason_bwd string, kept boolean")


def track_by_joins(seeds: DataFrame, peaks: DataFrame, steps: int, step: float = 0.5) -> DataFrame:
    """(seed_id, pos, x, y, z): each step is a join of the live ends with the peaks of their nearest voxel. For grids of any size; paths end where there is no peak."""
    p = peaks.where("rank = 0").select(F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"), "dx", "dy", "dz")
    checkpoint_folder(seeds.sparkSession)
    live = seeds.select("seed_id", F.lit(0).alias("pos"), *[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.lit(0.0).alias("p" + c) for c in "xyz"])
    out = live
    for k in range(1, steps + 1):
        near = live.select("*", *[F.rint(c).cast("int").alias("v" + c) for c in "xyz"]).join(p, ["vx", "vy", "vz"])
        sign = F.when(F.col("dx") * F.col("px") + F.col("dy") * F.col("py") + F.col("dz") * F.col("pz") < 0, -1.0).otherwise(1.0)
        live = near.select("seed_id", F.lit(k).alias("pos"), *[(F.col(c) + step * sign * F.col("d" + c)).alias(c) for c in "xyz"], *[(sign * F.col("d" + c)).alias("p" + c) for c in "xyz"])
        if k % 5 == 0:
            live = live.checkpoint()
        out = out.union(live)
    return out.select("seed_id", "pos", "x", "y", "z")


def tracking_summary(paths: DataFrame) -> DataFrame:
    """How the halves ended, and how many paths were kept."""
    r = paths.select(F.explode(F.array("reason_fwd", "reason_bwd")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    k = paths.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("kept")).alias("kept"))
    return r.crossJoin(F.broadcast(k)).withColumn("success", F.col("kept") / F.col("attempted"))


def sampled_peaks(peaks: DataFrame, seed: int = 42) -> DataFrame:
    """One peak of each voxel, chosen with its amplitude as weight."""
    from pyspark.sql import Window

    w = Window.partitionBy("x", "y", "z")
    share = F.sum("amp").over(w.orderBy("rank")) / F.sum("amp").over(w)
    got = peaks.withColumn("upto", share).where(F.col("upto") >= rng.uniform(seed, "x", "y", "z"))
    return got.withColumn("k", F.row_number().over(w.orderBy("rank"))).where("k = 1").drop("k", "upto")
