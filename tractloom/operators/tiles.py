"""Neighbourhoods of voxels by tiles: each row goes to its own tile and to those whose border it lies in, and a tile is a task's work.

A tile of EDGE voxels a side with its border is all that a task holds, whatever the volume's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.operators import voxels as vx
from tractloom.session import checkpoint_folder

EDGE = 24
#: Numbers of a window's values that are sorted at once.
AT_ONCE = 8_000_000


def by_tile(volume: DataFrame, border: int, work: Callable[[np.ndarray], np.ndarray], edge: int = EDGE) -> DataFrame:
    """(x, y, z, value) of what work makes of every tile.

    volume: x, y, z, value. work takes a cube of edge + 2 border with NaN where there is no row or no value, and gives a cube of
    edge, whose NaN are left out. A voxel named twice counts once; other columns are not carried.
    """
    if border < 0 or edge < 1:
        raise ValueError("border is 0 or more, edge 1 or more")
    x = volume.select(*[F.col(c).cast("int").alias(c) for c in "xyz"], F.col("value").cast("double").alias("value"))
    for c in "xyz":
        x = x.withColumn("t" + c, F.explode(F.sequence(F.floor((F.col(c) - border) / edge), F.floor((F.col(c) + border) / edge))))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        low = np.array([k.as_py() for k in key]) * edge
        cube = np.full([edge + 2 * border] * 3, np.nan)
        cube[tuple(t.column(c).to_numpy() - low[k] + border for k, c in enumerate("xyz"))] = t.column("value").to_numpy(zero_copy_only=False)
        out = work(cube)
        at = np.nonzero(~np.isnan(out))
        return pa.table({**{c: pa.array(at[k] + low[k], pa.int32()) for k, c in enumerate("xyz")}, "value": pa.array(out[at])})

    return x.groupBy("tx", "ty", "tz").applyInArrow(run, "x int, y int, z int, value double")


def medians(cube: np.ndarray, radius: int) -> np.ndarray:
    """Of every inner voxel that has a value: the median of the values in its window."""
    inner = cube[tuple([slice(radius, s - radius) for s in cube.shape])]
    out = np.full(inner.shape, np.nan)
    windows = np.lib.stride_tricks.sliding_window_view(cube, [2 * radius + 1] * 3)
    at = np.argwhere(~np.isnan(inner))
    step = max(1, AT_ONCE // (2 * radius + 1) ** 3)
    for k in range(0, len(at), step):
        i = tuple(at[k : k + step].T)
        v = np.sort(windows[i].reshape(len(i[0]), -1), axis=1)
        n = (~np.isnan(v)).sum(1)
        row = np.arange(len(v))
        out[i] = (v[row, (n - 1) // 2] + v[row, n // 2]) / 2
    return out


def median(volume: DataFrame, radius: int = 4, passes: int = 1, edge: int = EDGE) -> DataFrame:
    """(x, y, z, value): each value is the median of those within radius voxels along every axis, several times over. Voxels without a row or a value are left out of the windows and of the result."""
    for _ in range(passes):
        volume = by_tile(volume, radius, lambda cube: medians(cube, radius), edge)
    return volume


def _grown(on: np.ndarray) -> np.ndarray:
    out = on.copy()
    for axis in range(3):
        a, b = np.moveaxis(out, axis, 0), np.moveaxis(on, axis, 0)
        a[1:] |= b[:-1]
        a[:-1] |= b[1:]
    return out


def morphology(mask: DataFrame, steps: str, edge: int = EDGE) -> DataFrame:
    """A mask (x, y, z) after a word of steps, e for erosion and d for dilation by the six neighbours: "ed" opens, "ddee" closes by two.

    All steps are one pass: the border is as wide as they are many. Beyond every voxel of the mask lies background.
    """
    if set(steps) - {"e", "d"}:
        raise ValueError("steps are e and d")
    n = len(steps)

    def work(cube: np.ndarray) -> np.ndarray:
        on = ~np.isnan(cube)
        for s in steps:
            on = _grown(on) if s == "d" else ~_grown(~on)
        return np.where(on[tuple([slice(n, k - n) for k in on.shape])], 1.0, np.nan)

    return by_tile(mask.select("x", "y", "z", F.lit(1.0).alias("value")), n, work, edge).select("x", "y", "z")


def median_otsu(volume: DataFrame, radius: int = 4, passes: int = 4, dilated: int = 0, edge: int = EDGE) -> DataFrame:
    """(x, y, z) of the voxels above the threshold that best separates the volume after its medians, grown by dilated steps."""
    checkpoint_folder(volume.sparkSession)
    calm = median(volume, radius, passes, edge).checkpoint()  # read by the threshold and by the mask
    mask = calm.crossJoin(F.broadcast(vx.otsu(calm))).where("value > threshold").select("x", "y", "z")
    return morphology(mask, "d" * dilated, edge) if dilated else mask
