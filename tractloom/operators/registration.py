"""Registration of volumes to a reference: motion between the volumes of a scan.

A task holds one volume and the reference beside it, so scans spread over tasks by volume. The fit climbs a pyramid:
smoothed and thinned first, whole at last. Its measure is the mutual information of a joint histogram (cubic B-spline
windows along the moving volume's values) or the correlation, both with exact slopes, and each level is climbed by
quasi-Newton steps. Information also grows where an affine map spreads a volume's bright parts over more points (by some
7 % in the fixture of the tests), so maps that stretch are fitted by correlation unless asked otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.operators import voxels as vx
from tractloom.session import checkpoint_folder

BINS = 32
#: Thinning, smoothing (voxels) and most steps of each level.
LEVELS = ((4, 3.0, 60), (2, 1.0, 40), (1, 0.0, 25))
#: Points that are worked on at once.
CHUNK = 200_000

MOVE = [T.StructField(k, T.DoubleType()) for k in ("tx", "ty", "tz", "rx", "ry", "rz", "before", "after")] + [T.StructField("matrix", T.ArrayType(T.DoubleType())), T.StructField("centre", T.ArrayType(T.DoubleType()))]


def rotation(a: Sequence[float]) -> np.ndarray:
    """Turns about x, then y, then z."""
    (cx, cy, cz), (sx, sy, sz) = np.cos(a), np.sin(a)
    x = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    y = np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]])
    z = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    return z @ y @ x


def angles(m: np.ndarray) -> np.ndarray:
    """The turns of a matrix's rotation part; near the pole the third is 0."""
    u, _, vt = np.linalg.svd(m)
    r = u @ vt
    s = np.hypot(r[0, 0], r[1, 0])
    if s >= 1e-6:
        return np.array([np.arctan2(r[2, 1], r[2, 2]), np.arctan2(-r[2, 0], s), np.arctan2(r[1, 0], r[0, 0])])
    return np.array([np.arctan2(-r[1, 2], r[1, 1]), np.arctan2(-r[2, 0], s), 0.0])


def smoothed(v: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along each axis; what lies outside the grid is left out of the weights."""
    if not sigma:
        return v
    w = np.array(vx.gaussian(sigma))
    for axis in range(3):
        n = v.shape[axis]
        k = np.arange(n)[:, None] - np.arange(n)[None]
        m = np.where(np.abs(k) <= len(w) // 2, w[np.clip(k + len(w) // 2, 0, len(w) - 1)], 0.0)
        v = np.moveaxis(np.tensordot(m / m.sum(1, keepdims=True), v, (1, axis)), 0, axis)
    return v


def sampled(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values between voxels at q (n x 3), their slopes, and whether q is inside; outside, the border's value holds."""
    top = np.array(v.shape) - 1
    free = (q >= 0) & (q <= top)
    q = np.clip(q, 0, top)
    i = np.minimum(q.astype(np.int64), np.maximum(top - 1, 0))
    f, j = q - i, np.minimum(i + 1, top)
    flat, step = v.ravel(), np.array([v.shape[1] * v.shape[2], v.shape[2], 1])
    lo, hi = i * step, j * step
    c = {(a, b, d): flat[(hi if a else lo)[:, 0] + (hi if b else lo)[:, 1] + (hi if d else lo)[:, 2]] for a in (0, 1) for b in (0, 1) for d in (0, 1)}
    x, y, z = f.T
    mix = lambda a, b, t: a + (b - a) * t
    along_x = {(b, d): mix(c[0, b, d], c[1, b, d], x) for b in (0, 1) for d in (0, 1)}
    low, high = mix(along_x[0, 0], along_x[1, 0], y), mix(along_x[0, 1], along_x[1, 1], y)
    dx = {(b, d): c[1, b, d] - c[0, b, d] for b in (0, 1) for d in (0, 1)}
    slope = np.stack([
        mix(mix(dx[0, 0], dx[1, 0], y), mix(dx[0, 1], dx[1, 1], y), z),
        mix(along_x[1, 0] - along_x[0, 0], along_x[1, 1] - along_x[0, 1], z),
        high - low,
    ], axis=1)
    return mix(low, high, z), slope * free, free.all(1)


def in_bins(v: np.ndarray, lo: float, hi: float, pad: int) -> np.ndarray:
    """Values as places among the bins, pad bins free on either side."""
    return pad + (v - lo) / (hi - lo if hi > lo else 1.0) * (BINS - 1 - 2 * pad)


def mutual_information(fixed: np.ndarray, m: np.ndarray) -> tuple[float, np.ndarray]:
    """Of fixed bins and moving places (both by point): the measure and its slope by each place."""
    at = np.floor(m).astype(np.int64)
    t = m - at
    w = np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3]) / 6
    dw = np.stack([-((1 - t) ** 2), 3 * t**2 - 4 * t, -3 * t**2 + 2 * t + 1, t**2]) / 2
    cell = fixed * BINS + at - 1 + np.arange(4)[:, None]
    p = np.bincount(cell.ravel(), w.ravel(), BINS * BINS).reshape(BINS, BINS) / len(m)
    rows, cols = p.sum(1, keepdims=True), p.sum(0, keepdims=True)
    safe = lambda x: np.log(np.maximum(x, 1e-12))
    gain = safe(p) - safe(cols)
    return float((p * (gain - safe(rows))).sum()), (dw * gain.ravel()[cell]).sum(0) / len(m)


def correlation(fixed: np.ndarray, m: np.ndarray) -> tuple[float, np.ndarray]:
    """Of two lists of values: Pearson's r and its slope by each of the second; 0 where one doesn't vary."""
    a, b = fixed - fixed.mean(), m - m.mean()
    sa, sb = np.sqrt((a @ a) * 1.0), np.sqrt((b @ b) * 1.0)
    if sa < 1e-12 or sb < 1e-12:
        return 0.0, np.zeros(len(m))
    r = float(a @ b / (sa * sb))
    return r, a / (sa * sb) - r * b / sb**2


def climbed(f: Callable[[np.ndarray], tuple[float, np.ndarray]], p: np.ndarray, steps: int, reach: float) -> np.ndarray:
    """Quasi-Newton ascent with halved steps; no first step is longer than reach."""
    value, slope = f(p)
    h = None
    for _ in range(steps):
        size = np.linalg.norm(slope)
        if size < 1e-10:
            break
        d = slope * (reach / size) if h is None else h @ slope
        if d @ slope <= 0:
            h, d = None, slope * (reach / size)
        d *= min(1.0, 2 * reach / max(np.linalg.norm(d), 1e-300))
        for k in range(14):
            new, at = f(p + d * 0.5**k)
            if new >= value + 1e-4 * 0.5**k * (d @ slope):
                break
        else:
            if h is None:
                break
            h = None
            continue
        s, y = d * 0.5**k, slope - at
        done = np.linalg.norm(s) < 1e-4 * reach
        p, value, slope = p + s, new, at
        if s @ y > 1e-14:
            h = np.eye(len(p)) * (s @ y) / (y @ y) if h is None else h
            e = np.eye(len(p)) - np.outer(s, y) / (s @ y)
            h = e @ h @ e.T + np.outer(s, s) / (s @ y)
        if done:
            break
    return p


def fitted(fixed: np.ndarray, moving: np.ndarray, zooms: Sequence[float] = (1.0, 1.0, 1.0), kind: str = "rigid", metric: str | None = None, levels: Sequence[tuple[int, float, int]] = LEVELS) -> tuple[np.ndarray, np.ndarray, float, float]:
    """The map from places of fixed to those of moving, about the grid's centre, in mm: its matrix, its shift, and the measure before and after.

    Starts from no motion, or from the shift between the centres of mass where that is better; affine maps start from
    the rigid one, on levels that still see the shape's details. metric is mi or cc; unless given, mi for rigid maps and cc
    for affine ones. Volumes without contrast don't move.
    """
    metric = metric or ("mi" if kind == "rigid" else "cc")
    if kind not in ("rigid", "affine") or metric not in ("mi", "cc"):
        raise ValueError("kind is rigid or affine, metric is mi or cc")
    zoom, shape = np.asarray(zooms, float), np.array(fixed.shape)
    centre = (shape - 1) / 2 * zoom
    radius = max(float(np.linalg.norm(centre)) / 2, 1e-9)  # turns are counted by what they move, so that all parameters are in mm

    def matrix(p: np.ndarray) -> np.ndarray:
        return rotation(p[3:] / radius) if len(p) == 6 else np.eye(3) + p[3:].reshape(3, 3) / radius

    def measure(sigma: float, thin: int) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
        a, b = smoothed(fixed, sigma), smoothed(moving, sigma)
        every = [np.arange(0, n, max(1, min(thin, n // 8))) for n in shape]
        at = np.stack(np.meshgrid(*every, indexing="ij"), -1).reshape(-1, 3)
        here, value = at * zoom - centre, a[tuple(at.T)]
        lo, hi = float(b.min()), float(b.max())
        bins = np.round(in_bins(value, float(value.min()), float(value.max()), 0)).astype(np.int64)
        per_value = (BINS - 5) / (hi - lo) if hi > lo else 1.0

        def f(p: np.ndarray) -> tuple[float, np.ndarray]:
            m = matrix(p)
            eps = 1e-5 * radius
            turns = [(matrix(p + e) - matrix(p - e)) / (2 * eps) for e in np.eye(len(p))[3:] * eps]
            got = [sampled(b, (here[k : k + CHUNK] @ m.T + p[:3] + centre) / zoom)[:2] for k in range(0, len(here), CHUNK)]
            v, slope = (np.concatenate([g[c] for g in got]) for c in (0, 1))
            if metric == "mi":
                total, by = mutual_information(bins, in_bins(v, lo, hi, 2))
                by = by * per_value
            else:
                total, by = correlation(value, v)
            slope = by[:, None] * slope / zoom
            across = slope.T @ here  # how the measure answers to each entry of the matrix
            return total, np.concatenate([slope.sum(0), [float((t * across).sum()) for t in turns]])

        return f

    p = np.zeros(6)
    if not (np.ptp(fixed) > 0 and np.ptp(moving) > 0):
        return matrix(p), p[:3], 0.0, 0.0
    for n, (thin, sigma, steps) in enumerate(levels):
        f = measure(sigma, thin)
        if n == 0:
            grid = np.stack(np.meshgrid(*[np.arange(k) for k in shape], indexing="ij"), -1) * zoom
            low = [v - v.min() for v in (fixed, moving)]
            mass = [(grid * v[..., None]).sum((0, 1, 2)) / v.sum() for v in low]
            other = np.concatenate([mass[1] - mass[0], np.zeros(3)])
            p = max((p, other), key=lambda q: f(q)[0])
        p = climbed(f, p, steps, float(zoom.mean()) * max(1, thin) / 2)
    if kind == "affine":
        p = np.concatenate([p[:3], (matrix(p) - np.eye(3)).ravel() * radius])
        for thin, sigma, steps in levels[-2:]:
            p = climbed(measure(sigma, thin), p, 2 * steps, float(zoom.mean()) * max(1, thin) / 2)
    f = measure(0.0, 1)
    before, after = f(np.zeros(len(p)))[0], f(p)[0]
    if after < before:
        p, after = np.zeros(len(p)), before
    return matrix(p), p[:3], before, after


def _grid(t: pa.Table, column: str) -> np.ndarray:
    """A column as a full grid; voxels without a row, or without a finite value, are 0."""
    at = [t.column(c).to_numpy() for c in "xyz"]
    v = np.zeros([int(k.max()) + 1 for k in at])
    v[tuple(at)] = np.nan_to_num(t.column(column).cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0.0, posinf=0.0, neginf=0.0)
    return v


def motions(volumes: DataFrame, by: Sequence[str] = ("vol",), **fit) -> DataFrame:
    """One row per volume: shift of the grid's centre in mm, turns in radians, the measure before and after, the matrix (rows in one array) and the centre.

    volumes: by, x, y, z (from 0), value, reference. The map goes from the reference's places to the volume's. Nulls
    and missing voxels are 0; a voxel named twice counts once; a volume without contrast, or whose reference has none,
    stays. Other columns are not carried.
    """
    schema = T.StructType([*volumes.select(*by).schema.fields, *MOVE])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        a, b = _grid(t, "reference"), _grid(t, "value")
        m, shift, before, after = fitted(a, b, **fit)
        centre = (np.array(a.shape) - 1) / 2 * np.asarray(fit.get("zooms", (1.0, 1.0, 1.0)), float)
        row = [*[k.as_py() for k in key], *shift.tolist(), *angles(m).tolist(), before, after, m.ravel().tolist(), centre.tolist()]
        return pa.Table.from_pylist([dict(zip(schema.names, row, strict=True))], schema=pa.schema([(f.name, t.schema.field(f.name).type if f.name in by else pa.list_(pa.float64()) if f.name in ("matrix", "centre") else pa.float64()) for f in schema.fields]))

    return volumes.select(*by, "x", "y", "z", "value", "reference").groupBy(*by).applyInArrow(run, schema)


def moved_back(volumes: DataFrame, moves: DataFrame, by: Sequence[str] = ("vol",), zooms: Sequence[float] = (1.0, 1.0, 1.0), fill: float = 0.0) -> DataFrame:
    """(by, x, y, z, value) at the reference's places, between voxels by trilinear weights; fill stands where a volume doesn't reach."""
    zoom = np.asarray(zooms, float)
    keys = volumes.select(*by).schema.fields
    schema = T.StructType([*keys, *[T.StructField(c, T.IntegerType()) for c in "xyz"], T.StructField("value", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({f.name: pa.array([], right.schema.field(f.name).type if f.name in by else pa.float64() if f.name == "value" else pa.int32()) for f in schema.fields})
        v = _grid(left, "value")
        at = np.stack([left.column(c).to_numpy() for c in "xyz"], 1)
        if right.num_rows:
            m, centre = (np.array(right.column(c)[0].as_py()) for c in ("matrix", "centre"))
            shift = np.array([right.column(c)[0].as_py() for c in ("tx", "ty", "tz")])
            out = np.empty(len(at))
            for k in range(0, len(at), CHUNK):
                q = ((at[k : k + CHUNK] * zoom - centre) @ m.reshape(3, 3).T + shift + centre) / zoom
                value, _, inside = sampled(v, q)
                out[k : k + CHUNK] = np.where(inside, value, fill)
        else:
            out = v[tuple(at.T)]
        return pa.table({**{c: left.column(c) for c in by}, **{c: pa.array(at[:, k], pa.int32()) for k, c in enumerate("xyz")}, "value": pa.array(out)})

    return volumes.select(*by, "x", "y", "z", "value").groupBy(*by).cogroup(moves.toDF(*moves.columns).groupBy(*by)).applyInArrow(run, schema)


def turned_gradients(grad: DataFrame, moves: DataFrame, convention: str = "standard") -> DataFrame:
    """Directions turned back with their volumes, at unit length; zeros stay zeros. as_written: turned by the map itself, not by its inverse."""
    r = F.when(F.lit(convention == "standard"), F.array(-F.col("rx"), -F.col("ry"), -F.col("rz"))).otherwise(F.array("rx", "ry", "rz"))
    x = grad.select("vol", "bval", *["g" + c for c in "xyz"]).join(moves.select("vol", r.alias("r")), "vol", "left")
    order = "xyz" if convention == "as_written" else "zyx"
    v = {c: F.col("g" + c) for c in "xyz"}
    for axis in order:
        a = F.coalesce(F.col("r")["xyz".index(axis)], F.lit(0.0))
        j, k = {"x": "yz", "y": "zx", "z": "xy"}[axis]
        v[j], v[k] = F.cos(a) * v[j] - F.sin(a) * v[k], F.sin(a) * v[j] + F.cos(a) * v[k]
    x = x.select("vol", "bval", *[v[c].alias("g" + c) for c in "xyz"])
    n = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz"))
    return x.select("vol", "bval", *[F.when(n > 0, F.col("g" + c) / n).otherwise(F.col("g" + c)).alias("g" + c) for c in "xyz"])


def motion_corrected(signal: DataFrame, grad: DataFrame, b0: float = 50.0, convention: str = "standard", zooms: Sequence[float] = (1.0, 1.0, 1.0), **fit) -> tuple[DataFrame, DataFrame, DataFrame]:
    """signal (x, y, z, signal), grad and motions of a scan whose volumes are moved to the mean unweighted one, or to volume 0 where there is none.

    The motions are one row per volume; they are checkpointed, since signal, gradients and summary all read them.
    """
    number = F.posexplode(F.array_sort(F.collect_list(F.struct("vol", (F.col("bval") <= b0).alias("plain")))))
    flags = grad.agg(number).select("pos", F.col("col.plain").alias("plain"), F.col("col.vol").alias("vol"))
    one = flags.agg(F.array_sort(F.collect_list(F.struct("pos", "plain", "vol"))).alias("flags"))
    plain = F.filter(F.zip_with("signal", "flags", lambda v, f: F.when(f["plain"], v)), lambda v: v.isNotNull())
    mean = F.coalesce(F.try_divide(F.aggregate(plain, F.lit(0.0), lambda a, v: a + v), F.size(plain)), F.col("signal")[0])
    rows = signal.crossJoin(F.broadcast(one)).select("x", "y", "z", mean.alias("reference"), F.explode(F.arrays_zip("signal", F.col("flags.vol").alias("vol"))).alias("s"))
    volumes = rows.select("x", "y", "z", "reference", F.col("s.vol").alias("vol"), F.col("s.signal").cast("double").alias("value"))
    checkpoint_folder(signal.sparkSession)
    moves = motions(volumes, zooms=zooms, **fit).checkpoint()
    back = moved_back(volumes, moves, zooms=zooms)
    again = back.groupBy("x", "y", "z").agg(F.array_sort(F.collect_list(F.struct("vol", "value"))).alias("s")).select("x", "y", "z", F.col("s.value").alias("signal"))
    return again, turned_gradients(grad, moves, convention), moves
