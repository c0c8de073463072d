"""Surfaces: meshes, cotangent weights, areas, curvature and distances along a surface."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.functions import geometry as g

#: A cube cut into six tetrahedra around its main diagonal; corners are numbered by bits (x: 1, y: 2, z: 4).
TETRAHEDRA = [(0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7)]


def isosurface(field: np.ndarray, level: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and faces where a field crosses a level, by cutting tetrahedra; every grid edge gives one vertex, so the mesh is closed."""
    f = np.pad(field.astype(float), 1)
    f = np.where(f == level, level + 1e-2 * (f.max() - f.min()), f)  # a crossing at a corner would give faces without area
    dims = f.shape
    number = lambda p: (p[0] * dims[1] + p[1]) * dims[2] + p[2]
    at: dict[tuple[int, int], int] = {}
    verts: list[np.ndarray] = []
    faces: list[tuple[int, int, int]] = []
    lo = np.minimum.reduce([f[i : dims[0] - 1 + i, j : dims[1] - 1 + j, k : dims[2] - 1 + k] for i in (0, 1) for j in (0, 1) for k in (0, 1)])
    hi = np.maximum.reduce([f[i : dims[0] - 1 + i, j : dims[1] - 1 + j, k : dims[2] - 1 + k] for i in (0, 1) for j in (0, 1) for k in (0, 1)])
    for cell in np.argwhere((lo < level) & (hi >= level)):
        corner = [tuple(cell + (n & 1, n >> 1 & 1, n >> 2 & 1)) for n in range(8)]
        for tet in TETRAHEDRA:
            inside = [n for n in tet if f[corner[n]] >= level]
            outside = [n for n in tet if f[corner[n]] < level]
            if not inside or not outside:
                continue

            def cross(a: int, b: int) -> int:
                key = tuple(sorted((number(corner[a]), number(corner[b]))))
                if key not in at:
                    u, v = f[corner[a]], f[corner[b]]
                    at[key] = len(verts)
                    verts.append(np.array(corner[a]) + (level - u) / (v - u) * (np.array(corner[b]) - np.array(corner[a])) - 1)
                return at[key]

            if len(inside) == 2:
                a, b, c, d = cross(inside[0], outside[0]), cross(inside[0], outside[1]), cross(inside[1], outside[1]), cross(inside[1], outside[0])
                tri = [(a, b, c), (a, c, d)]
            else:
                one, rest = (inside[0], outside) if len(inside) == 1 else (outside[0], inside)
                tri = [tuple(cross(one, n) for n in rest)]
            centre = np.mean([corner[n] for n in inside], axis=0) - 1
            for t in tri:
                p = [verts[i] for i in t]
                out = np.cross(p[1] - p[0], p[2] - p[0]) @ (np.mean(p, axis=0) - centre) >= 0
                faces.append(t if out else (t[0], t[2], t[1]))
    return np.array(verts).reshape(-1, 3), np.array(faces, int).reshape(-1, 3)


def mesh(mask: DataFrame, key: str, sigma: float = 1.0, level: float = 0.5, step: int = 1) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of each subject's smoothed mask; one subject in one task."""

    def build(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        p = pdf[["x", "y", "z"]].to_numpy(int)
        origin = p.min(0) - 3
        f = np.zeros((p.max(0) - origin + 4).tolist())
        f[tuple((p - origin).T)] = 1
        r = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        w /= w.sum()
        for axis in range(3):
            f = np.apply_along_axis(lambda v: np.convolve(v, w, "same") if len(v) >= len(w) else np.convolve(v, w)[r : r + len(v)], axis, f)
        v, t = isosurface(f[::step, ::step, ::step], level)
        return v * step + origin, t

    def verts(pdf: pd.DataFrame) -> pd.DataFrame:
        v, _ = build(pdf)
        return pd.DataFrame({key: pdf[key].iloc[0], "vid": np.arange(len(v)), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]})

    def tris(pdf: pd.DataFrame) -> pd.DataFrame:
        _, t = build(pdf)
        return pd.DataFrame({key: pdf[key].iloc[0], "fid": np.arange(len(t)), "v0": t[:, 0], "v1": t[:, 1], "v2": t[:, 2]})

    kind = dict(mask.dtypes)[key]
    m = mask.select(key, "x", "y", "z").groupBy(key)
    return m.applyInPandas(verts, f"{key} {kind}, vid long, x double, y double, z double"), m.applyInPandas(tris, f"{key} {kind}, fid long, v0 long, v1 long, v2 long")


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners, by three joins on vertex ids."""
    out = faces
    for k in range(3):
        out = out.join(vertices.select(F.col("vid").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]), f"v{k}")
    return out


def _edge(a: int, b: int) -> list:
    return [F.col(f"{c}{b}") - F.col(f"{c}{a}") for c in "xyz"]


def _cross(u: list, v: list) -> list:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def face_areas(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return corners(vertices, faces).select("fid", (g.norm(*_cross(_edge(0, 1), _edge(0, 2))) / 2).alias("area"))


def surface_summary(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Total area and mean edge length, each edge counted once per face."""
    c = corners(vertices, faces)
    edge = F.explode(F.array(*[g.norm(*_edge(a, b)) for a, b in ((0, 1), (1, 2), (2, 0))]))
    return face_areas(vertices, faces).agg(F.count(F.lit(1)).alias("faces"), F.sum("area").alias("area")).crossJoin(c.select(edge.alias("e")).agg(F.avg("e").alias("mean_edge")))


def cotangent_laplacian(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(i, j, w): half the cotangents of the angles across each edge, and minus their sum on the diagonal."""
    c = corners(vertices, faces)
    rows = []
    for k in range(3):
        a, b = (k + 1) % 3, (k + 2) % 3
        u, v = _edge(k, a), _edge(k, b)
        dot = sum((p * q for p, q in zip(u, v, strict=True)), F.lit(0.0))
        rows.append(F.struct(F.col(f"v{a}").alias("i"), F.col(f"v{b}").alias("j"), (dot / F.greatest(g.norm(*_cross(u, v)), F.lit(1e-12)) / 2).alias("w")))
    one = c.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    both = one.select(F.explode(F.array(F.struct("i", "j", "w"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "w"), F.struct("i", F.col("i").alias("j"), (-F.col("w")).alias("w")), F.struct(F.col("j").alias("i"), "j", (-F.col("w")).alias("w")))).alias("r")).select("r.*")
    return both.groupBy("i", "j").agg(F.sum("w").alias("w"))


def vertex_curvature(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Angle deficit of each vertex over its number of faces."""
    c = corners(vertices, faces)
    rows = []
    for k in range(3):
        u, v = _edge(k, (k + 1) % 3), _edge(k, (k + 2) % 3)
        dot = sum((p * q for p, q in zip(u, v, strict=True)), F.lit(0.0))
        rows.append(F.struct(F.col(f"v{k}").alias("vid"), F.acos(g.clip(dot / F.greatest(g.norm(*u) * g.norm(*v), F.lit(1e-12)), -1.0, 1.0)).alias("angle")))
    a = c.select(F.explode(F.array(*rows)).alias("r")).select("r.*").groupBy("vid").agg(F.count(F.lit(1)).alias("n"), F.sum("angle").alias("angle"))
    return a.select("vid", ((F.lit(2 * np.pi) - F.col("angle")) / F.col("n")).alias("curvature"))


def heat_distances(v: np.ndarray, t: np.ndarray, sources: list[int]) -> np.ndarray:
    """Distances along a mesh from each source: heat flows for a short time, its gradient gives directions, and a Poisson equation gives the distance that follows them."""
    n = len(v)
    e = [v[t[:, (k + 2) % 3]] - v[t[:, (k + 1) % 3]] for k in range(3)]
    cross = np.cross(v[t[:, 1]] - v[t[:, 0]], v[t[:, 2]] - v[t[:, 0]])
    double = np.maximum(np.linalg.norm(cross, axis=1), 1e-12)
    real = double > 1e-9  # faces without area say nothing
    double = np.where(real, double, 1.0)
    normal = cross / double[:, None]
    lap, mass = np.zeros((n, n)), np.zeros(n)
    for k in range(3):
        a, b = (k + 1) % 3, (k + 2) % 3
        cot = np.where(real, -(e[a] * e[b]).sum(1) / double / 2, 0)
        for i, j, s in ((a, b, 1), (b, a, 1), (a, a, -1), (b, b, -1)):
            np.add.at(lap, (t[:, i], t[:, j]), s * cot)
        np.add.at(mass, t[:, k], np.where(real, double, 0) / 6)
    h = np.mean([np.linalg.norm(x, axis=1).mean() for x in e])
    heat = np.linalg.inv(np.diag(np.maximum(mass, 1e-9)) - h * h * lap)
    pinned = lap - 1e-9 * np.eye(n)
    pinned[0] = 0
    pinned[0, 0] = 1
    poisson = np.linalg.inv(pinned)
    out = []
    for s in sources:
        u = heat[:, s]
        grad = sum(u[t[:, k], None] * np.cross(normal, e[k]) for k in range(3)) / double[:, None]
        x = -grad / np.maximum(np.linalg.norm(grad, axis=1), 1e-12)[:, None]
        div = np.zeros(n)
        for k in range(3):
            a, b = (k + 1) % 3, (k + 2) % 3
            e1, e2 = v[t[:, a]] - v[t[:, k]], v[t[:, b]] - v[t[:, k]]
            cot_b = ((v[t[:, k]] - v[t[:, b]]) * (v[t[:, a]] - v[t[:, b]])).sum(1) / double
            cot_a = ((v[t[:, k]] - v[t[:, a]]) * (v[t[:, b]] - v[t[:, a]])).sum(1) / double
            np.add.at(div, t[:, k], 0.5 * (np.where(real, cot_b * (e1 * x).sum(1) + cot_a * (e2 * x).sum(1), 0)))
        div[0] = 0
        phi = poisson @ div
        out.append(np.abs(phi - phi[s]))
    return np.array(out)


def geodesic_distances(vertices: DataFrame, faces: DataFrame, sources: DataFrame, most: int = 5000) -> DataFrame:
    """(source, vid, distance). The mesh of one subject is broadcast after a check of its size; sources are spread over tasks."""
    if vertices.count() > most:
        raise ValueError("the mesh is too large for dense solves")
    spark = vertices.sparkSession
    v = vertices.orderBy("vid").select("x", "y", "z").toPandas().to_numpy()
    t = faces.orderBy("fid").select("v0", "v1", "v2").toPandas().to_numpy()
    shared = spark.sparkContext.broadcast((v, t))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                ids = pdf["source"].tolist()
                d = heat_distances(*shared.value, ids)
                yield pd.DataFrame({"source": np.repeat(ids, d.shape[1]), "vid": np.tile(np.arange(d.shape[1]), len(ids)), "distance": d.ravel()})

    return sources.select("source").mapInPandas(run, "source long, vid long, distance double")
