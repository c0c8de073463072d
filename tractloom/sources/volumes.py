"""Binary sources: NIfTI volumes and TRK / TCK streamlines, decoded from binaryFile scans in Arrow batches."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the NIfTI-1 standard: data type codes.
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
#: Voxels in one output batch.
CHUNK = 20_000


def nifti_header(raw: bytes) -> dict:
    """What the 348-byte header says; both byte orders."""
    order = "<" if struct.unpack_from("<i", raw, 0)[0] == 348 else ">"
    if struct.unpack_from(order + "i", raw, 0)[0] != 348:
        raise ValueError("no NIfTI-1 header")
    get = lambda f, at: struct.unpack_from(order + f, raw, at)
    dim = get("8h", 40)
    n = max(1, min(dim[0], 7))
    pix = get("8f", 76)
    return {
        "order": order, "shape": [int(v) for v in dim[1 : n + 1]], "zooms": [float(v) for v in pix[1 : n + 1]], "kind": int(get("h", 70)[0]), "offset": int(get("f", 108)[0]),
        "slope": float(get("f", 112)[0]), "inter": float(get("f", 116)[0]), "qform": int(get("h", 252)[0]), "sform": int(get("h", 254)[0]),
        "affine": [[float(v) for v in get("4f", 280 + 16 * r)] for r in range(3)] + [[0.0, 0.0, 0.0, 1.0]], "tr": float(pix[4]) if n > 3 else 0.0,
        "description": raw[148:228].split(b"\0")[0].decode("latin-1"), "aux": raw[228:252].split(b"\0")[0].decode("latin-1"),
    }


def nifti_array(raw: bytes) -> tuple[dict, np.ndarray]:
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    h = nifti_header(raw)
    a = np.frombuffer(raw, np.dtype(KINDS[h["kind"]]).newbyteorder(h["order"]), int(np.prod(h["shape"])), h["offset"]).reshape(h["shape"], order="F").astype(float)
    return h, a * h["slope"] + h["inter"] if h["slope"] not in (0.0, 1.0) or h["inter"] else a


def nifti_bytes(a: np.ndarray, affine: np.ndarray | None = None, zooms: tuple[float, ...] | None = None, kind: str = "f4") -> bytes:
    """A single-file NIfTI-1 volume, of 32-bit floats unless kind names another type."""
    raw = bytearray(352)
    struct.pack_into("<i", raw, 0, 348)
    struct.pack_into("<8h", raw, 40, a.ndim, *a.shape, *[1] * (7 - a.ndim))
    struct.pack_into("<hh", raw, 70, next(k for k, v in KINDS.items() if v == kind), 8 * np.dtype(kind).itemsize)
    z = zooms or (1.0,) * a.ndim
    struct.pack_into("<8f", raw, 76, 1.0, *z, *[1.0] * (7 - len(z)))
    struct.pack_into("<fff", raw, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<hh", raw, 252, 0, 1)
    m = np.eye(4) if affine is None else np.asarray(affine, float)
    for r in range(3):
        struct.pack_into("<4f", raw, 280 + 16 * r, *m[r])
    raw[344:348] = b"n+1\0"
    return bytes(raw) + np.asarray(a, "<" + kind).tobytes(order="F")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


HEADER = "path string, shape array<int>, zooms array<double>, kind int, qform int, sform int, affine array<array<double>>, tr double, description string, aux string"


def read_nifti_headers(spark: SparkSession, path: str) -> DataFrame:
    names = [c.split()[0] for c in HEADER.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                h = nifti_header(gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c)
                rows.append([p, *[h[k] for k in names[1:]]])
            yield pd.DataFrame(rows, columns=names)

    return _files(spark, path).mapInPandas(run, HEADER)


def axis_codes(affine: np.ndarray) -> str:
    """The letters towards which a voxel's axes run (R or L, A or P, S or I), by the largest shares of the map's polar factor."""
    m = np.asarray(affine, float)[:3, :3]
    size = np.sqrt((m * m).sum(0))
    u, _, vt = np.linalg.svd(m / np.where(size > 0, size, 1))
    share, out = u @ vt, ""
    for axis in range(3):
        k = int(np.argmax(np.abs(share[:, axis])))
        out += ("RAS" if share[k, axis] >= 0 else "LPI")[k]
        share[k] = 0
    return out


def with_geometry(headers: DataFrame) -> DataFrame:
    """headers with the field of view in mm (places times sizes of the first three axes) and the orientation's letters."""
    codes = F.pandas_udf(lambda s: s.map(lambda a: axis_codes(np.stack(a))), "string")
    fov = F.zip_with(F.slice("shape", 1, 3), F.slice("zooms", 1, 3), lambda d, z: d * z)
    return headers.withColumn("fov_mm", fov).withColumn("orientation", codes("affine"))


def read_nifti(spark: SparkSession, path: str, signal: bool | None = None) -> DataFrame:
    """One row per voxel: (path, x, y, z, value), or signal arrays over the fourth axis with signal=True. A file is decoded in one task and sent on in pieces."""
    many = bool(signal)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                _, a = nifti_array(c)
                a = a.reshape(*a.shape[:3], -1) if a.ndim > 3 or many else a.reshape((*a.shape, 1, 1)[:3] + (1,))
                n = int(np.prod(a.shape[:3]))
                flat = a.reshape(n, -1)
                for k in range(0, n, CHUNK):
                    at = np.unravel_index(np.arange(k, min(k + CHUNK, n)), a.shape[:3])
                    out = pd.DataFrame({"path": p, **{name: v.astype(np.int32) for name, v in zip("xyz", at, strict=True)}})
                    out["signal" if many else "value"] = list(flat[k : k + CHUNK]) if many else flat[k : k + CHUNK, 0]
                    yield out

    return _files(spark, path).mapInPandas(run, "path string, x int, y int, z int, " + ("signal array<double>" if many else "value double"))


LINES = "path string, sl_id long, points array<struct<x: double, y: double, z: double>>"


def trk_lines(raw: bytes) -> list[np.ndarray]:
    """Points in world coordinates: voxel millimetres are moved by the header's matrix where it has one."""
    scalars, props = struct.unpack_from("<h", raw, 36)[0], struct.unpack_from("<h", raw, 238)[0]
    size = np.array(struct.unpack_from("<3f", raw, 12))
    m = np.array(struct.unpack_from("<16f", raw, 440)).reshape(4, 4)
    out, at = [], struct.unpack_from("<i", raw, 996)[0]
    while at + 4 <= len(raw):
        n = struct.unpack_from("<i", raw, at)[0]
        p = np.frombuffer(raw, "<f4", n * (3 + scalars), at + 4).reshape(n, -1)[:, :3].astype(float)
        at += 4 + 4 * (n * (3 + scalars) + props)
        out.append((p / size - 0.5) @ m[:3, :3].T + m[:3, 3] if m[3, 3] else p)
    return out


def trk_bytes(lines: list[np.ndarray], affine: np.ndarray, shape: tuple[int, int, int]) -> bytes:
    return trk_head(len(lines), affine, shape) + trk_body(lines, affine)


def trk_head(count: int, affine: np.ndarray, shape: tuple[int, int, int]) -> bytes:
    m = np.asarray(affine, float)
    raw = bytearray(1000)
    raw[:6] = b"TRACK\0"
    struct.pack_into("<3h", raw, 6, *shape)
    struct.pack_into("<3f", raw, 12, *np.linalg.norm(m[:3, :3], axis=0))
    struct.pack_into("<16f", raw, 440, *m.ravel())
    raw[948:951] = b"RAS"
    struct.pack_into("<iii", raw, 988, count, 2, 1000)
    return bytes(raw)


def trk_body(lines: list[np.ndarray], affine: np.ndarray) -> bytes:
    m = np.asarray(affine, float)
    size, inv = np.linalg.norm(m[:3, :3], axis=0), np.linalg.inv(m)
    body = []
    for p in lines:
        v = ((p @ inv[:3, :3].T + inv[:3, 3]) + 0.5) * size
        body += [struct.pack("<i", len(p)), np.asarray(v, "<f4").tobytes()]
    return b"".join(body)


def tck_lines(raw: bytes) -> list[np.ndarray]:
    head = raw[: raw.index(b"END")].decode("latin-1")
    at = int(next(x for x in head.splitlines() if x.startswith("file:")).split()[-1])
    kind = ">f4" if "Float32BE" in head else "<f4"
    p = np.frombuffer(raw[at : at + (len(raw) - at) // 12 * 12], kind).reshape(-1, 3).astype(float)
    stop = np.flatnonzero(np.isinf(p).any(1))
    p = p[: stop[0]] if len(stop) else p
    cut = np.flatnonzero(np.isnan(p).any(1))
    return [q[~np.isnan(q).any(1)] for q in np.split(p, cut) if (~np.isnan(q).any(1)).any()]


def tck_bytes(lines: list[np.ndarray]) -> bytes:
    return tck_head(len(lines)) + tck_body(lines) + tck_end()


def tck_head(count: int) -> bytes:
    head = f"mrtrix tracks\ndatatype: Float32LE\ncount: {count}\nfile: . %d\nEND\n"
    at = len(head) + 4
    return (head % at).encode().ljust(at, b"\n")


def tck_body(lines: list[np.ndarray]) -> bytes:
    return b"".join([x for p in lines for x in (np.asarray(p, "<f4").tobytes(), np.full(3, np.nan, "<f4").tobytes())])


def tck_end() -> bytes:
    return np.full(3, np.inf, "<f4").tobytes()


def read_streamlines(spark: SparkSession, path: str) -> DataFrame:
    """(path, sl_id, points) of .trk and .tck files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                lines = trk_lines(c) if c[:5] == b"TRACK" else tck_lines(c)
                for k in range(0, len(lines), 1000):
                    part = lines[k : k + 1000]
                    yield pd.DataFrame({"path": p, "sl_id": np.arange(k, k + len(part)), "points": [[{"x": a, "y": b, "z": c_} for a, b, c_ in q.tolist()] for q in part]})

    return _files(spark, path).where(F.col("path").rlike(r"\.(trk|tck)$")).mapInPandas(run, LINES)
