"""Volumes, streamlines and matrices as tables: data sources nifti, trk, tck and npy for spark.read and df.write.

    register(spark)
    spark.read.format("nifti").option("signal", "true").load(path)
    write_nifti(voxels, path, shape=(96, 96, 60))

Files are read in pieces by several tasks wherever the format lets a piece be found: an uncompressed volume by slabs of
z, a TCK file by ranges of points, a matrix by ranges of rows. A compressed volume and a TRK file, whose records have no
index, are one piece each, read as a stream. Paths are opened through pyarrow's file systems, so all machines must see them.

Tasks write under _temporary-<id>; the files take their names when the whole job commits, and go when it is aborted. A
volume or matrix is one file: write_nifti() and write_npy() bring its rows together first; a file that two tasks wrote is
an error. Streamlines are written as one file a task.
"""

from __future__ import annotations

import gzip
import io
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tractloom.sources import volumes as vol

#: Bytes of a file that one task reads, unless the option pieceBytes says otherwise.
PIECE_BYTES = 64 << 20
#: Rows in a batch on the way out.
ROWS = 50_000
VOXELS = "path string, x int, y int, z int, value double"
SIGNALS = "path string, x int, y int, z int, signal array<double>"
LINES = "path string, sl_id long, points array<struct<x: double, y: double, z: double>>"
MATRIX = "path string, u long, row array<double>"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[5:]
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def found(path: str, endings: tuple[str, ...]) -> list[str]:
    """Files with one of these endings at or under a path, in order; names that begin with _ or . are passed over."""
    fs, p = opened(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(p, recursive=True))
    prefix = path[: len(path) - len(p)] if path.endswith(p) else ""
    inside = lambda x: not any(part[:1] in "_." for part in x[len(p) :].split("/") if part)
    return sorted(prefix + x.path for x in infos if x.type == pafs.FileType.File and x.path.endswith(endings) and inside(x.path))


def piece(path: str, at: int, size: int) -> bytes:
    fs, p = opened(path)
    with fs.open_input_file(p) as f:
        f.seek(at)
        return f.read(size)


@dataclass
class Piece(InputPartition):
    path: str
    first: int
    end: int
    extra: tuple = ()


def points_array(lines: list[np.ndarray]) -> pa.Array:
    p = np.concatenate(lines) if lines else np.zeros((0, 3))
    off = np.concatenate([[0], np.cumsum([len(q) for q in lines], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(p[:, k])) for k in range(3)], names=["x", "y", "z"]))


def each_path(points: pa.Array) -> Iterator[np.ndarray]:
    """The points of each row as a matrix, read in place; a null row has none."""
    size = points.value_lengths().fill_null(0).to_numpy()
    one = points.flatten()
    p = np.stack([pc.struct_field(one, c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], 1)
    end = np.cumsum(size)
    return (p[e - k : e] for e, k in zip(end.tolist(), size.tolist(), strict=True))


class Reader(DataSourceReader):
    endings: tuple[str, ...] = ()

    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("piecebytes", PIECE_BYTES))

    def partitions(self) -> list[Piece]:
        return [p for f in found(self.path, self.endings) for p in self.pieces(f)]

    def pieces(self, path: str) -> list[Piece]:
        return [Piece(path, 0, -1)]


class NiftiReader(Reader):
    endings = (".nii", ".nii.gz")

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.signal = options.get("signal", "false").lower() == "true"

    def pieces(self, path: str) -> list[Piece]:
        if path.endswith(".gz"):
            return [Piece(path, 0, -1)]
        h = vol.nifti_header(piece(path, 0, 348))
        shape = (h["shape"] + [1, 1, 1, 1])[:4]
        slab = shape[0] * shape[1] * shape[3] * np.dtype(vol.KINDS[h["kind"]]).itemsize
        step = max(1, self.size // max(slab, 1))
        return [Piece(path, z, min(z + step, shape[2])) for z in range(0, shape[2], step)]

    def read(self, p: Piece) -> Iterator[pa.RecordBatch]:
        if p.path.endswith(".gz"):
            fs, at = opened(p.path)
            with fs.open_input_stream(at, compression="gzip") as f:
                raw = f.read()
            take = lambda a, n: raw[a : a + n]
        else:
            take = lambda a, n: piece(p.path, a, n)
        h = vol.nifti_header(take(0, 348))
        nx, ny, nz, *rest = (h["shape"] + [1, 1, 1])[: max(3, len(h["shape"]))]
        nt, kind = int(np.prod(rest or [1])), np.dtype(vol.KINDS[h["kind"]]).newbyteorder(h["order"])
        end, plane = nz if p.end < 0 else p.end, nx * ny
        last = nt if self.signal else 1
        cube = np.empty((last, (end - p.first) * plane))
        for t in range(last):
            cube[t] = np.frombuffer(take(h["offset"] + kind.itemsize * (t * plane * nz + p.first * plane), kind.itemsize * cube.shape[1]), kind)
        if h["slope"] not in (0.0, 1.0) or h["inter"]:
            cube = cube * h["slope"] + h["inter"]
        for k in range(0, cube.shape[1], ROWS):
            i = np.arange(k, min(k + ROWS, cube.shape[1]))
            value = pa.array(np.ascontiguousarray(cube[0, i]))
            if self.signal:
                value = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * nt), pa.array(np.ascontiguousarray(cube[:, i].T).ravel()))
            at = [(i % nx).astype(np.int32), (i // nx % ny).astype(np.int32), (p.first + i // plane).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([p.path] * len(i)), *map(pa.array, at), value], names=["path", "x", "y", "z", "signal" if self.signal else "value"])


def line_batches(path: str, lines: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    got: list[tuple[int, np.ndarray]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(got)), pa.array([k for k, _ in got], pa.int64()), points_array([q for _, q in got])], names=["path", "sl_id", "points"])

    for x in lines:
        got.append(x)
        size += len(x[1])
        if size >= ROWS:
            yield batch()
            got, size = [], 0
    if got:
        yield batch()


class TrkReader(Reader):
    """sl_id is the number of the streamline in its file."""

    endings = (".trk",)

    def read(self, p: Piece) -> Iterator[pa.RecordBatch]:
        fs, at = opened(p.path)
        with fs.open_input_stream(at, compression=None) as f:
            head = f.read(1000)
            scalars, props = struct.unpack_from("<h", head, 36)[0], struct.unpack_from("<h", head, 238)[0]
            size, m = np.array(struct.unpack_from("<3f", head, 12)), np.array(struct.unpack_from("<16f", head, 440)).reshape(4, 4)

            def lines() -> Iterator[tuple[int, np.ndarray]]:
                k = 0
                while len(n := f.read(4)) == 4:
                    n = struct.unpack("<i", n)[0]
                    q = np.frombuffer(f.read(4 * n * (3 + scalars)), "<f4").reshape(n, -1)[:, :3].astype(float)
                    f.read(4 * props)
                    yield k, (q / size - 0.5) @ m[:3, :3].T + m[:3, 3] if m[3, 3] else q
                    k += 1

            yield from line_batches(p.path, lines())


class TckReader(Reader):
    """sl_id is the place of the streamline's first point in its file, so that pieces number theirs alone."""

    endings = (".tck",)

    def pieces(self, path: str) -> list[Piece]:
        head = piece(path, 0, 1 << 16)
        text = head[: head.index(b"END")].decode("latin-1")
        at = int(next(x for x in text.splitlines() if x.startswith("file:")).split()[-1])
        fs, p = opened(path)
        n = (fs.get_file_info(p).size - at) // 12
        step = max(1, self.size // 12)
        return [Piece(path, k, min(k + step, n), (at, n, "Float32BE" in text)) for k in range(0, n, step)]

    def read(self, p: Piece) -> Iterator[pa.RecordBatch]:
        at, n, big = p.extra

        def triples(a: int, b: int) -> np.ndarray:
            return np.frombuffer(piece(p.path, at + 12 * a, 12 * (b - a)), ">f4" if big else "<f4").reshape(-1, 3).astype(float)

        def lines() -> Iterator[tuple[int, np.ndarray]]:
            # A streamline belongs to the piece that its first point lies in; what is open before the piece is skipped.
            begin = p.first
            x = triples(max(begin - 1, 0), p.end)
            open_ = begin > 0 and np.isfinite(x[0]).all()
            x = x[1:] if begin > 0 else x
            cut = np.flatnonzero(~np.isfinite(x).all(1))
            if open_:
                if not len(cut):
                    return
                first = int(cut[0]) + 1 if not np.isinf(x[cut[0]]).any() else len(x)
            else:
                first = 0
            for c in cut[cut >= first].tolist():
                if c > first:
                    yield begin + first, x[first:c]
                if np.isinf(x[c]).any():
                    return
                first = c + 1
            if first < len(x):
                rest, k = [x[first:]], p.end
                while k < n:
                    y = triples(k, min(k + 4096, n))
                    stop = np.flatnonzero(~np.isfinite(y).all(1))
                    rest.append(y[: stop[0]] if len(stop) else y)
                    if len(stop):
                        break
                    k += len(y)
                yield begin + first, np.concatenate(rest)

        yield from line_batches(p.path, lines())


class NpyReader(Reader):
    endings = (".npy",)

    def pieces(self, path: str) -> list[Piece]:
        f = io.BytesIO(piece(path, 0, 1 << 16))
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if fortran or len(shape) != 2 or kind.hasobject:
            raise ValueError(f"{path}: a matrix of numbers by rows is needed")
        step = max(1, self.size // max(1, shape[1] * kind.itemsize))
        return [Piece(path, k, min(k + step, shape[0]), (f.tell(), shape[1], kind.str)) for k in range(0, shape[0], step)]

    def read(self, p: Piece) -> Iterator[pa.RecordBatch]:
        at, width, kind = p.extra
        kind, n = np.dtype(kind), p.end - p.first
        a = np.frombuffer(piece(p.path, at + p.first * width * kind.itemsize, n * width * kind.itemsize), kind).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([p.path] * n), pa.array(np.arange(p.first, p.end)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(a))], names=["path", "u", "row"])


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)  # (temporary path, name, first row)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.options, self.overwrite, self.path = options, overwrite, options["path"].rstrip("/")
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def put(self, name: str, data: bytes | Iterable[bytes]) -> str:
        fs, p = opened(f"{self.temporary}/{uuid.uuid4().hex}-{name.replace('/', '_')}")
        fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(p, compression=None) as f:
            for block in [data] if isinstance(data, bytes) else data:
                f.write(block)
        return p

    def cleared(self, fs: pafs.FileSystem, at: str) -> None:
        """Removes what is to be overwritten, but not what this job wrote."""
        for x in fs.get_file_info(pafs.FileSelector(at)) if self.overwrite and fs.get_file_info(at).type == pafs.FileType.Directory else ():
            if not x.base_name.startswith("_"):
                fs.delete_dir(x.path) if x.type == pafs.FileType.Directory else fs.delete_file(x.path)

    def commit(self, messages: list[Written | None]) -> None:
        files = [x for m in messages if m for x in m.files]
        names = [name for _, name, _ in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several tasks hold parts of one file: bring its rows together before writing")
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        self.cleared(fs, at)
        for p, name, _ in files:
            target = f"{at}/{name}"
            fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
            fs.move(p, target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, p = opened(self.temporary)
        if fs.get_file_info(p).type != pafs.FileType.NotFound:
            fs.delete_dir(p)


class NiftiWriter(Writer):
    """Rows name, x, y, z and value or signal. Voxels without a row are 0; the shape is that of the option, else up to the largest place."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        t = pa.Table.from_batches(list(batches))
        out = Written()
        if not t.num_rows:
            return out
        shape = [int(v) for v in self.options["shape"].split(",")] if "shape" in self.options else None
        affine = np.array([float(v) for v in self.options["affine"].split(",")]).reshape(-1, 4) if "affine" in self.options else None
        for name in sorted(set(t.column("name").to_pylist())):
            x = t.filter(pa.compute.equal(t.column("name"), name))
            at = [x.column(c).to_numpy() for c in "xyz"]
            size = shape[:3] if shape else [int(v.max()) + 1 for v in at]
            if "signal" in x.column_names:
                v = np.stack(x.column("signal").to_pylist()).astype(float)
                a = np.zeros((*size, v.shape[1]))
            else:
                v = x.column("value").to_numpy().astype(float)
                a = np.zeros(size)
            a[tuple(at)] = v
            raw = vol.nifti_bytes(a, affine, kind=self.options.get("kind", "f4"))
            zipped = name.endswith(".gz")
            file = name if name.endswith((".nii", ".nii.gz")) else f"{name}.nii"
            out.files.append((self.put(file, gzip.compress(raw) if zipped else raw), file, 0))
        return out


class LinesWriter(Writer):
    kind = "tck"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """A batch's streamlines go to the task's own temporary file; the head, which counts them, comes before it on the way out."""
        affine = np.array([float(v) for v in self.options["affine"].split(",")]).reshape(-1, 4)[:4] if "affine" in self.options else np.eye(4)
        affine = np.vstack([affine, [0, 0, 0, 1]]) if len(affine) == 3 else affine
        count = 0
        with tempfile.TemporaryFile() as body:
            for b in batches:
                lines = list(each_path(b.column(b.schema.get_field_index("points"))))
                body.write(vol.trk_body(lines, affine) if self.kind == "trk" else vol.tck_body(lines))
                count += len(lines)
            if not count:
                return Written()
            if self.kind == "trk":
                head, end = vol.trk_head(count, affine, tuple(int(v) for v in self.options.get("shape", "1,1,1").split(","))), b""
            else:
                head, end = vol.tck_head(count), vol.tck_end()
            body.seek(0)
            name = f"part-{uuid.uuid4().hex}.{self.kind}"
            return Written([(self.put(name, chain([head], iter(lambda: body.read(1 << 22), b""), [end])), name, 0)])


class TrkWriter(LinesWriter):
    kind = "trk"


class NpyWriter(Writer):
    """Rows u, row in ascending u within each task and over the tasks, as write_npy() deals them; one file <path>/matrix.npy."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        t = pa.Table.from_batches(list(batches))
        if not t.num_rows:
            return Written()
        t = t.sort_by("u")
        rows = np.stack(t.column("row").to_pylist()).astype("<f8")
        return Written([(self.put(f"rows-{t.column('u')[0].as_py()}", rows.tobytes()), rows.shape, t.column("u")[0].as_py())])

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((x for m in messages if m for x in m.files), key=lambda x: x[2])
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        self.cleared(fs, at)
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": "<f8", "fortran_order": False, "shape": (sum(s[0] for _, s, _ in files), files[0][1][1] if files else 0)})
        with fs.open_output_stream(f"{at}/matrix.npy") as out:
            out.write(head.getvalue())
            for p, _, _ in files:
                with fs.open_input_stream(p) as f:
                    while block := f.read(1 << 22):
                        out.write(block)
        self.abort(messages)


class Files(DataSource):
    kind, columns, reads, writes = "", "", Reader, Writer

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: StructType) -> Reader:
        return self.reads({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return self.writes({k.lower(): v for k, v in self.options.items()}, overwrite)


class Nifti(Files):
    kind, reads, writes = "nifti", NiftiReader, NiftiWriter

    def schema(self) -> str:
        return SIGNALS if self.options.get("signal", "false").lower() == "true" else VOXELS


class Trk(Files):
    kind, columns, reads, writes = "trk", LINES, TrkReader, TrkWriter


class Tck(Files):
    kind, columns, reads, writes = "tck", LINES, TckReader, LinesWriter


class Npy(Files):
    kind, columns, reads, writes = "npy", MATRIX, NpyReader, NpyWriter


def register(spark: SparkSession) -> SparkSession:
    for s in (Nifti, Trk, Tck, Npy):
        spark.dataSource.register(s)
    return spark


def _numbers(values: object) -> str:
    return ",".join(str(v) for v in np.asarray(values).ravel().tolist())


def write_nifti(voxels: DataFrame, path: str, shape: tuple[int, ...] | None = None, affine: np.ndarray | None = None, kind: str = "f4", mode: str = "append") -> None:
    """One volume for each name of voxels (name, x, y, z, value or signal); each is a task's work."""
    w = register(voxels.sparkSession) and voxels.repartition("name").write.format("nifti").mode(mode).option("kind", kind)
    for k, v in (("shape", shape), ("affine", affine)):
        w = w if v is None else w.option(k, _numbers(v))
    w.save(path)


def write_lines(lines: DataFrame, path: str, kind: str = "trk", affine: np.ndarray | None = None, shape: tuple[int, int, int] = (1, 1, 1), mode: str = "append") -> None:
    """Streamlines (points), a file for each task."""
    w = register(lines.sparkSession) and lines.select("points").write.format(kind).mode(mode).option("shape", _numbers(shape))
    (w if affine is None else w.option("affine", _numbers(affine))).save(path)


def write_npy(dense: DataFrame, path: str, mode: str = "overwrite") -> None:
    """dense (u, row) as <path>/matrix.npy, rows in the order of u. Rows are dealt by ranges of u and put together as bytes."""
    register(dense.sparkSession)
    dense.select(F.col("u").cast("long").alias("u"), "row").repartitionByRange("u").write.format("npy").mode(mode).save(path)
