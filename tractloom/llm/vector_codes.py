"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

Every part position has a vantage-point tree over its entries. A node holds one entry and, for the entries on either
side of its median distance, the smallest and largest distance; a leaf holds a few entries. Batches of parts go down
the tree together (branch and bound): at a node the exact integer squared distance to its entry is taken, and a side is
visited by those parts for which a nearer or equal entry may lie there. Bounds are floating point, with radii rounded
outwards and a non-strict comparison, so rounding or a tie never prunes an entry; which entry wins is decided by
integers alone, ties to the lower number.

A round hands on a row for each position and entry used in a task, summed by groupBy: at most positions x entries rows
reach the driver. Codebooks are that small; everything else stays in tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.llm import vectors
from tractloom.llm.runtime import stored

WIDTH, SCALE, PARTS, ENTRIES, ROUNDS = 64, 256, 16, 64, 2
#: Entries in a leaf of a tree.
LEAF = 6
#: Relative slack of floating-point distances, many times their rounding error.
SLACK = 1e-9
#: Labels that may be broadcast with their sums; beyond that the join is salted.
BROADCAST_LABELS, SALT = 200_000, 64
TOP = np.iinfo(np.int64).max


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows (or one row) to one entry (or rows of entries)."""
    return np.square(x - entry).sum(-1)


@dataclass
class Node:
    entries: np.ndarray  # numbers: of a leaf all of its entries, else the vantage point
    inner: Node | None = None
    outer: Node | None = None
    inner_range: tuple[float, float] = (0.0, 0.0)
    outer_range: tuple[float, float] = (0.0, 0.0)


def _range(d: np.ndarray) -> tuple[float, float]:
    """Smallest and largest distance, rounded outwards."""
    r = np.sqrt(d.astype(np.float64))
    return float(r.min() * (1 - SLACK)), float(r.max() * (1 + SLACK))


def grown(codebook: np.ndarray, members: np.ndarray | None = None) -> Node:
    """The tree over some entries of a codebook. The vantage point is the entry with the widest spread of distances."""
    members = np.arange(len(codebook)) if members is None else members
    if len(members) <= LEAF:
        return Node(members)
    d = np.square(codebook[members][:, None, :] - codebook[members][None, :, :]).sum(2)
    v = int(np.sqrt(d.astype(np.float64)).std(1).argmax())
    others = np.delete(np.arange(len(members)), v)
    order = others[np.argsort(d[v][others], kind="stable")]
    near, far = order[: len(order) // 2], order[len(order) // 2 :]
    return Node(members[v : v + 1], grown(codebook, members[near]), grown(codebook, members[far]), _range(d[v][near]), _range(d[v][far]))


class Search:
    """Nearest entries of many parts at once."""

    def __init__(self, codebook: np.ndarray):
        self.codebook, self.tree = codebook, grown(codebook)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry number and squared distance of each row of x."""
        self.x, self.best, self.entry = x, np.full(len(x), TOP), np.full(len(x), len(self.codebook), np.int64)
        self._visit(self.tree, np.arange(len(x)))
        return self.entry, self.best

    def _take(self, rows: np.ndarray, number: int, d: np.ndarray) -> None:
        win = (d < self.best[rows]) | ((d == self.best[rows]) & (number < self.entry[rows]))
        self.best[rows[win]], self.entry[rows[win]] = d[win], number

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        if node.inner is None:
            x = self.x[rows]
            for e in node.entries.tolist():
                self._take(rows, e, squared(x, self.codebook[e]))
            return
        v = int(node.entries[0])
        d = squared(self.x[rows], self.codebook[v])
        self._take(rows, v, d)
        r = np.sqrt(d.astype(np.float64))
        low = [np.maximum(r * (1 - SLACK) - hi, lo - r * (1 + SLACK)) for lo, hi in (node.inner_range, node.outer_range)]
        first_inner = low[0] <= low[1]
        for side, bound, first in ((node.inner, low[0], first_inner), (node.outer, low[1], ~first_inner), (node.inner, low[0], ~first_inner), (node.outer, low[1], first_inner)):
            near = first & (bound <= np.sqrt(self.best[rows].astype(np.float64)) * (1 + SLACK))
            if near.any():
                self._visit(side, rows[near])


def encoded(x: np.ndarray, searches: list[Search]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x positions) and squared distances summed over positions."""
    w = x.shape[1] // len(searches)
    code, error = np.empty((len(x), len(searches)), np.int64), np.zeros(len(x), np.int64)
    for p, s in enumerate(searches):
        code[:, p], d = s.nearest(np.ascontiguousarray(x[:, p * w : (p + 1) * w]))
        error += d
    return code, error


def improved(data: DataFrame, books: np.ndarray, width: int, scale: int) -> np.ndarray:
    """One round: entries at the floor of the mean of the parts that are nearest to them; unused entries stay."""
    parts, entries, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(b) for b in books]
        total, count = np.zeros((parts * entries, w), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            if b.num_rows:
                x = vectors.matrix(b.column(0), width, scale)
                code, _ = encoded(x, searches)
                for p in range(parts):
                    cell = p * entries + code[:, p]
                    order = np.argsort(cell, kind="stable")
                    on, first = np.unique(cell[order], return_index=True)
                    total[on] += np.add.reduceat(x[order, p * w : (p + 1) * w], first, axis=0)
                count += np.bincount((np.arange(parts) * entries + code).ravel(), minlength=parts * entries)
        on = np.flatnonzero(count)
        s = pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1) * w, pa.int32()), pa.array(total[on].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(count[on]), s], names=["cell", "n", "s"])

    rows = data.select("v").mapInArrow(run, "cell int, n long, s array<long>")
    sums = rows.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(w)])
    out = books.copy()
    for r in sums.collect():
        out[r["cell"] // entries, r["cell"] % entries] = [r[f"s{j}"] // r["n"] for j in range(w)]
    return out


def fit(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, width: int = WIDTH, scale: int = SCALE) -> np.ndarray:
    """Codebooks (positions x entries x components). They start as the parts of the vectors with the smallest ids."""
    if width % parts:
        raise ValueError(f"{width} components can't be cut into {parts} equal parts")
    if not 0 < entries <= 256:
        raise ValueError("an entry's number must fit two hexadecimal digits")
    good = vectors.kept(df, vector, width)
    start = vectors.first_rows(good.where(F.col(f"`{id_column}`").isNotNull()), [F.col(f"`{id_column}`")], vector, entries, scale)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy() if len(start) else np.zeros((parts, 0, width // parts), np.int64)
    data = good.select(F.col(f"`{vector}`").alias("v"))
    for _ in range(rounds if len(start) else 0):
        books = improved(data, books, width, scale)
    return books


def codes(df: DataFrame, books: np.ndarray, carry: list[str], vector: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """_row (struct c0, c1, .. of the carried columns), code and error of each usable vector; null without codebooks."""
    src = vectors.kept(df, vector, width).select(F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("_row"), F.col(f"`{vector}`").alias("v"))
    schema = T.StructType([src.schema["_row"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(b) for b in books] if books.shape[1] else None
        for b in batches:
            if not b.num_rows:
                continue
            if searches is None:
                code, error = pa.nulls(b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.int64())
            else:
                c, e = encoded(vectors.matrix(b.column(1), width, scale), searches)
                text, size = c.astype(np.uint8).tobytes().hex(), 2 * len(books)
                code, error = pa.array([text[i * size : (i + 1) * size] for i in range(len(c))], pa.string()), pa.array(e)
            yield pa.RecordBatch.from_arrays([b.column(0), code, error], names=["_row", "code", "error"])

    return src.mapInArrow(run, schema)


def decoded(code: str, books: np.ndarray) -> list[int]:
    """The integers that a code stands for."""
    return [int(x) for p, e in enumerate(bytes.fromhex(code)) for x in books[p, e]]


def compressed(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 of each usable vector of df.

    Left out are rows whose vector is null, has not width components, or holds null or non-finite ones. Components
    become floor(scale * x); beyond +-2^27 they are held there, so that distances fit a long. Rows that repeat an id
    count as vectors of their own; rows without id are coded, but start no entry; if no row has an id, codes are null.
    Equal distances go to the lower entry. Null labels are one label; a label's errors that don't fit a long give null.
    An empty table gives no rows. Other columns are not read.
    """
    books = fit(df, id_column, vector, rounds, parts, entries, width, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = codes(df, books, [id_column, label], vector, width, scale)
    rows = stored(rows.select(F.col("_row.c0").alias("id"), F.col("_row.c1").alias("label"), "code", "error"), "codes")
    sums = rows.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    sums = stored(sums, "labels")
    if sums.count() <= BROADCAST_LABELS:
        out = rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    else:
        salted = sums.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALT)).cast("int"))
        out = rows.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of")))
    return out.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
