"""Centroid clustering: plain Lloyd iterations over integer vectors.

Centroids (k rows of a fixed width) travel to the tasks with each round's function. A task takes Arrow batches as
pandas frames, computes the integer squared differences to each centroid in numpy and keeps the lowest index among the
nearest. It hands on one row for each centroid that got a vector: count and componentwise sums. These rows are summed
by groupBy, so at most k rows reach the driver, which divides exactly. No round keeps state outside these k rows: a lost
executor costs the tasks it ran.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.llm import vectors
from tractloom.llm.runtime import stored

WIDTH, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Vectors that are compared with all centroids at a time.
BLOCK = 8192


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid of each row (ties: the lowest) and the squared distance, all in integers."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    index = np.zeros(len(x), np.int32)
    for lo in range(0, len(x), BLOCK):
        part = x[lo : lo + BLOCK]
        d = np.stack([np.square(part - c).sum(1) for c in centroids], 1)
        index[lo : lo + BLOCK] = i = d.argmin(1)
        best[lo : lo + BLOCK] = np.take_along_axis(d, i[:, None], 1)[:, 0]
    return index, best


def _rows(frame: pd.DataFrame, scale: int) -> np.ndarray:
    return vectors.floored(np.stack(frame["v"].to_numpy()), scale)


def moved(data: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """One round: centroids at the floor of the mean of the vectors that are nearest to them; those without vectors stay."""
    k, width = centroids.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for f in frames:
            if len(f):
                x = _rows(f, scale)
                i, _ = nearest(x, centroids)
                for c in np.unique(i):
                    total[c] += x[i == c].sum(0)
                count += np.bincount(i, minlength=k)
        on = np.flatnonzero(count)
        if len(on):
            yield pd.DataFrame({"cluster": on.astype(np.int32), "n": count[on], "s": list(total[on])})

    parts = data.select("v").mapInPandas(run, "cluster int, n long, s array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(width)])
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return out


def fit(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """Centroids after all rounds. They start as the k vectors with the smallest sha256 of 'seed:id'; rows without id don't start any."""
    good = vectors.kept(df, vector, width)
    named = good.where(F.col(f"`{id_column}`").isNotNull())
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_column}`").cast("string")), 256)
    centroids = vectors.first_rows(named, [key], vector, k, scale)
    data = good.select(F.col(f"`{vector}`").alias("v"))
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(data, centroids, scale)
    return centroids


def assigned(df: DataFrame, centroids: np.ndarray, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, cluster, distance of each usable vector of df. Without any centroid, cluster and distance are null."""
    good = vectors.kept(df, vector, centroids.shape[1] if len(centroids) else WIDTH)
    kind = dict(df.dtypes)[id_column]
    src = good.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    if not len(centroids):
        return src.select(F.col("id").alias(id_column), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                i, d = nearest(_rows(f, scale), centroids)
                yield pd.DataFrame({"id": f["row"].map(lambda r: r["id"]), "cluster": i, "distance": d})

    # The id travels in a struct: pandas would turn a column of longs with nulls into doubles.
    rows = src.select(F.struct("id").alias("row"), "v").mapInPandas(run, f"id {kind}, cluster int, distance long")
    return rows.withColumnRenamed("id", id_column)


def clustered(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each usable vector of df.

    Left out are rows whose vector is null, has not width components, or holds null or non-finite ones. Components
    become floor(scale * x); beyond +-2^27 they are held there, so that distances fit a long. Rows that repeat an id
    count as vectors of their own; rows without id are clustered, but start no centroid. With fewer than k vectors there
    are fewer centroids. Equal distances go to the lower number. An empty table gives no rows. Other columns are not read.
    """
    centroids = fit(df, id_column, vector, k, rounds, width, scale, seed)
    rows = stored(assigned(df, centroids, id_column, vector, scale), "clusters")
    sums = {r["cluster"]: r["s"] for r in rows.where("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    top = (1 << 63) - 1

    def of(values: list[object], kind: str) -> F.Column:
        """The value of the row's cluster, out of at most k."""
        out = F.lit(None).cast(kind)
        for c, x in enumerate(values):
            out = F.when(F.col("cluster") == c, F.lit(x).cast(kind)).otherwise(out)
        return out

    n = len(centroids)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return rows.select(
        id_column, "cluster", "distance", of([min(top, int(sums.get(c, 0))) for c in range(n)], "long").alias("cluster_inertia"),
        F.when(F.col("cluster").isNotNull(), F.lit(min(top, int(sum(sums.values())))).cast("long")).alias("inertia"), of(digests, "string").alias("centroid_sha256"),
    )
