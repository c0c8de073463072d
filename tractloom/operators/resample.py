"""Bootstrap of a caller's statistic by Poisson weights.

Each row counts in each replicate as often as a Poisson number with mean 1, a function of seed, row id and replicate. A
statistic of sums (means, ratios, variances, correlations, slopes) then needs only weighted sums, which add up on the map
side. Quantiles need only a histogram: a bin of n rows counts as often as a Poisson number with mean n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sums that a task holds before it sends them on, and weights that it draws at once.
HELD, AT_ONCE = 4_000_000, 4_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A counter-based generator's 64 bits."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(ids: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """Rows x (1 + n_boot): 1 in column 0, the sample itself; Poisson numbers in the others."""
    steps = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))
    with np.errstate(over="ignore"):
        row = _mixed(ids.astype(np.uint64) ^ _mixed(np.array([seed], np.uint64)))
        u = (_mixed(row[:, None] + _mixed(np.arange(n_boot + 1, dtype=np.uint64))[None]) >> np.uint64(11)) * 2.0**-53
    w = np.searchsorted(steps, u, "right").astype(float)
    w[:, 0] = 1.0
    return w


def replicates(values: DataFrame, by: Sequence[str], id: str, sums: dict[str, Column], statistic: Callable[..., Column], n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """(by, r, stat): the statistic of each replicate r; r = 0 is the sample itself.

    sums names what is summed over rows, statistic takes these sums by name: mean is
    sums={"n": F.lit(1), "v": F.col("value")}, statistic=lambda n, v: v / n. A null adds nothing to its sum. Rows with one
    id share their weights, so an id may be a subject with many rows. Null keys are a group.
    """
    names = list(sums)
    x = values.select(*by, F.xxhash64(id).alias("_id"), *[c.cast("double").alias(f"_s{k}") for k, c in enumerate(sums.values())])
    schema = T.StructType([*values.select(*by).schema.fields, T.StructField("r", T.IntegerType()), *[T.StructField(f"_s{k}", T.DoubleType()) for k in range(len(names))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def sent() -> Iterator[pa.RecordBatch]:
            for key, s in held.items():
                cols = [pa.array([k] * len(s), t) for k, t in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(len(s)), pa.int32()), *[pa.array(s[:, k]) for k in range(len(names))]], names=schema.names)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(k).type for k in range(len(by))]
            index: dict[tuple, int] = {}
            rows = zip(*[batch.column(k).to_pylist() for k in range(len(by))], strict=True) if by else iter([()] * batch.num_rows)
            code = np.array([index.setdefault(k, len(index)) for k in rows])
            ids = batch.column(len(by)).to_numpy().view(np.uint64)
            m = np.nan_to_num(np.stack([batch.column(len(by) + 1 + k).to_numpy(zero_copy_only=False) for k in range(len(names))], 1), nan=0.0)
            keys = list(index)
            order = np.argsort(code, kind="stable")
            step = max(1, AT_ONCE // (n_boot + 1))
            for k in range(0, len(order), step):
                o = order[k : k + step]
                some, back = np.unique(ids[o], return_inverse=True)
                w = weights(some, n_boot, seed)[back]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(code[o])) + 1, [len(o)]])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    key, s = keys[code[o[a]]], w[a:b].T @ m[o[a:b]]
                    held[key] = held[key] + s if key in held else s
                if len(held) * (n_boot + 1) * len(names) > HELD:
                    yield from sent()
        yield from sent()

    got = x.mapInArrow(run, schema).groupBy(*by, "r").agg(*[F.sum(f"_s{k}").alias(f"_s{k}") for k in range(len(names))])
    return got.select(*by, "r", statistic(**{n: F.col(f"_s{k}") for k, n in enumerate(names)}).alias("stat"))


def interval(reps: DataFrame, by: Sequence[str], level: float = 0.95) -> DataFrame:
    """(by, estimate, se, low, high) of replicates: their spread and percentiles. A replicate without a value (a group that got no row) counts nothing."""
    low = (1 - level) / 2
    drawn = F.when(F.col("r") > 0, F.col("stat"))
    out = [F.max(F.when(F.col("r") == 0, F.col("stat"))).alias("estimate"), F.stddev_samp(drawn).alias("se"), F.percentile(drawn, low).alias("low"), F.percentile(drawn, 1 - low).alias("high")]
    return reps.groupBy(*by).agg(*out)


def quantile_interval(values: DataFrame, by: Sequence[str], q: float = 0.5, n_boot: int = 1000, level: float = 0.95, seed: int = 42, bins: int = 4096) -> DataFrame:
    """(by, estimate, se, low, high) of a quantile, read from a histogram of equal bins between a group's least and largest value.

    values: by, value. All are within one bin's width of what whole rows give. Nulls and NaN count nothing; a group without
    values has no row. At most bins rows of a group meet in a task.
    """
    v = values.select(*by, F.col("value").cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    ends = v.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    x = v.join(ends, same) if by else v.crossJoin(F.broadcast(ends))
    at = F.floor(F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins)
    h = x.select(*by, "lo", "hi", F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).groupBy(*by, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"))
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by]) if by else F.lit(0).cast("long")
    schema = T.StructType([*values.select(*by).schema.fields, *[T.StructField(k, T.DoubleType()) for k in ("estimate", "se", "low", "high")]])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("bin")
        n, edge = t.column("n").to_numpy(), t.column("bin").to_numpy()
        lo, hi, start = (t.column(c)[0].as_py() for c in ("lo", "hi", "_key"))
        width = (hi - lo) / bins
        rng = np.random.default_rng([seed, start & (2**64 - 1)])

        def quantile(w: np.ndarray) -> np.ndarray:
            c = np.cumsum(w, 1)
            want = q * c[:, -1:]
            k = np.minimum((c < want).sum(1), w.shape[1] - 1)
            row = np.arange(len(w))
            before = c[row, k] - w[row, k]
            return np.where(c[:, -1] > 0, lo + (edge[k] + np.where(w[row, k] > 0, (want[:, 0] - before) / np.maximum(w[row, k], 1), 0)) * width, np.nan)

        step = max(1, AT_ONCE // len(n))
        drawn = np.concatenate([quantile(rng.poisson(n, (min(step, n_boot - k), len(n)))) for k in range(0, n_boot, step)])
        drawn = drawn[~np.isnan(drawn)]
        tail = (1 - level) / 2
        spread = [float(drawn.std(ddof=1)), *np.quantile(drawn, [tail, 1 - tail]).tolist()] if len(drawn) > 1 else [None] * 3
        out = [float(quantile(n[None])[0]), *spread]
        return pa.table({**{c: t.column(c).slice(0, 1) for c in by}, **{k: pa.array([x], pa.float64()) for k, x in zip(("estimate", "se", "low", "high"), out, strict=True)}})

    return h.withColumn("_key", key).groupBy(*by).applyInArrow(run, schema)
