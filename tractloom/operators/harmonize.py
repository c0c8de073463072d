"""Site harmonisation and confound removal over long features (id, feature, value). Only design matrices reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def standardized(values: DataFrame) -> DataFrame:
    """values (id, batch, feature, value): value minus its batch's mean of the feature, plus the mean of all. Windows see sums of a batch, not its rows."""
    b = values.groupBy(F.col("feature").alias("_f"), F.col("batch").alias("_b")).agg(F.sum("value").alias("_s"), F.count("value").alias("_n"))
    every = Window.partitionBy("_f")
    m = b.select("_f", "_b", F.try_divide("_s", "_n").alias("_m"), F.try_divide(F.sum("_s").over(every), F.sum("_n").over(every)).alias("stand_mean"))
    got = values.join(m, F.col("feature").eqNullSafe(F.col("_f")) & F.col("batch").eqNullSafe(F.col("_b")))
    return got.select("id", "batch", "feature", (F.col("value") - F.col("_m") + F.col("stand_mean")).alias("z"), "stand_mean")


def batch_parameters(z: DataFrame) -> DataFrame:
    """Location and scale of each batch and feature, shrunk towards the batch's features.

    The location's prior is normal, the scale's inverse gamma with moments from the features of the batch.
    """
    p = z.groupBy("feature", "batch").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("gamma"), F.var_samp("z").alias("delta"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    w = Window.partitionBy("batch")
    mu, v = F.avg("delta").over(w), F.var_pop("delta").over(w)
    p = p.withColumn("g_bar", F.avg("gamma").over(w)).withColumn("t2", F.var_pop("gamma").over(w)).withColumn("mu", mu).withColumn("v", v)
    k = F.col("t2") * F.try_divide(F.col("n").cast("double"), F.col("delta"))
    p = p.withColumn("gamma_star", F.coalesce((k * F.col("gamma") + F.col("g_bar")) / (k + 1.0), F.col("gamma")))
    ss = F.col("zz") - 2 * F.col("gamma_star") * F.col("n") * F.col("gamma") + F.col("n") * F.col("gamma_star") * F.col("gamma_star")
    ratio = F.try_divide(F.col("mu") * F.col("mu"), F.col("v"))
    delta = (F.col("mu") * (ratio + 1) + ss / 2) / (ratio + 2 + F.col("n") / 2.0 - 1)
    return p.select("feature", "batch", "n", "gamma", "delta", "gamma_star", F.coalesce(delta, F.col("delta")).alias("delta_star"))


def combat(values: DataFrame, mean_only: bool = False, shrink: bool = True, params: DataFrame | None = None) -> DataFrame:
    """Harmonised values. params: what batch_parameters() found on other rows of the same batches, for transforming new ones."""
    z = standardized(values)
    p = params if params is not None else batch_parameters(z)
    g, s = ("gamma_star", "delta_star") if shrink else ("gamma", "delta")
    p = p.select("feature", "batch", F.col(g).alias("g"), F.col(s).alias("s")).withColumn("mean_s", F.avg("s").over(Window.partitionBy("feature")))
    out = F.col("z") - F.col("g")
    if not mean_only:
        out = out / F.greatest(F.sqrt(F.coalesce(F.try_divide(F.col("s"), F.col("mean_s")), F.lit(1.0))), F.lit(1e-8))
    return z.join(p, ["feature", "batch"]).select("id", "batch", "feature", (out + F.col("stand_mean")).alias("value"))


#: Levels of a covariate that get indicators: the design matrix has a column for each.
MOST_LEVELS = 1000


def design(subjects: DataFrame, columns: list[str]) -> DataFrame:
    """(id, x): a constant and the encoded columns. Texts and numbers of under ten distinct values become indicators (the first left out), others z-scores. A text of more than MOST_LEVELS distinct values is refused, never cut."""
    parts = [F.lit(1.0)]
    kinds = dict(subjects.dtypes)
    for c in [c for c in columns if c in kinds]:
        most = MOST_LEVELS if kinds[c] == "string" else 9  # of numbers, only whether there are ten values
        levels = [r[0] for r in subjects.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(most + 1).collect()]
        if kinds[c] == "string" and len(levels) > most:
            raise ValueError(f"{c} has more than {most} levels")
        if kinds[c] == "string" or len(levels) < 10:
            parts += [F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for v in levels[1:]]
        else:
            m, s = subjects.agg(F.avg(c), F.stddev_pop(c)).first()
            parts.append(F.coalesce((F.col(c) - float(m)) / float(s or 1.0), F.lit(0.0)))
    return subjects.select("id", F.array(*parts).alias("x"))


def residuals(values: DataFrame, x: DataFrame) -> DataFrame:
    """(id, feature, value): what a linear fit on the design leaves, plus the feature's mean. The normal equations are one aggregate over subjects; per feature, one more."""
    k = len(x.first()["x"])
    gram = x.agg(*[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]).first()
    inv = np.linalg.pinv(np.array(gram, float).reshape(k, k))
    b = values.join(x, "id").groupBy("feature").agg(F.avg("value").alias("mean"), *[F.sum(F.col("value") * F.col("x")[i]).alias(f"b{i}") for i in range(k)])
    beta = b.select("feature", "mean", F.array(*[sum((float(inv[i, j]) * F.col(f"b{j}") for j in range(k)), F.lit(0.0)) for i in range(k)]).alias("beta"))
    fit = F.aggregate(F.zip_with("x", "beta", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return values.join(beta, "feature").join(x, "id").select("id", "feature", (F.col("value") - fit + F.col("mean")).alias("value"))


def combat_with_covariates(values: DataFrame, subjects: DataFrame, covariates: list[str]) -> DataFrame:
    """ComBat after a fit of batch and covariates together; subjects (id, batch, covariates)."""
    clean = residuals(values.select("id", "feature", "value"), design(subjects.withColumn("batch", F.col("batch").cast("string")), ["batch", *covariates]))
    return combat(clean.join(subjects.select("id", "batch"), "id"))


def harmonized_edges(edges: DataFrame) -> DataFrame:
    """Connectomes without their batch's effect: each edge i < j is a feature. edges (id, batch, i, j, weight), zeros included."""
    e = edges.where("i < j").select("id", "batch", F.struct("i", "j").alias("feature"), F.col("weight").alias("value"))
    return combat(e).select("id", "batch", F.col("feature.i").alias("i"), F.col("feature.j").alias("j"), F.col("value").alias("weight"))
