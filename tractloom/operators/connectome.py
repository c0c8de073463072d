"""Region graphs from paths: endpoint joins, weighting, normalisation, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.functions import geometry as g
from tractloom.functions import scalars as s
from tractloom.functions.ordered import running


def label_points(points: DataFrame, parcels: DataFrame, shape: tuple[int, int, int], n_labels: int) -> DataFrame:
    """points (…, x, y, z) with label: that of the nearest voxel, -1 outside the grid or above the last label."""
    vox = points.select("*", *[g.vox_round(F.col(c)).alias("v" + c) for c in "xyz"])
    inside = F.lit(True)
    for c, n in zip("xyz", shape, strict=True):
        inside = inside & F.col("v" + c).between(0, n - 1)
    table = parcels.select(*[F.col(c).alias("v" + c) for c in "xyz"], F.col("label").alias("_l"))
    got = vox.join(table, ["vx", "vy", "vz"], "left")
    return got.withColumn("label", F.when(inside & (F.coalesce("_l", F.lit(0)) < n_labels), F.coalesce("_l", F.lit(0))).otherwise(-1)).drop("vx", "vy", "vz", "_l")


def endpoint_pairs(points: DataFrame) -> DataFrame:
    """(sl_id, a, b, n) from labelled points (sl_id, pos, label): labels of first and last point. One shuffle by path."""
    return points.groupBy("sl_id").agg(F.min_by("label", "pos").alias("a"), F.max_by("label", "pos").alias("b"), F.count(F.lit(1)).alias("n"))


def kept_pairs(paths: DataFrame) -> DataFrame:
    """Paths of two points or more whose ends lie in two different regions."""
    ok = (F.col("a") >= 0) & (F.col("b") >= 0) & (F.col("a") != F.col("b"))
    return paths.where(ok & (F.col("n") >= 2) if "n" in paths.columns else ok)


def build(paths: DataFrame, weighting: str = "count", symmetric: bool = True) -> DataFrame:
    """Edges (i, j, weight) of paths (a, b, len, fa). Symmetric: one canonical row per pair, summed before the shuffle."""
    w = s.edge_weight(weighting, F.col("len"), F.col("fa"))
    i, j = (F.least("a", "b"), F.greatest("a", "b")) if symmetric else (F.col("a"), F.col("b"))
    return kept_pairs(paths).select(i.alias("i"), j.alias("j"), w.alias("w")).groupBy("i", "j").agg(F.sum("w").alias("weight"))


def normalized(edges: DataFrame, volumes: DataFrame) -> DataFrame:
    """Weights over the root of both regions' volumes (1 at least). volumes (label, volume): one row per region, broadcast if Spark finds it small."""
    v = lambda c: volumes.select(F.col("label").alias(c), F.greatest(F.col("volume").cast("double"), F.lit(1.0)).alias("v" + c))
    got = edges.join(v("i"), "i", "left").join(v("j"), "j", "left")
    return got.select("i", "j", (F.col("weight") / F.sqrt(F.coalesce("vi", F.lit(1.0)) * F.coalesce("vj", F.lit(1.0)))).alias("weight"))


def edge_statistics(paths: DataFrame) -> DataFrame:
    """Lengths per ordered pair."""
    return kept_pairs(paths).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean_len"), F.stddev_pop("len").alias("std_len"), F.min("len").alias("min_len"), F.max("len").alias("max_len"))


def info(edges: DataFrame, n_nodes: int) -> DataFrame:
    """Matrix view (both triangles) and graph view of the same edges."""
    m = F.count_if(F.col("weight") > 0)
    return edges.agg(
        (2 * m).alias("n_edges"), m.alias("n_edge_pairs"), (2 * m / float(n_nodes * n_nodes)).alias("matrix_density"),
        F.try_divide(2.0 * m, F.lit(float(n_nodes * (n_nodes - 1)))).alias("graph_density"), (2 * F.sum("weight")).alias("total_weight"),
        F.avg(F.when(F.col("weight") > 0, F.col("weight"))).alias("mean_edge_weight"),
    )


def threshold_log(edges: DataFrame, least: float) -> DataFrame:
    kept = F.when(F.col("weight") < least, 0.0).otherwise(F.col("weight"))
    return edges.select("i", "j", kept.alias("weight"), s.log_weight(kept).alias("log_weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v, w) in both directions, without a second scan of the edges."""
    return edges.select(F.explode(F.array(F.struct(F.col("i").alias("u"), F.col("j").alias("v"), F.col("weight").alias("w")), F.struct(F.col("j").alias("u"), F.col("i").alias("v"), F.col("weight").alias("w")))).alias("e")).select("e.*")


def dense(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the full matrix, as arrays ordered by node; nodes (node). The grid is nodes squared, which is the result's size."""
    grid = nodes.select(F.col("node").alias("u")).crossJoin(nodes.select(F.col("node").alias("v")))
    full = grid.join(both_ways(edges), ["u", "v"], "left").select("u", "v", F.coalesce("w", F.lit(0.0)).alias("w"))
    return full.groupBy("u").agg(F.transform(F.sort_array(F.collect_list(F.struct("v", "w"))), lambda e: e["w"]).alias("row"))


def upper_triangle(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Feature vectors: weights of i < j in order, per key."""
    return edges.where("i < j").groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "weight"))), lambda e: e["weight"]).alias("features"))


def with_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Names of both regions; P<index> where there is none."""
    name = lambda c: labels.select(F.col("node").alias(c), F.col("name").alias("name_" + c))
    got = edges.join(name("i"), "i", "left").join(name("j"), "j", "left")
    return got.select("i", "j", "weight", *[F.coalesce("name_" + c, F.concat(F.lit("P"), F.col(c).cast("string"))).alias("name_" + c) for c in "ij"])


def parcel_volumes(parcels: DataFrame) -> DataFrame:
    return parcels.groupBy("label").agg(F.count(F.lit(1)).alias("volume"))


def grid_parcels(mask: DataFrame, cell: int = 10) -> DataFrame:
    return mask.select("x", "y", "z", s.grid_parcel(F.col("x"), F.col("y"), F.col("z"), cell).alias("label"))


def trilinear(points: DataFrame, volume: DataFrame, keys: list[str]) -> DataFrame:
    """Value at each point by the eight voxels around it; null where one of them is outside. points (keys, x, y, z); volume (x, y, z, value)."""
    corner = F.explode(F.array(*[F.struct(*[F.lit(k >> s & 1).alias(d) for s, d in enumerate(("dx", "dy", "dz"))]) for k in range(8)]))
    p = points.select(*keys, *[F.floor(c).cast("int").alias("f" + c) for c in "xyz"], *[(F.col(c) - F.floor(c)).alias("r" + c) for c in "xyz"], corner.alias("c"))
    w = F.lit(1.0)
    for c in "xyz":
        w = w * F.when(F.col(f"c.d{c}") == 1, F.col("r" + c)).otherwise(1.0 - F.col("r" + c))
    at = p.select(*keys, *[(F.col("f" + c) + F.col(f"c.d{c}")).alias(c) for c in "xyz"], w.alias("w"))
    got = at.join(volume.select("x", "y", "z", "value"), ["x", "y", "z"], "left").groupBy(*keys)
    return got.agg(F.count("value").alias("n"), F.sum(F.col("w") * F.col("value")).alias("v")).select(*keys, F.when(F.col("n") == 8, F.col("v")).alias("value"))


def even_subsample(df: DataFrame, order: str, k: int) -> DataFrame:
    """k rows spread evenly over an order, both ends among them: places trunc(i (n - 1) / (k - 1)).

    Places come from counts per range of the (numeric) order, so rows are never gathered in one task.
    """
    n = df.count()
    if n <= k:
        return df
    ranked = running(df, order, {"_place": F.lit(1)}, inclusive=False)
    want = df.sparkSession.range(k).select(F.floor(F.col("id") * (n - 1) / float(max(k - 1, 1))).alias("_place"))
    return ranked.join(F.broadcast(want), "_place", "left_semi").drop("_place")
