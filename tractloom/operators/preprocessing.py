"""A scan from raw signal to a corrected one: the steps in order, and one row that judges them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.operators import registration as rg
from tractloom.operators import tiles as tl
from tractloom.operators import voxels as vx


def mean_unweighted(signal: DataFrame, grad: DataFrame, b0: float = 50.0) -> DataFrame:
    """(x, y, z, value): mean over the unweighted volumes. Their numbers, one per volume of a scan, travel as one row."""
    flags = grad.agg(F.sort_array(F.collect_list(F.struct("vol", (F.col("bval") <= b0).alias("plain")))).alias("flags"))
    plain = F.filter(F.zip_with("signal", "flags", lambda v, f: F.when(f["plain"], v)), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(plain, F.lit(0.0), lambda a, v: a + v), F.size(plain))
    return signal.crossJoin(F.broadcast(flags)).select("x", "y", "z", mean.alias("value"))


def preprocess(signal: DataFrame, grad: DataFrame, extract: bool = True, correct: bool = True, sigma: float = 15.0, motion: str | None = None, method: str = "otsu", radius: int = 4, passes: int = 4) -> dict[str, DataFrame]:
    """signal, grad, mask and qc of a scan: gradients rounded and normalised, volumes moved to the unweighted one, background removed, bias divided out of every volume.

    signal (x, y, z, signal), grad (vol, bval, gx, gy, gz). extract and correct leave a step out. The mask is the largest
    part above the threshold that best separates the mean unweighted volume. method is otsu, or median_otsu,
    which takes medians within radius voxels first, passes times. motion is rigid, affine or None (volumes stay
    where they are); with it, gradients turn with their volumes, and qc has the summary of the motions.
    """
    if method not in ("otsu", "median_otsu"):
        raise ValueError("method is otsu or median_otsu")
    table = vx.normalized_bvecs(vx.rounded_bvals(grad))
    moves = None
    if motion:
        signal, table, moves = rg.motion_corrected(signal, table, kind=motion)
    mean = mean_unweighted(signal, table)
    mask = mean.select("x", "y", "z")
    if extract:
        bright = tl.median_otsu(mean, radius, passes) if method == "median_otsu" else mean.crossJoin(F.broadcast(vx.otsu(mean))).where("value > threshold").select("x", "y", "z")
        mask = vx.largest_component(bright)
    inner = vx.masked(mean, mask)
    before = vx.variation(inner, mask).select(F.col("cv").alias("cv_before"))
    out, after = vx.masked(signal, mask), before.select(F.col("cv_before").alias("cv_after"))
    if correct:
        field = vx.bias_field(inner, sigma)
        out = out.join(field, ["x", "y", "z"]).select("x", "y", "z", F.transform("signal", lambda v: v / F.col("field")).alias("signal"))
        after = vx.variation(vx.bias_corrected(inner, field), mask).select(F.col("cv").alias("cv_after"))
    qc = vx.gradient_quality(table).select("n_b0", "n_dwi", F.col("valid").alias("gradients_valid")).crossJoin(vx.mask_quality(mean, mask)).crossJoin(before).crossJoin(after)
    if moves is not None:
        qc = qc.crossJoin(vx.motion_summary(moves))
    good = F.col("gradients_valid") & F.col("fraction").between(0.05, 0.95)
    return {"signal": out, "grad": table, "mask": mask, "qc": qc.withColumn("passed", good)}
