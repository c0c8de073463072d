"""Scalar rules of reports and catalogues as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(p: Column) -> Column:
    """-sum p ln(p + 1e-10) of an array of probabilities."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.log(x + 1e-10))


def confidence(p: Column) -> Column:
    return F.array_max(p)


def log_weight(w: Column) -> Column:
    return F.log10(1.0 + w)


def edge_weight(kind: str, length: Column, sample: Column) -> Column:
    """What one path adds to its edge. sample: mean of a map along it, null where no point lies inside."""
    mean = F.coalesce(sample, F.lit(0.0))
    return {"count": F.lit(1.0), "length_normalized": 1.0 / (length + 1e-6), "mean_fa": mean, "mean_md": mean, "hybrid": 1.0 + mean}.get(kind, F.lit(1.0))


def bucket(c: Column, high: float, low: float) -> Column:
    return F.when(c > high, "high").when(c > low, "moderate").otherwise("low")


def norm_flag(z: Column) -> Column:
    return F.when(F.abs(z) > 2, "significant").when(F.abs(z) > 1, "marginal").otherwise("normal")


def file_type(name: Column) -> Column:
    """What a result file holds, by its suffix."""
    n = F.lower(name)
    rules = [(r"\.nii(\.gz)?$", "volume"), (r"\.(trk|tck|vtk)$", "streamlines"), (r"\.(npy|csv)$", "matrix"), (r"\.json$", "json"), (r"\.(txt|log|md)$", "text"), (r"\.(png|jpg|jpeg|svg)$", "image")]
    out = F.when(n.rlike(rules[0][0]), rules[0][1])
    for pattern, kind in rules[1:]:
        out = out.when(n.rlike(pattern), kind)
    return out.otherwise("other")


def form_code(code: Column) -> Column:
    """Meaning of a q-form or s-form code."""
    names = {0: "unknown", 1: "scanner", 2: "aligned", 3: "talairach", 4: "mni152"}
    out = F.when(code == 0, names[0])
    for k in range(1, 5):
        out = out.when(code == k, names[k])
    return out.otherwise("other")


def subject_name_ok(name: Column) -> Column:
    return name.rlike("^sub-[a-zA-Z0-9]+$")


def grid_parcel(i: Column, j: Column, k: Column, cell: int = 10) -> Column:
    """Id of a grid cell; ids repeat once an axis has more than ten cells."""
    q = lambda c: F.floor(c / cell)
    return (q(i) * 100 + q(j) * 10 + q(k)).cast("long")


def sh_coefficients(order: Column) -> Column:
    return ((order + 1) * (order + 2) / 2).cast("int")


def sh_order_for(directions: Column) -> Column:
    """The largest even order up to 8 whose coefficients the directions can determine."""
    return F.when(directions >= 45, 8).when(directions >= 28, 6).when(directions >= 15, 4).otherwise(2)


def is_b0(b: Column, threshold: float = 50.0, inclusive: bool = True) -> Column:
    return b <= threshold if inclusive else b < threshold


def shell_name(b: Column) -> Column:
    """Shells by b-value to the next hundred, halves to even; up to 50 is b0."""
    r = F.bround(b, -2).cast("int")
    return F.when(b <= 50, "b0").otherwise(F.concat(F.lit("b"), r.cast("string")))


def random_clustering(n: Column, m: Column) -> Column:
    return F.try_divide(2.0 * m, n * (n - 1.0))


def random_path_length(n: Column, c: Column) -> Column:
    return F.try_divide(F.log(n), F.log(n * c))
