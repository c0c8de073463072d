"""Shapley contributions of forests: how much each feature moves a prediction away from the mean.

A tree's prediction, given only some features, follows their splits and averages over the others by how many training
rows went each way (path-dependent). A leaf's share in it is a product over the features on its path: 1 or 0 for a known
feature whose value leads there or not, the share of rows for an unknown one. So contributions are sums over leaves of
weighted coefficients of small polynomials, taken for whole Arrow batches of rows at once. The forest's node table, as
Spark saves it, is bounded by the model and travels with the tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.session import checkpoint_folder


@dataclass
class Leaf:
    """value: its prediction over the number of trees; features on its path with their bounds low < x <= high, and shares of rows."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def node_table(model: PipelineModel, df: DataFrame) -> list[dict[int, dict]]:
    """The nodes of each tree by number, from the model's saved form in the session's checkpoint folder."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/forest-{uuid.uuid4().hex}"
    model.stages[-1].write().save(path)
    trees: dict[int, dict[int, dict]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r.asDict(recursive=True)
    return [trees[k] for k in sorted(trees)]


def leaves(trees: list[dict[int, dict]], of: int = 1) -> list[Leaf]:
    """Leaves of all trees; a prediction is the share of class of. Categorical splits are refused."""
    out: list[Leaf] = []
    for nodes in trees:
        stack = [(0, {})]
        while stack:
            k, path = stack.pop()
            n = nodes[k]
            if n["leftChild"] < 0:
                f = np.array(sorted(path), np.int64)
                low, high, share = (np.array([path[i][c] for i in f.tolist()], float) for c in range(3))
                out.append(Leaf(n["impurityStats"][of] / sum(n["impurityStats"]) / len(trees), f, low, high, share))
                continue
            if n["split"]["numCategories"] >= 0:
                raise ValueError("splits by category have no threshold")
            f, t = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
            for child, left in ((n["leftChild"], True), (n["rightChild"], False)):
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                part = sum(nodes[child]["impurityStats"]) / sum(n["impurityStats"])
                stack.append((child, path | {f: (low, min(high, t), share * part) if left else (max(low, t), high, share * part)}))
    return out


def base_value(found: list[Leaf]) -> float:
    """The prediction when no feature is known."""
    return float(sum(x.value * x.share.prod() for x in found))


def contributions_of(x: np.ndarray, found: list[Leaf]) -> np.ndarray:
    """Rows x features: contributions, which sum to the prediction less base_value()."""
    phi = np.zeros(x.shape)
    for leaf in found:
        m = len(leaf.features)
        if not m or not leaf.value:
            continue
        here = x[:, leaf.features]
        known = ((here > leaf.low) & (here <= leaf.high)).astype(float)
        for i in range(m):
            # Coefficient k: the sum over sets of k other features that are known.
            c = np.zeros((m, len(x)))
            c[0] = 1.0
            for j in range(m):
                if j != i:
                    c[1:] = c[1:] * leaf.share[j] + c[:-1] * known[:, j]
                    c[0] *= leaf.share[j]
            weight = sum(c[k] * (factorial(k) * factorial(m - 1 - k) / factorial(m)) for k in range(m))
            phi[:, leaf.features[i]] += leaf.value * (known[:, i] - leaf.share[i]) * weight
    return phi


def tree_contributions(model: PipelineModel, df: DataFrame, of: int = 1) -> DataFrame:
    """(id, feature, phi) of a forest's probability of class of, for df (id, v). One narrow pass."""
    found = leaves(node_table(model, df), of)
    scaled = model.stages[0].transform(df).select("id", vector_to_array("z").alias("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                phi = contributions_of(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), found)
                off = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * phi.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(off, pa.array(phi.ravel()))], names=["id", "phi"])

    got = scaled.mapInArrow(run, f"id {dict(df.dtypes)['id']}, phi array<double>")
    return got.select("id", F.posexplode("phi").alias("feature", "phi"))
