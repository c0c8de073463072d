"""Vectors as integers: which rows count, and how their components are read inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers beyond +-LARGEST are held at it, so that 64 squared differences fit a signed 64-bit integer.
LARGEST = 1 << 27


def usable(vector: str, width: int) -> Column:
    """Rows whose vector has width components, none of them null or non-finite."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) == width) & ~bad, F.lit(False))


def kept(df: DataFrame, vector: str, width: int) -> DataFrame:
    return df.where(usable(vector, width))


def floored(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles as int64."""
    return np.clip(np.floor(scale * x.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows x width integers of an Arrow column of lists."""
    return floored(column.flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, width)


def first_rows(df: DataFrame, order: list[Column], vector: str, n: int, scale: int) -> np.ndarray:
    """Integers of the n first rows in an order; rows that tie in it are told apart by their vectors. At most n rows reach the driver."""
    got = df.orderBy(*order, F.col(f"`{vector}`")).limit(n).select(F.col(f"`{vector}`").alias("v")).collect()
    return floored(np.array([r.v for r in got], np.float64), scale) if got else np.zeros((0, 0), np.int64)
