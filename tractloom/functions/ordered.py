"""Running totals and places over a whole table, without a window over one partition.

Rows are dealt into buckets of a numeric column by fixed bounds (approximate quantiles, a few hundred numbers), so that
equal values share a bucket and every use of the bounds agrees. Windows run inside buckets; what lies before a bucket is
a table with one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds(df: DataFrame, value: str, parts: int | None = None) -> list[float]:
    """Values that cut the rows into about equal parts."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sorted(set(df.approxQuantile(value, [k / n for k in range(1, n)], 0.01))) if n > 1 else []


def bucket(value: str, cuts: list[float]) -> Column:
    """The number of bounds below a value."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in cuts]), lambda x: x < F.col(value))) if cuts else F.lit(0)


def bucketed(df: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """df with _b, which rises with value; null values come first."""
    return df.withColumn("_b", F.when(F.col(value).isNull(), -1).otherwise(bucket(value, bounds(df, value, parts))))


def running(df: DataFrame, value: str, sums: dict[str, Column], ties: tuple[str, ...] = (), descending: bool = False, inclusive: bool = True, kind: str = "sum") -> DataFrame:
    """df with running sums (or minima) of columns in the order of value, ties broken by further columns."""
    agg = {"sum": F.sum, "min": F.min}[kind]
    x = bucketed(df, value)
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    order = [way(value), *[way(t) for t in ties]]
    inner = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.orderBy(way("_b")).rowsBetween(Window.unboundedPreceding, -1)
    total = x.groupBy("_b").agg(*[agg(c).alias("_t" + k) for k, c in sums.items()])
    skip = total.select("_b", *[agg("_t" + k).over(before).alias("_s" + k) for k in sums])
    got = x.select("*", *[agg(c).over(inner).alias("_i" + k) for k, c in sums.items()]).join(F.broadcast(skip), "_b")
    both = (lambda k: F.coalesce("_i" + k, F.lit(0)) + F.coalesce("_s" + k, F.lit(0))) if kind == "sum" else (lambda k: F.least("_i" + k, "_s" + k))
    return got.select(*df.columns, *[both(k).alias(k) for k in sums])
