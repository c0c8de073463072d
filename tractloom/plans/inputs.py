"""Domain objects read off the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractloom.operators import connectome as cn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path per line item: a and b are the nations of customer and supplier, its length the quantity, its map value the discount.

    Only the columns needed leave the scans; customers and suppliers are joined by size as Spark measures it.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("len"), F.col("l_discount").alias("fa"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderpriority").alias("subject"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b"))
    return li.join(o.join(c, "o_custkey"), "l_orderkey").join(s, "l_suppkey").select("l_orderkey", "l_linenumber", "o_custkey", "subject", "a", "b", "len", "fa")


PATHS = """paths AS (
  SELECT l_orderkey, l_linenumber, o_custkey, o_orderpriority AS subject, c_nationkey AS a, s_nationkey AS b, l_quantity AS len, l_discount AS fa
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""

EDGES = PATHS + """,
edges AS (SELECT least(a, b) AS i, greatest(a, b) AS j, CAST(count(*) AS DOUBLE) AS weight FROM paths WHERE a <> b GROUP BY 1, 2)"""


def edges(spark: SparkSession, sf_dir: str, weighting: str = "count") -> DataFrame:
    return cn.build(paths(spark, sf_dir), weighting)


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of the stronger edges: weights from the third quartile on."""
    e = edges(spark, sf_dir)
    cut = e.agg(F.percentile("weight", 0.75).alias("cut"))
    return e.crossJoin(F.broadcast(cut)).where("weight >= cut").drop("cut")


GRAPH = EDGES + """,
g AS (SELECT * FROM edges WHERE weight >= (SELECT quantile_cont(weight, 0.75) FROM edges)),
ends AS (SELECT i AS u, j AS v, weight AS w FROM g UNION ALL SELECT j, i, weight FROM g),
deg AS (SELECT u AS node, count(*) AS degree, sum(w) AS strength FROM ends GROUP BY 1)"""

#: Hop distances of all pairs; walks are kept once per pair and number of steps.
HOPS = """,
walk AS (
  SELECT DISTINCT u AS src, u AS dst, 0 AS hops FROM ends
  UNION
  SELECT src, v, hops + 1 FROM walk JOIN ends ON dst = u WHERE hops < 24),
hop AS (SELECT src, dst, min(hops) AS hops FROM walk GROUP BY 1, 2 HAVING min(hops) > 0)"""


def _square(name: str, before: str) -> str:
    return f""",
{name} AS (
  SELECT x.src, y.dst, min(x.d + y.d) AS d FROM {before} x JOIN {before} y ON x.dst = y.src GROUP BY 1, 2)"""


#: Weighted distances by repeated squaring of the distance matrix (paths of up to 32 edges).
DISTANCES = """,
d0 AS (SELECT u AS src, v AS dst, w AS d FROM ends UNION ALL SELECT DISTINCT u, u, 0.0 FROM ends)""" + "".join(_square(f"d{k}", f"d{k - 1}") for k in range(1, 6))


#: Betweenness with weights as lengths: shortest paths are walked one by one and counted.
BETWEENNESS = """,
dag AS (SELECT x.src, u, v FROM d5 x JOIN ends ON x.dst = u JOIN d5 y ON y.src = x.src AND y.dst = v WHERE x.d + w = y.d),
sp AS (SELECT DISTINCT u AS src, u AS v FROM ends UNION ALL SELECT sp.src, dag.v FROM sp JOIN dag ON dag.src = sp.src AND dag.u = sp.v),
np AS (SELECT src, v AS dst, CAST(count(*) AS DOUBLE) AS c FROM sp GROUP BY 1, 2),
via AS (SELECT a.dst AS node, sum(a.c * b.c / x.c) AS b FROM np a JOIN np b ON b.src = a.dst JOIN np x ON x.src = a.src AND x.dst = b.dst
  JOIN d5 p ON p.src = a.src AND p.dst = a.dst JOIN d5 q ON q.src = b.src AND q.dst = b.dst JOIN d5 t ON t.src = x.src AND t.dst = x.dst
  WHERE p.d + q.d = t.d AND a.dst <> a.src AND a.dst <> b.dst GROUP BY 1),
bw AS (SELECT node, coalesce(b, 0) / greatest(((SELECT count(*) FROM deg) - 1) * ((SELECT count(*) FROM deg) - 2), 1) AS betweenness FROM deg LEFT JOIN via USING (node))"""


def per_subject_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cn.kept_pairs(paths(spark, sf_dir))
    return p.groupBy("subject", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of paths in order: hours since the first day, value, a number from the properties."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 3.6e9
    return e.select(F.col("user_id").alias("sl_id"), F.col("ts"), "event_id", hours.alias("x"), F.col("value").alias("y"), F.coalesce(k, F.lit(0.0)).alias("z"))


POINTS = """pts AS (
  SELECT user_id AS sl_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
    (epoch_us(ts) - 1704067200000000) / 3.6e9 AS x, value AS y, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS z
  FROM events)"""


def streamlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sl_id, points): one row per path. A path's points are what a row is meant to hold."""
    p = points(spark, sf_dir).groupBy("sl_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "x", "y", "z"))).alias("p"))
    return p.select("sl_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), q["z"].alias("z"))).alias("points"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, feature, value) from the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


FEATURES = """feat AS (
  SELECT vec_id AS id, label, unnest(range(0, len(embedding))) AS feature, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, value, n): line items binned into a grid, mean quantity per voxel."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_partkey") % 16).cast("int").alias("x"), (F.col("l_suppkey") % 16).cast("int").alias("y"), F.col("l_linenumber").alias("z")).agg(F.avg("l_quantity").alias("value"), F.count(F.lit(1)).alias("n"))


VOLUME = """vol AS (
  SELECT CAST(l_partkey % 16 AS INTEGER) AS x, CAST(l_suppkey % 16 AS INTEGER) AS y, l_linenumber AS z, avg(l_quantity) AS value, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3)"""


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels with at least the mean number of line items."""
    v = volume(spark, sf_dir)
    return v.crossJoin(F.broadcast(v.agg(F.avg("n").alias("mean")))).where("n >= mean").select("x", "y", "z")


MASK = VOLUME + """,
mask AS (SELECT x, y, z FROM vol WHERE n >= (SELECT avg(n) FROM vol))"""
