"""Queries on paths in space and on groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tractloom.functions import geometry as g
from tractloom.functions import rng
from tractloom.operators import connectome as cn
from tractloom.operators import resample as rs
from tractloom.operators import stats as st
from tractloom.operators import streamlines as sl
from tractloom.plans import inputs as inp
from tractloom.plans.inputs import FEATURES, MASK, PATHS, POINTS, VOLUME, r, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


STEPS = POINTS + """,
st AS (SELECT sl_id, pos, x, y, z, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM pts WINDOW w AS (PARTITION BY sl_id ORDER BY pos)),
len AS (SELECT sl_id, count(*) AS n, coalesce(sum(sqrt(dx * dx + dy * dy + dz * dz)), 0) AS length FROM st GROUP BY 1)"""

CURV = STEPS + """,
u AS (SELECT sl_id, pos, dx / (sqrt(dx*dx+dy*dy+dz*dz) + 1e-10) AS ux, dy / (sqrt(dx*dx+dy*dy+dz*dz) + 1e-10) AS uy, dz / (sqrt(dx*dx+dy*dy+dz*dz) + 1e-10) AS uz FROM st WHERE dx IS NOT NULL),
cv AS (SELECT sl_id, pos, CASE WHEN lag(ux) OVER w IS NOT NULL THEN degrees(acos(greatest(-1, least(1, ux * lag(ux) OVER w + uy * lag(uy) OVER w + uz * lag(uz) OVER w)))) END AS angle FROM u WINDOW w AS (PARTITION BY sl_id ORDER BY pos))"""


@query(f"WITH {STEPS} SELECT sl_id, n, round(length, 4) AS length FROM len")
def streamline_length(spark: SparkSession, d: str) -> DataFrame:
    x = inp.streamlines(spark, d)
    return sl.with_length(x).select("sl_id", F.size("points").cast("long").alias("n"), r("length", 4).alias("length"))


@query(f"WITH {CURV} SELECT sl_id, round(avg(angle), 4) AS mean_angle, round(max(angle), 4) AS max_angle, count(angle) AS n FROM cv GROUP BY 1")
def streamline_curvature(spark: SparkSession, d: str) -> DataFrame:
    c = inp.streamlines(spark, d).withColumn("c", g.curvature(F.col("points")))
    return c.select("sl_id", r(F.aggregate("c", F.lit(0.0), lambda a, x: a + x) / F.size("c"), 4).alias("mean_angle"), r(F.array_max("c"), 4).alias("max_angle"), F.size("c").cast("long").alias("n"))


@query(f"WITH {STEPS} SELECT sl_id, round(length, 4) AS length FROM len WHERE length BETWEEN 100 AND 1e9")
def filter_length(spark: SparkSession, d: str) -> DataFrame:
    return sl.length_filter(inp.streamlines(spark, d), 100.0, 1e9).select("sl_id", r("length", 4).alias("length"))


@query(f"WITH {CURV} SELECT sl_id, round(max(angle), 4) AS max_curvature FROM cv GROUP BY 1 HAVING max(angle) <= 179.9")
def filter_curvature(spark: SparkSession, d: str) -> DataFrame:
    return sl.curvature_filter(inp.streamlines(spark, d), 179.9).select("sl_id", r("max_curvature", 4).alias("max_curvature"))


@query(f"WITH {STEPS} SELECT sl_id, pos, round(sum(coalesce(sqrt(dx*dx+dy*dy+dz*dz), 0)) OVER (PARTITION BY sl_id ORDER BY pos), 4) AS arc FROM st")
def arc_length(spark: SparkSession, d: str) -> DataFrame:
    x = inp.streamlines(spark, d).select("sl_id", F.posexplode(sl.arc_lengths(F.col("points"))).alias("p", "arc"))
    return x.select("sl_id", (F.col("p") + 1).cast("long").alias("pos"), r("arc", 4).alias("arc"))


@query(f"""WITH {STEPS}, a AS (SELECT sl_id, pos, x, y, z, sum(coalesce(sqrt(dx*dx+dy*dy+dz*dz), 0)) OVER (PARTITION BY sl_id ORDER BY pos) AS s FROM st),
seg AS (SELECT *, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, max(s) OVER (PARTITION BY sl_id) AS total, max(pos) OVER (PARTITION BY sl_id) AS last FROM a WINDOW w AS (PARTITION BY sl_id ORDER BY pos)),
want AS (SELECT DISTINCT sl_id, total, CAST(unnest(range(0, 20)) AS BIGINT) AS k FROM seg)
SELECT want.sl_id, k, round(arg_min(x + (x2 - x) * (want.total * k / 19 - s) / (s2 - s), pos), 3) AS x, round(arg_min(y + (y2 - y) * (want.total * k / 19 - s) / (s2 - s), pos), 3) AS y
FROM want JOIN seg ON want.sl_id = seg.sl_id AND s2 > s AND want.total * k / 19 <= s2 + 1e-9 GROUP BY 1, 2""")
def resample_20(spark: SparkSession, d: str) -> DataFrame:
    x = sl.resample(inp.streamlines(spark, d), n=20).select("sl_id", F.posexplode("points").alias("k", "p"))
    return x.select("sl_id", F.col("k").cast("long").alias("k"), r("p.x", 3).alias("x"), r("p.y", 3).alias("y"))


_W = [__import__("math").exp(-0.5 * k * k) for k in range(-4, 5)]
_W = [w / sum(_W) for w in _W]


@query(f"""WITH {POINTS}, b AS (SELECT *, max(pos) OVER (PARTITION BY sl_id) AS last FROM pts), k AS (SELECT unnest(range(-4, 5)) AS k, unnest([{', '.join(f'{w!r}::DOUBLE' for w in _W)}]) AS w)
SELECT b.sl_id, b.pos, round(sum(w * q.x), 4) AS x, round(sum(w * q.y), 4) AS y, round(sum(w * q.z), 4) AS z FROM b CROSS JOIN k JOIN pts q ON q.sl_id = b.sl_id AND q.pos = least(greatest(b.pos + k.k, 1), b.last) GROUP BY 1, 2""")
def smooth_gaussian(spark: SparkSession, d: str) -> DataFrame:
    p = inp.streamlines(spark, d).select("sl_id", F.posexplode("points").alias("pos", "p")).select("sl_id", (F.col("pos") + 1).cast("long").alias("pos"), "p.*")
    return sl.smooth(p, 1.0).select("sl_id", "pos", *[r(c, 4).alias(c) for c in "xyz"])


@query(f"""WITH {STEPS} SELECT count(*) AS n, round(avg(length), 4) AS mean_length, round(stddev_pop(length), 4) AS std_length, round(min(length), 4) AS min_length, round(max(length), 4) AS max_length,
round(quantile_cont(length, 0.5), 4) AS median_length, round(avg(n), 4) AS mean_points, round(sum(length), 3) AS total_length FROM len""")
def bundle_stats(spark: SparkSession, d: str) -> DataFrame:
    b = sl.bundle_stats(inp.streamlines(spark, d))
    return b.select("n", *[r(c, 4).alias(c) for c in b.columns if c not in ("n", "total_length")], r("total_length", 3).alias("total_length"))


#: Every whole path at 20 points, evenly by arc length.
EVEN = STEPS + """,
a AS (SELECT sl_id, pos, x, y, z, sum(coalesce(sqrt(dx*dx+dy*dy+dz*dz), 0)) OVER (PARTITION BY sl_id ORDER BY pos) AS s FROM st),
seg AS (SELECT *, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, max(s) OVER (PARTITION BY sl_id) AS total FROM a WINDOW w AS (PARTITION BY sl_id ORDER BY pos)),
want AS (SELECT DISTINCT sl_id, total, CAST(unnest(range(0, 20)) AS BIGINT) AS k FROM seg),
ev AS (SELECT want.sl_id, k, arg_min(x + (x2 - x) * (want.total * k / 19 - s) / (s2 - s), pos) AS x, arg_min(y + (y2 - y) * (want.total * k / 19 - s) / (s2 - s), pos) AS y, arg_min(z + (z2 - z) * (want.total * k / 19 - s) / (s2 - s), pos) AS z
  FROM want JOIN seg ON want.sl_id = seg.sl_id AND s2 > s AND want.total * k / 19 <= s2 + 1e-9 GROUP BY 1, 2),
h AS (SELECT sl_id, list({'x': x, 'y': y, 'z': z} ORDER BY k) AS p FROM ev GROUP BY 1)"""


MDF = """least(
  list_sum(list_transform(range(1, 21), lambda k: sqrt(pow(a.p[k].x - b.p[k].x, 2) + pow(a.p[k].y - b.p[k].y, 2) + pow(a.p[k].z - b.p[k].z, 2)))),
  list_sum(list_transform(range(1, 21), lambda k: sqrt(pow(a.p[k].x - b.p[21 - k].x, 2) + pow(a.p[k].y - b.p[21 - k].y, 2) + pow(a.p[k].z - b.p[21 - k].z, 2))))) / 20"""


@query(f"WITH {EVEN}, m AS (SELECT a.sl_id AS a, b.sl_id AS b, {MDF} AS mdf FROM h a JOIN h b ON a.sl_id < b.sl_id) SELECT a, b, round(mdf, 4) AS mdf FROM m")
def mdf_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sl.mdf_pairs(sl.evenly(inp.streamlines(spark, d), 20), digits=4)


@query(f"WITH {EVEN}, m AS (SELECT a.sl_id AS a, b.sl_id AS b, {MDF} AS mdf FROM h a JOIN h b ON a.sl_id < b.sl_id) SELECT a, b, round(mdf, 4) AS mdf FROM m WHERE mdf < 60")
def mdf_pairs_near(spark: SparkSession, d: str) -> DataFrame:
    return sl.mdf_pairs(sl.evenly(inp.streamlines(spark, d), 20), most=60.0).select("a", "b", r("mdf", 4).alias("mdf"))


@query(f"""WITH {STEPS}, per AS (SELECT sl_id % 3 AS run, count(*) AS n, avg(length) AS m FROM len GROUP BY 1)
SELECT count(*) AS runs, round(avg(n), 4) AS mean_count, round(stddev_pop(n) / avg(n), 6) AS cv_count, round(avg(m), 4) AS mean_length, round(stddev_pop(m) / avg(m), 6) AS cv_length, stddev_pop(m) / avg(m) < 0.2 AND stddev_pop(n) / avg(n) < 0.3 AS consistent FROM per""")
def run_consistency(spark: SparkSession, d: str) -> DataFrame:
    c = sl.consistency(inp.streamlines(spark, d).withColumn("run", F.col("sl_id") % 3), "run")
    return c.select("runs", r("mean_count", 4).alias("mean_count"), r("cv_count").alias("cv_count"), r("mean_length", 4).alias("mean_length"), r("cv_length").alias("cv_length"), "consistent")


@query(f"""WITH {EVEN}, s AS (SELECT sl_id, p FROM h WHERE sl_id % 2 = 0), t AS (SELECT sl_id, p FROM h WHERE sl_id % 2 = 1),
o AS (SELECT a.sl_id, min({MDF}) AS d FROM s a, t b GROUP BY 1), hl AS (SELECT sl_id, length AS l FROM len),
x AS (SELECT (SELECT avg(CASE WHEN d < 60 THEN 1.0 ELSE 0.0 END) FROM o) AS overlap, (SELECT count(*) FROM s) AS n1, (SELECT count(*) FROM t) AS n2, (SELECT avg(l) FROM hl WHERE sl_id % 2 = 0) AS l1, (SELECT avg(l) FROM hl WHERE sl_id % 2 = 1) AS l2)
SELECT round(overlap, 6) AS overlap, round(2.0::DOUBLE * least(n1, n2) / (n1 + n2), 6) AS dice, round(abs(l1 - l2) / greatest(l1, l2), 6) AS length_difference, overlap > 0.5 AND 2.0 * least(n1, n2) / (n1 + n2) > 0.7 AS reproducible FROM x""")
def reproducibility(spark: SparkSession, d: str) -> DataFrame:
    x = inp.streamlines(spark, d)
    c = sl.reproducibility(x.where("sl_id % 2 = 0"), x.where("sl_id % 2 = 1"), near=60.0, sample=100_000, n_points=20)
    return c.select(*[r(x).alias(x) for x in ("overlap", "dice", "length_difference")], "reproducible")


@query(f"""WITH {STEPS}, n AS (SELECT count(*) AS n FROM len), o AS (SELECT sl_id, row_number() OVER (ORDER BY sl_id) - 1 AS place FROM len), w AS (SELECT CAST(floor(k * (n - 1) / 19.0::DOUBLE) AS BIGINT) AS place FROM n, range(0, 20) t(k))
SELECT sl_id FROM o WHERE (SELECT n FROM n) <= 20 OR place IN (SELECT place FROM w)""")
def even_subsample(spark: SparkSession, d: str) -> DataFrame:
    return cn.even_subsample(inp.streamlines(spark, d).select("sl_id"), "sl_id", 20).select("sl_id")


@query(f"""WITH {STEPS}, e AS (SELECT sl_id, arg_max(x, pos) - arg_min(x, pos) AS dx, arg_max(y, pos) - arg_min(y, pos) AS dy, arg_max(z, pos) - arg_min(z, pos) AS dz FROM pts GROUP BY 1),
u AS (SELECT sl_id, CASE WHEN sqrt(dx*dx+dy*dy+dz*dz) > 0 THEN dx / sqrt(dx*dx+dy*dy+dz*dz) ELSE 0 END AS dx, CASE WHEN sqrt(dx*dx+dy*dy+dz*dz) > 0 THEN dy / sqrt(dx*dx+dy*dy+dz*dz) ELSE 0 END AS dy, CASE WHEN sqrt(dx*dx+dy*dy+dz*dz) > 0 THEN dz / sqrt(dx*dx+dy*dy+dz*dz) ELSE 1 END AS dz FROM e),
m AS (SELECT min(length) AS lo, max(length) AS hi FROM len)
SELECT sl_id, round((length - lo) / (hi - lo), 6) AS shade, round(abs(dx), 6) AS red, round(abs(dy), 6) AS green, round(abs(dz), 6) AS blue FROM len JOIN u USING (sl_id), m""")
def orientation_rgb(spark: SparkSession, d: str) -> DataFrame:
    c = sl.colours(inp.streamlines(spark, d))
    return c.select("sl_id", *[r(x).alias(x) for x in ("shade", "red", "green", "blue")])


@query(f"WITH {POINTS} SELECT count(*) AS n_points, round(min(x), 4) AS min_x, round(max(x), 4) AS max_x, round(min(y), 4) AS min_y, round(max(y), 4) AS max_y, min(z) AS min_z, max(z) AS max_z FROM pts")
def bounds(spark: SparkSession, d: str) -> DataFrame:
    b = sl.bounds(inp.streamlines(spark, d))
    return b.select("n_points", *[r(c, 4).alias(c) for c in b.columns if c[-1] in "xy"], "min_z", "max_z")


@query(f"WITH {STEPS} SELECT round(avg(length), 4) AS mean_length, round(stddev_pop(length), 4) AS std_length, avg(length) BETWEEN 10 AND 1e6 AND stddev_pop(length) < avg(length) AS plausible FROM len")
def length_check(spark: SparkSession, d: str) -> DataFrame:
    return sl.length_check(inp.streamlines(spark, d), 10, 1e6).select(r("mean_length", 4).alias("mean_length"), r("std_length", 4).alias("std_length"), "plausible")


def _grid_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of the event paths moved into the voxel grid."""
    return inp.points(spark, d).select("sl_id", F.struct("ts", "event_id").alias("pos"), (F.col("x") % 16).alias("x"), (F.abs("y") % 16).alias("y"), (F.col("z") % 7 + 1).alias("z"))


GRID = POINTS + ", gp AS (SELECT sl_id, pos, x % 16 AS x, abs(y) % 16 AS y, z % 7 + 1 AS z FROM pts)"


@query(f"WITH {GRID}, {MASK}, v AS (SELECT trunc(x)::INT AS x, trunc(y)::INT AS y, trunc(z)::INT AS z, count(*) AS visits FROM gp GROUP BY 1, 2, 3) SELECT x, y, z, coalesce(visits, 0) AS visits FROM mask LEFT JOIN v USING (x, y, z)")
def coverage_map(spark: SparkSession, d: str) -> DataFrame:
    return sl.coverage(_grid_points(spark, d), inp.mask(spark, d))


@query(f"""WITH {GRID}, {MASK}, v AS (SELECT trunc(x)::INT AS x, trunc(y)::INT AS y, trunc(z)::INT AS z, count(*) AS visits FROM gp GROUP BY 1, 2, 3), c AS (SELECT coalesce(visits, 0) AS n FROM mask LEFT JOIN v USING (x, y, z))
SELECT count(*) AS voxels, count(*) FILTER (n > 0) AS covered, round(avg(n) FILTER (n > 0), 4) AS mean_visits, max(n) AS max_visits, round(count(*) FILTER (n > 0) / count(*), 6) AS fraction, count(*) FILTER (n > 0) / count(*) >= 0.3 AS sufficient FROM c""")
def coverage_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = sl.coverage_summary(sl.coverage(_grid_points(spark, d), inp.mask(spark, d)))
    return c.select("voxels", "covered", r("mean_visits", 4).alias("mean_visits"), "max_visits", r("fraction").alias("fraction"), "sufficient")


@query(f"""WITH {GRID}, {MASK}, k AS (SELECT sl_id, pos, CASE WHEN NOT (trunc(gp.x) BETWEEN 0 AND 14 AND trunc(gp.y) BETWEEN 0 AND 15 AND trunc(gp.z) BETWEEN 0 AND 15) THEN 'outside' WHEN mask.x IS NULL THEN 'off_mask' WHEN coalesce(value, 0) < 25 THEN 'low_fa' END AS kind
FROM gp LEFT JOIN mask ON mask.x = trunc(gp.x) AND mask.y = trunc(gp.y) AND mask.z = trunc(gp.z) LEFT JOIN vol ON vol.x = trunc(gp.x) AND vol.y = trunc(gp.y) AND vol.z = trunc(gp.z)),
f AS (SELECT sl_id, arg_min(kind, pos) FILTER (kind IS NOT NULL) AS kind FROM k GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (kind = 'outside') AS outside, count(*) FILTER (kind = 'off_mask') AS off_mask, count(*) FILTER (kind = 'low_fa') AS low_fa, round(count(kind) / count(*), 6) AS rate, count(kind) / count(*) < 0.1 AS plausible FROM f""")
def plausibility(spark: SparkSession, d: str) -> DataFrame:
    p = sl.plausibility(_grid_points(spark, d), inp.volume(spark, d), inp.mask(spark, d), (15, 16, 16), 25.0)
    return p.select("n", "outside", "off_mask", "low_fa", r("rate").alias("rate"), "plausible")


@query(f"WITH {GRID}, {MASK} SELECT DISTINCT sl_id FROM gp JOIN mask ON mask.x = trunc(gp.x) AND mask.y = trunc(gp.y) AND mask.z = trunc(gp.z) WHERE mask.x < 2")
def roi_pass(spark: SparkSession, d: str) -> DataFrame:
    return sl.roi_pass(_grid_points(spark, d), inp.mask(spark, d).where("x < 2"))


@query(f"""SELECT p AS plausible, c AS covered, l AS lengths, k AS consistent, p AND c AND l AND k AS passed
FROM (SELECT plausible AS p FROM ({SQL['plausibility']})), (SELECT sufficient AS c FROM ({SQL['coverage_metrics']})), (SELECT plausible AS l FROM ({SQL['length_check']})), (SELECT consistent AS k FROM ({SQL['run_consistency']}))""")
def quality_verdict(spark: SparkSession, d: str) -> DataFrame:
    return sl.verdict(plausibility(spark, d), coverage_metrics(spark, d), length_check(spark, d), run_consistency(spark, d))


LABELLED = GRID + f""", {VOLUME}, par AS (SELECT x, y, z, CAST(floor(x / 4.0) * 100 + floor(y / 4.0) * 10 + floor(z / 4.0) AS BIGINT) AS label FROM vol),
vx AS (SELECT sl_id, pos, CAST(round_even(x, 0) AS INTEGER) AS x, CAST(round_even(y, 0) AS INTEGER) AS y, CAST(round_even(z, 0) AS INTEGER) AS z FROM gp),
lab AS (SELECT sl_id, pos, CASE WHEN vx.x BETWEEN 0 AND 15 AND vx.y BETWEEN 0 AND 15 AND vx.z BETWEEN 0 AND 7 AND coalesce(label, 0) < 320 THEN coalesce(label, 0) ELSE -1 END AS label FROM vx LEFT JOIN par USING (x, y, z))"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Points of the event paths with the label of the grid cell around their nearest voxel."""
    return cn.label_points(_grid_points(spark, d), cn.grid_parcels(inp.volume(spark, d), 4), (16, 16, 8), 320)


@query(f"WITH {LABELLED} SELECT CAST(label AS BIGINT) AS label, count(*) AS n FROM lab GROUP BY 1")
def point_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LABELLED}, e AS (SELECT sl_id, arg_min(label, pos) AS a, arg_max(label, pos) AS b, count(*) AS n FROM lab GROUP BY 1)
SELECT CAST(least(a, b) AS BIGINT) AS i, CAST(greatest(a, b) AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS weight FROM e WHERE a >= 0 AND b >= 0 AND a <> b AND n >= 2 GROUP BY 1, 2""")
def connectome_from_points(spark: SparkSession, d: str) -> DataFrame:
    """From points to edges: nearest parcel of each point, the two ends of each path, one count per path."""
    p = cn.endpoint_pairs(_labelled(spark, d)).select("sl_id", "a", "b", "n", F.lit(1.0).alias("len"), F.lit(1.0).alias("fa"))
    return cn.build(p, "count").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("weight").cast("double").alias("weight"))


@query(f"""WITH {POINTS}, o AS (SELECT sl_id, md5('42:' || sl_id) AS h FROM (SELECT DISTINCT sl_id FROM pts)) SELECT sl_id FROM o ORDER BY h, sl_id LIMIT 25""")
def random_subsample(spark: SparkSession, d: str) -> DataFrame:
    return sl.subsample(inp.streamlines(spark, d).select("sl_id"), 25)


@query()
def quickbundles(spark: SparkSession, d: str) -> DataFrame:
    return sl.cluster(inp.streamlines(spark, d).withColumn("subject", F.col("sl_id") % 3), "subject", 60.0)


@query()
def hierarchical_clusters(spark: SparkSession, d: str) -> DataFrame:
    return sl.cluster(inp.streamlines(spark, d).withColumn("subject", F.col("sl_id") % 3), "subject", 60.0, method="hierarchical")


# Group statistics.


def _two_groups(spark: SparkSession, d: str) -> DataFrame:
    return inp.features(spark, d).where("label IN (0, 1)").withColumnRenamed("label", "group")


TWO = FEATURES + ", two AS (SELECT id, label AS grp, feature, value FROM feat WHERE label IN (0, 1))"


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("label IN (0, 1)").select(F.col("vec_id").alias("id"), F.col("label").alias("group"))


PERM = TWO + """,
sub AS (SELECT DISTINCT id, grp FROM two),
pg AS (SELECT perm, id, CASE WHEN perm = 0 THEN grp WHEN row_number() OVER (PARTITION BY perm ORDER BY md5('42:' || perm || ':' || id), id) <= sum(CASE WHEN grp = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY perm) THEN 0 ELSE 1 END AS grp
  FROM sub, (SELECT CAST(unnest(range(0, {n} + 1)) AS INTEGER) AS perm))"""


@query(f"""WITH {PERM.replace('{n}', '200')}, s AS (SELECT perm, feature, avg(value) FILTER (pg.grp = 0) - avg(value) FILTER (pg.grp = 1) AS stat FROM two JOIN pg USING (id) GROUP BY 1, 2),
o AS (SELECT feature, stat AS observed FROM s WHERE perm = 0) SELECT feature, round(observed, 6) AS observed, round(avg(CASE WHEN abs(stat) >= abs(observed) THEN 1.0 ELSE 0.0 END), 6) AS p FROM s JOIN o USING (feature) WHERE perm > 0 GROUP BY 1, 2""")
def permutation_mean_diff(spark: SparkSession, d: str) -> DataFrame:
    v = _two_groups(spark, d).select("id", "feature", "value")
    return st.permutation_test(v, _subjects(spark, d), 200).select("feature", r("observed").alias("observed"), r("p").alias("p"))


@query()
def permutation_mean_diff_whole(spark: SparkSession, d: str) -> DataFrame:
    v = _two_groups(spark, d).select("id", "feature", "value")
    return st.permutation_test_in_batches(v, _subjects(spark, d), 10000).select("feature", r("observed").alias("observed"), r("p").alias("p"))


EFFECT = TWO + """,
e AS (SELECT feature, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1, avg(value) FILTER (grp = 0) AS m0, avg(value) FILTER (grp = 1) AS m1, var_samp(value) FILTER (grp = 0) AS v0, var_samp(value) FILTER (grp = 1) AS v1 FROM two GROUP BY 1),
es AS (SELECT *, m0 - m1 AS difference, n0 + n1 - 2 AS df, sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) AS pooled FROM e)"""


@query(f"""WITH {EFFECT} SELECT feature, n0, n1, round(difference, 6) AS difference, round(difference / pooled, 5) AS cohens_d, round(difference / pooled * (1 - 3.0 / (4 * df - 1)), 5) AS hedges_g, round(difference / sqrt(v1), 5) AS glass_delta, round(difference / (pooled * sqrt(1.0 / n0 + 1.0 / n1)), 5) AS t, df FROM es""")
def effect_sizes(spark: SparkSession, d: str) -> DataFrame:
    e = st.effect_sizes(_two_groups(spark, d), ["feature"])
    return e.select("feature", "n0", "n1", r("difference").alias("difference"), *[r(c, 5).alias(c) for c in ("cohens_d", "hedges_g", "glass_delta", "t")], "df")


@query(f"""WITH {TWO}, x AS (SELECT feature, grp, value, row_number() OVER (PARTITION BY feature, grp ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY feature, grp) AS n FROM two),
s AS (SELECT feature, grp, r, CAST(floor(CAST(('0x' || substr(md5('42:' || r || ':' || k), 1, 12)) AS BIGINT)::DOUBLE / 281474976710656.0 * n) AS BIGINT) AS k FROM x, (SELECT unnest(range(1, 101)) AS r)),
m AS (SELECT feature, r, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1, avg(value) FILTER (grp = 0) AS m0, avg(value) FILTER (grp = 1) AS m1, var_samp(value) FILTER (grp = 0) AS v0, var_samp(value) FILTER (grp = 1) AS v1 FROM s JOIN x USING (feature, grp, k) GROUP BY 1, 2),
b AS (SELECT feature, (m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) AS d FROM m), ci AS (SELECT feature, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM b GROUP BY 1),
o AS (SELECT feature, avg(value) FILTER (grp = 0) - avg(value) FILTER (grp = 1) AS diff, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1, var_samp(value) FILTER (grp = 0) AS v0, var_samp(value) FILTER (grp = 1) AS v1 FROM two GROUP BY 1)
SELECT feature, round(diff / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 5) AS cohens_d, round(low, 5) AS low, round(high, 5) AS high FROM o JOIN ci USING (feature)""")
def effect_size_ci(spark: SparkSession, d: str) -> DataFrame:
    return st.effect_size_interval(_two_groups(spark, d), ["feature"], 100).select("feature", *[r(c, 5).alias(c) for c in ("cohens_d", "low", "high")])


PV = EFFECT + ", pv AS (SELECT feature AS id, exp(-abs(difference / (pooled * sqrt(1.0 / n0 + 1.0 / n1)))) AS p FROM es)"


def _pseudo_p(spark: SparkSession, d: str) -> DataFrame:
    return st.effect_sizes(_two_groups(spark, d), ["feature"]).select(F.col("feature").alias("id"), F.exp(-F.abs("t")).alias("p"))


def _fdr_sql(c: str) -> str:
    return f"""WITH {PV}, k AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS rank, count(*) OVER () AS n FROM pv), c AS (SELECT {c} AS c FROM (SELECT count(*) AS n FROM pv)),
x AS (SELECT *, p * n / rank * c AS raw, CAST(rank AS DOUBLE) / n * 0.2 / c >= p AS ok FROM k, c)
SELECT id, round(p, 6) AS p, rank, round(least(1.0, min(raw) OVER (ORDER BY rank DESC)), 6) AS adjusted, rank <= coalesce(max(CASE WHEN ok THEN rank END) OVER (), 0) AS rejected FROM x"""


@query(_fdr_sql("1.0::DOUBLE"))
def fdr_bh(spark: SparkSession, d: str) -> DataFrame:
    return st.fdr(_pseudo_p(spark, d), 0.2).select("id", r("p").alias("p"), F.col("rank").cast("long").alias("rank"), r("adjusted").alias("adjusted"), "rejected")


@query(_fdr_sql("(SELECT sum(1.0::DOUBLE / i) FROM range(1, n + 1) t(i))"))
def fdr_by(spark: SparkSession, d: str) -> DataFrame:
    return st.fdr(_pseudo_p(spark, d), 0.2, "by").select("id", r("p").alias("p"), F.col("rank").cast("long").alias("rank"), r("adjusted").alias("adjusted"), "rejected")


@query(f"""WITH {FEATURES}, x AS (SELECT label, feature, id, value, row_number() OVER (PARTITION BY label, feature ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY label, feature) AS n FROM feat),
s AS (SELECT label, feature, r, CAST(floor(CAST(('0x' || substr(md5('42:' || r || ':' || k), 1, 12)) AS BIGINT)::DOUBLE / 281474976710656.0 * n) AS BIGINT) AS k FROM x, (SELECT unnest(range(1, 101)) AS r)),
m AS (SELECT label, feature, r, avg(value) AS mean FROM s JOIN x USING (label, feature, k) GROUP BY 1, 2, 3), ci AS (SELECT label, feature, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m GROUP BY 1, 2)
SELECT label, feature, round(avg(value), 6) AS estimate, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM x JOIN ci USING (label, feature) GROUP BY 1, 2""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    v = inp.features(spark, d).select("label", "feature", "id", "value")
    return st.bootstrap(v, ["label", "feature"], 100, level=0.95).select("label", "feature", *[r(c).alias(c) for c in ("estimate", "low", "high")])


@query()
def bootstrap_ci_whole(spark: SparkSession, d: str) -> DataFrame:
    v = inp.features(spark, d).select("label", "feature", "id", "value")
    return st.bootstrap_in_batches(v, "label", 10000, level=0.95).select("label", "feature", *[r(c).alias(c) for c in ("estimate", "low", "high")])


@query()
def bootstrap_variation(spark: SparkSession, d: str) -> DataFrame:
    """Standard deviation of each feature within each label, a statistic of three sums."""
    v = inp.features(spark, d)
    sums = {"n": F.lit(1), "s": F.col("value"), "ss": F.col("value") * F.col("value")}
    reps = rs.replicates(v, ["label", "feature"], "id", sums, lambda n, s, ss: F.sqrt(F.greatest(F.try_divide(ss, n) - F.pow(F.try_divide(s, n), 2), F.lit(0.0))), 500)
    return rs.interval(reps, ["label", "feature"])


@query()
def bootstrap_median(spark: SparkSession, d: str) -> DataFrame:
    return rs.quantile_interval(inp.features(spark, d), ["label", "feature"], n_boot=500)


@query()
def mass_univariate(spark: SparkSession, d: str) -> DataFrame:
    return st.mass_univariate(_two_groups(spark, d))


PAIR = "WITH p AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))


@query(f"{PAIR} SELECT label, count(*) AS n, round(corr(a, b), 6) AS r FROM p GROUP BY 1")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    return st.correlation(_pairs(spark, d), ["label"]).select("label", "n", r("r").alias("r"))


@query(f"{PAIR}, k AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY a) + (count(*) OVER (PARTITION BY label, a) - 1) / 2.0 AS a, rank() OVER (PARTITION BY label ORDER BY b) + (count(*) OVER (PARTITION BY label, b) - 1) / 2.0 AS b FROM p) SELECT label, count(*) AS n, round(corr(a, b), 6) AS r FROM k GROUP BY 1")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return st.correlation(_pairs(spark, d), ["label"], "spearman").select("label", "n", r("r").alias("r"))


@query(f"""{PAIR}, x AS (SELECT * FROM p, (SELECT CAST(unnest(range(0, 101)) AS INTEGER) AS perm)), l AS (SELECT label, perm, a, row_number() OVER (PARTITION BY label, perm ORDER BY id) AS k FROM x),
q AS (SELECT label, perm, b, CASE WHEN perm = 0 THEN row_number() OVER (PARTITION BY label, perm ORDER BY id) ELSE row_number() OVER (PARTITION BY label, perm ORDER BY md5('42:' || perm || ':' || id), id) END AS k FROM x),
c AS (SELECT label, perm, count(*) AS n, corr(a, b) AS r FROM l JOIN q USING (label, perm, k) GROUP BY 1, 2), o AS (SELECT label, n, r AS seen FROM c WHERE perm = 0)
SELECT label, any_value(o.n) AS n, round(any_value(seen), 6) AS r, round(avg(CASE WHEN abs(r) >= abs(seen) THEN 1.0 ELSE 0.0 END), 6) AS p FROM c JOIN o USING (label) WHERE perm > 0 GROUP BY 1""")
def corr_permutation(spark: SparkSession, d: str) -> DataFrame:
    return st.correlation_permutation(_pairs(spark, d), 100, keys=("label",)).select("label", "n", r("r").alias("r"), r("p").alias("p"))


@query()
def corr_permutation_whole(spark: SparkSession, d: str) -> DataFrame:
    return st.correlation_permutation_in_batches(_pairs(spark, d), 10000, keys=("label",)).select("label", "n", r("r").alias("r"), r("p").alias("p"))


def _subject_edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Forty subjects with edges among regions, zeros included, and their groups."""
    p = cn.kept_pairs(inp.paths(spark, d)).withColumn("id", (F.col("o_custkey") % 40).cast("int"))
    e = p.groupBy("id", F.least(F.col("a") % 8, F.col("b") % 8).alias("i"), F.greatest(F.col("a") % 8, F.col("b") % 8).alias("j")).agg(F.sum("len").alias("value")).where("i < j")
    ids = e.select("id").distinct()
    pairs = e.select("i", "j").distinct()
    full = ids.crossJoin(F.broadcast(pairs)).join(e, ["id", "i", "j"], "left").select("id", "i", "j", F.coalesce("value", F.lit(0.0)).alias("value"))
    return full, ids.select("id", F.when(F.col("id") < 20, 0).otherwise(1).alias("group"))


@query()
def nbs(spark: SparkSession, d: str) -> DataFrame:
    v, s = _subject_edges(spark, d)
    return st.nbs(v, s, 1.5, 5000).select("observed", r("p").alias("p"))


@query(f"""WITH {PATHS}, e0 AS (SELECT o_custkey % 40 AS id, least(a % 8, b % 8) AS i, greatest(a % 8, b % 8) AS j, sum(len) AS value FROM paths WHERE a <> b GROUP BY 1, 2, 3), e AS (SELECT * FROM e0 WHERE i < j),
f AS (SELECT s.id, q.i, q.j, coalesce(value, 0.0) AS value, CASE WHEN s.id < 20 THEN 0 ELSE 1 END AS grp FROM (SELECT DISTINCT id FROM e) s CROSS JOIN (SELECT DISTINCT i, j FROM e) q LEFT JOIN e ON e.id = s.id AND e.i = q.i AND e.j = q.j),
x AS (SELECT i, j, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1, avg(value) FILTER (grp = 0) AS m0, avg(value) FILTER (grp = 1) AS m1, var_samp(value) FILTER (grp = 0) AS v0, var_samp(value) FILTER (grp = 1) AS v1 FROM f GROUP BY 1, 2)
SELECT i, j, round((m0 - m1) / (sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) * sqrt(1.0 / n0 + 1.0 / n1)), 4) AS t FROM x""")
def nbs_edge_t(spark: SparkSession, d: str) -> DataFrame:
    v, s = _subject_edges(spark, d)
    return st.edge_t(v, s.withColumn("perm", F.lit(0))).select("i", "j", r("t", 4).alias("t"))
