"""Queries on seeds, tracks, surfaces, reports and catalogues."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractloom.functions import scalars as s
from tractloom.operators import graph as gr
from tractloom.operators import paths as pt
from tractloom.operators import reports as rp
from tractloom.operators import surfaces as sf
from tractloom.operators import tracking as tk
from tractloom.operators import voxels as vx
from tractloom.plans import graphs as gp
from tractloom.plans import inputs as inp
from tractloom.plans import models as md
from tractloom.plans.inputs import GRAPH, MASK, POINTS, VOLUME, r, table
from tractloom.session import checkpoint_folder
from tractloom.sources import files, sinks

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _u(c: str, key: str) -> str:
    return f"(CAST(('0x' || substr(md5('42{c}:' || {key}), 1, 12)) AS BIGINT)::DOUBLE / 281474976710656.0)"


KEY = "x || ':' || y || ':' || z || ':' || k"
AT = ", ".join(f"round({c} + ({_u(c, KEY)} - 0.5) * 2 * 0.5, 6) AS s{c}" for c in "xyz")


@query(f"WITH {MASK} SELECT x, y, z, k, {AT} FROM mask, (SELECT CAST(unnest(range(1, 3)) AS INTEGER) AS k)")
def seeds_whole_brain(spark: SparkSession, d: str) -> DataFrame:
    return tk.whole_brain_seeds(inp.mask(spark, d), 2).select("x", "y", "z", "k", *[r("s" + c).alias("s" + c) for c in "xyz"])


@query(f"WITH {VOLUME}, t AS (SELECT max(value) AS top FROM vol WHERE value > 30), n AS (SELECT x, y, z, CAST(greatest(1, floor(2 * (1 + 2 * (value - 30) / (top - 30)))) AS INTEGER) AS n FROM vol, t WHERE value > 30), e AS (SELECT x, y, z, CAST(unnest(range(1, n + 1)) AS INTEGER) AS k FROM n) SELECT x, y, z, k, {AT} FROM e")
def seeds_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return tk.adaptive_seeds(inp.volume(spark, d), 30.0, 2).select("x", "y", "z", "k", *[r("s" + c).alias("s" + c) for c in "xyz"])


@query(f"WITH {MASK}, i AS (SELECT x, y, z FROM (SELECT x + o.dx AS x, y + o.dy AS y, z + o.dz AS z FROM mask, (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dx, dy, dz)) GROUP BY 1, 2, 3 HAVING count(*) = 7), b AS (SELECT x, y, z, 1 AS k FROM mask ANTI JOIN i USING (x, y, z)) SELECT x, y, z, k, {AT} FROM b")
def seeds_roi_boundary(spark: SparkSession, d: str) -> DataFrame:
    return tk.roi_seeds(inp.mask(spark, d), 1, True).select("x", "y", "z", "k", *[r("s" + c).alias("s" + c) for c in "xyz"])


@query(f"WITH {VOLUME}, p AS (SELECT x, y, z, (x // 8) * 2 + y // 8 + 1 AS label FROM vol) SELECT DISTINCT a.x, a.y, a.z, CAST(a.label AS INTEGER) AS label FROM p a JOIN p b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 AND a.label <> b.label")
def parcel_boundary(spark: SparkSession, d: str) -> DataFrame:
    p = inp.volume(spark, d).select("x", "y", "z", (F.floor(F.col("x") / 8) * 2 + F.floor(F.col("y") / 8) + 1).cast("int").alias("label"))
    return tk.parcel_boundary(p)


@query(f"WITH {MASK}, e AS (SELECT x, y, z, k, md5('42:' || {KEY}) AS h FROM mask, (SELECT CAST(unnest(range(1, 3)) AS INTEGER) AS k)) SELECT x, y, z, k FROM e ORDER BY h, x, y, z, k LIMIT 100")
def seeds_subsample(spark: SparkSession, d: str) -> DataFrame:
    return tk.subsample_seeds(tk.whole_brain_seeds(inp.mask(spark, d), 2), 100).select("x", "y", "z", "k")


DIR = "peak AS (SELECT x, y, z, CASE WHEN (x + y) % 2 = 0 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS dx, CASE WHEN (x + y) % 2 = 0 THEN 0.0::DOUBLE ELSE 0.8::DOUBLE END AS dy, 0.0::DOUBLE AS dz FROM vol)"


def _made_peaks(spark: SparkSession, d: str) -> DataFrame:
    even = (F.col("x") + F.col("y")) % 2 == 0
    return inp.volume(spark, d).select("x", "y", "z", F.lit(0).alias("rank"), F.when(even, 1.0).otherwise(0.6).alias("dx"), F.when(even, 0.0).otherwise(0.8).alias("dy"), F.lit(0.0).alias("dz"), F.lit(1.0).alias("amp"))


def _step(k: int) -> str:
    sign = "CASE WHEN dx * px + dy * py + dz * pz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"
    return f"t{k} AS (SELECT seed_id, t.x + 0.5 * ({sign}) * dx AS x, t.y + 0.5 * ({sign}) * dy AS y, t.z + 0.5 * ({sign}) * dz AS z, ({sign}) * dx AS px, ({sign}) * dy AS py, ({sign}) * dz AS pz FROM t{k - 1} t JOIN peak p ON p.x = round_even(t.x, 0)::INT AND p.y = round_even(t.y, 0)::INT AND p.z = round_even(t.z, 0)::INT)"


@query(f"WITH {VOLUME}, {DIR}, t0 AS (SELECT x * 10000 + y * 100 + z AS seed_id, x::DOUBLE + 0.1 AS x, y::DOUBLE + 0.2 AS y, z::DOUBLE AS z, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py, 0.0::DOUBLE AS pz FROM vol), {', '.join(_step(k) for k in range(1, 7))} " + " UNION ALL ".join(f"SELECT CAST(seed_id AS BIGINT) AS seed_id, {k} AS pos, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM t{k}" for k in range(7)))
def track_relational_k_steps(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d, inp.volume(spark, d))


def _steps(spark: SparkSession, d: str, v: DataFrame) -> DataFrame:
    seeds = v.select((F.col("x") * 10000 + F.col("y") * 100 + F.col("z")).cast("long").alias("seed_id"), (F.col("x") + F.lit(0.1)).alias("x"), (F.col("y") + F.lit(0.2)).alias("y"), F.col("z").cast("double").alias("z"))
    return tk.track_by_joins(seeds, _made_peaks(spark, d), 6).select("seed_id", "pos", *[r(c).alias(c) for c in "xyz"])


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    fa = inp.volume(spark, d).select("x", "y", "z", F.lit(0.5).alias("fa"))
    cube = tk.cubes(_made_peaks(spark, d), fa, fa.select("x", "y", "z"), (16, 16, 8))
    seeds = fa.select((F.col("x") * 10000 + F.col("y") * 100 + F.col("z")).cast("long").alias("seed_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return tk.track(seeds, cube, 2, min_length=1.0, max_angle=60.0)


@query()
def track_probabilistic(spark: SparkSession, d: str) -> DataFrame:
    return _tracks(spark, d).select("seed_id", "sample", F.size("points").alias("n"), "reason_fwd", "reason_bwd", "kept")


@query()
def tracking_summary(spark: SparkSession, d: str) -> DataFrame:
    return tk.tracking_summary(_tracks(spark, d))


@query()
def surface_mesh_summary(spark: SparkSession, d: str) -> DataFrame:
    m = inp.mask(spark, d).withColumn("subject", F.lit("all"))
    v, f = sf.mesh(m, "subject")
    return sf.surface_summary(v.select("vid", "x", "y", "z"), f.select("fid", "v0", "v1", "v2"))


def _tetra(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vertices from embeddings, joined into a strip of faces."""
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("vid"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    ids = v.select("vid")
    f = ids.select(F.col("vid").alias("fid"), F.col("vid").alias("v0"), (F.col("vid") + 1).alias("v1"), (F.col("vid") + 2).alias("v2"))
    for k in (1, 2):
        f = f.join(ids.withColumnRenamed("vid", f"v{k}"), f"v{k}")
    return v, f.select("fid", "v0", "v1", "v2")


STRIP = """v AS (SELECT vec_id AS vid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
c AS (SELECT a.vid AS fid, a.vid AS v0, b.vid AS v1, c.vid AS v2, b.x-a.x AS ux, b.y-a.y AS uy, b.z-a.z AS uz, c.x-a.x AS wx, c.y-a.y AS wy, c.z-a.z AS wz, c.x-b.x AS tx, c.y-b.y AS ty, c.z-b.z AS tz FROM v a JOIN v b ON b.vid = a.vid + 1 JOIN v c ON c.vid = a.vid + 2),
ar AS (SELECT *, sqrt(pow(uy*wz-uz*wy, 2) + pow(uz*wx-ux*wz, 2) + pow(ux*wy-uy*wx, 2)) AS dbl FROM c)"""


@query(f"WITH {STRIP} SELECT fid, round(dbl / 2, 6) AS area FROM ar")
def face_areas(spark: SparkSession, d: str) -> DataFrame:
    return sf.face_areas(*_tetra(spark, d)).select("fid", r("area").alias("area"))


@query(f"""WITH {STRIP}, h AS (SELECT v1 AS i, v2 AS j, (ux*wx+uy*wy+uz*wz) / greatest(dbl, 1e-12) / 2 AS w FROM ar UNION ALL SELECT v2, v0, -(ux*tx+uy*ty+uz*tz) / greatest(dbl, 1e-12) / 2 FROM ar UNION ALL SELECT v0, v1, (wx*tx+wy*ty+wz*tz) / greatest(dbl, 1e-12) / 2 FROM ar),
b AS (SELECT i, j, w FROM h UNION ALL SELECT j, i, w FROM h UNION ALL SELECT i, i, -w FROM h UNION ALL SELECT j, j, -w FROM h) SELECT i, j, round(sum(w), 4) AS w FROM b GROUP BY 1, 2""")
def cotangent_laplacian(spark: SparkSession, d: str) -> DataFrame:
    return sf.cotangent_laplacian(*_tetra(spark, d)).select("i", "j", r("w", 4).alias("w"))


@query()
def vertex_curvature(spark: SparkSession, d: str) -> DataFrame:
    return sf.vertex_curvature(*_tetra(spark, d)).select("vid", r("curvature").alias("curvature"))


# Reports and catalogues.


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("running").alias("status"), F.col("o_orderdate").alias("created_at"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, CAST(o_orderdate AS VARCHAR)[1:10] AS created FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 50")
def jobs_recent(spark: SparkSession, d: str) -> DataFrame:
    return rp.recent_jobs(_jobs(spark, d), 50).select("job_id", "status", F.substring(F.col("created_at").cast("string"), 1, 10).alias("created"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status FROM orders) GROUP BY 1")
def jobs_by_status(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 7
    names = ["fa_map.nii.gz", "tracks.trk", "tracks.tck", "connectome.csv", "metrics.json", "run.log", "plot.png"]
    name = F.when(k == 0, names[0])
    for i in range(1, 7):
        name = name.when(k == i, names[i])
    return table(spark, d, "orders").select(F.concat(F.lit("sub-"), (F.col("o_custkey") % 20).cast("string")).alias("subject"), name.alias("name"), F.floor("o_totalprice").alias("size"))


FILES = "f AS (SELECT 'sub-' || (o_custkey % 20) AS subject, ['fa_map.nii.gz', 'tracks.trk', 'tracks.tck', 'connectome.csv', 'metrics.json', 'run.log', 'plot.png'][o_orderkey % 7 + 1] AS name, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders)"


@query(f"WITH {FILES} SELECT subject, count(*) AS files, CAST(sum(size) AS BIGINT) AS size, bool_or(name LIKE '%.trk' OR name LIKE '%.tck') AS has_streamlines, bool_or(name LIKE 'connectome%.csv') AS has_connectome, bool_or(name LIKE '%metrics.json') AS has_metrics, bool_or(name LIKE 'fa%') AS has_maps FROM f GROUP BY 1")
def results_available(spark: SparkSession, d: str) -> DataFrame:
    return rp.results(_files(spark, d))


@query(f"WITH {FILES} SELECT CASE WHEN name LIKE '%.nii.gz' THEN 'volume' WHEN name LIKE '%.tck' OR name LIKE '%.trk' THEN 'streamlines' WHEN name LIKE '%.csv' THEN 'matrix' WHEN name LIKE '%.json' THEN 'json' WHEN name LIKE '%.log' THEN 'text' WHEN name LIKE '%.png' THEN 'image' ELSE 'other' END AS type, count(*) AS n FROM f GROUP BY 1")
def file_classifier(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).groupBy(s.file_type(F.col("name")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


TREE = "t AS (SELECT '/data/sub-' || (o_custkey % 20) || '/ses-' || (o_orderkey % 3) || '/' || CASE WHEN o_orderkey % 4 = 0 THEN 'dwi' WHEN o_custkey % 20 < 15 THEN 'anat' ELSE 'func' END || '/x_' || o_orderkey || '_T1w.nii.gz' AS path, CAST(o_orderkey AS BIGINT) AS size, 'sub-' || (o_custkey % 20) AS subject, 'ses-' || (o_orderkey % 3) AS session, CASE WHEN o_orderkey % 4 = 0 THEN 'dwi' WHEN o_custkey % 20 < 15 THEN 'anat' ELSE 'func' END AS modality FROM orders)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    m = F.when(F.col("o_orderkey") % 4 == 0, "dwi").when(F.col("o_custkey") % 20 < 15, "anat").otherwise("func")
    return rp.scans(table(spark, d, "orders").select(F.concat(F.lit("/data/sub-"), (F.col("o_custkey") % 20).cast("string"), F.lit("/ses-"), (F.col("o_orderkey") % 3).cast("string"), F.lit("/"), m, F.lit("/x_"), F.col("o_orderkey").cast("string"), F.lit("_T1w.nii.gz")).alias("path"), F.col("o_orderkey").alias("size")))


@query(f"WITH {TREE}, p AS (SELECT subject, session, bool_or(modality = 'dwi') AND bool_or(modality = 'anat') AS ok, sum(size) AS size FROM t GROUP BY 1, 2) SELECT subject, bool_or(ok) AS complete, count(*) AS sessions, CAST(sum(size) AS BIGINT) AS size, true AS valid_name FROM p GROUP BY 1")
def dataset_completeness(spark: SparkSession, d: str) -> DataFrame:
    return rp.completeness(_tree(spark, d))


@query(f"WITH {TREE} SELECT path, subject, session, modality, 'T1w' AS suffix, '.nii.gz' AS extension FROM t WHERE modality = 'dwi' AND subject = 'sub-3'")
def layout_query(spark: SparkSession, d: str) -> DataFrame:
    return rp.scan_query(_tree(spark, d), modality="dwi", subject="sub-3").drop("size")


_SIX = {"global_efficiency": "global_efficiency", "path_length": "char_path_length", "density": "graph_density", "assortativity": "assortativity", "modularity": "modularity_of_lobes"}
NORM_ROWS = ", ".join(f"('{k}', {m}, {sd})" for k, m, sd in rp.NORMS)
SIX_VALUES = " UNION ALL ".join([f"SELECT '{k}' AS metric, (SELECT {k} FROM ({gp.SQL[q]})) AS value" if k != "density" else f"SELECT 'density', (SELECT round(density, 6) FROM ({gp.SQL[q]}))" for k, q in _SIX.items()])


@query(f"""WITH v AS ({SIX_VALUES} UNION ALL SELECT 'clustering', (SELECT round(avg(clustering), 6) FROM ({gp.SQL["weighted_clustering"]}))),
n AS (SELECT * FROM (VALUES {NORM_ROWS}) t(metric, mean, sd)), z AS (SELECT metric, value, (value - mean) / CAST(sd AS DOUBLE) AS z FROM v JOIN n USING (metric))
SELECT metric, value, round(z, 5) AS z, CASE WHEN abs(z) > 2 THEN 'significant' WHEN abs(z) > 1 THEN 'marginal' ELSE 'normal' END AS flag FROM z""")
def zscore_norms(spark: SparkSession, d: str) -> DataFrame:
    """All six metrics of the graph against their norms; modularity is that of the lobes."""
    value = {k: gp.Q[q](spark, d).select(F.lit(k).alias("metric"), r(k).alias("value")) for k, q in _SIX.items()}
    rows = gp.Q["weighted_clustering"](spark, d).agg(r(F.avg("clustering")).alias("value")).select(F.lit("clustering").alias("metric"), "value")
    for x in value.values():
        rows = rows.union(x)
    return rp.z_scores(rows).select("metric", "value", r("z", 5).alias("z"), "flag")


def _summary(spark: SparkSession, d: str, strategy: str = "targeted") -> DataFrame:
    """Global metrics of each subject; resilience_half is the efficiency after five of ten steps of removal."""
    e = inp.per_subject_edges(spark, d)
    half = gr.resilience(e, ["subject"], strategy=strategy, seed=42).where("step = 5").select("subject", F.col("efficiency").alias("resilience_half"))
    g = gr.global_metrics(e, ["subject"]).join(half, "subject")
    return g.withColumn("modularity", F.col("louvain_q")).withColumn("density", 2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1)))


@query()
def health_score(spark: SparkSession, d: str) -> DataFrame:
    return rp.health_score(_summary(spark, d))


@query()
def interpretation(spark: SparkSession, d: str) -> DataFrame:
    """Indicators look at targeted removal, this judgement at random removal."""
    return rp.interpretation(_summary(spark, d, "random"))


@query()
def pathology_indicators(spark: SparkSession, d: str) -> DataFrame:
    return rp.indicators(_summary(spark, d))


@query()
def metrics_mapping(spark: SparkSession, d: str) -> DataFrame:
    return rp.metrics_mapping(_summary(spark, d))


@query(f"WITH RECURSIVE {GRAPH} {inp.DISTANCES} {inp.BETWEENNESS} SELECT node, round(betweenness * degree, 6) AS vulnerability FROM deg JOIN bw USING (node) ORDER BY betweenness * degree DESC, node LIMIT 15")
def vulnerability_top(spark: SparkSession, d: str) -> DataFrame:
    """Degree times betweenness."""
    g = inp.graph(spark, d)
    return rp.vulnerability(gr.degree_strength(g).join(pt.betweenness(g), "node")).select("node", r("vulnerability").alias("vulnerability"))


#: Scans made of the volume: one in order, one with NaN, negative values and too few gradients, one of a single value.
_SCANS = {
    "sound": ("[value + 1, 2 * value + n]", 2, 2),
    "broken": ("[value - 30, CASE WHEN n % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(n AS DOUBLE) END, value]", 4, 2),
    "constant": ("[CAST(5 AS DOUBLE), CAST(5 AS DOUBLE)]", 2, 2),
}
_CHECKS = "('error', 'finite', bad = 0), ('error', 'volumes', n0 = n1), ('error', 'bvals', n1 = {b}), ('error', 'bvecs', n1 = {v}), ('warning', 'negative', low >= 0), ('warning', 'range', high <= 1e6), ('warning', 'constant', high > low)"


def _scan_sql(name: str, signal: str, b: int, v: int) -> str:
    agg = f"(SELECT count(*) FILTER (len(list_filter(s, lambda x: x IS NULL OR isnan(x))) > 0) AS bad, min(len(s)) AS n0, max(len(s)) AS n1, min(list_min(s)) AS low, max(list_max(s)) AS high FROM (SELECT {signal} AS s FROM vol))"
    return f"""SELECT '{name}' AS scan, t.level, t."check", t.passed FROM {agg} a, LATERAL (VALUES {_CHECKS.format(b=b, v=v)}) t(level, "check", passed)"""


@query(f"WITH {VOLUME} " + " UNION ALL ".join(_scan_sql(k, *x) for k, x in _SCANS.items()))
def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks of a sound scan and of two that must fail some."""
    rows = []
    for name, (signal, b, v) in _SCANS.items():
        sig = inp.volume(spark, d).select("x", "y", "z", F.expr("array(" + signal[1:-1] + ")").alias("signal"))
        rows.append(rp.quality_rows(sig, b, v).select(F.lit(name).alias("scan"), "level", "check", "passed"))
    return rows[0].union(rows[1]).union(rows[2])


@query(f"WITH {VOLUME} SELECT count(*) AS lines, CAST(sum(length(v)) AS BIGINT) AS chars FROM (SELECT printf('%.6f', value) AS v FROM vol)")
def matrix_text(spark: SparkSession, d: str) -> DataFrame:
    v = inp.volume(spark, d).select(F.monotonically_increasing_id().alias("u"), F.array("value").alias("row"))
    return sinks.matrix_lines(v).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("chars"))


@query()
def vtk_text(spark: SparkSession, d: str) -> DataFrame:
    return sinks.vtk_lines(inp.streamlines(spark, d)).select("part", "sl_id", F.md5("value").alias("digest"))


@query(f"WITH {VOLUME} SELECT CAST(floor(x / 10.0) * 100 + floor(y / 10.0) * 10 + floor(z / 10.0) AS BIGINT) AS label, count(*) AS volume FROM vol GROUP BY 1")
def grid_parcel_volumes(spark: SparkSession, d: str) -> DataFrame:
    from tractloom.operators import connectome as cn

    return cn.parcel_volumes(cn.grid_parcels(inp.volume(spark, d)))


@query()
def region_labels(spark: SparkSession, d: str) -> DataFrame:
    return rp.region_labels(spark)


@query(f"WITH {VOLUME} SELECT x, y, z FROM vol WHERE value > 20 EXCEPT SELECT x, y, z FROM vol WHERE n < 10")
def masked_voxels(spark: SparkSession, d: str) -> DataFrame:
    v = inp.volume(spark, d)
    return vx.masked(v.where("value > 20"), v.where("n >= 10")).select("x", "y", "z")


@query(f"WITH {VOLUME} SELECT * FROM (SELECT unnest([{{'level': 'error', 'check': 'nan', 'passed': count(*) FILTER (value IS NULL OR isnan(value)) = 0}}, {{'level': 'error', 'check': 'inf', 'passed': count(*) FILTER (isinf(value)) = 0}}, {{'level': 'warning', 'check': 'negative', 'passed': min(value) >= 0}}, {{'level': 'warning', 'check': 'range', 'passed': max(value) <= 1e6}}], recursive := true) FROM vol)")
def anatomical_checks(spark: SparkSession, d: str) -> DataFrame:
    return rp.anatomical_rows(inp.volume(spark, d))


JOBS = "j AS (SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status FROM orders)"


@query(f"""WITH {JOBS}, q AS (SELECT DISTINCT CAST(l_orderkey + l_linenumber AS VARCHAR) AS job_id, CASE WHEN l_linenumber % 2 = 0 THEN 'connectome' ELSE 'metrics' END AS kind FROM lineitem),
f AS (SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 'connectome' AS kind, '/results/' || o_orderkey AS path FROM orders WHERE o_orderkey % 3 = 0)
SELECT job_id, kind, CASE WHEN status IS NULL THEN 404 WHEN status <> 'completed' THEN 400 WHEN path IS NULL THEN 404 ELSE 200 END AS code, CASE WHEN status = 'completed' THEN path END AS path FROM q LEFT JOIN j USING (job_id) LEFT JOIN f USING (job_id, kind)""")
def job_result_lookups(spark: SparkSession, d: str) -> DataFrame:
    """A request per line item, for the order so many numbers on: there may be none."""
    kind = F.when(F.col("l_linenumber") % 2 == 0, "connectome").otherwise("metrics")
    requests = table(spark, d, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber")).cast("string").alias("job_id"), kind.alias("kind")).distinct()
    key = F.col("o_orderkey")
    found = table(spark, d, "orders").where(key % 3 == 0).select(key.cast("string").alias("job_id"), F.lit("connectome").alias("kind"), F.concat(F.lit("/results/"), key.cast("string")).alias("path"))
    return rp.result_lookups(requests, _jobs(spark, d), found)


@query("""WITH u AS (SELECT CAST(l_orderkey AS VARCHAR) AS job_id, l_linenumber AS step, 0.65 + 0.2 * (l_linenumber::DOUBLE / 7) AS progress FROM lineitem), m AS (SELECT job_id, max(step) AS step, arg_max(progress, step) AS progress FROM u GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS job_id, round(coalesce(progress, 0), 6) AS progress, CASE WHEN step IS NOT NULL THEN 'step ' || step END AS message, step AS updated_at FROM orders LEFT JOIN m ON job_id = CAST(o_orderkey AS VARCHAR)""")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    """Each line item tells of the tracking stage of its order."""
    n = F.col("l_linenumber")
    updates = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("job_id"), n.alias("at"), rp.stage_progress(n, F.lit(7), 0.65, 0.2).alias("progress"), F.concat(F.lit("step "), n.cast("string")).alias("message"))
    return rp.with_progress(_jobs(spark, d), updates).select("job_id", r("progress").alias("progress"), "message", "updated_at")


@query(f"""WITH {MASK}, s AS (SELECT {AT} FROM mask, (SELECT CAST(unnest(range(1, 3)) AS INTEGER) AS k)), v AS (SELECT printf('%.6f %.6f %.6f', sx, sy, sz) AS value FROM s)
SELECT 'whole_brain' AS strategy, 42 AS rng_seed, 'per_voxel=2, scale=0.5' AS parameters, count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(md5(value), 1, 10) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS checksum FROM v""")
def seed_log(spark: SparkSession, d: str) -> DataFrame:
    return sinks.seed_log(seeds_whole_brain(spark, d), "whole_brain", 42, per_voxel=2, scale=0.5)


def _folder(spark: SparkSession) -> str:
    """A new folder where all machines can write."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


@query(f"WITH {VOLUME} SELECT CAST('part-' || z % 2 AS VARCHAR) AS name, x, y, CAST(z AS INTEGER) AS z, value FROM vol WHERE value <> 0")
def nifti_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The volume as two NIfTI files of doubles, written by the sink and read back by slabs; voxels without a row are 0 in a file."""
    where = _folder(spark)
    v = inp.volume(spark, d).select(F.concat(F.lit("part-"), F.col("z") % 2).alias("name"), "x", "y", F.col("z").cast("int").alias("z"), "value")
    files.write_nifti(v, where, kind="f8")
    back = spark.read.format("nifti").option("pieceBytes", 1 << 16).load(where)
    return back.where("value <> 0").select(F.regexp_extract("path", r"(part-\d)\.nii$", 1).alias("name"), "x", "y", "z", "value")


@query(f"""WITH {POINTS}, f AS (SELECT sl_id, pos, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y FROM pts)
SELECT count(*) AS n, round(arg_min(x, pos), 4) AS first_x, round(arg_max(x, pos), 4) AS last_x, round(sum(y), 3) AS sum_y FROM f GROUP BY sl_id""")
def tck_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All paths as TCK files, one a task, read back by ranges of points."""
    where = _folder(spark)
    files.write_lines(inp.streamlines(spark, d), where, "tck")
    back = spark.read.format("tck").option("pieceBytes", 1 << 16).load(where)
    p = F.col("points")
    return back.select(F.size(p).cast("long").alias("n"), r(p[0]["x"], 4).alias("first_x"), r(F.element_at(p, -1)["x"], 4).alias("last_x"), r(F.aggregate(p, F.lit(0.0), lambda a, q: a + q["y"]), 3).alias("sum_y"))
