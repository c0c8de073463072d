"""Queries on region graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractloom.functions import scalars as s
from tractloom.operators import connectome as cn
from tractloom.operators import graph as gr
from tractloom.operators import paths as pt
from tractloom.plans import inputs as inp
from tractloom.plans.inputs import DISTANCES, EDGES, GRAPH, HOPS, PATHS, r, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {EDGES} SELECT i, j, weight, a.n_name AS name_i, b.n_name AS name_j FROM edges LEFT JOIN nation a ON i = a.n_nationkey LEFT JOIN nation b ON j = b.n_nationkey""")
def connectome_count(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"))
    return cn.with_labels(inp.edges(spark, d), labels)


def _weighted(kind: str, expr: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return inp.edges(spark, d, kind).select("i", "j", r("weight").alias("weight"))

    f.__name__ = f"connectome_{kind}"
    return query(f"WITH {PATHS} SELECT least(a, b) AS i, greatest(a, b) AS j, round(sum({expr}), 6) AS weight FROM paths WHERE a <> b GROUP BY 1, 2")(f)


_weighted("length_normalized", "1.0 / (len + 1e-6)")
_weighted("mean_fa", "fa")
_weighted("hybrid", "1.0 + fa")


@query(f"""WITH {EDGES}, v AS (SELECT c_nationkey AS label, CAST(count(*) AS DOUBLE) AS volume FROM customer GROUP BY 1)
SELECT i, j, round(weight / sqrt(greatest(coalesce(x.volume, 1), 1) * greatest(coalesce(y.volume, 1), 1)), 6) AS weight FROM edges LEFT JOIN v x ON i = x.label LEFT JOIN v y ON j = y.label""")
def connectome_volume_normalized(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("label")).agg(F.count(F.lit(1)).alias("volume"))
    return cn.normalized(inp.edges(spark, d), v).select("i", "j", r("weight").alias("weight"))


@query(f"""WITH {PATHS} SELECT a, b, count(*) AS n, round(avg(len), 6) AS mean_len, round(stddev_pop(len), 6) AS std_len, min(len) AS min_len, max(len) AS max_len FROM paths WHERE a <> b GROUP BY 1, 2""")
def edge_statistics(spark: SparkSession, d: str) -> DataFrame:
    return cn.edge_statistics(inp.paths(spark, d)).select("a", "b", "n", r("mean_len").alias("mean_len"), r("std_len").alias("std_len"), "min_len", "max_len")


@query(f"""WITH {EDGES} SELECT 2 * count(*) AS n_edges, count(*) AS n_edge_pairs, round(2 * count(*) / 625.0::DOUBLE, 6) AS matrix_density,
round(2 * count(*) / 600.0::DOUBLE, 6) AS graph_density, 2 * sum(weight) AS total_weight, round(avg(weight), 6) AS mean_edge_weight FROM edges""")
def connectome_info(spark: SparkSession, d: str) -> DataFrame:
    g = cn.info(inp.edges(spark, d), 25)
    return g.select("n_edges", "n_edge_pairs", *[r(c).alias(c) for c in ("matrix_density", "graph_density")], "total_weight", r("mean_edge_weight").alias("mean_edge_weight"))


@query(f"""WITH {EDGES} SELECT i, j, CASE WHEN weight < 100 THEN 0.0::DOUBLE ELSE weight END AS weight, round(log10(1 + CASE WHEN weight < 100 THEN 0 ELSE weight END), 6) AS log_weight FROM edges""")
def edge_threshold_log(spark: SparkSession, d: str) -> DataFrame:
    return cn.threshold_log(inp.edges(spark, d), 100.0).select("i", "j", "weight", r("log_weight").alias("log_weight"))


@query(f"""WITH {EDGES}, e2 AS (SELECT i AS u, j AS v, weight AS w FROM edges UNION ALL SELECT j, i, weight FROM edges)
SELECT a.n_nationkey AS u, array_to_string(list(CAST(CAST(coalesce(w, 0) AS BIGINT) AS VARCHAR) ORDER BY b.n_nationkey), ',') AS row FROM nation a CROSS JOIN nation b LEFT JOIN e2 ON u = a.n_nationkey AND v = b.n_nationkey GROUP BY 1""")
def dense_matrix(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    return cn.dense(inp.edges(spark, d), nodes).select("u", F.array_join(F.transform("row", lambda w: w.cast("long").cast("string")), ",").alias("row"))


@query(f"""WITH {PATHS} SELECT subject, sum(w) AS total, count(*) AS n_features, max(w) AS top FROM (SELECT subject, least(a, b) AS i, greatest(a, b) AS j, CAST(count(*) AS DOUBLE) AS w FROM paths WHERE a <> b GROUP BY 1, 2, 3) GROUP BY 1""")
def upper_triangle_features(spark: SparkSession, d: str) -> DataFrame:
    f = cn.upper_triangle(inp.per_subject_edges(spark, d), ["subject"])
    return f.select("subject", F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("features").cast("long").alias("n_features"), F.array_max("features").alias("top"))


# Local graph metrics.


@query(f"WITH {GRAPH} SELECT * FROM deg")
def node_degree_strength(spark: SparkSession, d: str) -> DataFrame:
    return gr.degree_strength(inp.graph(spark, d))


@query(f"WITH {GRAPH} SELECT (SELECT count(*) FROM deg) AS n, (SELECT count(*) FROM g) AS m, round(2.0::DOUBLE * (SELECT count(*) FROM g) / ((SELECT count(*) FROM deg) * ((SELECT count(*) FROM deg) - 1)), 6) AS density")
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return gr.density(inp.graph(spark, d)).select("n", "m", r("density").alias("density"))


TRI = ", tri AS (SELECT x.u AS a, x.v AS b, y.v AS c, x.w AS wab, y.w AS wac, z.w AS wbc FROM ends x JOIN ends y ON x.u = y.u JOIN ends z ON z.u = x.v AND z.v = y.v WHERE x.v < y.v)"


@query(f"""WITH {GRAPH} {TRI}, t AS (SELECT a AS node, sum(pow(wab * wac * wbc / pow((SELECT max(weight) FROM g), 3), 1.0 / 3)) AS t FROM tri GROUP BY 1)
SELECT node, degree, round(CASE WHEN degree < 2 THEN 0.0 ELSE 2 * coalesce(t, 0) / (degree * (degree - 1)) END, 6) AS clustering FROM deg LEFT JOIN t USING (node)""")
def weighted_clustering(spark: SparkSession, d: str) -> DataFrame:
    return gr.weighted_clustering(inp.graph(spark, d)).select("node", "degree", r("clustering").alias("clustering"))


@query(f"""WITH {GRAPH} {TRI} SELECT (SELECT count(*) // 3 FROM tri) AS triangles, CAST(sum(degree * (degree - 1) / 2) AS DOUBLE) AS triples, round((SELECT count(*) FROM tri) / sum(degree * (degree - 1) / 2), 6) AS transitivity FROM deg""")
def transitivity(spark: SparkSession, d: str) -> DataFrame:
    return gr.transitivity(inp.graph(spark, d)).select("triangles", F.col("triples").cast("double").alias("triples"), r("transitivity").alias("transitivity"))


@query(f"WITH {GRAPH} SELECT round(corr(x.degree, y.degree), 6) AS assortativity FROM ends JOIN deg x ON u = x.node JOIN deg y ON v = y.node")
def assortativity(spark: SparkSession, d: str) -> DataFrame:
    return gr.assortativity(inp.graph(spark, d)).select(r("assortativity").alias("assortativity"))


@query(f"""WITH {GRAPH}, ks AS (SELECT CAST(unnest(range(1, (SELECT max(degree) FROM deg))) AS BIGINT) AS k),
n AS (SELECT k, count(*) AS n FROM ks JOIN deg ON degree > k GROUP BY 1 HAVING count(*) > 1),
m AS (SELECT k, count(*) AS m FROM ks, g JOIN deg x ON i = x.node JOIN deg y ON j = y.node WHERE x.degree > k AND y.degree > k GROUP BY 1)
SELECT k, n, coalesce(m, 0) AS m, round(2.0::DOUBLE * coalesce(m, 0) / (n * (n - 1)), 6) AS phi FROM n LEFT JOIN m USING (k)""")
def rich_club(spark: SparkSession, d: str) -> DataFrame:
    return gr.rich_club(inp.graph(spark, d)).select(F.col("k").cast("long").alias("k"), "n", "m", r("phi").alias("phi"))


def _lobes(spark: SparkSession, d: str) -> DataFrame:
    n, g = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(g), n["n_regionkey"] == g["r_regionkey"]).select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"), F.col("r_name").alias("lobe"), F.when(F.col("n_nationkey") % 2 == 0, "left").otherwise("right").alias("hemisphere"))


LOBES = ", lobes AS (SELECT n_nationkey AS node, n_name AS name, r_name AS lobe, CASE WHEN n_nationkey % 2 = 0 THEN 'left' ELSE 'right' END AS hemisphere FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {GRAPH} {LOBES} SELECT lobe, count(*) AS n, round(avg(degree), 6) AS mean_degree, sum(strength) AS strength FROM deg JOIN lobes USING (node) GROUP BY 1")
def lobe_metrics(spark: SparkSession, d: str) -> DataFrame:
    g = gr.degree_strength(inp.graph(spark, d)).join(F.broadcast(_lobes(spark, d)), "node").where("lobe <> 'unknown'")
    return g.groupBy("lobe").agg(F.count(F.lit(1)).alias("n"), r(F.avg("degree")).alias("mean_degree"), F.sum("strength").alias("strength"))


@query(f"WITH {GRAPH} {LOBES} SELECT hemisphere, round(avg(degree), 6) AS mean_degree, round(avg(strength), 6) AS mean_strength FROM deg JOIN lobes USING (node) GROUP BY 1")
def hemisphere_metrics(spark: SparkSession, d: str) -> DataFrame:
    g = gr.degree_strength(inp.graph(spark, d)).join(F.broadcast(_lobes(spark, d)), "node")
    return g.groupBy("hemisphere").agg(r(F.avg("degree")).alias("mean_degree"), r(F.avg("strength")).alias("mean_strength"))


@query(f"WITH {GRAPH} {LOBES} SELECT node, name, degree, strength FROM deg JOIN lobes USING (node) ORDER BY degree DESC, strength DESC, node LIMIT 10")
def hub_top_n(spark: SparkSession, d: str) -> DataFrame:
    g = gr.degree_strength(inp.graph(spark, d)).join(F.broadcast(_lobes(spark, d)), "node")
    return g.orderBy(F.desc("degree"), F.desc("strength"), "node").limit(10).select("node", "name", "degree", "strength")


@query(f"WITH {GRAPH} SELECT round(coalesce(corr(degree, strength), 0), 6) AS r, count(*) AS n FROM deg")
def metric_correlation(spark: SparkSession, d: str) -> DataFrame:
    return gr.degree_strength(inp.graph(spark, d)).agg(r(F.coalesce(F.corr("degree", "strength"), F.lit(0.0))).alias("r"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {GRAPH}, x AS (SELECT (SELECT count(*) FROM deg) AS n, (SELECT count(*) FROM g) AS m)
SELECT n, m, round(2.0::DOUBLE * m / (n * (n - 1)), 6) AS random_clustering, round(ln(n) / ln(n * (2.0::DOUBLE * m / (n * (n - 1)))), 6) AS random_path_length FROM x""")
def random_expectation(spark: SparkSession, d: str) -> DataFrame:
    x = gr.density(inp.graph(spark, d))
    c = s.random_clustering(F.col("n"), F.col("m"))
    return x.select("n", "m", r(c).alias("random_clustering"), r(s.random_path_length(F.col("n"), c)).alias("random_path_length"))


@query(f"""WITH {GRAPH} {LOBES}, c AS (SELECT node, lobe AS community FROM lobes), w AS (SELECT sum(weight) AS m FROM g),
q AS (SELECT c.community, sum(strength) AS s, (SELECT coalesce(sum(weight), 0) FROM g JOIN c x ON i = x.node JOIN c y ON j = y.node WHERE x.community = c.community AND y.community = c.community) AS inside FROM deg JOIN c USING (node) GROUP BY 1)
SELECT round(sum(inside / m - pow(s / (2 * m), 2)), 6) AS modularity FROM q, w""")
def modularity_of_lobes(spark: SparkSession, d: str) -> DataFrame:
    c = _lobes(spark, d).select("node", F.col("lobe").alias("community"))
    return gr.modularity(inp.graph(spark, d), c).select(r("modularity").alias("modularity"))


# Path metrics.


@query(f"WITH RECURSIVE {GRAPH} {HOPS} SELECT src, dst, hops FROM hop")
def hop_distances(spark: SparkSession, d: str) -> DataFrame:
    return gr.hop_distances(inp.graph(spark, d)).select("src", "dst", "hops")


def _one(g: DataFrame) -> DataFrame:
    return g.withColumn("subject", F.lit("all"))


@query(f"WITH RECURSIVE {GRAPH} {HOPS} SELECT round(sum(1.0::DOUBLE / hops) / ((SELECT count(*) FROM deg) * ((SELECT count(*) FROM deg) - 1)), 6) AS global_efficiency FROM hop")
def global_efficiency(spark: SparkSession, d: str) -> DataFrame:
    return pt.global_efficiency(inp.graph(spark, d)).select(r("global_efficiency").alias("global_efficiency"))


@query(f"""WITH {GRAPH} {DISTANCES}, comp AS (SELECT src, min(dst) AS c FROM d5 GROUP BY 1), big AS (SELECT c FROM comp GROUP BY 1 ORDER BY count(*) DESC, c LIMIT 1)
SELECT round(sum(d) / (sum(CASE WHEN src <> dst THEN 1 ELSE 0 END)), 6) AS path_length FROM d5 JOIN comp USING (src) WHERE c = (SELECT c FROM big)""")
def char_path_length(spark: SparkSession, d: str) -> DataFrame:
    return pt.path_length(inp.graph(spark, d)).select(r("path_length").alias("path_length"))


@query(f"""WITH {GRAPH} {DISTANCES} SELECT src AS node, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d) * (count(*) - 1) / ((SELECT count(*) FROM deg) - 1) ELSE 0 END, 6) AS closeness FROM d5 GROUP BY 1""")
def closeness(spark: SparkSession, d: str) -> DataFrame:
    return pt.closeness(inp.graph(spark, d)).select("node", r("closeness").alias("closeness"))


@query(f"""WITH RECURSIVE {GRAPH} {HOPS},
np AS (SELECT u AS src, u AS dst, 0 AS hops, 1.0::DOUBLE AS c FROM (SELECT DISTINCT u FROM ends)
  UNION ALL SELECT np.src, ends.v, any_value(np.hops) + 1, sum(np.c) FROM np JOIN ends ON np.dst = ends.u JOIN hop h ON h.src = np.src AND h.dst = ends.v AND h.hops = np.hops + 1 GROUP BY np.src, ends.v),
pairs AS (SELECT a.src AS s, b.dst AS t, a.dst AS v, a.c * b.c / x.c AS share FROM np a JOIN np b ON b.src = a.dst JOIN np x ON x.src = a.src AND x.dst = b.dst
  WHERE a.hops + b.hops = x.hops AND a.dst <> a.src AND a.dst <> b.dst)
SELECT node, round(coalesce((SELECT sum(share) FROM pairs WHERE v = node), 0) / (((SELECT count(*) FROM deg) - 1) * ((SELECT count(*) FROM deg) - 2)), 6) AS betweenness FROM deg""")
def betweenness_hop(spark: SparkSession, d: str) -> DataFrame:
    return pt.betweenness(inp.graph(spark, d), "hop").select("node", r("betweenness").alias("betweenness"))


@query(f"WITH RECURSIVE {GRAPH} {HOPS}, c AS (SELECT src AS node, least(src, min(dst)) AS component FROM hop GROUP BY 1) SELECT node, component FROM c")
def components(spark: SparkSession, d: str) -> DataFrame:
    return pt.components(inp.graph(spark, d))


@query(f"WITH {GRAPH} {DISTANCES} SELECT dst, d AS distance FROM d5 WHERE src = (SELECT min(u) FROM ends)")
def shortest_path_from(spark: SparkSession, d: str) -> DataFrame:
    g = inp.graph(spark, d)
    first = pt.nodes_of(g).agg(F.min("node").alias("node")).where("node IS NOT NULL")
    return pt.distances_from(g, first).select(F.col("node").alias("dst"), F.col("d").alias("distance"))


@query(f"""WITH RECURSIVE {GRAPH}, sub AS (SELECT x.u AS center, y.u AS u, y.v AS v FROM ends x JOIN ends y ON y.u = x.v JOIN ends z ON z.u = x.u AND z.v = y.v),
lw AS (SELECT DISTINCT u AS center, v AS src, v AS dst, 0 AS hops FROM ends UNION SELECT lw.center, lw.src, sub.v, lw.hops + 1 FROM lw JOIN sub ON sub.center = lw.center AND sub.u = lw.dst WHERE lw.hops < 20),
lh AS (SELECT center, src, dst, min(hops) AS hops FROM lw GROUP BY 1, 2, 3 HAVING min(hops) > 0)
SELECT node, round(CASE WHEN degree < 2 THEN 0 ELSE coalesce((SELECT sum(1.0::DOUBLE / hops) FROM lh WHERE center = node), 0) / (degree * (degree - 1)) END, 6) AS local_efficiency FROM deg""")
def local_efficiency(spark: SparkSession, d: str) -> DataFrame:
    return pt.local_efficiency(inp.graph(spark, d)).select("node", r("local_efficiency").alias("local_efficiency"))


def _resilience(order: str) -> str:
    return f"""WITH RECURSIVE {GRAPH}, st AS (SELECT CAST(unnest(range(0, 11)) AS BIGINT) AS step), ord AS (SELECT node, row_number() OVER (ORDER BY {order}) - 1 AS k, count(*) OVER () AS n FROM deg),
alive AS (SELECT step, node, n FROM st, ord WHERE k >= step * greatest(1, n // 10)), ae AS (SELECT a.step, u, v FROM alive a JOIN ends ON u = a.node JOIN alive b ON b.step = a.step AND b.node = v),
w AS (SELECT step, node AS src, node AS dst, 0 AS hops FROM alive UNION SELECT w.step, w.src, ae.v, w.hops + 1 FROM w JOIN ae ON ae.step = w.step AND ae.u = w.dst WHERE w.hops < 20),
h AS (SELECT step, src, dst, min(hops) AS hops FROM w GROUP BY 1, 2, 3 HAVING min(hops) > 0), e AS (SELECT step, sum(1.0::DOUBLE / hops) AS e FROM h GROUP BY 1), c AS (SELECT step, count(*) AS n FROM alive GROUP BY 1)
SELECT step, round(CASE WHEN coalesce(n, 0) > 1 THEN coalesce(e, 0) / (n * (n - 1)) ELSE 0 END, 6) AS efficiency, coalesce(n, 0) AS size FROM st LEFT JOIN c USING (step) LEFT JOIN e USING (step)"""


@query(_resilience("degree DESC, node"))
def resilience_targeted(spark: SparkSession, d: str) -> DataFrame:
    g = inp.graph(spark, d)
    return pt.removed_in_steps(g, pt.by_degree(g)).select("step", r("efficiency").alias("efficiency"), "size")


@query()
def node_metrics_per_subject(spark: SparkSession, d: str) -> DataFrame:
    return gr.node_metrics(inp.per_subject_edges(spark, d), ["subject"])


@query()
def global_metrics_per_subject(spark: SparkSession, d: str) -> DataFrame:
    return gr.global_metrics(inp.per_subject_edges(spark, d), ["subject"])


@query()
def communities_louvain(spark: SparkSession, d: str) -> DataFrame:
    return gr.communities(_one(inp.graph(spark, d)), ["subject"])


@query()
def communities_leiden(spark: SparkSession, d: str) -> DataFrame:
    return gr.communities(_one(inp.graph(spark, d)), ["subject"], refine=True)


@query(f"""WITH RECURSIVE {GRAPH} {DISTANCES} {inp.BETWEENNESS} SELECT node, degree, strength, round(betweenness, 6) AS betweenness FROM deg JOIN bw USING (node)
WHERE degree > (SELECT quantile_cont(degree, 0.75) FROM deg) AND betweenness > (SELECT quantile_cont(betweenness, 0.75) FROM bw)""")
def hub_p75(spark: SparkSession, d: str) -> DataFrame:
    g = inp.graph(spark, d)
    return gr.hubs(gr.degree_strength(g).join(pt.betweenness(g), "node")).select("node", "degree", "strength", r("betweenness").alias("betweenness"))


@query(_resilience("md5('42:' || node), node"))
def resilience_random(spark: SparkSession, d: str) -> DataFrame:
    g = inp.graph(spark, d)
    return pt.removed_in_steps(g, pt.at_random(g, 42)).select("step", r("efficiency").alias("efficiency"), "size")
