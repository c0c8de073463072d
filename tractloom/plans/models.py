"""Queries on harmonisation, classification and voxel algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractloom.operators import connectome as cn
from tractloom.operators import harmonize as hz
from tractloom.operators import harmonizer as hr
from tractloom.operators import explain as ex
from tractloom.operators import learning as ml
from tractloom.operators import preprocessing as pp
from tractloom.operators import registration as rg
from tractloom.operators import tiles as tl
from tractloom.operators import training as tr
from tractloom.operators import voxels as vx
from tractloom.plans import inputs as inp
from tractloom.plans.inputs import FEATURES, MASK, VOLUME, r, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _batched(spark: SparkSession, d: str) -> DataFrame:
    return inp.features(spark, d).select("id", (F.col("id") % 3).cast("int").alias("batch"), "feature", "value")


Z = FEATURES + """,
z AS (SELECT id, CAST(id % 3 AS INTEGER) AS batch, feature, value - avg(value) OVER (PARTITION BY feature, id % 3) + avg(value) OVER (PARTITION BY feature) AS z, avg(value) OVER (PARTITION BY feature) AS m FROM feat),
bp0 AS (SELECT feature, batch, count(*) AS n, avg(z) AS gamma, var_samp(z) AS delta, sum(z * z) AS zz FROM z GROUP BY 1, 2),
bp1 AS (SELECT *, avg(gamma) OVER w AS gb, var_pop(gamma) OVER w AS t2, avg(delta) OVER w AS mu, var_pop(delta) OVER w AS v FROM bp0 WINDOW w AS (PARTITION BY batch)),
bp2 AS (SELECT *, (t2 * n / delta * gamma + gb) / (t2 * n / delta + 1) AS gs FROM bp1),
bp AS (SELECT *, (mu * (mu * mu / v + 1) + (zz - 2 * gs * n * gamma + n * gs * gs) / 2) / (mu * mu / v + 2 + n / 2.0 - 1) AS ds FROM bp2)"""


@query(f"WITH {Z} SELECT id, feature, round(z, 6) AS z FROM z")
def combat_standardize(spark: SparkSession, d: str) -> DataFrame:
    return hz.standardized(_batched(spark, d)).select("id", "feature", r("z").alias("z"))


@query(f"WITH {Z} SELECT feature, batch, n, round(gamma, 6) AS gamma, round(delta, 6) AS delta, round(gs, 6) AS gamma_star, round(ds, 6) AS delta_star FROM bp")
def combat_params(spark: SparkSession, d: str) -> DataFrame:
    p = hz.batch_parameters(hz.standardized(_batched(spark, d)))
    return p.select("feature", "batch", "n", *[r(c).alias(c) for c in ("gamma", "delta", "gamma_star", "delta_star")])


@query(f"WITH {Z}, s AS (SELECT feature, batch, gs, ds / avg(ds) OVER (PARTITION BY feature) AS k FROM bp) SELECT id, batch, feature, round((z - gs) / greatest(sqrt(k), 1e-8) + m, 5) AS value FROM z JOIN s USING (feature, batch)")
def combat_harmonized(spark: SparkSession, d: str) -> DataFrame:
    return hz.combat(_batched(spark, d)).select("id", "batch", "feature", r("value", 5).alias("value"))


@query(SQL["combat_harmonized"])
def harmonizer_transform(spark: SparkSession, d: str) -> DataFrame:
    """The fitted form, row by row: on the rows of the fit it is the one-step form."""
    x = _batched(spark, d)
    return hr.Harmonizer(location="fitted").fit(x).transform(x).select("id", "batch", "feature", r("value", 5).alias("value"))


@query(f"WITH {FEATURES}, x AS (SELECT id, feature, value, CAST(id AS DOUBLE) AS c FROM feat), b AS (SELECT feature, regr_slope(value, c) AS s, regr_intercept(value, c) AS i, avg(value) AS m FROM x GROUP BY 1) SELECT id, feature, round(value - s * c - i + m, 5) AS value FROM x JOIN b USING (feature)")
def confound_residual(spark: SparkSession, d: str) -> DataFrame:
    v = inp.features(spark, d).select("id", "feature", "value")
    x = hz.design(v.select("id").distinct().withColumn("age", F.col("id").cast("double")), ["age"])
    return hz.residuals(v, x).select("id", "feature", r("value", 5).alias("value"))


@query(f"WITH {FEATURES} SELECT id, feature, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1 END, 5) AS value FROM feat WINDOW w AS (PARTITION BY feature)")
def feature_scaling(spark: SparkSession, d: str) -> DataFrame:
    return ml.scaled(inp.features(spark, d)).select("id", "feature", r("value", 5).alias("value"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    l, x = table(spark, d, "labels"), table(spark, d, "documents")
    score = F.round(1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1000.0)), 3)
    return l.join(x.select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), score.alias("score"))


SCORED = "sc AS (SELECT doc_id AS id, quality AS y, round(1 / (1 + exp(-(n_chars - 1500) / 1000.0)), 3) AS score FROM labels JOIN documents USING (doc_id)), tot AS (SELECT sum(y) AS pos, count(*) - sum(y) AS neg FROM sc), cum AS (SELECT score, p, n, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n - p) OVER (ORDER BY score DESC) AS fp FROM (SELECT score, sum(y) AS p, count(*) AS n FROM sc GROUP BY 1))"


@query(f"WITH {SCORED} SELECT score, round(fp::DOUBLE / neg, 6) AS fpr, round(tp::DOUBLE / pos, 6) AS tpr FROM cum, tot")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return ml.roc_curve(_scored(spark, d)).select("score", r("fpr").alias("fpr"), r("tpr").alias("tpr"))


@query(f"WITH {SCORED} SELECT round((SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) FROM sc a, sc b WHERE a.y = 1 AND b.y = 0)::DOUBLE / (pos * neg), 6) AS auc FROM tot")
def auc(spark: SparkSession, d: str) -> DataFrame:
    return ml.auc(_scored(spark, d)).select(r("auc").alias("auc"))


@query(f"WITH {SCORED} SELECT score, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / pos, 6) AS recall FROM cum, tot")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return ml.pr_curve(_scored(spark, d)).select("score", r("precision").alias("precision"), r("recall").alias("recall"))


@query(f"WITH {SCORED} SELECT round(sum(p::DOUBLE / pos * tp / (tp + fp)), 6) AS average_precision FROM cum, tot")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return ml.average_precision(_scored(spark, d)).select(r("average_precision").alias("average_precision"))


@query(f"WITH {SCORED} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS share FROM sc GROUP BY 1")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return ml.calibration(_scored(spark, d)).select("bin", "n", r("mean_score").alias("mean_score"), r("share").alias("share"))


@query(f"WITH {SCORED} SELECT round(avg(pow(score - y, 2)), 6) AS brier FROM sc")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return ml.brier(_scored(spark, d)).select(r("brier").alias("brier"))


@query(f"WITH {SCORED} SELECT y, CAST(score >= 0.5 AS INTEGER) AS predicted, count(*) AS n FROM sc GROUP BY 1, 2")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return ml.confusion(_scored(spark, d).withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


@query(f"""WITH {SCORED}, p AS (SELECT y, CAST(score >= 0.5 AS INTEGER) AS q FROM sc), c AS (SELECT k AS class, count(*) FILTER (y = k AND q = k) AS hit, count(*) FILTER (y = k) AS support, count(*) FILTER (q = k) AS said FROM p, (VALUES (0), (1)) t(k) GROUP BY 1)
SELECT class, round(coalesce(hit::DOUBLE / nullif(said, 0), 0), 6) AS precision, round(coalesce(hit::DOUBLE / nullif(support, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * hit / nullif(said + support, 0), 0), 6) AS f1, support FROM c""")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    c = ml.class_report(_scored(spark, d).withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
    return c.select("class", *[r(k).alias(k) for k in ("precision", "recall", "f1")], "support")


@query("""WITH f AS (SELECT vec_id AS id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings) SELECT label, CAST(fold AS INTEGER) AS fold, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM f GROUP BY 1, 2""")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return ml.stratified_folds(e, 5).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("""WITH f AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT id, label, CASE WHEN k <= round(n * 0.2::DOUBLE) THEN 'test' WHEN k <= round(n * 0.2::DOUBLE) + round((n - round(n * 0.2::DOUBLE)) * 0.2::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM f""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return ml.stratified_split(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"))


@query("""WITH p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))) AS e FROM embeddings), q AS (SELECT id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM p)
SELECT id, round(list_max(p), 6) AS confidence, round(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-10))), 6) AS uncertainty FROM q""")
def prediction_entropy(spark: SparkSession, d: str) -> DataFrame:
    from tractloom.functions import scalars as s

    e = F.transform("embedding", lambda x: F.exp(x.cast("double")))
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), e.alias("e")).withColumn("t", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    p = p.select("id", F.transform("e", lambda x: x / F.col("t")).alias("p"))
    return p.select("id", r(s.confidence(F.col("p"))).alias("confidence"), r(s.entropy(F.col("p"))).alias("uncertainty"))


def _binary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("label IN (0, 1)")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("features"))


@query()
def cross_validation(spark: SparkSession, d: str) -> DataFrame:
    return ml.cross_validate(_binary(spark, d), 3)


@query()
def predictions(spark: SparkSession, d: str) -> DataFrame:
    x = ml.with_vector(ml.balanced(_binary(spark, d)))
    return ml.predict(ml.classifier("random_forest", trees=10, weight="weight").fit(x), x)


@query()
def linear_explanations(spark: SparkSession, d: str) -> DataFrame:
    x = ml.with_vector(_binary(spark, d))
    return ml.top_contributions(ml.linear_contributions(ml.classifier(n=x.count()).fit(x), x), 5)


@query()
def tree_explanations(spark: SparkSession, d: str) -> DataFrame:
    """The five features that move each prediction of a forest most."""
    x = ml.with_vector(_binary(spark, d))
    return ml.top_contributions(ex.tree_contributions(ml.classifier("random_forest", trees=20).fit(x), x), 5)


# Voxels.


@query(f"WITH {MASK}, s AS (SELECT x + o.dx AS x, y + o.dy AS y, z + o.dz AS z FROM mask, (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dx, dy, dz)) SELECT x, y, z FROM s GROUP BY 1, 2, 3 HAVING count(*) = 7")
def erode6(spark: SparkSession, d: str) -> DataFrame:
    return vx.erode(inp.mask(spark, d))


@query(f"WITH {MASK} SELECT DISTINCT x + o.dx AS x, y + o.dy AS y, z + o.dz AS z FROM mask, (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dx, dy, dz)")
def dilate6(spark: SparkSession, d: str) -> DataFrame:
    return vx.dilate(inp.mask(spark, d))


@query(f"""WITH RECURSIVE {MASK}, v AS (SELECT *, x::BIGINT * 4398046511104 + y::BIGINT * 2097152 + z AS id FROM mask),
e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
c(id, l) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT n.id, n.m FROM (SELECT e.a AS id, min(c.l) AS m FROM c JOIN e ON e.b = c.id GROUP BY 1) n JOIN recurring.c o ON o.id = n.id WHERE n.m < o.l)
SELECT count(DISTINCT l) AS components, (SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY l)) AS largest FROM c""")
def mask_components(spark: SparkSession, d: str) -> DataFrame:
    c = vx.label_components(inp.mask(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))


@query(f"""WITH {VOLUME}, r AS (SELECT min(value) AS lo, max(value) AS hi FROM vol WHERE value > 0), b AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 256)), 255) AS INTEGER) AS bin, lo, (hi - lo) / 256 AS w FROM vol, r WHERE value > 0),
h AS (SELECT bin, any_value(lo) + bin * any_value(w) + any_value(w) / 2 AS c, count(*) AS n FROM b GROUP BY 1), x AS (SELECT bin, c, sum(n) OVER f AS w1, sum(n * c) OVER f AS s1, sum(n) OVER () - sum(n) OVER f AS w2, sum(n * c) OVER () - sum(n * c) OVER f AS s2 FROM h WINDOW f AS (ORDER BY bin))
SELECT round(arg_max(c, w1 * w2 * pow(s1 / (w1 + 1e-10) - s2 / (w2 + 1e-10), 2)), 5) AS threshold FROM x""")
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return vx.otsu(inp.volume(spark, d)).select(r("threshold", 5).alias("threshold"))


@query(f"""WITH {MASK}, v AS (SELECT value, mask.x IS NOT NULL AS m FROM vol LEFT JOIN mask USING (x, y, z))
SELECT count(*) AS voxels, count(*) FILTER (m) AS inside, round(avg(value) FILTER (m), 5) AS mean_in, round(avg(value) FILTER (NOT m), 5) AS mean_out, round(count(*) FILTER (m) / count(*), 6) AS fraction, round(abs(avg(value) FILTER (m) - avg(value) FILTER (NOT m)) / stddev_pop(value) FILTER (NOT m), 5) AS cnr FROM v""")
def mask_quality(spark: SparkSession, d: str) -> DataFrame:
    q = vx.mask_quality(inp.volume(spark, d), inp.mask(spark, d))
    return q.select("voxels", F.col("inside").cast("long").alias("inside"), r("mean_in", 5).alias("mean_in"), r("mean_out", 5).alias("mean_out"), r("fraction").alias("fraction"), r("cnr", 5).alias("cnr"))


@query(f"WITH {MASK} SELECT round(stddev_pop(value) / avg(value), 6) AS cv FROM vol JOIN mask USING (x, y, z)")
def bias_cv(spark: SparkSession, d: str) -> DataFrame:
    return vx.variation(inp.volume(spark, d), inp.mask(spark, d)).select(r("cv").alias("cv"))


_G = vx.gaussian(1.0)


def _conv(name: str, before: str, axis: str) -> str:
    other = [c for c in "xyz" if c != axis]
    return f", {name} AS (SELECT x, y, z, value FROM (SELECT a.x, a.y, a.z, sum(w * b.value) / sum(w) AS value FROM {before} a JOIN {before} b ON {' AND '.join(f'a.{c} = b.{c}' for c in other)} JOIN k ON b.{axis} = a.{axis} + k.k GROUP BY 1, 2, 3))"


@query(f"WITH {VOLUME}, k AS (SELECT unnest(range(-4, 5)) AS k, unnest([{', '.join(f'{w!r}::DOUBLE' for w in _G)}]) AS w), v0 AS (SELECT x, y, z, value FROM vol){_conv('v1', 'v0', 'x')}{_conv('v2', 'v1', 'y')}{_conv('v3', 'v2', 'z')} SELECT x, y, z, round(greatest(0.5, least(2.0, value / (SELECT quantile_cont(value, 0.5) FROM v3))), 5) AS field FROM v3")
def bias_field(spark: SparkSession, d: str) -> DataFrame:
    return vx.bias_field(inp.volume(spark, d), 1.0).select("x", "y", "z", r("field", 5).alias("field"))


@query(f"WITH {VOLUME} SELECT round(min(value), 5) AS min, round(max(value), 5) AS max, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.01), 5) AS p1, round(quantile_cont(value, 0.99), 5) AS p99 FROM vol")
def volume_percentiles(spark: SparkSession, d: str) -> DataFrame:
    v = vx.describe(inp.volume(spark, d))
    return v.select(*[r(c, 5).alias(c) for c in v.columns])


@query(f"WITH {VOLUME}, s AS (SELECT quantile_cont(value, 0.5) FILTER (value > 0) AS med, quantile_cont(value, 0.99) AS p99 FROM vol) SELECT x, y, z, round(least(value * 1000.0 / med, 2 * p99 * 1000.0 / med), 4) AS value FROM vol, s")
def histogram_correction(spark: SparkSession, d: str) -> DataFrame:
    return vx.histogram_corrected(inp.volume(spark, d)).select("x", "y", "z", r("value", 4).alias("value"))


def _gradients(spark: SparkSession, d: str) -> DataFrame:
    """A direction per embedding."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("vol"), (F.col("label") * 500.0 + F.col("vec_id") % 7 * 3).alias("bval"), *[F.col("embedding")[k].cast("double").alias("g" + c) for k, c in enumerate("xyz")])


GRAD = "gr AS (SELECT CAST(vec_id AS INTEGER) AS vol, label * 500.0::DOUBLE + vec_id % 7 * 3 AS bval, CAST(embedding[1] AS DOUBLE) AS gx, CAST(embedding[2] AS DOUBLE) AS gy, CAST(embedding[3] AS DOUBLE) AS gz FROM embeddings)"


@query(f"WITH {GRAD} SELECT CASE WHEN bval <= 50 THEN 'b0' ELSE 'b' || CAST(round_even(bval / 100, 0) * 100 AS INTEGER) END AS shell, count(*) AS n, min(bval) AS min_b, max(bval) AS max_b FROM gr GROUP BY 1")
def bval_shells(spark: SparkSession, d: str) -> DataFrame:
    return vx.shells(_gradients(spark, d))


@query(f"WITH {GRAD} SELECT vol, CASE WHEN bval < 50 THEN 0.0 ELSE round_even(bval / 5, 0) * 5 END AS bval FROM gr")
def bval_rounding(spark: SparkSession, d: str) -> DataFrame:
    return vx.rounded_bvals(_gradients(spark, d)).select("vol", "bval")


@query(f"""WITH {GRAD}, w AS (SELECT vol, bval, sqrt(gx*gx+gy*gy+gz*gz) AS n, gx, gy, gz FROM gr) SELECT vol, bval, round(CASE WHEN bval < 50 THEN 0 ELSE gx / n END, 6) + 0.0 AS gx, round(CASE WHEN bval < 50 THEN 0 ELSE gy / n END, 6) + 0.0 AS gy, round(CASE WHEN bval < 50 THEN 0 ELSE gz / n END, 6) + 0.0 AS gz FROM w""")
def bvec_normalization(spark: SparkSession, d: str) -> DataFrame:
    return vx.normalized_bvecs(_gradients(spark, d)).select("vol", "bval", *[r(c).alias(c) for c in ("gx", "gy", "gz")])


@query(f"""WITH {GRAD}, w AS (SELECT vol, sqrt(gx*gx+gy*gy+gz*gz) AS n, gx, gy, gz FROM gr WHERE bval > 50)
SELECT a.vol AS a, b.vol AS b, round(sqrt(pow(a.gx-b.gx,2)+pow(a.gy-b.gy,2)+pow(a.gz-b.gz,2)), 5) AS distance, round(degrees(acos(least(1.0, greatest(0.0, abs(a.gx*b.gx+a.gy*b.gy+a.gz*b.gz) / (a.n*b.n))))), 4) AS angle FROM w a JOIN w b ON a.vol < b.vol""")
def gradient_angles(spark: SparkSession, d: str) -> DataFrame:
    return vx.direction_pairs(_gradients(spark, d), digits=(5, 4))


@query()
def gradient_quality(spark: SparkSession, d: str) -> DataFrame:
    return vx.gradient_quality(vx.normalized_bvecs(_gradients(spark, d)))


@query(f"""WITH {VOLUME}, p AS (SELECT vec_id AS id, abs(CAST(embedding[1] AS DOUBLE)) * 4.0::DOUBLE + 2 AS x, abs(CAST(embedding[2] AS DOUBLE)) * 4.0::DOUBLE + 2 AS y, abs(CAST(embedding[3] AS DOUBLE)) * 2.0::DOUBLE + 1.2 AS z FROM embeddings),
c AS (SELECT id, CAST(floor(x) AS INTEGER) + dx AS vx, CAST(floor(y) AS INTEGER) + dy AS vy, CAST(floor(z) AS INTEGER) + dz AS vz, (CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN dz = 1 THEN z - floor(z) ELSE 1 - z + floor(z) END) AS w FROM p, (VALUES (0),(1)) a(dx), (VALUES (0),(1)) b(dy), (VALUES (0),(1)) e(dz))
SELECT id, round(CASE WHEN count(value) = 8 THEN sum(w * value) END, 5) AS value FROM c LEFT JOIN vol ON vx = vol.x AND vy = vol.y AND vz = vol.z GROUP BY 1""")
def trilinear_sample(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    p = e.select(F.col("vec_id").alias("id"), (F.abs(F.col("embedding")[0].cast("double")) * 4.0 + 2).alias("x"), (F.abs(F.col("embedding")[1].cast("double")) * 4.0 + 2).alias("y"), (F.abs(F.col("embedding")[2].cast("double")) * 2.0 + 1.2).alias("z"))
    return cn.trilinear(p, inp.volume(spark, d), ["id"]).select("id", r("value", 5).alias("value"))


@query(f"WITH {VOLUME}, h AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin FROM vol, (SELECT min(value) AS lo, max(value) AS hi FROM vol)) SELECT bin, count(*) AS n FROM h GROUP BY 1")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    return vx.histogram(inp.volume(spark, d), 20).select("bin", "n")


def _signals(spark: SparkSession, d: str) -> tuple[DataFrame, list[float], list[list[float]]]:
    """Voxels with a made-up diffusion signal: one unweighted and seven weighted volumes, whose tensor follows the voxel's value."""
    h = 0.5**0.5
    dirs = [[1, 0, 0], [0, 1, 0], [0, 0, 1], [h, h, 0], [h, 0, h], [0, h, h], [h, -h, 0]]
    lam = F.col("value") / 53.0 * 1e-3
    bvals = [1000.0] * 5 + [2000.0] * 2  # two shells: with one, the constant could not be told from the trace
    sig = [F.lit(1000.0)]
    for b, v in zip(bvals, dirs, strict=True):
        q = (lam + 1e-3) * v[0] ** 2 + lam * v[1] ** 2 + 4e-4 * v[2] ** 2
        sig.append(1000.0 * F.exp(-b * q))
    return inp.volume(spark, d).select("x", "y", "z", F.array(*sig).alias("signal")), [0.0, *bvals], [[0.0, 0.0, 0.0], *dirs]


@query(f"""WITH {VOLUME}, l AS (SELECT x, y, z, value / 53.0::DOUBLE * 1e-3::DOUBLE AS a FROM vol), e AS (SELECT x, y, z, list_reverse_sort([a + 1e-3, a, 4e-4::DOUBLE]) AS e FROM l), m AS (SELECT x, y, z, e, list_sum(e) / 3 AS m FROM e)
SELECT x, y, z, round(m, 9) AS md, round(e[1], 9) AS ad, round((e[2] + e[3]) / 2, 9) AS rd, round(sqrt(1.5 * (pow(e[1]-m,2)+pow(e[2]-m,2)+pow(e[3]-m,2)) / (e[1]*e[1]+e[2]*e[2]+e[3]*e[3])), 6) AS fa FROM m""")
def tensor_fit(spark: SparkSession, d: str) -> DataFrame:
    s, b, v = _signals(spark, d)
    return vx.tensors(s, b, v).select("x", "y", "z", *[r(c, 9).alias(c) for c in ("md", "ad", "rd")], r("fa", 6).alias("fa"))


@query()
def response_function(spark: SparkSession, d: str) -> DataFrame:
    s, b, v = _signals(spark, d)
    return vx.response(s, vx.response_voxels(vx.tensors(s, b, v)))


@query()
def orientation_peaks(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    s, b, v = _signals(spark, d)
    op = vx.csd_operator(np.array(b), np.array(v), np.array([1000.0] + [300.0] * 7), order=2)
    return vx.peaks(vx.orientation_coefficients(s, op), 2)


@query(f"WITH {VOLUME}, k AS (SELECT max(x) + 1 AS places FROM vol) SELECT y, z, round(value, 5) AS value FROM vol, k WHERE x = floor(0.5::DOUBLE * (places - 1))")
def volume_slice(spark: SparkSession, d: str) -> DataFrame:
    return vx.slice_at(inp.volume(spark, d), "x", 0.5).select("y", "z", r("value", 5).alias("value"))


_ENTRY = ", ".join(f"round({' + '.join(f'abs(CAST(embedding[{k + 1}] AS DOUBLE)) * CAST(embedding[{4 + 3 * i + k}] AS DOUBLE) * CAST(embedding[{4 + 3 * j + k}] AS DOUBLE)' for k in range(3))}, 6) + 0.0 AS d{'xyz'[i]}{'xyz'[j]}" for i in range(3) for j in range(i, 3))


@query(f"SELECT vec_id AS id, {_ENTRY} FROM embeddings")
def tensor_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    """Three numbers of an embedding as eigenvalues, the next nine as eigenvectors."""
    e = F.col("embedding")
    number = lambda k: e[k].cast("double")
    fits = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(*[F.abs(number(k)) for k in range(3)]).alias("l"), F.array(*[number(3 + k) for k in range(9)]).alias("v"))
    t = vx.reconstructed(fits, ["id"])
    return t.select("id", *[r(c).alias(c) for c in t.columns[1:]])


@query()
def mask_parts(spark: SparkSession, d: str) -> DataFrame:
    return vx.mask_parts(inp.mask(spark, d))


@query()
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    x = _binary(spark, d)
    model = ml.classifier(n=x.count()).fit(ml.with_vector(x))
    return ml.permutation_importance(model, x)


_FROM, _TO = [[0.0, -2.0, 0.0, 5.0], [2.0, 0.0, 0.0, 1.0], [0.0, 0.0, 2.0, 0.0], [0.0, 0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0, 0.0], [0.0, 2.0, 0.0, 0.0], [0.0, 0.0, -1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]


@query(f"WITH {GRAD}, t AS (SELECT vol, bval, -2 * gy AS gx, gx AS gy, -2 * gz AS gz FROM gr), n AS (SELECT *, sqrt(gx*gx+gy*gy+gz*gz) AS n FROM t) SELECT vol, bval, round(gx / n, 6) + 0.0 AS gx, round(gy / n, 6) + 0.0 AS gy, round(gz / n, 6) + 0.0 AS gz FROM n")
def gradient_reorientation(spark: SparkSession, d: str) -> DataFrame:
    """From a map that turns and stretches to one that stretches and flips; the SQL states their quotient."""
    return vx.reoriented(_gradients(spark, d), _FROM, _TO).select("vol", "bval", *[r(c).alias(c) for c in ("gx", "gy", "gz")])


def _scan_gradients(spark: SparkSession, b: list[float], v: list[list[float]]) -> DataFrame:
    return spark.createDataFrame([(k, b[k], *map(float, v[k])) for k in range(len(b))], "vol int, bval double, gx double, gy double, gz double")


@query()
def preprocessing(spark: SparkSession, d: str) -> DataFrame:
    s, b, v = _signals(spark, d)
    return pp.preprocess(s, _scan_gradients(spark, b, v), sigma=2.0)["qc"]


def _medians(name: str, before: str) -> str:
    return f", {name} AS (SELECT a.x, a.y, a.z, median(b.value) AS value FROM {before} a JOIN {before} b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 GROUP BY 1, 2, 3)"


@query(f"WITH {VOLUME}{_medians('m', 'vol')} SELECT x, y, z, round(value, 5) AS value FROM m")
def median_filter(spark: SparkSession, d: str) -> DataFrame:
    return tl.median(inp.volume(spark, d), 1, edge=8).select("x", "y", "z", r("value", 5).alias("value"))


@query(f"""WITH {VOLUME}{_medians('m1', 'vol')}{_medians('m2', 'm1')}, s AS (SELECT min(value) AS lo, (max(value) - min(value)) / 256 AS w FROM m2 WHERE value > 0), b AS (SELECT CAST(least(floor((value - lo) / w), 255) AS INTEGER) AS bin, lo, w FROM m2, s WHERE value > 0),
h AS (SELECT any_value(lo) + bin * any_value(w) + any_value(w) / 2 AS c, count(*) AS n, bin FROM b GROUP BY bin), f AS (SELECT c, sum(n) OVER o AS w1, sum(n * c) OVER o AS s1, sum(n) OVER () - sum(n) OVER o AS w2, sum(n * c) OVER () - sum(n * c) OVER o AS s2 FROM h WINDOW o AS (ORDER BY bin)),
t AS (SELECT arg_max(c, w1 * w2 * pow(s1 / (w1 + 1e-10) - s2 / (w2 + 1e-10), 2)) AS c FROM f) SELECT x, y, z FROM m2, t WHERE value > c""")
def median_otsu_mask(spark: SparkSession, d: str) -> DataFrame:
    return tl.median_otsu(inp.volume(spark, d), 1, 2, edge=8)


_SIX = "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 1"


@query(f"WITH {MASK}, e AS (SELECT a.x, a.y, a.z FROM mask a JOIN mask b ON {_SIX} GROUP BY 1, 2, 3 HAVING count(*) = 7) SELECT DISTINCT b.x + k[1] AS x, b.y + k[2] AS y, b.z + k[3] AS z FROM e b, (SELECT unnest([[0,0,0],[1,0,0],[-1,0,0],[0,1,0],[0,-1,0],[0,0,1],[0,0,-1]]) AS k)")
def mask_opened(spark: SparkSession, d: str) -> DataFrame:
    return tl.morphology(inp.mask(spark, d), "ed", edge=8)


_SHIFTS = {0: (0.0, 0.0, 0.0), 1: (1.5, 0.0, 0.0), 2: (0.0, -1.25, 0.5), 3: (-0.75, 1.0, 0.0)}


@query()
def motion_correction(spark: SparkSession, d: str) -> DataFrame:
    """The table's volume, smoothed and around 0, and copies of it that are shifted: each shift as it was planted and as registration by correlation finds it (these 16 x 16 x 7 voxels are few for a joint histogram)."""
    v = inp.volume(spark, d).select("x", "y", "z", "value")
    for axis in "xyz":
        v = vx.convolve_axis(v, axis, vx.gaussian(1.5))
    v = v.crossJoin(F.broadcast(v.agg(F.avg("value").alias("mean")))).select("x", "y", "z", (F.col("value") - F.col("mean")).alias("value"))
    planted = spark.createDataFrame([(k, *s) for k, s in _SHIFTS.items()], "vol int, px double, py double, pz double")
    at = planted.select("vol", *[(-F.col("p" + c)).alias("t" + c) for c in "xyz"], F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)]).alias("matrix"), F.array(*[F.lit(0.0)] * 3).alias("centre"))
    copies = v.crossJoin(F.broadcast(planted.select("vol")))
    volumes = rg.moved_back(copies, at).join(v.withColumnRenamed("value", "reference"), ["x", "y", "z"])
    return rg.motions(volumes, metric="cc").join(planted, "vol").select("vol", "px", "py", "pz", *[r(c, 4).alias(c) for c in ("tx", "ty", "tz", "rx", "ry", "rz", "before", "after")])


@query()
def training_report(spark: SparkSession, d: str) -> DataFrame:
    return tr.train(_binary(spark, d))[1]
