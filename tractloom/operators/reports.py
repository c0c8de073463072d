"""Report rules, catalogues of scans, results and jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractloom.functions import scalars as s

#: Reference means and spreads of global metrics.
NORMS = [("global_efficiency", 0.45, 0.08), ("clustering", 0.55, 0.10), ("path_length", 2.5, 0.4), ("modularity", 0.42, 0.06), ("density", 0.20, 0.06), ("assortativity", 0.10, 0.08)]


def z_scores(metrics: DataFrame, norms: list[tuple[str, float, float]] = NORMS) -> DataFrame:
    """metrics (metric, value) against a table of norms."""
    n = metrics.sparkSession.createDataFrame(norms, "metric string, mean double, sd double")
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    return metrics.join(F.broadcast(n), "metric").select("metric", "value", z.alias("z"), s.norm_flag(z).alias("flag"))


def interpretation(metrics: DataFrame) -> DataFrame:
    """One row per judgement of a one-row frame: global_efficiency, modularity, sigma, resilience_half."""
    rows = [("efficiency", s.bucket(F.col("global_efficiency"), 0.5, 0.3)), ("modularity", s.bucket(F.col("modularity"), 0.4, 0.3)), ("small_world", F.when(F.col("sigma") > 1, "yes").otherwise("no")), ("resilience", F.when(F.col("resilience_half") > 0.5, "robust").otherwise("vulnerable"))]
    return metrics.select(F.explode(F.array(*[F.struct(F.lit(k).alias("judgement"), v.alias("value")) for k, v in rows])).alias("r")).select("r.*")


def indicators(metrics: DataFrame) -> DataFrame:
    """Warnings that hold."""
    rows = [("low_efficiency", F.col("global_efficiency") < 0.3), ("high_modularity", F.col("modularity") > 0.6), ("low_resilience", F.col("resilience_half") < 0.3)]
    return metrics.select(F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rows]), lambda x: x.isNotNull())).alias("indicator"))


def health_score(metrics: DataFrame) -> DataFrame:
    """Share of good signs in percent, and its class."""
    good = [F.col("global_efficiency") >= 0.3, F.col("modularity").between(0.3, 0.6), F.col("sigma") > 1, F.col("resilience_half") >= 0.3, F.col("density").between(0.05, 0.6)]
    score = 100.0 * sum((F.coalesce(c, F.lit(False)).cast("int") for c in good), F.lit(0)) / len(good)
    return metrics.select(score.alias("score"), F.when(score >= 80, "good").when(score >= 50, "fair").otherwise("poor").alias("class"))


def vulnerability(nodes: DataFrame, n: int = 15) -> DataFrame:
    v = F.col("betweenness") * F.col("degree")
    return nodes.select("node", v.alias("vulnerability")).orderBy(F.desc("vulnerability"), "node").limit(n)


def metrics_mapping(row: DataFrame) -> DataFrame:
    """A result's metrics under the names that clients read: missing ones fall back to others, then to 0."""
    cols = set(row.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in cols], F.lit(0.0))
    return row.select(pick("global_efficiency").alias("global_efficiency"), pick("path_length").alias("characteristic_path_length"), pick("clustering").alias("clustering_coefficient"), pick("louvain_q").alias("modularity"), pick("sigma").alias("small_worldness"), pick("local_efficiency", "eigenvector").alias("local_efficiency"))


def quality_rows(signal: DataFrame, n_bvals: int, n_bvecs: int) -> DataFrame:
    """(level, check, passed) of a diffusion scan: one aggregate over its voxels. signal (x, y, z, signal)."""
    v = F.col("signal")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    a = signal.agg(F.count_if(bad).alias("bad"), F.min(F.size(v)).alias("n0"), F.max(F.size(v)).alias("n1"), F.min(F.array_min(v)).alias("low"), F.max(F.array_max(v)).alias("high"))
    rows = [("error", "finite", F.col("bad") == 0), ("error", "volumes", F.col("n0") == F.col("n1")), ("error", "bvals", F.col("n1") == n_bvals), ("error", "bvecs", F.col("n1") == n_bvecs), ("warning", "negative", F.col("low") >= 0), ("warning", "range", F.col("high") <= 1e6), ("warning", "constant", F.col("high") > F.col("low"))]
    return a.select(F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(c).alias("check"), ok.alias("passed")) for k, c, ok in rows])).alias("r")).select("r.*")


def anatomical_rows(volume: DataFrame) -> DataFrame:
    """(level, check, passed) of an anatomical scan: one aggregate over its voxels. volume (x, y, z, value)."""
    v = F.col("value")
    a = volume.agg(F.count_if(F.isnan(v) | v.isNull()).alias("nan"), F.count_if(F.abs(v) == float("inf")).alias("inf"), F.min(v).alias("low"), F.max(v).alias("high"))
    rows = [("error", "nan", F.col("nan") == 0), ("error", "inf", F.col("inf") == 0), ("warning", "negative", F.col("low") >= 0), ("warning", "range", F.col("high") <= 1e6)]
    return a.select(F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(c).alias("check"), ok.alias("passed")) for k, c, ok in rows])).alias("r")).select("r.*")


# Scans in a directory tree: files (path, size).


def scans(files: DataFrame) -> DataFrame:
    """Subject, session, modality, suffix and extension of each path."""
    p = F.col("path")
    part = lambda pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit(""))
    return files.select("path", "size", part(r"/(sub-[^/]+)/").alias("subject"), part(r"/(ses-[^/]+)/").alias("session"), part(r"/(dwi|anat|func|fmap)/[^/]+$").alias("modality"), part(r"_([A-Za-z0-9]+)\.[^/]*$").alias("suffix"), part(r"(\.nii\.gz|\.[^./]+)$").alias("extension"))


def scan_query(found: DataFrame, **wanted: str | None) -> DataFrame:
    for k, v in wanted.items():
        if v is not None:
            found = found.where(F.col(k) == v)
    return found.orderBy("path")


def completeness(found: DataFrame, modalities: tuple[str, ...] = ("dwi", "anat"), first_session_only: bool = False) -> DataFrame:
    """Subjects with all modalities in some session (or, as written elsewhere, in their first)."""
    per = found.where(F.col("subject").isNotNull()).groupBy("subject", F.coalesce("session", F.lit("")).alias("session")).agg(F.collect_set("modality").alias("m"), F.sum("size").alias("size"))
    ok = F.lit(True)
    for m in modalities:
        ok = ok & F.array_contains("m", m)
    good = F.min_by(ok, "session") if first_session_only else F.bool_or(ok)
    return per.groupBy("subject").agg(good.alias("complete"), F.count(F.lit(1)).alias("sessions"), F.sum("size").alias("size"), F.bool_and(s.subject_name_ok(F.col("subject"))).alias("valid_name"))


def results(files: DataFrame) -> DataFrame:
    """What each subject's results hold. files (subject, name, size)."""
    has = lambda pattern: F.bool_or(F.col("name").rlike(pattern))
    return files.groupBy("subject").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), has(r"\.(trk|tck)$").alias("has_streamlines"), has("connectome.*\\.(npy|csv)$").alias("has_connectome"), has(r"metrics\.json$").alias("has_metrics"), has("^fa|_fa").alias("has_maps"))


def safe_name(name: str) -> str:
    """A file name that can't leave its folder."""
    if not name or "/" in name or "\\" in name or name.startswith("."):
        raise ValueError("no such file")
    return name


# Jobs: (job_id, status, progress, created_at).


def submit_job(jobs: DataFrame, kind: str, config: str) -> DataFrame:
    spark = jobs.sparkSession
    new = spark.createDataFrame([(uuid.uuid4().hex, "pending", 0.0)], "job_id string, status string, progress double").select("job_id", "status", "progress", F.current_timestamp().alias("created_at"), F.lit(kind).alias("kind"), F.lit(config).alias("config"))
    return jobs.unionByName(new, allowMissingColumns=True)


def recent_jobs(jobs: DataFrame, n: int = 50, status: str | None = None) -> DataFrame:
    j = jobs.where(F.col("status") == status) if status else jobs
    return j.orderBy(F.desc("created_at"), "job_id").limit(n)


def result_lookups(requests: DataFrame, jobs: DataFrame, found: DataFrame) -> DataFrame:
    """(job_id, kind, code, path) of each request (job_id, kind): 404 for no such job, 400 for one that isn't completed, 404 for no such result, else 200 and its path. found (job_id, kind, path)."""
    j = jobs.select("job_id", "status")
    got = requests.join(j, "job_id", "left").join(found, ["job_id", "kind"], "left")
    code = F.when(F.col("status").isNull(), 404).when(F.col("status") != "completed", 400).when(F.col("path").isNull(), 404).otherwise(200)
    return got.select("job_id", "kind", code.alias("code"), F.when(code == 200, F.col("path")).alias("path"))


def stage_progress(done: Column, total: Column, start: float, share: float) -> Column:
    """Progress of a job inside a stage that begins at start and takes a share of the whole."""
    return F.lit(start) + F.lit(share) * F.coalesce(F.try_divide(done.cast("double"), total), F.lit(0.0))


def with_progress(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """jobs with the latest progress and message that was told of them. updates (job_id, at, progress, message)."""
    last = updates.groupBy("job_id").agg(F.max(F.struct("at", "progress", "message")).alias("_u"))
    keep = [c for c in jobs.columns if c not in ("progress", "message", "updated_at")]
    return jobs.join(last, "job_id", "left").select(*keep, F.coalesce("_u.progress", F.col("progress") if "progress" in jobs.columns else F.lit(0.0)).alias("progress"), F.col("_u.message").alias("message"), F.col("_u.at").alias("updated_at"))


def cancel_job(jobs: DataFrame, job_id: str) -> DataFrame:
    live = F.col("status").isin("pending", "running") & (F.col("job_id") == job_id)
    return jobs.withColumn("status", F.when(live, "failed").otherwise(F.col("status")))


def delete_job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("job_id") != job_id)


def atlases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("aal", 89), ("grid", 1000)], "atlas string, regions int")


def algorithms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("probabilistic", "tracking"), ("csd", "orientation"), ("tensor", "orientation"), ("louvain", "communities"), ("leiden", "communities")], "name string, kind string")


#: Regions of one hemisphere's cortex in the order of their numbers (name, abbreviation, lobe).
CORTEX = [
    ("Banks STS", "BSTS", "temporal"),
    ("Caudal Anterior Cingulate", "CAC", "frontal"),
    ("Caudal Middle Frontal", "CMF", "frontal"),
    ("Cuneus", "CUN", "occipital"),
    ("Entorhinal", "ENT", "temporal"),
    ("Fusiform", "FUS", "temporal"),
    ("Inferior Parietal", "IP", "parietal"),
    ("Inferior Temporal", "IT", "temporal"),
    ("Isthmus Cingulate", "IC", "limbic"),
    ("Lateral Occipital", "LO", "occipital"),
    ("Lateral Orbitofrontal", "LOF", "frontal"),
    ("Lingual", "LIN", "occipital"),
    ("Medial Orbitofrontal", "MOF", "frontal"),
    ("Middle Temporal", "MT", "temporal"),
    ("Parahippocampal", "PH", "temporal"),
    ("Paracentral", "PC", "frontal"),
    ("Pars Opercularis", "POP", "frontal"),
    ("Pars Orbitalis", "POR", "frontal"),
    ("Pars Triangularis", "PTR", "frontal"),
    ("Pericalcarine", "PCAL", "occipital"),
    ("Postcentral", "POST", "parietal"),
    ("Posterior Cingulate", "PCC", "limbic"),
    ("Precentral", "PRE", "frontal"),
    ("Precuneus", "PCUN", "parietal"),
    ("Rostral Anterior Cingulate", "RAC", "frontal"),
    ("Rostral Middle Frontal", "RMF", "frontal"),
    ("Superior Frontal", "SF", "frontal"),
    ("Superior Parietal", "SP", "parietal"),
    ("Superior Temporal", "ST", "temporal"),
    ("Supramarginal", "SM", "parietal"),
    ("Frontal Pole", "FP", "frontal"),
    ("Temporal Pole", "TP", "temporal"),
    ("Transverse Temporal", "TT", "temporal"),
    ("Insula", "INS", "insular"),
]
#: Regions below the cortex of one hemisphere.
DEEP = [
    ("Thalamus", "THA", "subcortical"),
    ("Caudate", "CAU", "subcortical"),
    ("Putamen", "PUT", "subcortical"),
    ("Pallidum", "PAL", "subcortical"),
    ("Hippocampus", "HIP", "subcortical"),
    ("Amygdala", "AMY", "subcortical"),
    ("Accumbens", "ACC", "subcortical"),
    ("Ventral DC", "VDC", "subcortical"),
]
#: The last regions (name, abbreviation, hemisphere, lobe).
OTHER = [("Left Cerebellum Cortex", "L-CBLM", "left", "cerebellum"), ("Right Cerebellum Cortex", "R-CBLM", "right", "cerebellum"), ("Brain Stem", "BSTM", "midline", "brainstem"), ("Corpus Callosum", "CC", "midline", "white_matter")]


def region_labels(spark: SparkSession) -> DataFrame:
    """(node, name, abbreviation, hemisphere, lobe) of the 89 regions: background, left and right cortex, left and right deep regions, the others."""
    rows = [("Unknown", "UNK", "none", "none")]
    for part in (CORTEX, DEEP):
        for side in ("Left", "Right"):
            rows += [(f"{side} {name}", f"{side[0]}-{short}", side.lower(), lobe) for name, short, lobe in part]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows + OTHER)], "node int, name string, abbreviation string, hemisphere string, lobe string")
