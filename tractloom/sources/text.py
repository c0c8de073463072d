"""Text sources: gradient files, matrices, feature tables, labels, sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a feature table that describe a subject.
METADATA = ("subject_id", "label", "age", "sex", "scanner", "site", "diagnosis")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """Lines with numbers in order, one whole file in one row: these files are a few kilobytes."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split(F.trim("value"), r"\r?\n")).alias("line", "text"))
    return t.where(F.trim("text") != "")


def _numbers(rows: DataFrame) -> DataFrame:
    return rows.select("path", "line", F.posexplode(F.transform(F.split(F.trim("text"), r"[\s,]+"), lambda v: v.try_cast("double"))).alias("col", "v"))


def read_bvals(spark: SparkSession, path: str) -> DataFrame:
    """(path, vol, bval): a white-space matrix, flattened in reading order."""
    w = Window.partitionBy("path").orderBy("line", "col")
    return _numbers(_rows(spark, path)).select("path", (F.row_number().over(w) - 1).alias("vol"), F.col("v").alias("bval"))


def read_bvecs(spark: SparkSession, path: str) -> DataFrame:
    """(path, vol, gx, gy, gz) of three rows or of three columns; other shapes raise an error when the frame is used."""
    n = _numbers(_rows(spark, path))
    size = n.groupBy("path").agg(F.countDistinct("line").alias("rows"), F.max("col").alias("last"))
    line = Window.partitionBy("path").orderBy("line")
    x = n.join(size, "path").withColumn("k", F.dense_rank().over(line) - 1)
    wide = F.col("rows") == 3
    ok = F.when(wide | (F.col("last") == 2), F.lit(0)).otherwise(F.raise_error(F.lit("gradient vectors need three rows or three columns")).cast("int"))
    x = x.select("path", F.when(wide, F.col("col")).otherwise(F.col("k")).alias("vol"), (F.when(wide, F.col("k")).otherwise(F.col("col")) + ok).alias("axis"), "v")
    return x.groupBy("path", "vol").agg(*[F.max(F.when(F.col("axis") == k, F.col("v"))).alias(c) for k, c in enumerate(("gx", "gy", "gz"))])


def sidecars(files: DataFrame) -> DataFrame:
    """(path, bval, bvec) of volumes in a listing (path): files of the same stem, if the listing has them; a stem without _dwi falls back to one with it."""
    stem = F.regexp_replace("path", r"\.nii(\.gz)?$", "")
    v = files.where(F.col("path").rlike(r"\.nii(\.gz)?$")).select("path", stem.alias("stem"), F.concat(stem, F.lit("_dwi")).alias("other"))
    out = v
    for kind in ("bval", "bvec"):
        f = files.where(F.col("path").rlike(rf"\.{kind}s?$")).select(F.regexp_replace("path", rf"\.{kind}s?$", "").alias("s"), F.col("path").alias(kind))
        a, b = f.select(F.col("s").alias("stem"), F.col(kind).alias(kind + "1")), f.select(F.col("s").alias("other"), F.col(kind).alias(kind + "2"))
        out = out.join(a, "stem", "left").join(b, "other", "left").withColumn(kind, F.coalesce(kind + "1", kind + "2")).drop(kind + "1", kind + "2")
    return out.select("path", "bval", "bvec")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, j, weight) of square text matrices, zeros left out."""
    return _numbers(_rows(spark, path)).where("v <> 0").select("path", F.col("line").alias("i"), F.col("col").alias("j"), F.col("v").alias("weight"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path).select("path", F.col("line").alias("node"), F.trim("text").alias("name"))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    return read_bvals(spark, path).select("path", F.col("vol").alias("pos"), F.col("bval").alias("value"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    n = _numbers(_rows(spark, path)).where("col < 3")
    return n.groupBy("path", F.col("line").alias("seed_id")).agg(*[F.max(F.when(F.col("col") == k, F.col("v"))).alias(c) for k, c in enumerate("xyz")])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Metadata columns, and all other columns in one array. The header is read first, so numbers need no inference pass."""
    head = spark.read.csv(path, header=True).columns
    schema = ", ".join(f"`{c}` {'string' if c in METADATA else 'double'}" for c in head)
    df = spark.read.csv(path, header=True, schema=schema)
    return df.select(*[c for c in head if c in METADATA], F.array(*[F.col(f"`{c}`") for c in head if c not in METADATA]).alias("features"))


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Configurations, manifests and sidecars: (path, doc) with doc as a variant."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.parse_json("value").alias("doc"))
