"""Edges kept up to date from a stream of paths, with event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def edge_windows(paths: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, i, j, weight) from a stream (ts, a, b): counts per window and pair; rows later than the watermark allows are left out."""
    p = paths.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).where("a >= 0 AND b >= 0 AND a <> b")
    w = p.groupBy(F.window("ts", window).alias("w"), F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.count(F.lit(1)).alias("weight"))
    return w.select(F.col("w.start").alias("start"), "i", "j", "weight")


def sessions(events: DataFrame, key: str, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_paths(paths: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return paths.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landing_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
