"""Sinks: tables by subject and kind, matrices, reports, VTK text, streamed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.functions.ordered import running


def write_volumes(df: DataFrame, path: str) -> None:
    """Long volumes by subject and kind, so that reading one map of one subject opens only its files."""
    df.write.partitionBy("subject", "kind").mode("append").parquet(path)


def write_streamlines(df: DataFrame, path: str, rows_per_file: int = 1000) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).mode("append").parquet(path)


def matrix_lines(dense: DataFrame) -> DataFrame:
    """(u, value): a row of the matrix as text with six decimals. dense (u, row)."""
    return dense.select("u", F.array_join(F.transform("row", lambda w: F.format_string("%.6f", w)), ",").alias("value"))


def write_matrix(dense: DataFrame, path: str) -> None:
    matrix_lines(dense).orderBy("u").select("value").coalesce(1).write.mode("overwrite").text(path)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def report_lines(df: DataFrame) -> DataFrame:
    """name: value lines of a one-row frame."""
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for k, c in enumerate(df.columns)])).alias("p")
    return df.select(pair).orderBy("p.k").select(F.concat_ws(": ", "p.name", F.coalesce("p.v", F.lit("none"))).alias("value"))


def prediction_rows(predictions: DataFrame, classes: list[str]) -> DataFrame:
    """Predictions with one probability column per class, for CSV."""
    return predictions.select("id", "predicted", "confidence", *[F.col("probabilities")[k].alias(f"prob_{c}") for k, c in enumerate(classes)])


def vtk_lines(lines: DataFrame) -> DataFrame:
    """(part, sl_id, value): the text of a VTK polydata file; parts in order are head, points, line counts. Offsets are running sums of path sizes over ids.

    Sizes are one row per path; the running sum takes them alone, bucket by bucket, and points stay where they are.
    """
    n = lines.select("sl_id", F.size("points").cast("long").alias("n"))
    at = running(n, "sl_id", {"first": F.col("n")}, inclusive=False)
    point = lambda p: F.format_string("%.6f %.6f %.6f", p["x"], p["y"], p["z"])
    pts = lines.select(F.lit(1).alias("part"), "sl_id", F.array_join(F.transform("points", point), "\n").alias("value"))
    ids = at.select(F.lit(3).alias("part"), "sl_id", F.concat_ws(" ", F.col("n").cast("string"), F.array_join(F.transform(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1), lambda k: k.cast("string")), " ")).alias("value"))
    t = n.agg(F.sum("n").alias("p"), F.count(F.lit(1)).alias("l"))
    head = t.select(F.lit(0).alias("part"), F.lit(-1).cast("long").alias("sl_id"), F.format_string("# vtk DataFile Version 3.0\nstreamlines\nASCII\nDATASET POLYDATA\nPOINTS %d float", "p").alias("value"))
    mid = t.select(F.lit(2).alias("part"), F.lit(-1).cast("long").alias("sl_id"), F.format_string("LINES %d %d", F.col("l"), F.col("p") + F.col("l")).alias("value"))
    return head.union(pts).union(mid).union(ids)


def seed_lines(seeds: DataFrame) -> DataFrame:
    """Seeds as text, three numbers of six decimals each."""
    return seeds.select(F.format_string("%.6f %.6f %.6f", "sx", "sy", "sz").alias("value"))


def write_seeds(seeds: DataFrame, path: str) -> None:
    seed_lines(seeds.orderBy("x", "y", "z", "k")).write.mode("overwrite").text(path)


def seed_log(seeds: DataFrame, strategy: str, rng_seed: int, **parameters: object) -> DataFrame:
    """One row that lets a set of seeds be made again: strategy, parameters, number and a checksum that does not depend on order."""
    names = ", ".join(f"{k}={v}" for k, v in sorted(parameters.items()))
    mark = F.sum(F.conv(F.substring(F.md5(F.format_string("%.6f %.6f %.6f", "sx", "sy", "sz")), 1, 10), 16, 10).cast("decimal(38,0)")).cast("string")
    return seeds.agg(F.count(F.lit(1)).alias("n"), mark.alias("checksum")).select(F.lit(strategy).alias("strategy"), F.lit(rng_seed).alias("rng_seed"), F.lit(names).alias("parameters"), "n", "checksum")


def append_seed_log(log: DataFrame, path: str) -> None:
    log.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def sampled_checksum(values: DataFrame, every: int = 1000) -> DataFrame:
    """md5 over every so many values in order; values (pos, value)."""
    some = values.where(F.col("pos") % every == 0).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v"))
    return some.select(F.md5(F.array_join(F.transform("v", lambda x: F.format_string("%.6f", x["value"])), ",")).alias("checksum"))


def append_decision(df: DataFrame, table: str) -> None:
    df.withColumn("at", F.current_timestamp()).write.mode("append").saveAsTable(table)
