"""Perspective rotation of dialogues, on DataFrames alone.

Every participant of a conversation becomes the assistant once: the dialogue is rendered with that speaker's turns as
the assistant's, all others as named users, and the loss mask covers what the assistant says. The result has one row
per conversation, perspective and turn, with its rendered segment and its place in the whole rendering, so that a
conversation of any length is spread over tasks. Places are prefix sums in two levels: over blocks of turns, then
inside a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns in one block of the prefix sums.
BLOCK_TURNS = 256


def rotated(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, name, rendered, loss, start_char, mask_start, mask_end.

    A null role is the speaker 'unknown', a null text is empty, rows without conv_id are one conversation, and a null
    turn comes first. Turns that tie are ordered by speaker and text; rows that repeat are rendered each. Markers
    inside a text or a speaker's name are broken up where they are rendered, so that neither can end its own turn. Texts
    of any length are rendered whole; other columns are not carried. Offsets count code points, ends exclusive; the mask
    of a turn that isn't the assistant's is empty.
    """
    said = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("said")
    ).withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    people = said.select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    every = said.join(people, said["conv_id"].eqNullSafe(people["conv"])).drop("conv")
    own = F.col("speaker") == F.col("perspective")
    shown = F.replace(F.replace(F.col("speaker"), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), shown, F.lit("|>\n")))
    every = every.withColumn("head", head).withColumn("rendered", F.concat("head", "said", F.lit("<|end|>\n"))).withColumn("loss", own)
    key = ["conv_id", "perspective"]
    blocks = every.groupBy(*key, "block").agg(F.sum(F.length("rendered")).alias("chars"))
    before = Window.partitionBy(*key).orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(c).alias("b_" + c) for c in (*key, "block")], F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("skip"))
    same = every["conv_id"].eqNullSafe(blocks["b_conv_id"]) & (every["perspective"] == blocks["b_perspective"]) & every["block"].eqNullSafe(blocks["b_block"])
    inner = Window.partitionBy(*key, "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "said").rowsBetween(Window.unboundedPreceding, -1)
    placed = every.join(blocks, same).withColumn("start_char", F.col("skip") + F.coalesce(F.sum(F.length("rendered")).over(inner), F.lit(0)))
    mask_start = F.col("start_char") + F.length("head")
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", F.when(F.col("loss"), "assistant").otherwise("user").alias("role"),
        F.when(~F.col("loss"), F.col("speaker")).alias("name"), "rendered", "loss", "start_char", mask_start.alias("mask_start"),
        F.when(F.col("loss"), F.col("start_char") + F.length("rendered") - 1).otherwise(mask_start).alias("mask_end"),
    )


def dialogues(turns: DataFrame) -> DataFrame:
    """Whole renderings, one row per conversation and perspective: text and mask spans. For conversations that fit a row."""
    piece = F.sort_array(F.collect_list(F.struct("start_char", "rendered", "loss", "mask_start", "mask_end")))
    got = rotated(turns).groupBy("conv_id", "perspective").agg(piece.alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return got.select("conv_id", "perspective", F.array_join(F.transform("p", lambda x: x["rendered"]), "").alias("text"), spans.alias("mask"))
