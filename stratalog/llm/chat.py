"""Dialogues rendered once from every participant's perspective, with training masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CHUNK = 256


def perspectives(turns: DataFrame, context: str = "system") -> DataFrame:
    """For every conversation and participant, the conversation with that speaker as assistant: one row a turn.

    turns: conv_id, turn, role, text; other columns are ignored. Returns conv_id, speaker (the perspective), seat (order of the
    turn, from 1), turn, role, segment (the rendered text), start, length (of the segment, in the rendered dialogue, code points),
    mask_start, mask_length (what is trained on within the dialogue; length 0 where another speaks).
    Participants are the distinct roles of a conversation but `context`, which is rendered as such in every perspective; others'
    turns are a user's with their role as name. A null role is an unnamed user and no participant; a null text is empty;
    turns go by turn (nulls first), role, text, repeated rows each counting; a null conv_id is a conversation of its own; a conversation
    without participants has no perspective. Joining segments by seat gives the dialogue.

    Starts are running sums in two steps, within chunks of turn numbers and over the chunks' totals, so that a conversation
    with very many turns isn't put together in one task.
    """
    own = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    speakers = own.where(F.col("role").isNotNull() & (F.col("role") != context)).groupBy("conv_id", "role").agg(F.lit(1).alias("one"))
    speakers = speakers.select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker"))
    # a turn's rendering has one of three heads, which differ between perspectives
    mine, rest = F.col("role").eqNullSafe(F.col("speaker")), F.coalesce(F.col("role") == context, F.lit(False))
    head = F.when(mine, "assistant\n").when(rest, F.lit(f"{context}\n")).when(F.col("role").isNull(), "user\n").otherwise(F.concat(F.lit("user name="), F.col("role"), F.lit("\n")))
    seen = own.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    seen = seen.withColumn("head", F.concat(F.lit(OPEN), head)).withColumn("length", F.length("head") + F.length("text") + len(CLOSE)).withColumn("mine", mine)
    seen = seen.withColumn("chunk", F.expr(f"turn div {CHUNK}"))
    within = Window.partitionBy("conv_id", "speaker", "chunk").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    seen = seen.withColumns({"inner": F.coalesce(F.sum("length").over(within), zero), "nr": F.count(F.lit(1)).over(within)})
    totals = seen.groupBy("conv_id", "speaker", "chunk").agg(F.sum("length").alias("chars"), F.count(F.lit(1)).alias("rows"))
    over = Window.partitionBy("conv_id", "speaker").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("_c"), F.col("speaker").alias("_s"), F.col("chunk").alias("_k"), F.coalesce(F.sum("chars").over(over), zero).alias("before"), F.coalesce(F.sum("rows").over(over), zero).alias("earlier"))
    placed = seen.join(totals, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("speaker") == F.col("_s")) & F.col("chunk").eqNullSafe(F.col("_k")))
    start = F.col("before") + F.col("inner")
    return placed.select(
        "conv_id", "speaker", (F.col("earlier") + F.col("nr") + 1).cast("long").alias("seat"), "turn", "role", F.concat("head", "text", F.lit(CLOSE)).alias("segment"), start.alias("start"), F.col("length").cast("long").alias("length"),
        (start + F.length("head")).cast("long").alias("mask_start"), F.when(F.col("mine"), F.length("text") + len(CLOSE)).otherwise(0).cast("long").alias("mask_length"),
    )
