"""Multi-party perspective rotation of conversations, in DataFrame operations.

For every participant of a conversation, the dialogue is rendered with that
speaker as the assistant and all others as named users, with the character
spans a model may learn from (the participant's own turns). Speakers in
``system_roles`` are no participants; their turns stay system turns in every
rendering.

A conversation may hold a large share of all rows, so no task ever holds
one whole: turns are sorted by range over all tasks, offsets are running
sums inside a task's stretch plus the total of the stretches before (one
row per stretch and rendering), and renderings come in blocks of about
``block_chars`` characters. Blocks joined in order are the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rendering of a turn
OPEN, CLOSE = "<|", "|>\n"
END_OF_TURN = "\n"


@dataclass(frozen=True)
class ChatOptions:
    system_roles: tuple[str, ...] = ("system",)
    block_chars: int = 1_000_000


DEFAULT = ChatOptions()


def _header(role: Column, name: Column) -> Column:
    """``<|assistant|>``, ``<|system|>`` or ``<|user:name|>`` and a line feed."""
    return F.concat(F.lit(OPEN), role, F.when(role == "user", F.concat(F.lit(":"), name)).otherwise(F.lit("")), F.lit(CLOSE))


def rotated_turns(turns: DataFrame, opt: ChatOptions = DEFAULT) -> DataFrame:
    """One row per conversation, perspective and turn of ``turns`` (conv_id,
    turn, role, text): seen_role, name, n_copies, rendered and its offsets
    start, body_start and end in the rendering, and learn (own turn).

    Order: turn (nulls first), then the MD5 of role and text, role and text.
    A turn that is recorded several times (same conversation, turn, role and
    text) is rendered once; n_copies tells how often it was there. A null
    text is an empty turn; a null role is an unnamed speaker, "". Rows with
    a null conv_id are one conversation, the null one. A conversation of
    system turns alone has no participant and no row.
    """
    spoken = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    once = spoken.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n_copies"))
    people = (
        spoken.where(~F.col("role").isin(*opt.system_roles))
        .select(F.col("conv_id").alias("p_conv"), F.col("role").alias("perspective"))
        .distinct()
    )
    seen = F.when(F.col("role") == F.col("perspective"), "assistant").when(F.col("role").isin(*opt.system_roles), "system").otherwise("user")
    seats = (
        once.join(people, F.col("conv_id").eqNullSafe(F.col("p_conv")))
        .withColumn("seen_role", seen)
        .withColumn("head", _header(F.col("seen_role"), F.col("role")))
        .withColumn("tie", F.md5(F.concat_ws("\x00", "role", "text")))
        .withColumn("size", F.length("head") + F.length("text") + len(END_OF_TURN))
    )
    order = ["conv_id", "perspective", "turn", "tie", "role", "text"]
    spread = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # checkpointed, so that both passes below see the same stretches
    laid = seats.repartitionByRange(spread, *order).withColumn("stretch", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("s_conv", "s_persp").orderBy("s_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        laid.groupBy(F.col("conv_id").alias("s_conv"), F.col("perspective").alias("s_persp"), F.col("stretch").alias("s_stretch"))
        .agg(F.sum("size").alias("total"))
        .withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    )
    inside = Window.partitionBy("stretch", "conv_id", "perspective").orderBy("turn", "tie", "role", "text")
    placed = laid.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    same = (
        F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("perspective") == F.col("s_persp")) & (F.col("stretch") == F.col("s_stretch"))
    )
    start = F.col("base") + F.col("upto") - F.col("size")
    return placed.join(totals, same).select(
        "conv_id",
        "perspective",
        "turn",
        "seen_role",
        F.col("role").alias("name"),
        "n_copies",
        F.concat("head", "text", F.lit(END_OF_TURN)).alias("rendered"),
        start.alias("start"),
        (start + F.length("head")).alias("body_start"),
        (start + F.col("size")).alias("end"),
        (F.col("role") == F.col("perspective")).alias("learn"),
    )


def render_perspectives(turns: DataFrame, opt: ChatOptions = DEFAULT) -> DataFrame:
    """Renderings in blocks: conv_id, perspective, block, n_turns, start, text
    and mask, the spans to learn from as ``start-end`` joined by commas
    (character offsets in the whole rendering, end exclusive; a span holds
    the turn's text and its end mark, not its header).

    A block holds the turns that start in its stretch of ``block_chars``
    characters; a conversation shorter than that is one row per perspective.
    """
    block = F.floor(F.col("start") / opt.block_chars).cast("bigint")
    piece = F.struct("start", "rendered", F.when(F.col("learn"), F.concat_ws("-", "body_start", "end")).alias("span"))
    grouped = (
        rotated_turns(turns, opt)
        .withColumn("block", block)
        .groupBy("conv_id", "perspective", "block")
        .agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.count(F.lit(1)).alias("n_turns"), F.min("start").alias("start"))
    )
    spans = F.filter(F.col("pieces.span"), lambda s: s.isNotNull())
    return grouped.select(
        "conv_id",
        "perspective",
        "block",
        "n_turns",
        "start",
        F.array_join(F.col("pieces.rendered"), "").alias("text"),
        F.array_join(spans, ",").alias("mask"),
    )
