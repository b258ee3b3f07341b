"""Multi-party perspective rotation of chat dialogues.

For every participant of a dialogue, the dialogue is rendered with that speaker
as the assistant and all others as named users.  A rendering is the sequence of
its segments, one row a message, with character offsets and loss masks; the
whole text is the segments in order of `position`.  No dialogue is gathered in
one row or task: positions and offsets are sums over blocks of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|start|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    """Text that can't open or close a message: backslashes doubled, `<|` written as `<\\|`."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def rotate(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", context: tuple[str, ...] = ("system",), block: int = 256) -> DataFrame:
    """One row per dialogue, perspective and message.

    Columns: conv_id, perspective, position (gapless from 0), turn, speaker,
    chat_role (system, user or assistant), name (of users, else null), segment
    (the rendered message), start and stop (its characters in the rendering),
    loss_start and loss_stop (the part that is learnt: an assistant's content
    and its closing mark; null elsewhere).

    Speakers in `context` are no participants; their messages come out as
    system messages in every rendering.  A dialogue without participants gives
    no rows.  A null speaker is the participant named unknown; a null text is
    empty; messages of a null conv_id form one dialogue; a null turn comes
    first; ties in turn are ordered by speaker, then text; repeated rows stay.
    Other columns are dropped.  An empty table gives no rows.
    """
    said = messages.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    said = said.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    people = said.where(~F.col("speaker").isin(*context)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    rows = said.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    role = F.when(F.col("speaker").isin(*context), "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    rows = rows.withColumn("chat_role", role).withColumn("name", F.when(F.col("chat_role") == "user", F.col("speaker")))
    head = F.concat(F.lit(OPEN), F.col("chat_role"), F.when(F.col("chat_role") == "user", F.concat(F.lit(" name="), escaped(F.replace("name", F.lit("\n"), F.lit(" "))))).otherwise(""), F.lit("\n"))
    rows = rows.withColumn("head", F.char_length(head)).withColumn("segment", F.concat(head, escaped(F.col("text")), F.lit(CLOSE)))
    rows = rows.withColumn("size", F.char_length("segment").cast("long"))
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "speaker", "text")
    rows = rows.withColumn("_pos", F.row_number().over(inside).cast("long") - 1).withColumn("_stop", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy("conv_id", "perspective", "block").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
        .select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("k"),
                F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("before")))
    whole = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("k")))
    stop = F.col("_stop") + F.col("before")
    learnt = F.col("chat_role") == "assistant"
    return whole.select(
        "conv_id", "perspective", (F.col("_pos") + F.col("n_before")).alias("position"), "turn", "speaker", "chat_role", "name", "segment",
        (stop - F.col("size")).alias("start"), stop.alias("stop"),
        F.when(learnt, stop - F.col("size") + F.col("head")).alias("loss_start"), F.when(learnt, stop - 1).alias("loss_stop"))
