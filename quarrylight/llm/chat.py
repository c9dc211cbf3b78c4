"""Multi-party chat: every participant's view of a dialogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END, ASSISTANT, SYSTEM = "<|end|>\n", "<|assistant|>\n", "<|system|>\n"


def _header(role: Column) -> Column:
    """Of a turn, to anyone but its speaker."""
    return F.when(role == "system", F.lit(SYSTEM)).otherwise(F.concat(F.lit("<|user name="), F.regexp_replace(role, "[^0-9A-Za-z_-]", "_"), F.lit("|>\n")))


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation and participant, rendered with that speaker as the assistant.

    Columns: conv_id, speaker, text, mask (the [start, stop) characters of the
    speaker's messages with their end marks, which are to be learned), n_turns
    and n_learned.  Others are users with their names; "system" is context for
    everyone and no participant.  Turns are in the order of turn (null first),
    ties in the order of role and text; repeated rows are said twice.

    A null or empty role is "unknown"; a null text is empty.  "<|" inside a
    text becomes "< |", so that no text can forge a mark.  Rows without
    conv_id are dropped; a conversation of system turns only gives no row.

    An empty table gives an empty one; other columns are not read.

    Plan: one shuffle by conversation.  Where a turn begins depends on the
    speaker only by the header of each turn of theirs before it, so a running
    sum and a running count give every mask in linear time; rendering is JVM
    expressions on the collected turns.
    """
    role = F.when(F.coalesce(F.col(role_col).cast("string"), F.lit("")) == "", F.lit("unknown")).otherwise(F.col(role_col).cast("string"))
    said = F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    said_by = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 63))).alias("turn"), role.alias("role"), said.alias("said"))
    said_by = said_by.withColumn("head", _header(F.col("role"))).withColumn("size", F.length("said") + len(END))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "said").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "role").orderBy("turn", "said")
    ahead = F.coalesce(F.sum(F.length("head") + F.col("size")).over(before), F.lit(0)) - (F.row_number().over(own) - 1) * (F.length("head") - len(ASSISTANT)) + len(ASSISTANT)
    conv = said_by.withColumn("start", ahead.cast("int")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "said", "head", "start", "size"))).alias("turns"))
    speakers = F.array_sort(F.array_distinct(F.filter(F.transform("turns", lambda t: t.role), lambda r: r != "system")))
    view = conv.withColumn("speaker", F.explode(speakers))
    mine = F.filter("turns", lambda t: t.role == F.col("speaker"))
    return view.select(
        "conv_id",
        "speaker",
        F.array_join(F.transform("turns", lambda t: F.concat(F.when(t.role == F.col("speaker"), F.lit(ASSISTANT)).otherwise(t["head"]), t.said, F.lit(END))), "").alias("text"),
        F.transform(mine, lambda t: F.array(t["start"], t["start"] + t["size"])).alias("mask"),
        F.size("turns").alias("n_turns"),
        F.size(mine).alias("n_learned"),
    )
