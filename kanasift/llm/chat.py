"""Logged conversations as training text: snapshots that a longer log begins with are collapsed, then turns are rendered.

A running hash over a conversation's turns stands for each of its prefixes. A conversation whose whole hash is
a shorter prefix of another is dropped by an anti-join; of equal ones the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import written

START, END = "<|im_start|>", "<|im_end|>"
ROLES = ("system", "user", "assistant", "tool")


def snapshots(turns: DataFrame) -> DataFrame:
    """(conv_id, n, h1, h2) for each prefix of n turns of each conversation.

    turns has conv_id, turn, role, text; null roles and texts count as empty, null conv_ids are left out, rows
    repeated in full count once, and turns of one number stand in order of role and text, null numbers first.
    The hash of a prefix adds up its turns' hashes, each taken with the turn's place, so it runs along a window.
    """
    rows = _clean(turns)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("n"))
    one, two = F.xxhash64("n", "role", "text"), F.xxhash64(F.lit(7), "n", "text", "role")
    wide = placed.select("conv_id", "turn", "role", "text", "n", one.cast("decimal(20,0)").alias("a"), two.cast("decimal(20,0)").alias("b"))
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return wide.select("conv_id", F.col("n"), F.sum("a").over(run).alias("h1"), F.sum("b").over(run).alias("h2"))


def _clean(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null").distinct()


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n): conversations that no longer one begins with, one of each set of equals, and their turns.

    Prefixes are summed up by hash in each task before they are dealt out, so a first turn that very many
    conversations share is no hot key.
    """
    prefixes = written(snapshots(turns), "snapshots")
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("n", "h1", "h2")).alias("w")).select("conv_id", "w.*")
    whole = written(whole, "whole")
    # A prefix that two different lengths of log have, or one longer log, outlives the log that ends there.
    longest = whole.select("conv_id", F.col("n").alias("size"))
    inner = prefixes.join(longest, "conv_id").where("n < size").select("n", "h1", "h2").distinct()
    unique = whole.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    return unique.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns long, text) of each maximal conversation: its turns in chat markup.

    Roles other than the known ones are rendered as user; markup inside a turn is broken by a space, so a
    turn cannot end itself. A conversation is one row of the result and so is gathered in one task. Empty tables
    give no rows; other columns are ignored.
    """
    kept = maximal(turns)
    rows = _clean(turns).join(kept.select("conv_id", "n"), "conv_id")
    role = F.lower(F.trim("role"))
    role = F.when(role.isin(*ROLES), role).otherwise("user")
    body = F.replace(F.replace(F.col("text"), F.lit(START), F.lit("<| im_start|>")), F.lit(END), F.lit("<| im_end|>"))
    line = F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(END + "\n"))
    parts = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("p"))
    return parts.select("conv_id", F.size("p").cast("long").alias("n_turns"), F.array_join(F.transform("p", lambda x: x["line"]), "").alias("text"))
