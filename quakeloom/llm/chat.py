"""Chat formatting with cumulative-snapshot collapse.

Logs hold a conversation again and again as it grows. Each turn has a rolling hash of the turns up to it; a
conversation whose last hash is the hash of a proper prefix of another is dropped by an anti-join, and of equal conversations the
smallest id stays. What remains is rendered with role marks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def prefix_hashes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, pos, role, text, h1, h2``: two independent 64-bit hashes of the turns up to each, position counted from 1.

    Turns go by number, then role and text; repeated rows count. Null roles and texts are empty. Rows
    without a conversation id are left out. The running hash is an exclusive or, so a window holds no list of turns.
    """
    own = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    by = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = own.withColumn("pos", F.row_number().over(by))
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, salt in (("h1", 1), ("h2", 2)):
        rows = rows.withColumn(name, F.bit_xor(F.xxhash64(F.lit(salt), "pos", "role", F.lit(salt * 7), "text")).over(upto))
    return rows.drop("turn")


def maximal_conversations(turns: DataFrame, **columns: str) -> DataFrame:
    """``conv, n_turns, n_copies``: conversations that are no proper prefix of another; of equal ones the smallest id."""
    hashed = materialize(prefix_hashes(turns, **columns).select("conv", "pos", "h1", "h2"), "prefixes")
    ends = hashed.groupBy(F.col("conv").alias("c")).agg(F.max("pos").alias("n"))
    both = hashed.join(ends, F.col("conv") == F.col("c"))
    last = both.where(F.col("pos") == F.col("n"))
    whole = last.groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = both.where(F.col("pos") < F.col("n")).select(F.col("pos").alias("n"), "h1", "h2").distinct()  # a common first turn is one row
    return whole.join(prefixes, ["n", "h1", "h2"], "left_anti").select("conv", F.col("n").cast("long").alias("n_turns"), F.col("n_copies").cast("long").alias("n_copies"))


def render(turns: DataFrame, kept: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, n_turns, n_copies, rendered``: each kept conversation as one string, turns in order, each between marks."""
    rows = prefix_hashes(turns, conv_col, turn_col, role_col, text_col).select("conv", "pos", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")).alias("part"))
    own = rows.join(kept, "conv")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "")
    return own.groupBy(F.col("conv").alias(conv_col)).agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), joined.alias("rendered"))
