"""Chat logs: conversations that others continue are dropped, the rest rendered. DataFrame functions
only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: the marks of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
MARKS = r"<\|(im_start|im_end)\|>"


def ordered_turns(logs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place): each conversation's turns in order, numbered from 1. Rows
    that repeat in all four columns are one turn; turns with the same number are ordered by role and
    text; nulls come first. Null roles and texts count as empty."""
    rows = logs.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # dealt by conversation once: the rest needs no other shuffle
    rows = rows.repartition("conv_id").dropDuplicates(["conv_id", "turn", "role", "text"])
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.withColumn("place", F.row_number().over(by))


def rolling(rows: DataFrame) -> DataFrame:
    """Prefix hashes of 128 bits at each turn: the turns' hashes with their places, folded by exclusive
    or. last says whether the conversation ends here."""
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), "place", "role", "text")).over(so_far) for seed in (17, 40503)]
    following = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(
        "conv_id", "place", hashes[0].alias("hash1"), hashes[1].alias("hash2"), F.lead("place").over(following).isNull().alias("last")
    )


def turn_text() -> Column:
    text = F.regexp_replace("text", MARKS, "<| $1 |>")
    return F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"), text, F.lit(CLOSE + "\n"))


def maximal_conversations(logs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of each conversation that no longer one begins with. Of equal
    conversations the smallest conv_id stays; n_copies counts them. Rows without a conv_id are one
    conversation. An empty table gives an empty result.

    Prefixes are made distinct before they are joined, so a first turn that many logs share is one
    row in the anti-join.
    """
    marks = rolling(ordered_turns(logs))
    keys = ["place", "hash1", "hash2"]
    begun = marks.where("NOT last").select(*keys).distinct()
    whole = marks.where("last").groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    return whole.join(begun, keys, "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def render_conversations(logs: DataFrame) -> DataFrame:
    """maximal_conversations() with rendered: the turns one after the other, each between marks. Marks
    inside a text are spaced out so that they cannot end a turn. Other columns of logs are not read."""
    kept = maximal_conversations(logs)
    turns = ordered_turns(logs)
    rows = turns.join(kept, turns["conv_id"].eqNullSafe(kept["conv_id"])).select(kept["*"], "place", turn_text().alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("place", "part")))
    rows = rows.groupBy("conv_id", "n_turns", "n_copies").agg(parts.alias("parts"))
    return rows.select("conv_id", "n_turns", "n_copies", F.array_join("parts.part", "").alias("rendered"))
