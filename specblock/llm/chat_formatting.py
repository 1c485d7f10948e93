"""Chat formatting after collapse of cumulative snapshots.

A log that saves a conversation after every turn holds each prefix of it as a
conversation of its own.  Every turn gets its place and a rolling hash of the
turns up to it (the xor of place-tagged hashes, in two lanes), by distributed
prefix folds, so one conversation may hold a third of all rows.  A
conversation whose whole hash is a prefix hash of a longer one goes in an
anti-join; of equal conversations the smallest id stays.  What is left is
rendered, up to `chunk_turns` turns to a row.

Defined results: turns sort by number (null first), then role and text; equal
turn numbers keep that order; a null role renders as an empty one, a null text
as empty, and nulls equal only nulls when conversations are compared; rows
with a null id are one conversation; repeated rows are turns of their own; an
empty table gives none; other columns are ignored.  `<|` inside a role or text
renders as `< |`, so that no text can forge a marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specblock.llm.prefix import prefix_folds, prefix_sums
from specblock.session import cut

CHUNK_TURNS = 1024
START, END = "<|im_start|>", "<|im_end|>"


def numbered_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, role, text): place counts the turns of a conversation from 1."""
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.lit(1).cast("long").alias("one"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    placed = prefix_sums(rows, "conv", order, "one", "before")
    return placed.select("conv", (F.col("before") + 1).alias("place"), "role", "text")


def prefix_hashes(numbered: DataFrame) -> DataFrame:
    """(conv, place, p1, p2, turns): the hashes of the turns up to each, and how many the conversation has."""
    lane = lambda seed: F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    hashed = numbered.select("conv", "place", lane(1).alias("h1"), lane(2).alias("h2"))
    folded = prefix_folds(hashed, "conv", [F.col("place")], {"h1": "b1", "h2": "b2"}, xor=True)
    folded = folded.select("conv", "place", F.col("b1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("b2").bitwiseXOR(F.col("h2")).alias("p2"))
    length = folded.groupBy(F.col("conv").alias("__conv")).agg(F.max("place").alias("turns"))
    return folded.join(length, folded["conv"].eqNullSafe(length["__conv"])).drop("__conv")


def maximal_conversations(numbered: DataFrame) -> DataFrame:
    """(conv, turns) of conversations that are no prefix of a longer one, one of equal ones."""
    prefixes = cut(prefix_hashes(numbered))
    longer = prefixes.groupBy("place", "p1", "p2").agg(F.max("turns").alias("longest")).where(F.col("longest") > F.col("place"))
    # Equal conversations become one row before they meet the prefixes: a hot one is combined where it is.
    ends = prefixes.where(F.col("place") == F.col("turns")).groupBy("place", "p1", "p2").agg(F.min("conv").alias("conv"), F.max("turns").alias("turns"))
    return ends.join(longer, ["place", "p1", "p2"], "left_anti").select("conv", "turns")


def rendered(role: Column, text: Column) -> Column:
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(START), safe(role), F.lit("\n"), safe(text), F.lit(END + "\n"))


def format_chats(
    turns: DataFrame, chunk_turns: int = CHUNK_TURNS, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """id_col, chunk, n_turns (of the conversation), rendered: the maximal conversations."""
    numbered = cut(numbered_turns(turns, id_col, turn_col, role_col, text_col))
    kept = maximal_conversations(numbered).withColumnRenamed("conv", "__conv")
    rows = numbered.join(kept, numbered["conv"].eqNullSafe(kept["__conv"]))
    chunk = F.floor((F.col("place") - 1) / chunk_turns).cast("long")
    rows = rows.select("conv", "turns", chunk.alias("chunk"), "place", rendered(F.col("role"), F.col("text")).alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    whole = rows.groupBy("conv", "turns", "chunk").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("rendered"))
    return whole.select(F.col("conv").alias(id_col), "chunk", F.col("turns").alias("n_turns"), "rendered")
