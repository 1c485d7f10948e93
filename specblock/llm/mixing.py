"""Mixing sources to target weights by distributed prefix sums.

Every document has a hash-random key.  Documents are range-sorted by source
and key, prefix sums of their word counts are taken across partitions, and
each source is cut at its exact budget: a source whose budget is beyond its
size is taken in whole epochs first, and the document that the cut falls into
gives the words before it.

Sources are weighed in code-point order, null last, by a repeating list of
weights.  A source's target stops at `most` times its size; what is above is
shared again by weight until none is above.

Defined results: a null text has size 0; a null source is a source of its own;
null ids are kept; repeated rows are mixed as rows of their own; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specblock.llm.prefix import prefix_sums
from specblock.session import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row a source.

    Only sums over sources reach the driver, however many sources there are.
    """
    order = [F.col("source").asc_nulls_last()]
    ranked = prefix_sums(sizes.withColumn("one", F.lit(1).cast("long")), None, order, "one", "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", weight.alias("weight")))
    top = F.col("source_size") * most
    total = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total[0] or 0)
    level = budget / total[1] if total[1] else 0.0
    while True:
        above = top < F.col("weight") * level
        full, weight_left = ranked.agg(F.sum(F.when(above, top)), F.sum(F.when(~above, F.col("weight")))).first()
        following = (budget - (full or 0)) / weight_left if weight_left else level
        if following <= level:
            break
        level = following
    return ranked.select("source", "source_size", F.least(top.cast("double"), F.col("weight") * F.lit(float(level))).alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """id_col, source, size, source_size, target, taken of every row of docs."""
    if share > most:
        raise ValueError("no mix of over `most` times every source can be made")
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("key")
    )
    # Cut here, or drawing the ranges would count all words a second time.
    placed = prefix_sums(cut(rows), "source", [F.col("key"), F.col("id"), F.col("size")], "size", "before")
    targets = source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    targets = targets.withColumnRenamed("source", "__source")
    # A source may hold a third of all rows; AQE splits its side of this join, and small targets are broadcast.
    joined = placed.join(targets, placed["source"].eqNullSafe(targets["__source"]))
    words, whole = F.floor("target"), F.col("source_size")
    epochs = F.when(whole > 0, F.floor(words / whole)).otherwise(0)
    rest = F.least(F.col("size"), F.greatest(F.lit(0), words - epochs * whole - F.col("before")))
    return joined.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (epochs * F.col("size") + rest).cast("long").alias("taken"))
