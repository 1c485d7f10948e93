"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specblock.session import cut, cut_afresh


#: Rows of a partition at least; tables of a shrinking graph are not spread over more tasks than that.
TASK_ROWS = 100_000


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many rows, on no more partitions than they need."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a long, b long).

    The component is its smallest node.  Rounds of local contraction: every
    node joins the smallest node of its closed neighbourhood under an order
    that is drawn anew each round, and edges are rewritten between what is
    left, so the graph shrinks by a constant factor and a star, however hot
    its centre, is gone after one round.  Aggregates combine before they
    shuffle; each round is cut by a checkpoint that forgets estimated sizes,
    on as many partitions as its rows need.  Self-loops and repeated edges are
    allowed; null ends are left out.
    """
    raw = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    raw = cut_afresh(raw.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows = raw.count()
    nodes = 2 * rows
    # xxhash64 of one long is a bijection: each round's fresh order loses no node.
    fresh = lambda c: F.xxhash64(F.col(c))
    labels = raw.select(F.col("a").alias("node")).union(raw.select(F.col("b").alias("node"))).distinct()
    labels = labels.withColumn("label", fresh("node"))
    left = cut_afresh(_packed(raw.select(fresh("a").alias("a"), fresh("b").alias("b")).where("a <> b"), rows))
    while rows := left.count():
        both = left.union(left.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("to"))
        least = cut(_packed(least, 2 * rows))
        labels = labels.join(least, labels["label"] == least["u"], "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = cut_afresh(_packed(labels.select("node", fresh("label").alias("label")), nodes))
        la = least.select(F.col("u").alias("a"), F.col("to").alias("la"))
        lb = least.select(F.col("u").alias("b"), F.col("to").alias("lb"))
        moved = left.join(la, "a").join(lb, "b").where("la <> lb")
        moved = moved.select(F.xxhash64(F.greatest("la", "lb")).alias("a"), F.xxhash64(F.least("la", "lb")).alias("b")).distinct()
        left = cut_afresh(_packed(moved, rows))
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(smallest, "label").select("node", "component")
