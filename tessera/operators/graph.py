"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import cut, few

#: Tables of labels up to so many rows (some 50 bytes each) are broadcast.
BROADCAST_LABELS = 200_000


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component``: the smallest node that each node is connected to.

    Every round labels a node with the least of its neighbours and itself, in the
    order of a hash, and contracts the edges to the labels; as the order is random,
    a round leaves a fraction of the nodes, chains included, and a star is done at
    once. The labels of all rounds are composed in the end. Each round is
    checkpointed; nothing but whether edges are left reaches the driver. Edges with a
    null end are ignored; an empty table gives no rows.
    """

    def ranked(c: str):
        return F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("id"))

    left_edges = cut(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).dropna().distinct())
    rounds = []
    while True:
        both = left_edges.union(left_edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min(ranked("b")).alias("near"))
        rounds.append(cut(near.select(F.col("a").alias("node"), F.least("near", ranked("a"))["id"].alias("to"))))
        labels = few(rounds[-1], BROADCAST_LABELS)
        of_a, of_b = labels.toDF("a", "to_a"), labels.toDF("b", "to_b")
        moved = left_edges.join(of_a, "a").join(of_b, "b").filter("to_a <> to_b")
        left_edges = cut(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        if left_edges.isEmpty():
            break
    whole = rounds.pop().toDF("node", "root")
    while rounds:
        above = few(whole, BROADCAST_LABELS).toDF("to", "above")
        whole = rounds.pop().join(above, "to", "left").select("node", F.coalesce("above", "to").alias("root"))
    whole = cut(whole)
    # Cut, so that beyond the broadcast both sides are shuffled for the join alone and a huge component is split.
    least = cut(whole.groupBy("root").agg(F.min("node").alias("component")))
    return whole.join(few(least, BROADCAST_LABELS), "root").select("node", "component")
