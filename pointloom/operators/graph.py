"""Components of a graph, with labels that are hooked to smaller ones and shortened in every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.shared import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every row of ``nodes`` (node), linked by ``edges`` (a, b).

    In each round a node, and its label, take the smallest label that any neighbour's label has, and every label its own
    label, so that the rounds grow with the logarithm of a component's width. All steps are joins and minima
    with partial aggregation; rounds are checkpointed. Labels are looked up among those that are no root any more, so a component
    that has settled joins nothing. Edges of nodes that ``nodes`` lacks count for nothing.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    held = cut(nodes.select("node", F.col("node").alias("root")).distinct())
    while True:
        moved = held.where("node != root").select(F.col("node").alias("old"), F.col("root").alias("next"))
        over = held.join(moved, F.col("root") == F.col("old"), "left").select("node", "root", F.coalesce("next", "root").alias("far"))
        over = cut(over)
        near = both.join(over.select(F.col("node").alias("b"), F.col("far").alias("least")), "b").groupBy(F.col("a").alias("node")).agg(F.min("least").alias("least"))
        offers = over.join(near, "node").select("node", "root", "least")
        all_offers = offers.select("node", "least").union(offers.select(F.col("root"), "least")).union(over.select("node", "far"))
        fresh = cut(all_offers.groupBy("node").agg(F.min("least").alias("root")))
        changed = fresh.join(held.withColumnRenamed("root", "was"), "node").where("root != was").isEmpty()
        held = fresh
        if changed:
            return held
