"""Connected components of a graph of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import drop_staged, stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long): component is the smallest node reachable.

    Every node has a parent, at first itself. In each round a node learns the smallest grandparent among its neighbours; it
    takes that for its parent if it is smaller, its old parent does so too, and then each follows its grandparent. So trees
    hang themselves onto smaller ones and flatten, and the number of rounds grows with the logarithm of the size. Rows that
    repeat, edges in either direction and loops are allowed; rows with a null end are ignored. Parents are tables in the
    shared folder, of which only the last one stays; nothing but a count for each round reaches the driver.
    """
    both = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    both = stage(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    nodes = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("parent"))
    tree = stage(_grand(nodes.withColumn("changed", F.lit(True))), "parents")
    for _ in range(max_rounds):
        near = both.join(tree.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("near"))
        step = tree.join(near, "node").select("node", "parent", "grand", "near")
        hung = step.groupBy(F.col("parent").alias("node")).agg(F.min("near").alias("hung"))
        step = step.join(hung, "node", "left").withColumn("new", F.least("parent", "grand", "near", F.coalesce("hung", "parent")))
        new = stage(_grand(step.select("node", F.col("new").alias("parent"), ((F.col("new") != F.col("parent")) | (F.col("grand") != F.col("parent"))).alias("changed"))), "parents")
        moving = new.where("changed or grand <> parent").limit(1).count()
        drop_staged(tree)
        tree = new
        if not moving:
            drop_staged(both)
            return tree.select("node", F.col("parent").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _grand(tree: DataFrame) -> DataFrame:
    """(node, parent, changed) with each node's grandparent."""
    up = tree.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return tree.join(up, "parent").select("node", "parent", "grand", "changed")
