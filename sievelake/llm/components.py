"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node
    that links reach.

    Each round every node takes the smallest label among its neighbours' and its
    own, then the label of that label, so long chains shrink by doubling.  Each
    round is cut by a reliable checkpoint.
    """
    both = common.checkpoint(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = common.checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        new = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = new.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "old")
        new = common.checkpoint(new)
        changed = not new.filter(F.col("component") != F.col("old")).isEmpty()
        labels = new.drop("old")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, component) after ``edges`` (a, b) are added: only the
    components that the edges touch are gone through again."""
    if edges.isEmpty():
        return labels
    one = labels.select(F.col("node").alias("a"), F.col("component").alias("x"))
    two = labels.select(F.col("node").alias("b"), F.col("component").alias("y"))
    named = common.checkpoint(edges.join(one, "a", "left").join(two, "b", "left").select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")))
    merged = connected_components(named.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    new = named.select(F.col("a").alias("node"), F.col("x").alias("component")).union(named.select("b", "y")).distinct()
    every = labels.union(new.join(labels, "node", "left_anti"))
    changed = merged.select(F.col("node").alias("component"), F.col("component").alias("new"))
    return common.checkpoint(every.join(changed, "component", "left").select("node", F.coalesce("new", "component").alias("component")))
