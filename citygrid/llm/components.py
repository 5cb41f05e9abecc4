"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node reachable, for each node that has an edge (a, b).

    Each round takes the smallest label among a node's neighbours (a minimum, so Spark combines it before the shuffle and a
    node with very many neighbours is no burden) and then the label of that label. start: labels known already.
    Rounds end when nothing changes; the number grows with the logarithm of the longest path. Without edges: empty.
    """
    both = cut(edges.selectExpr("a", "b").union(edges.selectExpr("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label"))
    if start is not None:
        labels = labels.unionByName(start.select("node", "label")).groupBy("node").agg(F.min("label").alias("label"))
    labels = cut(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        least = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = cut(least.join(jump, "label", "left").select("node", "old", F.least("label", "far").alias("label")), "labels")
        labels = step.select("node", "label")
        if not step.where("label <> old").limit(1).count():
            return labels
