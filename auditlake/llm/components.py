"""Connected components of an edge table by distributed minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import cut


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after links (a, b) between nodes: only the labels that links join are looked at again."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
    ends = cut(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "ends")
    if ends.isEmpty():
        return labels
    lower = connected_components(ends)
    lower = lower.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("new"))
    return cut(labels.join(lower, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) of every node of edges (a, b).

    Each round takes the smallest label of the neighbours and then the label of that label, so paths shorten by half
    or more; every round is written to the shared folder. A node with very many edges is only summed over, never
    gathered.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "l").alias("label"))
        far = lower.select(F.col("node").alias("label"), F.col("label").alias("l"))
        new = cut(lower.join(far, "label").select("node", "was", F.least("label", "l").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("was <> label").isEmpty():
            return labels
