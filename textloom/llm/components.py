"""Connected components of a graph that is never held in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b): the smallest node reachable.

    Each round takes the least label among neighbours and then the label's own label, so that long chains
    shorten by more than half a round. Rounds are written to the shared folder.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        before, closer = labels, staged(labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "closer")
        onward = closer.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = staged(closer.join(onward, "label").select("node", "old", F.least("label", "next").alias("label")), "labels", after=[before, closer])
        labels = jumped.select("node", "label")
        if not jumped.where("old <> label").limit(1).count():
            return labels
