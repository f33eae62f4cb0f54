"""Connected components of a graph given as edges, by smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveknn.llm.common import stored


def connected(edges: DataFrame) -> DataFrame:
    """``id, label`` of every node of ``edges(a, b)``: the smallest id that it reaches.

    Each round takes the smallest label among neighbours and then the label's own label, so paths
    halve; it ends when no label changes. All tables are stored, so that joins on a hub's id are between
    exchanges that Spark can split.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = labels.select(F.col("id").alias("b"), F.col("label").alias("m"))
        pulled = both.join(near, "b").groupBy(F.col("a").alias("id")).agg(F.min("m").alias("m"))
        lower = stored(labels.join(pulled, "id", "left").select("id", "label", F.least("label", "m").alias("new")), "labels")
        roots = lower.select(F.col("id").alias("new"), F.col("new").alias("root"))
        jumped = stored(lower.join(roots, "new", "left").select("id", F.col("label").alias("old"), F.least("new", "root").alias("label")), "labels")
        labels = jumped.select("id", "label")
        if not jumped.where("label < old").limit(1).count():
            return labels
