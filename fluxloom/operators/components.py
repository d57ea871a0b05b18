"""Connected classes of a link table, by minimum labels with reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.session import cut


def connected_classes(links: DataFrame) -> DataFrame:
    """node, label of every node of ``links`` (a, b): label is the smallest node of its class.

    Each round takes the smallest label among the neighbours and then the label's own label (pointer jumping), so long
    chains halve; rounds go on until no label moves. Self links and repeated links are harmless; an empty table gives no rows.
    """
    edges = links.select("a", "b").where(F.col("a") != F.col("b"))
    edges = cut(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    while True:
        labels = cut(labels)
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("hop"))
        step = cut(step.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("hop", "next")).alias("next")))
        moved = step.where(F.col("next") != F.col("label")).limit(1).count()
        labels = step.select("node", F.col("next").alias("label"))
        if not moved:
            return labels
