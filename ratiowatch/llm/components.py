"""Connected components of a graph that stays on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratiowatch.session import cut_lineage, drop_scratch


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the smallest node it reaches.

    Each round takes the smallest label among neighbours and then the label of that label,
    so the distance to the smallest node is at least halved on paths. Rounds are tables in
    the shared folder, and only a count of changes reaches the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = cut_lineage(both.where(F.col("a") != F.col("b")))
    labels = cut_lineage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = cut_lineage(met.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        changed = moved.where(F.col("old") != F.col("label")).limit(1).count()
        drop_scratch(labels)
        labels = moved
        if not changed:
            drop_scratch(edges)
            return labels.select("node", "label")
