"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.runtime import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (the smallest node of its component) of an edge table; nulls are no nodes.

    Each round every node takes the smallest label around it and then the label of that label, so the number of rounds
    grows with the logarithm of the diameter. Labels are checkpointed; only a count of changes reaches the driver. An
    edge set that has not settled within `rounds` raises.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    e = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    for _ in range(rounds):
        around = e.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(around, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = cut(near.join(jump, F.col("label") == F.col("_n")).select("node", "old", F.least("label", "_l").alias("label")))
        changed = new.where(F.col("old") != F.col("label")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components have not settled in {rounds} rounds")
