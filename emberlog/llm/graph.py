"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import materialise


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(``node``, ``component``) for every node of edges (``a``, ``b``); a component is its smallest node.

    Each round takes the smallest label of all neighbours, then the label of that label, and is
    written to the shared folder; labels never reach the driver. The minimum per node is partial in
    each task, and joins are ones that Spark can split, so a hub is no hot spot.
    """
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = materialise(ends.union(ends.select("other", "node")).where("node <> other").distinct(), "edges")
    labels = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component"))
    labels = materialise(labels, "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("next"))
        moved = lower.join(jump, "new", "left").select("node", "old", F.coalesce("next", "new").alias("component"))
        step = materialise(moved, "labels")
        labels = step.select("node", "component")
        if step.where("old <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
