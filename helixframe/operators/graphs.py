"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import settled


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges (a, b) -> (node, component), the smallest node reachable.

    Each round gives a node the smallest label among its neighbours' and then jumps to that label's own label, so paths halve. A round's
    labels are a table (`settled`): what a checkpoint keeps of the plan before it are size estimates that multiply with every join.
    """
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels, last = settled(both.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()), None
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        stepped = settled(labels.join(near, "node").select("node", F.least("component", "m").alias("component")))
        labels = settled(stepped.join(stepped.select(F.col("node").alias("component"), F.col("component").alias("further")), "component").select("node", F.least("component", "further").alias("component")))
        mark = labels.agg(F.sum(F.col("component").cast("decimal(38,0)")), F.count("*")).first()
        if mark == last:
            return labels
        last = mark
    raise RuntimeError("components did not settle")
