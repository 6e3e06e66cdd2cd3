"""Connected components of a graph given by its links, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node in ``links(a, b)``: the smallest node
    that links reach.

    Every node takes the smallest label among its own and its neighbours', then
    the label of that label, which halves distances in chains.  Labels are
    written to the shared folder each round, and both sides of each join are
    read from there, so adaptive execution can split the links of a hub."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialise(both, "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(around, "node").select("node", "component", F.least("component", "m").alias("m"))
        ahead = labels.select(F.col("node").alias("m"), F.col("component").alias("next"))
        moved = step.join(ahead, "m").select("node", "component", F.least("m", "next").alias("new"))
        moved = materialise(moved, "labels")
        labels = moved.select("node", F.col("new").alias("component"))
        if moved.filter("component <> new").isEmpty():
            return labels
