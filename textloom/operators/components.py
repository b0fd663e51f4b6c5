"""Connected components of an undirected edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that can be reached. Nodes that only have edges to themselves or null don't appear.

    Each round takes the smallest label among a node's neighbours, a grouped minimum with map-side combining, and then that
    label's own label, so that long chains need few rounds. A node without smaller neighbours keeps its label.
    """
    e = edges.select(F.col(a).alias("n"), F.col(b).alias("o")).filter("n <> o")
    e = cut(e.unionByName(e.select(F.col("o").alias("n"), F.col("n").alias("o"))).distinct())
    labels = cut(e.groupBy("n").agg(F.least("n", F.min("o")).alias("label")))
    while True:
        near = e.join(labels.withColumnRenamed("n", "o"), "o").groupBy("n").agg(F.min("label").alias("near"))
        low = labels.join(near, "n").select("n", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = low.select(F.col("n").alias("label"), F.col("label").alias("jump"))
        new = cut(low.join(jump, "label").select("n", "before", F.col("jump").alias("label")))
        labels = new.select("n", "label")
        if new.filter("before <> label").isEmpty():
            return labels.select(F.col("n").alias("node"), F.col("label").alias("component"))
