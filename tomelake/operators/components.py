"""Connected components over an edge table: smallest reachable label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", cut=lambda df: df.checkpoint()) -> DataFrame:
    """edges(src, dst) -> (vertex, component): component is the smallest vertex reachable. Loops and repeated edges do no harm.

    Each round takes the least label among a vertex and its neighbours and then the label of that label, so a path of n
    vertices needs about log n rounds. `cut` ends the lineage of a round's result; the default is a reliable checkpoint.
    """
    edges = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src <> dst")
    both = cut(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(both.groupBy("src").agg(F.min("dst").alias("least")).select(F.col("src").alias("vertex"), F.least("src", "least").alias("component")))
    while True:
        near = (
            both.join(labels.select(F.col("vertex").alias("dst"), "component"), "dst")
            .groupBy("src")
            .agg(F.min("component").alias("near"))
            .select(F.col("src").alias("vertex"), "near")
        )
        step = labels.join(near, "vertex").select("vertex", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = step.select(F.col("vertex").alias("to"), F.col("to").alias("further"))
        after = cut(step.join(jump, "to").select("vertex", F.least("to", "further").alias("component"), (F.least("to", "further") < F.col("was")).alias("moved")))
        labels = after.select("vertex", "component")
        if after.filter("moved").isEmpty():
            return labels
