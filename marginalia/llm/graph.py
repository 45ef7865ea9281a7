"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash, unstash


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for each id in links, comp being the smallest id it reaches.

    Each round takes the least label among neighbours and then the label's own label, so that paths
    halve; each round is a written table. Skewed hubs are left to adaptive skew joins, as no step
    needs a hub's rows in one task.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = stash(pairs.union(pairs.select("y", "x")).distinct(), "edges")
    labels = stash(edges.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("id"), F.least("x", "y").alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges["y"] == labels["id"]).groupBy("x").agg(F.min("comp").alias("near"))
        best = labels.join(near, labels["id"] == near["x"]).select("id", "comp", F.least("comp", "near").alias("best"))
        jump = labels.select(F.col("id").alias("best"), F.col("comp").alias("further"))
        moved = best.join(jump, "best", "left").select("id", F.col("comp").alias("old"), F.least("best", "further").alias("comp"))
        moved = stash(moved, "labels")
        unstash(labels)
        labels = moved.select("id", "comp")
        if not moved.where("old <> comp").take(1):
            unstash(edges)
            return labels
