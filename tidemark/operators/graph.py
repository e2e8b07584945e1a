"""Connected components of long ids, for the operators that join neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import shared


def connected(nodes: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """id, root: the smallest id that undirected edges (a, b) reach.  Each round takes the least label of all neighbours
    (a partial aggregate) and then the label of that label, so rounds grow with the logarithm of the longest path.  A
    round's labels are written, which cuts the lineage."""
    both = shared.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = shared.written(nodes.select("id", F.col("id").alias("root")), "labels")
    for _ in range(most):
        least = both.join(label, F.col("a") == F.col("id")).groupBy(F.col("b").alias("id")).agg(F.min("root").alias("m"))
        near = shared.written(label.join(least, "id", "left").select("id", "root", F.least("root", "m").alias("m")), "near")
        on = near.select(F.col("id").alias("m"), F.col("m").alias("further"))
        now = shared.written(near.join(on, "m").select("id", F.least("m", "further").alias("root"), (F.least("m", "further") < F.col("root")).alias("moved")), "labels")
        label = now.select("id", "root")
        if now.where("moved").isEmpty():
            return label
    raise RuntimeError("components did not settle")
