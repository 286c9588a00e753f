"""Connected components of an edge table, by contraction and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise


def _jumped(hooks: DataFrame) -> DataFrame:
    """(a, p) with p the root of a's tree: the distance to it halves each round."""
    while True:
        up = hooks.select(F.col("a").alias("__a"), F.col("p").alias("__p"))
        step = materialise(
            hooks.join(broadcast_if_small(up), F.col("p") == F.col("__a")).select("a", F.col("__p").alias("p"), (F.col("__p") != F.col("p")).alias("moved"))
        )
        hooks = step.select("a", "p")
        if not step.where("moved").limit(1).count():
            return hooks


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every end of the edges (a, b); comp is the least node of the component.

    Each round hooks every node that still has a neighbour on its least one. The only cycles are
    pairs that name each other (the second next of a node on a cycle is at most the node itself);
    their lesser end becomes the root. So each tree has two nodes or more, and contracting the trees
    halves the nodes at least: rounds and jumps are logarithmic on any graph, and need no cap.
    Labels and edges stay in tables in the shared folder; only counts come to the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    rest = both.where("a != b")
    while rest.limit(1).count():
        least = materialise(rest.groupBy("a").agg(F.min("b").alias("p")))
        back = least.select(F.col("a").alias("__a"), F.col("p").alias("__p"))
        own = (F.col("__p") == F.col("a")) & (F.col("a") < F.col("p"))
        hooks = least.join(broadcast_if_small(back), F.col("p") == F.col("__a")).select("a", F.when(own, F.col("a")).otherwise(F.col("p")).alias("p"))
        hooks = _jumped(materialise(hooks))
        root = broadcast_if_small(hooks.select(F.col("a").alias("__a"), F.col("p").alias("__p")))
        other = broadcast_if_small(hooks.select(F.col("a").alias("__b"), F.col("p").alias("__q")))
        labels = materialise(labels.join(root, F.col("comp") == F.col("__a"), "left").select("node", F.coalesce("__p", "comp").alias("comp")))
        rest = rest.join(root, F.col("a") == F.col("__a")).join(other, F.col("b") == F.col("__b"))
        rest = materialise(rest.where("__p != __q").select(F.col("__p").alias("a"), F.col("__q").alias("b")).distinct())
    least = labels.groupBy(F.col("comp").alias("__c")).agg(F.min("node").alias("least"))
    return labels.join(broadcast_if_small(materialise(least)), F.col("comp") == F.col("__c")).select("node", F.col("least").alias("comp"))
