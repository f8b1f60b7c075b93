"""Connected components of an edge list, by hooking every node to its smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from granary.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, label) for every node that has an edge to another; one label a component.

    Each round writes what is left to the shared folder, so lineage stays short. The number of nodes falls at least by
    the largest of each component and in practice several times a round. Nulls, loops and repeated edges are ignored.
    """
    left = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while labels is None or not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parents = written(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent")), "parents")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("label"))
        else:
            up = parents.select(F.col("node").alias("label"), "parent")
            labels = labels.join(up, "label", "left").select("node", F.coalesce("parent", "label").alias("label"))
        labels = written(labels, "labels")
        a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        left = left.join(a, "a").join(b, "b").where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        left = written(left, "edges")
    return labels
