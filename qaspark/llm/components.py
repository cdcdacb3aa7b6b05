"""Connected components as joins: every node hooks to its smallest neighbour, pointers are halved, the graph is contracted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import checkpointed


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, parent), where every parent is smaller than its node. Doubles the pointers until none moves."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        parents = checkpointed(parents.join(up, "parent", "left").select("node", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("_moved")))
        if parents.where("_moved").isEmpty():
            return parents.select("node", F.col("parent").alias("root"))
        parents = parents.select("node", "parent")


def relabelled(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges between roots, without loops and repeats."""
    for end in ("a", "b"):
        edges = edges.join(found.select(F.col("node").alias(end), F.col("root").alias("_root")), end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[c for c in edges.columns if c not in "ab"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component; ``edges`` has integer columns a and b."""
    edges = checkpointed(edges.where("a <> b").select("a", "b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).where("parent < node")
        found = roots(hooks)
        if labels is None:
            labels = found
        else:
            step = found.select(F.col("node").alias("root"), F.col("root").alias("_root"))
            labels = checkpointed(labels.join(step, "root", "left").select("node", F.coalesce("_root", "root").alias("root")).union(found))
        edges = checkpointed(relabelled(edges, found).distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
