"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage


def _roots(parents: DataFrame) -> DataFrame:
    """Pointer jumping: (node, root) from (node, parent), every parent being smaller than its node."""
    parents = stage(parents, "parents")
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = stage(parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "parents")
        if jumped.where("moved").limit(1).count() == 0:
            return jumped.select("node", F.col("parent").alias("root"))
        parents = jumped.select("node", "parent")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is not its component's smallest; root is that smallest node.

    Each round hangs every node below its smallest neighbour, follows the pointers
    to their roots and keeps the links between different roots; the number of
    rounds is logarithmic in the size of a component.
    """
    edges, roots = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"), None
    while True:
        edges = stage(edges.distinct(), "edges")
        if edges.limit(1).count() == 0:
            break
        parents = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        step = _roots(parents)
        if roots is None:
            roots = step
        else:
            over = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = stage(roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(step.join(roots.select("node"), "node", "left_anti")), "roots")
        for end in ("a", "b"):
            to = step.select(F.col("node").alias(end), "root")
            edges = edges.join(to, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return roots
