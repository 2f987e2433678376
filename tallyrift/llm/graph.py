"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrift.session import materialize


def _jump(parents: DataFrame) -> DataFrame:
    """Follow parents to their ends; parents only ever shrink, so there are no cycles."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = parents.join(above, "parent", "left")
        parents = materialize(
            jumped.select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")),
            "parents",
        )
        if parents.where("moved").isEmpty():
            return parents.select("node", "parent")
        parents = parents.select("node", "parent")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has a smaller node in its component;
    ``root`` is the component's smallest. ``edges`` has bigint ``u, v``.

    Every node points to its smallest neighbour (a map-side minimum, so a hub
    sends one row per task), pointers are followed to their ends, and what
    remains of the edges joins the ends. Edges are a table all the time."""

    def plain(pairs: DataFrame) -> DataFrame:
        low, high = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
        return materialize(pairs.where("u <> v").select(low, high).distinct(), "edges")

    edges, labels = plain(edges), None
    while not edges.isEmpty():
        parents = _jump(
            materialize(edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent")), "parents")
        )
        if labels is None:
            labels = parents
        else:
            next_root = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            moved = labels.join(next_root, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
            labels = materialize(moved.unionByName(parents), "labels")
        for end in ("u", "v"):
            root = parents.select(F.col("node").alias(end), F.col("parent").alias("above"))
            edges = edges.join(root, end, "left").withColumn(end, F.coalesce("above", end)).drop("above")
        edges = plain(edges)
    if labels is None:
        labels = edges.select(F.col("u").alias("node"), F.col("v").alias("parent"))
    return labels.select("node", F.col("parent").alias("root"))
