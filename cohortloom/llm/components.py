"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortloom.storage import discard, materialize


def components(links: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``node`` and ``component`` (its least reachable node) of every node with a link.

    Each round takes the least label among a node's neighbours, then the label
    of that label; rounds are written, and end when nothing changed.
    """
    edges = materialize(
        links.select(F.col(x).alias("a"), F.col(y).alias("b"))
        .unionByName(links.select(F.col(y).alias("a"), F.col(x).alias("b"))).distinct(), "edges")
    labels = materialize(
        edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels.withColumnsRenamed({"node": "b", "component": "_l"}), "b").groupBy("a").agg(F.min("_l").alias("_l"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "component", F.least("component", "_l").alias("_new"))
        top = labels.withColumnsRenamed({"node": "_new", "component": "_top"})
        moved = materialize(
            lower.join(top, "_new").select(
                "node", F.least("_new", "_top").alias("component"), (F.least("_new", "_top") < F.col("component")).alias("changed")),
            "labels")
        discard(labels)
        labels = moved.select("node", "component")
        if not moved.where("changed").limit(1).count():
            discard(edges)
            return labels
