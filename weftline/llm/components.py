"""Connected components of a graph whose edges are rows, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the least node of its component.

    Each round takes the least label among a node and its neighbours, then the label of that label, and is written to
    the shared folder; rounds end when no label changes. Labels meet in aggregates that combine before the shuffle and
    in joins that can be split, so a node with very many neighbours does not load one task."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.filter("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        above = labels.select(F.col("node").alias("up"), F.col("comp").alias("top"))
        jumped = hooked.join(above, F.col("comp") == F.col("up"), "left").select("node", "old", F.least("comp", F.coalesce("top", "comp")).alias("comp"))
        jumped = materialize(jumped, "labels")
        labels = jumped.select("node", "comp")
        if jumped.filter("old <> comp").isEmpty():
            return labels
