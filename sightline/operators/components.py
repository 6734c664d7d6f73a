"""Connected components of an edge table, by labels that flow to the smallest id, never leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.runtime import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, label): each endpoint of edges (a long, b long) with the smallest id of its component.

    A round takes the smallest label among neighbours and then the label's own label, so chains shorten by more than
    half each round; every round is a table in the shared folder. Loops and repeated edges are harmless.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("l"))
        root = labels.select(F.col("id").alias("l"), F.col("label").alias("up"))
        new = materialize(step.join(root, "l").select("id", "old", F.least("l", "up").alias("label")), "labels")
        changed = not new.filter("label <> old").isEmpty()
        discard(labels)
        labels = new.select("id", "label")
        if not changed:
            discard(both)
            return labels
