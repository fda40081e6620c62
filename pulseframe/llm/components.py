"""Connected components by iterated joins: labels fall to the smallest neighbour's, then jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_table, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in `links` (a long, b long; loops allowed).

    Each round takes the smallest label of all neighbours and then the label of that label, so the
    rounds grow with the logarithm of a component's diameter. Nothing is collected; a node with many
    links costs partial aggregates.
    """
    links = links.select("a", "b").filter("a is not null and b is not null")
    edges = materialise(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        theirs = labels.select(F.col("node").alias("b"), F.col("label").alias("theirs"))
        best = edges.join(theirs, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("best"))
        stepped = labels.join(best, "node").select("node", F.least("label", "best").alias("low"), "label")
        stepped = materialise(stepped, "labels-step")
        jump = stepped.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        after = stepped.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("label"), (F.least("low", F.coalesce("lower", "low")) < F.col("label")).alias("moved"))
        after = materialise(after, "labels")
        more = after.filter("moved").limit(1).count()
        drop_table(stepped)
        drop_table(labels)
        labels = after.drop("moved")
        if not more:
            drop_table(edges)
            return labels.select("node", F.col("label").alias("component"))
