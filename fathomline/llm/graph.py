"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


FEW = 500_000


def few(df: DataFrame, count: int) -> DataFrame:
    """A side of a join that is sent to all tasks if it has at most ``FEW`` narrow rows; beyond, both sides are shuffled and AQE can split a hot key."""
    return F.broadcast(df) if count <= FEW else df


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Each round takes the least label among the neighbours and then jumps to the label's own
    label, so the rounds grow with the logarithm of a chain. Links and labels are checkpointed tables.
    """
    both = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    count = labels.count()
    while True:
        near = both.join(few(labels.select(F.col("node").alias("b"), "root"), count), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        moved = settle(near.join(few(labels, count), "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("up")))
        target = moved.select(F.col("node").alias("up"), F.col("up").alias("root"))
        jumped = settle(moved.join(few(target, count), "up").select("node", "old", "root"))
        labels = jumped.select("node", "root")
        if jumped.filter("old <> root").isEmpty():
            return labels
