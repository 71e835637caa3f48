"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, store

FEW = 200_000


def _small(links: DataFrame) -> DataFrame:
    """(root, parent) of all ends of a bounded table of links, in one task: parent is the smallest id of the component."""
    kind = links.schema["a"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
            ids = batch.schema.field("a").type
        if parent:
            roots = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(roots, ids), pa.array([find(x) for x in roots], ids)], names=["root", "parent"])

    return links.coalesce(1).mapInArrow(run, f"root {kind.simpleString()}, parent {kind.simpleString()}")


def _jump(up: DataFrame) -> DataFrame:
    above = up.select(F.col("root").alias("parent"), F.col("parent").alias("top"))
    return up.join(above, "parent", "left").select("root", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("moved"))


def components(links: DataFrame, few: int = FEW) -> tuple[DataFrame, int]:
    """(id, root) of every id in ``links`` (a, b), where root is the smallest id that links lead to; and the number of rounds.

    A round hooks each root that stands beside a smaller one below the smallest such, and then replaces every root by its own root by doubling steps; links
    within a tree are dropped. So a chain needs rounds as its length's logarithm. Once at most ``few`` links between roots are left, one task ends the work.
    Labels and links are stored tables; all joins are between two shuffled sides, so that a hot root can be split.
    """
    ends = links.select("a", "b").filter("a <> b")
    rest = store(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = store(rest.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")), "labels")
    rounds, left = 0, rest.count()
    while left:
        rounds += 1
        last = left <= few
        up = store(_small(rest) if last else rest.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("parent")), "up")
        moving = not last
        while moving:
            jumped = store(_jump(_jump(up).drop("moved")), "up")
            moving = not jumped.filter("moved").isEmpty()
            discard(up)
            up = jumped.select("root", "parent")
        relabelled = store(labels.join(up, "root", "left").select("id", F.coalesce("parent", "root").alias("root")), "labels")
        discard(labels)
        labels, left = relabelled, 0
        if not last:
            ahead = rest
            for end in ("a", "b"):
                ahead = ahead.join(up.select(F.col("root").alias(end), F.col("parent").alias("new")), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
            ahead = store(ahead.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
            discard(rest)
            rest, left = ahead, ahead.count()
        discard(up)
    discard(rest)
    return labels, rounds
