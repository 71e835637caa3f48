"""Uniform shuffle with exact shard sizes by a hypergeometric communication matrix.

Each row gets a number of its own from where it stands in its input partition, and falls into a source block by a keyed hash
of that number, so that equal rows are dealt to all blocks. The number of rows that block b sends to shard
s is drawn from the exact law of a uniform permutation: a matrix of hypergeometric draws
whose row sums are the block sizes and whose column sums are the shard sizes (at most one
apart). Each block is permuted locally, its first C[b][0] rows go to shard 0, the next
C[b][1] to shard 1, and so on; every shard is permuted again after the exchange, in slices. Blocks and slices grow in number with
the table, so that neither holds more than some ``GROUP`` rows. The only
thing on the driver is the matrix, blocks x shards numbers.

The numbered rows (without texts) are a table in the shared folder, so that the counts and the exchange see the same
numbers whatever is computed again.

Defined cases: null text has no bytes; null doc_id is a value like any other; repeated rows
are placed one by one; fewer rows than shards leave shards empty; an empty table gives an
empty result; further columns are ignored, whatever their names, unless named in ``carried``.
"""

from __future__ import annotations

import json
import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, carry, stored, text_of

SHARDS = 40
GROUP = 1 << 20
LEAST_BLOCKS = 256


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """An exact draw (inverse transform, searched outwards from the mode): marked items among ``draws``."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(log(good, mode) + log(bad, draws - mode) - log(good + bad, draws))
    left = right = mode
    p_left = p_right = p
    u = rng.random() - p
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return mode


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """C[b][s]: rows from block b to shard s, drawn so that all row and column sums hold exactly."""
    rng = random.Random(seed)
    room = list(shard_sizes)
    matrix = []
    for size in block_sizes:
        rest, left, row = sum(room), size, []
        for s, free in enumerate(room):
            rest -= free
            n = left if s == len(room) - 1 else hypergeometric(rng, free, rest, left)
            row.append(n)
            left -= n
        room = [a - b for a, b in zip(room, row)]
        matrix.append(row)
    return matrix


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = 7, carried: tuple[str, ...] = (), group: int = GROUP, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """Columns doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard), then ``carried``."""
    spark = docs.sparkSession
    text = F.coalesce(text_of(docs), F.lit(""))
    keep = ["doc_id", *carried]
    rows = carry(docs, keep, (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("crc"), F.monotonically_increasing_id().alias("number"))
    rows = stored(rows, "numbered")
    hashed = lambda salt, *of: F.xxhash64(F.lit(f"{seed}/{salt}"), *of)
    total = rows.count()
    blocks = max(least_blocks, -(-total // group))
    slices = max(1, -(-max(least_blocks, total // group) // shards))
    rows = rows.withColumn("block", F.pmod(hashed("block", "number"), F.lit(blocks)).cast("int"))

    counts = {r[0]: r[1] for r in rows.groupBy("block").count().collect()}  # at most ``blocks`` rows
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    cells = [list(accumulate(row)) for row in communication_matrix([counts.get(b, 0) for b in range(blocks)], targets, seed)]
    matrix = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(cells)), "array<array<bigint>>")).alias("block", "bounds"))

    local = Window.partitionBy("block").orderBy(hashed("local", "number"), "number")
    dealt = (
        rows.withColumn("rank", F.row_number().over(local))
        .join(F.broadcast(matrix), "block")  # ``blocks`` rows of ``shards`` numbers
        .withColumn("shard", F.size(F.filter("bounds", lambda b: b < F.col("rank"))).cast("int"))
        .withColumn("order", hashed("again", "number"))
        .withColumn("slice", F.pmod(F.shiftrightunsigned("order", 20), F.lit(slices)).cast("int"))
        .drop("bounds")
    )
    # The second permutation: slices of a shard in order, and the rows of a slice in the order of their hash.
    per_slice = dealt.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.select("shard", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "slice").orderBy("order", "number")
    placed = dealt.withColumn("inside", F.row_number().over(inside)).join(F.broadcast(starts), ["shard", "slice"])  # shards x slices rows at most
    own = [F.col("size"), F.col("crc").alias("text_crc32"), F.col("shard"), (F.col("start") + F.col("inside") - 1).cast("long").alias("slot")]
    return placed.select(F.col(KEPT).getField("doc_id").alias("doc_id"), *own, *(F.col(KEPT).getField(c).alias(c) for c in carried))
