"""SimHash near-duplicates with pigeonring filtering.

Fingerprints have 64 bits in a ring of four segments. If two of them differ in at most three
bits, there is a segment from which every chain of l consecutive segments differs in at most
floor(3 l / 4) bits: 0, 1, 2, 3. So candidates need one segment equal and its successor within
one bit; those two conditions are one 34-bit join key (the successor either equal, or with one
set bit cleared on the side that has it). The third budget and the full distance follow.

Only distinct fingerprints are joined, never their copies, and only true links leave the
join. Links are condensed to components by rounds of joins.

Defined cases: null and word-free texts have fingerprint zero, linked like any other; null
doc_id never is a component_id unless a whole component has no other; repeated rows
each get their row; texts of any length count whole; an empty table gives an empty result; further columns are
ignored or pass through, whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard_join
from .common import carry, give_back, map_batches, map_carried, named, settle, text_of, utf8
from .graph import components, few

SEED = 42
BITS = 3
NEAR = jaccard_join.Similarity(shingle=5, percent=80)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the text's word shingles."""
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        h = [hash64(b" ".join(w), SEED)]
    else:
        joined = b" ".join(w)
        at = [0, *accumulate(len(x) + 1 for x in w)]
        h = [hash64(joined[a : b - 1], SEED) for a, b in zip(at, at[shingle:])]
    ones = np.zeros(64, np.int64)
    values = np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for k in range(0, len(values), 16_384):
        ones += np.unpackbits(values[k : k + 16_384], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3) -> DataFrame:
    """The caller's columns ``keep`` as one, and fp (signed 64-bit fingerprint) and doc_id."""

    def make():
        return lambda batch: [pa.array([fingerprint(x, shingle) for x in utf8(batch.column("text"))], pa.int64()), batch.column("doc_id")]

    return map_carried(carry(docs, keep, text_of(docs), named("doc_id").cast("long").alias("doc_id")), "fp long, doc_id long", make)


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * (k % 4)).bitwiseAND(0xFFFF)


def _apart(a: Column, b: Column, k: int) -> Column:
    return F.bit_count(_segment(a.bitwiseXOR(b), k))


def link(distinct: DataFrame) -> DataFrame:
    """All pairs (a < b) of the fingerprints in column fp that differ in one to three bits."""
    fp = F.col("fp")
    exact, near = [], []
    for k in range(4):
        head = F.shiftleft(_segment(fp, k), 16).bitwiseOR(F.lit(k).cast("long") * (1 << 32))
        tail = _segment(fp, k + 1)
        exact.append(F.struct(F.lit(k).alias("k"), head.bitwiseOR(tail).alias("key")))
        for bit in range(16):
            has = tail.bitwiseAND(1 << bit) != 0
            near.append(F.when(has, F.struct(F.lit(k).alias("k"), head.bitwiseOR(tail.bitwiseAND(0xFFFF ^ (1 << bit))).alias("key"))))
    index = distinct.select(F.col("fp").alias("y"), F.explode(F.array(*exact)).alias("e")).select("y", "e.key")
    equal = distinct.select(F.col("fp").alias("x"), F.lit(False).alias("cleared"), F.explode(F.array(*exact)).alias("e"))
    cleared = distinct.select(F.col("fp").alias("x"), F.lit(True).alias("cleared"), F.explode(F.array_compact(F.array(*near))).alias("e"))
    probe = equal.unionAll(cleared).select("x", "cleared", "e.k", "e.key")
    x, y = F.col("x"), F.col("y")
    third = F.lit(False)
    for k in range(4):
        chain = _apart(x, y, k) + _apart(x, y, k + 1) + _apart(x, y, k + 2)
        third = F.when(F.col("k") == k, chain <= 2).otherwise(third)
    pairs = probe.join(index, (probe["key"] == index["key"]) & (F.col("cleared") | (x < y)) & third & (F.bit_count(x.bitwiseXOR(y)) <= BITS))
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def classes(fps: DataFrame) -> DataFrame:
    """(fp, component_id): for each distinct fingerprint the smallest doc_id of its component."""
    own = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(link(own.select("fp")))
    count = roots.count()
    linked = settle(own.join(few(roots.select(F.col("node").alias("fp"), "root"), count), "fp").select("fp", "root", "least_id"))
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    joined = linked.join(few(least, count), "root").select("fp", "component_id")
    return settle(own.join(few(joined, count), "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")))


def near_duplicates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``keep`` (doc_id), fingerprint (16 hex digits), component_id."""
    keep = keep or ["doc_id"]
    fps = settle(fingerprints(docs, keep))
    return give_back(fps.join(classes(fps), "fp"), keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component of fingerprints, as ``near_duplicates`` has them, the row with the smallest doc_id (rows that tie in doc_id: the least text hashes, then
    one of the equal rows; null ids come last). Columns as they come."""
    names, own, key = docs.columns, named("doc_id").cast("long"), ["id", "no_id", "t1", "t2"]
    ids = [F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("no_id"), *jaccard_join.text_hashes(docs)]

    def make():
        return lambda batch: pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), pa.array([fingerprint(x) for x in utf8(batch.column("text"))], pa.int64())], names=[*key, "fp"])

    fps = settle(map_batches(docs.select(*ids, text_of(docs)), "id long, no_id boolean, t1 long, t2 long, fp long", make))
    least = settle(fps.groupBy("fp").agg(F.min(F.struct("no_id", "id", "t1", "t2")).alias("one")))
    roots = components(link(least.select("fp")))
    found = least.join(few(roots.select(F.col("node").alias("fp"), "root"), roots.count()), "fp", "left")
    stay = settle(found.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("one").alias("one")).select(*(F.col("one").getField(c).alias(c) for c in key)))
    return give_back(carry(docs, names, *ids).join(stay, key, "left_semi").dropDuplicates(key), names)


def representatives(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each group of near copies (by ``jaccard_join``, not by fingerprints: five words, similarity 0.8; texts without
    words are one group) the row with the smallest doc_id (rows that tie in doc_id: the least text hashes, then one of the equal
    rows). Columns as they come; a group whose ids are all null keeps one row too."""
    names = docs.columns
    doc_id, none = F.col("doc_id"), F.col("doc_id").isNull()
    one = F.min_by(F.struct("doc_id", "t1", "t2"), F.struct(none, "doc_id", "t1", "t2"))
    stay = jaccard_join.classes(docs, NEAR).groupBy("root").agg(one.alias("one")).select("one.*")
    stay = settle(stay.select(F.coalesce(doc_id, F.lit(0)).alias("id"), none.alias("no_id"), "t1", "t2"))
    own = named("doc_id").cast("long")
    key = ["id", "no_id", "t1", "t2"]
    rows = carry(docs, names, F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("no_id"), *jaccard_join.text_hashes(docs))
    return give_back(rows.join(stay, key, "left_semi").dropDuplicates(key), names)
