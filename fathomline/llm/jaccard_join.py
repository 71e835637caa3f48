"""Jaccard links of texts by their word n-grams, as a sparse matrix product in blocks.

The incidence matrix has a row for each distinct set of n-grams (shingles, of ``shingle`` words) and a column for each shingle. The product with its
transpose holds all overlaps; it is never formed whole:

* Columns have one global order, the rarer first. How frequent a shingle is tells a table of counters (``COUNTERS``, by hash) over all
  texts, so that a passage or a template that many texts share comes last. The order decides the work, never the result.
* Sets of sizes a and b with the similarity share at least p (a + b) / (100 + p) shingles, so each shares one of its first n - ceil(p n / 100) + 1
  columns with the other. Only these columns are multiplied first, and only their entries that stand in two rows or more.
* A pair is discarded as soon as bounds from the sizes say that it can't have the overlap: by the places of a shared
  shingle in both rows, and by the parities of the sets' hash classes (two sets differ in no fewer shingles than their parities in bits).
* What is left is multiplied exactly, in blocks: one row (the centre) by the others it is paired with, some ``BLOCK`` entries at once.

A large group of near copies doesn't become all its pairs: each column's rows are first multiplied with one row only, the one whose shingles are
shared most. Links so found are condensed to components, and then only rows of one column that are not in one component are paired.

Defined cases: a text of fewer words than a shingle has is one shingle; texts without words (null, empty) have an empty set, which is linked with
nothing here; a null doc_id never is a component_id unless a whole component has no other; rows that are repeated each get their row;
an empty table gives an empty result; texts of any length are taken whole; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, named, settle, stored, text_of, utf8
from .graph import components, few

COUNTERS = 1 << 18
PARITIES, MOST = 512, 18
BLOCK = 100_000
REMEMBERED = 200_000
# An odd multiplier, and the finalizer of the published splitmix64 generator.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


@dataclass(frozen=True)
class Similarity:
    """Sets of shingles of so many words are similar where 100 * intersection >= percent * union."""

    shingle: int = 3
    percent: int = 90

    def least(self, a, b):
        """The overlap that sets of sizes a and b must have; of numbers or whole arrays."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix(self, n: int) -> int:
        """Among how many of its first columns a set of n shares one with each similar set."""
        return n - -(-self.percent * n // 100) + 1 if n else 0


class _Numbers(dict):
    """Numbers of words in the order they were met; their hashes stand in ``table``."""

    def __init__(self):
        self.table = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros(n, np.uint64)])
        self.table[n] = xxhash.xxh3_64_intdigest(word)
        self[word] = n
        return n


class WordHashes:
    """64-bit hashes of words, remembered."""

    def __init__(self):
        self.numbers = _Numbers()

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.numbers) > REMEMBERED:
            self.numbers = _Numbers()
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        return self.numbers.table[at]


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ z >> np.uint64(30)) * np.uint64(FIRST)
    z = (z ^ z >> np.uint64(27)) * np.uint64(SECOND)
    return z ^ z >> np.uint64(31)


def every_shingle(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """The shingle hashes of a text in its order, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = hashes.of(words)
    size = min(size, len(h))
    count = len(h) - size + 1
    acc = h[:count]
    for k in range(1, size):
        acc = acc * np.uint64(STEP) + h[k : k + count]
    return _mixed(acc).view(np.int64)


def shingles(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    found = np.sort(every_shingle(text, size, hashes))
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def parities(found: np.ndarray, classes: int) -> np.ndarray:
    """The parities of the set's shingles in so many hash classes, as packed bits."""
    return np.packbits((np.bincount(found & (classes - 1), minlength=classes) & 1).astype(np.uint8), bitorder="little")


def apart(p: np.ndarray, q: np.ndarray) -> int:
    """In how many parities two sets differ; the longer one is folded to the length of the shorter."""
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _levels(docs: DataFrame, rule: Similarity) -> np.ndarray:
    """How frequent the shingles of each hash class are over all texts: 0 up to twice the mean, and one more for each doubling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashes = np.zeros(COUNTERS, np.int64), WordHashes()
        for batch in batches:
            found = [every_shingle(text, rule.shingle, hashes) & (COUNTERS - 1) for text in utf8(batch.column("text"))]
            counts += np.bincount(np.concatenate([*found, np.zeros(0, np.int64)]), minlength=COUNTERS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["class", "n"])

    counted = docs.select(text_of(docs)).mapInArrow(run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # at most ``COUNTERS`` rows of two numbers
    n = np.zeros(COUNTERS)
    n[rows["class"].to_numpy()] = rows["n"].to_numpy()
    return np.floor(np.log2(np.maximum(n / max(n.mean(), 1), 1))).astype(np.uint8)


SETS = "doc_id long, t1 long, t2 long, key binary, size int, parity array<long>, sketch binary, firsts array<long>"


def sets(docs: DataFrame, rule: Similarity) -> DataFrame:
    """A row of each row of ``docs``: doc_id, two hashes of the text, key (128 bits of the set) and size; once a task for each key, parity (``PARITIES`` classes), sketch (as many classes as the set is large) and firsts."""
    shared = docs.sparkSession.sparkContext.broadcast(_levels(docs, rule))
    names = [x.split()[0] for x in SETS.split(", ")]

    def make():
        import xxhash

        levels, hashes = shared.value, WordHashes()
        seen: set[bytes] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in utf8(batch.column("text")):
                found = shingles(text, rule.shingle, hashes)
                key = xxhash.xxh3_128_digest(found.tobytes())
                if len(seen) > REMEMBERED:
                    seen.clear()
                if key in seen or not len(found):
                    rows.append((key, len(found), None, None, None))
                else:
                    order = np.argsort(levels[found & (COUNTERS - 1)], kind="stable")
                    fit = 1 << min(MOST, max(PARITIES, len(found)).bit_length())
                    rows.append((key, len(found), parities(found, PARITIES).view(np.int64), parities(found, fit).tobytes(), found[order[: rule.prefix(len(found))]]))
                seen.add(key)
            kinds = [pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], names=names)

        return step

    rows = docs.select(named("doc_id").cast("long").alias("doc_id"), *text_hashes(docs), text_of(docs))
    return stored(map_batches(rows, SETS, make), "sets")


def text_hashes(docs: DataFrame) -> list[Column]:
    text = named("text").cast("string")
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def _may_reach(x: str, y: str, rule: Similarity) -> Column:
    """Whether two rows with a shingle in common can have the overlap, by their sizes and its places in them."""
    a, b, i, j = F.col(f"{x}.size"), F.col(f"{y}.size"), F.col(f"{x}.at"), F.col(f"{y}.at")
    most = F.least(i, j) + 1 + F.least(a - i - 1, b - j - 1)
    return (100 + rule.percent) * most.cast("long") >= rule.percent * (a + b).cast("long")


def _may_differ(a: Column, b: Column, p: Column, q: Column, rule: Similarity) -> Column:
    """Whether sets of sizes a and b with the parities p and q may have the overlap: they differ in a + b - 2 overlap shingles at most."""
    differ = sum((F.bit_count(F.get(p, F.lit(k)).bitwiseXOR(F.get(q, F.lit(k)))) for k in range(1, PARITIES // 64)), F.bit_count(F.get(p, F.lit(0)).bitwiseXOR(F.get(q, F.lit(0)))))
    return (100 + rule.percent) * differ.cast("long") <= (100 - rule.percent) * (a + b).cast("long")


def _likely(pairs: DataFrame, nodes: DataFrame, rule: Similarity) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity, with size_a."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b, p, q = (batch.column(c).to_pylist() for c in ("size_a", "size_b", "p", "q"))
            may = [(100 + rule.percent) * apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= (100 - rule.percent) * (m + n) for m, n, x, y in zip(a, b, p, q)]
            return batch.filter(pa.array(may, pa.bool_())).select(["a", "b", "size_a"])

        return step

    side = lambda k, s: nodes.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("sketch").alias(s))
    return settle(map_batches(pairs.select("a", "b").join(side("a", "p"), "a").join(side("b", "q"), "b"), "a long, b long, size_a int", make))


def _product(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, rule: Similarity) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets have the similarity, by blocks: the texts that are paired with b, and b's."""

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = [], []
            for centre, rows in zip(batch.column("b").to_pylist(), batch.column("rows")):
                rows = rows.values
                others, texts = rows.field("a").to_pylist(), utf8(rows.field("text"))
                own = shingles(texts.pop(others.index(None)), rule.shingle, hashes)
                others.remove(None)
                for node, text in zip(others, texts):
                    found = shingles(text, rule.shingle, hashes)
                    if len(np.intersect1d(own, found, assume_unique=True)) >= rule.least(len(own), len(found)):
                        a.append(node)
                        b.append(centre)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        return step

    pairs = _likely(pairs, nodes, rule)
    block = F.struct("b", "salt")
    loads = pairs.groupBy("b").agg((1 + F.floor(F.sum("size_a") / BLOCK)).alias("salts"))
    dealt = settle(pairs.join(loads, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt")))
    rows = dealt.select(F.col("a").alias("node"), "a", "b", "salt").unionAll(dealt.select("b", "salt").distinct().select(F.col("b").alias("node"), F.lit(None).cast("long"), "b", "salt"))
    rows = settle(rows.join(nodes.select("node", "t1", "t2"), "node").select("a", block.alias("block"), "t1", "t2"))
    wanted = settle(rows.select("t1", "t2").distinct())
    texts = docs.select(*text_hashes(docs), text_of(docs)).join(few(wanted, wanted.count()), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    blocks = rows.join(texts, ["t1", "t2"]).groupBy("block").agg(F.collect_list(F.struct("a", "text")).alias("rows"))
    return settle(map_batches(blocks.select("block.b", "rows"), "a long, b long", make))


def _nodes(found: DataFrame) -> DataFrame:
    """A numbered row of each distinct set."""
    return stored(found.filter("parity is not null").dropDuplicates(["key"]).drop("doc_id").withColumn("node", F.monotonically_increasing_id()), "nodes")


def links(docs: DataFrame, nodes: DataFrame, rule: Similarity) -> DataFrame:
    """Links (a, b) of nodes whose components are those of all similar pairs."""
    each = nodes.select("node", "size", F.posexplode("firsts").alias("at", "s"))
    shared = each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = stored(each.join(shared, "s"), "entries")
    parity = nodes.select("node", "size", "parity")

    def side(name: str, p: str) -> DataFrame:
        return parity.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col("parity").alias(p))

    # Of each column one row is the centre; each row is multiplied with the weightiest of its columns' centres that it may be similar to.
    weight = entries.groupBy("node").agg((F.sum("n") / F.max("size")).alias("weight"))
    centre = entries.join(weight, "node").groupBy("s").agg(F.max(F.struct("weight", "node", "size", "at")).alias("y"))
    near = entries.alias("x").join(centre, "s").filter((F.col("x.node") != F.col("y.node")) & _may_reach("x", "y", rule))
    near = near.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.max("y.weight").alias("weight"))
    near = near.join(side("a", "p"), "a").join(side("b", "q"), "b").filter(_may_differ(F.col("size_a"), F.col("size_b"), F.col("p"), F.col("q"), rule))
    near = settle(near.groupBy("a").agg(F.max_by("b", F.struct("weight", "b")).alias("b")))
    first = _product(near, docs, nodes, rule)

    # Then those rows of one column that are still apart.
    root = components(first)
    placed = stored(entries.join(root, "node", "left").select("s", "node", "size", "at", F.coalesce("root", "node").alias("root")), "placed")
    several = placed.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("s")
    left = stored(placed.join(several, "s", "left_semi").join(parity.select("node", "parity"), "node"), "left")
    x, y = left.alias("x"), left.alias("y")
    still = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _may_reach("x", "y", rule)
    still = still & _may_differ(F.col("x.size"), F.col("y.size"), F.col("x.parity"), F.col("y.parity"), rule)
    other = x.join(y, (F.col("x.s") == F.col("y.s")) & still).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    tried = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = _product(settle(other.join(tried, ["a", "b"], "left_anti")), docs, nodes, rule)
    discard(entries, placed, left)
    return first.union(second)


def classes(docs: DataFrame, rule: Similarity = Similarity()) -> DataFrame:
    """(doc_id, t1, t2, size, root) of each row: rows of one root are linked, directly or by others between them; empty sets have root null."""
    found = sets(docs, rule)
    nodes = _nodes(found)
    root = components(links(docs, nodes, rule))
    roots = nodes.select("key", "node").join(root, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    out = settle(found.select("doc_id", "t1", "t2", "size", "key").join(roots, "key", "left").drop("key"))
    discard(found, nodes)
    return out


def join(docs: DataFrame, rule: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to, its own included) of each row."""
    rows = classes(docs, rule)
    least = settle(rows.groupBy("root").agg(F.min("doc_id").alias("least")))  # both sides are plain tables, so that a hot root can be split
    component = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return rows.join(least, "root", "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"))
