"""Importance resampling towards a target distribution of n-grams, by a dictionary of distinct features.

Documents are counted in blocks: a block is one row with its distinct n-gram strings, once each, and its
documents' counts as a sparse matrix (numbers of the block's strings, and how often). The strings of all blocks
are counted globally; each distinct string is hashed once, to a bucket; the buckets' totals over the documents and over the
target give a gain a bucket, and with it each string's. The gains are joined back to the blocks' strings, gathered
by block, and every document's counts meet their gains there. So a frequent word is joined once a block, not once a document.

Documents with enough words are drawn by Gumbel scores: the mean gain of a document's features plus noise from a keyed
hash of doc_id. The highest scores are ranked by ranges, of which only the counts meet in one place.

Defined cases: null, empty and word-free texts have no features and weight 0; a null doc_id is hashed like an empty one and
comes last among equal scores; rows that are repeated each get their row, and ties of score and doc_id an order of their own; an
empty target has no counts (every t is 0); an empty table gives an empty result; texts of any length are taken whole; further
columns are ignored or pass through, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import KEPT, carry, discard, give_back, map_batches, named, settle, stored, text_of, utf8
from .decontaminate import words

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024


def ngrams(found: list[bytes], shortest: int, longest: int) -> Counter:
    """How often each run of ``shortest`` to ``longest`` words occurs, joined by a space."""
    out: Counter = Counter()
    for n in range(shortest, longest + 1):
        out.update(found if n == 1 else map(b" ".join, zip(*(found[k:] for k in range(n)))))
    return out


# Of a block: its strings with their totals, its documents' words and numbers of distinct features, and these, document by document, packed.
MATRIX = "strings array<string>, totals array<bigint>, n_words array<bigint>, sizes array<bigint>, matrix binary"


def pack(sizes: np.ndarray, places: np.ndarray, counts: np.ndarray) -> bytes:
    """The places of each document's features, ascending, as steps, and their counts: 32-bit numbers, the lowest bytes of all first, compressed."""
    order = np.lexsort((places, np.repeat(np.arange(len(sizes)), sizes)))
    places, counts = places[order], counts[order]
    steps = np.diff(places, prepend=0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[first] = places[first]
    return zstandard.compress(b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (steps, counts)), 3)


def unpack(sizes: np.ndarray, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts as ``pack`` had them, each document's in ascending order of places."""
    both = np.frombuffer(zstandard.decompress(packed), np.uint8)
    steps, counts = (np.ascontiguousarray(x.reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for x in np.split(both, 2))
    ends = np.cumsum(sizes)
    run = np.concatenate([[0], np.cumsum(steps)])
    return run[1:] - np.repeat(run[ends - sizes], sizes), counts


def blocks(docs: DataFrame, keep: list[str], shortest: int, longest: int) -> DataFrame:
    """Rows (block, ``KEPT``: the documents' structs, and ``MATRIX``), one for each slice of documents, as a stored table."""
    rows = carry(docs, keep, F.monotonically_increasing_id().alias("block"), text_of(docs))
    kept = ArrayType(rows.schema[KEPT].dataType)
    fields = StructType.fromDDL(MATRIX).fields
    schema = StructType([StructField("block", LongType()), StructField(KEPT, kept), *fields])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            numbers: dict[bytes, int] = {}
            n_words, sizes, places, counts = [], [], [], []
            for text in utf8(batch.column("text")):
                found = words(text)
                own = ngrams(found, shortest, longest)
                n_words.append(len(found))
                sizes.append(len(own))
                places += [numbers.setdefault(x, len(numbers)) for x in own]
                counts += own.values()
            totals = np.zeros(len(numbers), np.int64)
            np.add.at(totals, places, counts)
            held = batch.column(KEPT)
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            columns = [batch.column("block")[:1], pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), pa.array([list(numbers)], pa.list_(pa.binary())).cast(pa.list_(pa.string()))]
            packed = pack(np.array(sizes, np.int64), np.array(places, np.int64), np.array(counts, np.int64))
            columns += [one(totals, pa.int64()), one(n_words, pa.int64()), one(sizes, pa.int64()), pa.array([packed], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

        return step

    return stored(map_batches(rows, schema, make), "blocks")


def _counted(found: DataFrame, name: str, other: str) -> DataFrame:
    pairs = found.select(F.explode(F.arrays_zip("strings", "totals")).alias("x"))
    return pairs.select(F.col("x.strings").alias("string"), F.col("x.totals").alias(name), F.lit(0).cast("long").alias(other))


def dictionary(found: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(string, gain) of each distinct string of the blocks ``found``: a bucket's gain is a thousand times the logarithm of how much likelier it is in the target."""
    strings = _counted(found, "s", "t").unionAll(_counted(target, "t", "s").select("string", "s", "t")).groupBy("string").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    hashed = stored(strings.select("string", "s", "t", F.pmod(F.crc32(F.encode("string", "utf-8")), F.lit(buckets)).cast("int").alias("bucket")), "strings")
    by_bucket = settle(hashed.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))  # at most ``buckets`` rows
    all_s, all_t = (int(x or 0) for x in by_bucket.agg(F.sum("s"), F.sum("t")).first())
    d = lambda name: F.col(name).cast("double") + 1.0
    ratio = d("t") * F.lit(float(all_s + buckets)) / (d("s") * F.lit(float(all_t + buckets)))
    gains = by_bucket.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))
    return hashed.filter("s > 0").select("string", "bucket").join(F.broadcast(gains), "bucket").select("string", "gain")


def _weights(found: DataFrame, gains: DataFrame) -> DataFrame:
    """``KEPT``, n_words, n_features and weight of each document: the mean gain of its features, rounded down."""
    strings = found.select("block", F.posexplode("strings").alias("at", "string"))
    valued = strings.join(gains, "string").select("block", F.struct("at", "gain").alias("x"))
    by_block = valued.groupBy("block").agg(F.collect_list("x").alias("gains"))  # as many as a block has strings
    rows = found.select("block", KEPT, "n_words", "sizes", "matrix").join(by_block, "block", "left")
    schema = StructType([StructField(KEPT, found.schema[KEPT].dataType.elementType), *StructType.fromDDL("n_words long, n_features long, weight long").fields])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list[np.ndarray]] = [[], [], []]
            for k in range(batch.num_rows):
                n_words, sizes = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("n_words", "sizes"))
                places, counts = unpack(sizes, batch.column("matrix")[k].as_py())
                gains = np.zeros(len(places) and int(places.max()) + 1, np.int64)
                if len(gains):
                    pairs = batch.column("gains")[k].values
                    gains[pairs.field("at").to_numpy()] = pairs.field("gain").to_numpy()
                ends = np.cumsum(sizes)
                total, n = (np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]) for x in (gains[places] * counts, counts))
                for column, values in zip(columns, (n_words, n, np.where(n > 0, total // np.maximum(n, 1), 0))):
                    column.append(values)
            arrays = [pa.array(np.concatenate(c), pa.int64()) for c in columns]
            return pa.RecordBatch.from_arrays([batch.column(KEPT).flatten(), *arrays], names=[f.name for f in schema])

        return step

    return map_batches(rows, schema, make)


def noise(doc_id: Column, seed: int) -> Column:
    """A thousandfold Gumbel variate from a hash of the seed and doc_id, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u)))


def resample(docs: DataFrame, target: DataFrame, keep: list[str] | None = None, percent: int = PERCENT, ngram: tuple[int, int] = (1, 1), buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Columns ``keep`` (doc_id), then n_features, weight, score and rank: 1, 2, 3... by falling score (ties: rising doc_id) for the ``percent`` in a hundred drawn of the
    documents with ``least_words`` words, null for all others."""
    keep = keep or ["doc_id"]
    held = docs.select(F.struct(*(named(c).alias(c) for c in keep)).alias(KEPT), named("doc_id").cast("long").alias("doc_id"), text_of(docs))
    found = blocks(held, [KEPT, "doc_id"], *ngram)
    wanted = blocks(target.select(F.lit(True).alias("wanted"), text_of(target)), ["wanted"], *ngram)
    gains = dictionary(found, wanted, buckets)
    weighed = _weights(found, gains)
    score = F.col("weight") + noise(F.col(f"{KEPT}.doc_id"), seed)
    rows = weighed.select(F.col(f"{KEPT}.{KEPT}").alias(KEPT), F.col(f"{KEPT}.doc_id").alias("doc_id"), "n_words", "n_features", "weight", score.alias("score"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "scores")
    can = F.col("n_words") >= least_words
    drawn = rows.filter(can).count() * percent // 100
    ranked = _ranked(rows.filter(can).select("row", "doc_id", "score"), drawn)
    out = settle(rows.join(ranked, "row", "left").select(KEPT, "n_features", "weight", "score", "rank"))
    discard(found, wanted, rows, gains)
    return give_back(out, keep, "n_features", "weight", "score", "rank")


def _ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """(row, rank) of the ``drawn`` highest scores: sorted by ranges, whose counts give each range's first rank."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("place", F.monotonically_increasing_id())
    placed = placed.select("row", F.shiftright("place", 33).alias("range"), F.col("place").bitwiseAND((1 << 33) - 1).alias("inside"))
    counts = placed.groupBy("range").count()  # as many rows as ranges
    before = counts.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    rank = F.col("before") + F.col("inside") + 1
    return placed.join(F.broadcast(before), "range").select("row", rank.alias("rank")).filter(F.col("rank") <= drawn)


def draw(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn documents, all columns as they come."""
    drawn = resample(docs.select(F.struct(*(named(c).alias(c) for c in docs.columns)).alias(KEPT), named("doc_id").alias("doc_id"), text_of(docs)), target, [KEPT], **settings)
    return give_back(drawn.filter("rank is not null"), docs.columns)
