"""Line deduplication over a suffix array of line-ID sequences, by distributed prefix doubling.

The corpus is one sequence of line IDs, documents in doc_id order with breaks between them. The
suffixes are sorted by their first 2^j lines, depth after depth: at depth 2^(j+1) by the pairs of ranks
that a suffix and the one 2^j lines on have at depth 2^j, and by place where these agree. A suffix's rank is
the number in that order of the first suffix that shares its first 2^j lines, so a rank names
a longest-common-prefix interval, whose first suffix is its earliest copy. Suffixes alone in their interval
leave the table: what is unique ends every repeat.

From the deepest ranks down, each suffix then gets the longest common prefix that it has with any
earlier suffix, by adding 2^j lines wherever it isn't the first of the smaller interval that these make. If
that prefix has ``min_words`` words or more, it is a repeated run whose earlier copy stays, and
its lines are deleted; for all suffixes of a run together these are the lines of the maximal run.

Every sort ends with the place, so that a line that is very frequent is dealt to several tasks; what
an interval's parts need of each other are the first and last rows of the sorted partitions.

Defined cases: a text is split at "\\n"; null text has no lines and stays null; null doc_id comes
last in the order; rows that agree in doc_id and text are one document, treated alike; rows that agree in doc_id only are
ordered by the hash of the text; a run
that repeats inside one document loses its later copies too; blank lines belong to runs but
have no words; documents that lose every line are dropped by ``deduplicate``, kept with an
empty text by ``report``; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, carry, discard, give_back, map_batches, named, settle, stored, text_of

MIN_WORDS = 50
KEY = ["d", "t1", "t2"]
PLACE = ["doc", "pos"]
LAST = (1 << 63) - 1
SEEN = 1 << 18


def windows(counts: list[int], least: int) -> tuple[list[int], list[int]]:
    """For each line the number of lines of the shortest window with ``least`` words that begins there, and that ends there; 0: none."""
    n = len(counts)
    total = [0, *accumulate(counts)]
    ahead, back = [0] * n, [0] * n
    end = 0
    for i in range(n):
        end = max(end, i)
        while end < n and total[end + 1] - total[i] < least:
            end += 1
        if end == n:
            break
        ahead[i] = end - i + 1
    begin = n - 1
    for i in range(n - 1, -1, -1):
        begin = min(begin, i)
        while begin >= 0 and total[i + 1] - total[begin] < least:
            begin -= 1
        if begin < 0:
            break
        back[i] = i - begin + 1
    return ahead, back


def _key(docs: DataFrame) -> list:
    text = named("text").cast("string")
    number = named("doc_id").cast("long")
    hashed = F.xxhash64(text)
    # Null comes last: it shares LAST with the largest number, so there the hash's sign tells them apart.
    first = F.when(number.isNull(), hashed.bitwiseAND(LAST)).when(number == LAST, hashed.bitwiseOR(-LAST - 1)).otherwise(hashed)
    return [F.coalesce(number, F.lit(LAST)).alias("d"), first.alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line: the document's number in the order and its key, pos, ahead (lines of the shortest
    window of ``min_words`` words from there, 0: none), span (the longer one of the windows from and to there), and the line's 128-bit hash."""
    import xxhash

    hash128 = xxhash.xxh3_128_intdigest
    columns = [*KEY, "pos", "ahead", "span", "h1", "h2"]

    def split():
        seen: set = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            take, pos, ahead, span, h1, h2 = [], [], [], [], [], []
            keys = zip(*(batch.column(c).to_pylist() for c in KEY))
            for k, (key, text) in enumerate(zip(keys, batch.column("text").cast(pa.binary()).to_pylist())):
                if key in seen:  # a repeated row: one document
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                lines = text.split(b"\n")
                a, b = windows([len(x.split()) for x in lines], min_words)
                take += [k] * len(lines)
                pos += range(len(lines))
                ahead += a
                span += map(max, a, b)
                for x in lines:
                    h = hash128(x)
                    h1.append((h >> 64) - (1 << 63))
                    h2.append((h & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
            own = [batch.column(c).take(pa.array(take, pa.int32())) for c in KEY]
            rest = [pa.array(x, t) for x, t in ((pos, pa.int32()), (ahead, pa.int32()), (span, pa.int32()), (h1, pa.int64()), (h2, pa.int64()))]
            return pa.RecordBatch.from_arrays([*own, *rest], names=columns)

        return step

    def number():
        last, count = None, -1

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal last, count
            keys = np.stack([batch.column(c).to_numpy() for c in (*KEY, "pos")])
            before = np.concatenate([keys[:, :1] if last is None else last, keys[:, :-1]], 1)
            same = (keys == before).all(0)
            new = (keys[:-1] != before[:-1]).any(0)
            if last is None:
                same[0], new[0] = False, True
            docs = count + np.cumsum(new)
            last, count = keys[:, -1:], int(docs[-1])
            rows = pa.RecordBatch.from_arrays([pa.array((batch.column("part").to_numpy().astype(np.int64) << 33) + docs), *(batch.column(c) for c in columns)], names=["doc", *columns])
            return rows.filter(pa.array(~same))

        return step

    rows = docs.select(*_key(docs), text_of(docs)).filter("text is not null")
    lines = map_batches(rows, "d long, t1 long, t2 long, pos int, ahead int, span int, h1 long, h2 long", split)
    ordered = lines.repartitionByRange(*KEY).sortWithinPartitions(*KEY, "pos").withColumn("part", F.spark_partition_id())
    return stored(map_batches(ordered, "doc long, d long, t1 long, t2 long, pos int, ahead int, span int, h1 long, h2 long", number), "lines")


def _ends(by: list[str]):
    """Of each sorted partition one row: its number, its first and last keys, and where the last key begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, begin, n = None, None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in by])
            if first is None:
                part, first = batch.column("part")[0].as_py(), keys[:, 0]
            differ = (keys != keys[:, -1:]).any(0)
            if differ.any():
                begin = n + int(np.flatnonzero(differ)[-1]) + 1
            elif last is not None and (last != keys[:, -1]).any():
                begin = n
            last, n = keys[:, -1], n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first.tolist()], pa.list_(pa.int64())), pa.array([last.tolist()], pa.list_(pa.int64())), pa.array([begin], pa.int64())], names=["part", "first", "last", "begin"])

    return run


def intervals(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows that agree with another one in ``by`` (long columns), sorted by it and their place, with ``rank`` (the number, in that order, of the first
    row of the interval, increasing but not dense) and ``later`` (there is an earlier one)."""
    ordered = settle(rows.orderBy(*by, *PLACE)).withColumn("part", F.spark_partition_id())
    found = ordered.select("part", *by).mapInArrow(_ends(by), "part int, first array<long>, last array<long>, begin long").collect()  # a row of each partition
    found.sort()
    joins: dict[int, tuple[int, bool]] = {}  # the rank that goes on from the partition before, and whether the last one goes on
    rank = -1
    for k, x in enumerate(found):
        into = rank if k and found[k - 1].last == x.first else -1
        joins[x.part] = (into, k + 1 < len(found) and found[k + 1].first == x.last)
        rank = into if into >= 0 and not x.begin else (x.part << 33) + x.begin
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last, rank = None, 0, None, -1

        def ranked(batch: pa.RecordBatch, after: np.ndarray | bool) -> pa.RecordBatch:
            nonlocal n, last, rank
            keys = np.stack([batch.column(c).to_numpy() for c in by])
            part = batch.column("part")[0].as_py()
            into, on = joins[part]
            same = np.empty(batch.num_rows + 1, bool)
            same[1:-1] = (keys[:, 1:] == keys[:, :-1]).all(0)
            same[0] = into >= 0 if last is None else (keys[:, 0] == last).all()
            same[-1] = on if after is True else (keys[:, -1] == after).all()
            if last is None:
                rank = into
            begins = np.where(same[:-1], -1, (part << 33) + n + np.arange(batch.num_rows))
            ranks = np.maximum.accumulate(np.concatenate([[rank], begins]))[1:]
            n, last, rank = n + batch.num_rows, keys[:, -1], int(ranks[-1])
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ranks), pa.array(same[:-1])], names=[*names, "rank", "later"])
            return out.filter(pa.array(same[:-1] | same[1:]))

        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield ranked(held, np.array([batch.column(c)[0].as_py() for c in by]))
                held = batch
        if held is not None:
            yield ranked(held, True)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ordered.mapInArrow(run, f"{kinds}, rank long, later boolean")


def rank_levels(lines: DataFrame) -> list[DataFrame]:
    """The tables (doc, pos, rank) at depths 1, 2, 4, ... of the suffixes whose first lines of that number occur
    twice, as deep as windows go."""
    first = settle(intervals(lines.select(*PLACE, "span", "h1", "h2"), ["h1", "h2"]).select(*PLACE, "span", "rank"))
    longest = first.agg(F.max("span")).first()[0] or 0
    levels = [first.select(*PLACE, "rank")] if longest else []
    while levels and 1 << len(levels) <= longest:
        ranks, size = levels[-1], 1 << len(levels) - 1
        after = ranks.select("doc", (F.col("pos") - size).alias("pos"), F.col("rank").alias("r2"))
        pairs = ranks.withColumnRenamed("rank", "r1").join(after, PLACE)
        deeper = settle(intervals(pairs, ["r1", "r2"]).select(*PLACE, "rank"))
        if deeper.isEmpty():
            break
        levels.append(deeper)
    return levels


def earlier_prefixes(lines: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(doc, pos, ahead, m): for each suffix with a window, the length m of the longest prefix that an earlier one has too
    (as far as windows go); rows of which it is known to be shorter than the window may be left out."""
    # ``own`` rows are the suffixes; the others stand for an interval's first suffix, which others of it are compared with.
    state = levels[0].join(lines.filter("ahead > 0").select(*PLACE, "ahead"), PLACE)
    state = settle(state.select(*PLACE, "ahead", F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("class"), F.lit(True).alias("own")))
    for level in range(len(levels) - 1, -1, -1):
        size = 1 << level
        there = levels[level].select("doc", F.col("pos").cast("long").alias("at"), F.col("rank").alias("r"))
        reached = settle(state.withColumn("at", F.col("pos") + F.col("m")).join(there, ["doc", "at"], "left").drop("at"))
        # A unique beginning of no more lines than the window has: neither this suffix nor one that is compared with it has a run here.
        alone = F.col("r").isNull() & (F.col("m") == 0) & (F.col("ahead") >= size)
        going = intervals(reached.filter("r is not null"), ["m", "class", "r"])
        going = settle(going.select(*PLACE, "ahead", "m", "class", "own", "rank", "later"))
        longer = (F.col("m") + size).alias("m")
        rank = F.col("rank").alias("class")
        grown = going.filter("own and later").select(*PLACE, "ahead", longer, rank, "own")
        first = going.filter("not later").select(*PLACE, "ahead", longer, rank, F.lit(False).alias("own"))
        stay = reached.filter(~alone).select(*PLACE, "ahead", "m", "class", "own")
        moved = going.filter("own and later").select(*PLACE, "m", "class", "own")
        state = settle(stay.join(moved, [*PLACE, "m", "class", "own"], "left_anti").select(*PLACE, "ahead", "m", "class", "own").unionAll(grown).unionAll(first))
    return state.filter("own").select(*PLACE, "ahead", "m")


def report(docs: DataFrame, min_words: int = MIN_WORDS, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs``: columns ``keep`` (doc_id), text without the later copies, n_lines and n_deleted."""
    keep = keep or ["doc_id"]
    return give_back(_cut(docs, min_words, keep), keep, F.col("cut").alias("text"), "n_lines", "n_deleted")


def _cut(docs: DataFrame, min_words: int, keep: list[str]) -> DataFrame:
    """The caller's columns as ``KEPT``, and cut, n_lines, n_deleted."""
    lines = line_table(docs, min_words)
    levels = rank_levels(lines)
    rows = carry(docs, keep, text_of(docs), *_key(docs))
    whole = F.split("text", "\n", -1)
    if levels:
        cuts = earlier_prefixes(lines, levels).filter("m >= ahead").groupBy("doc", F.col("pos").cast("long").alias("start")).agg(F.max(F.col("pos") + F.col("m")).alias("end"))
        # A document's prefixes are merged to disjoint runs before they are gathered.
        order = Window.partitionBy("doc").orderBy("start")
        cuts = cuts.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        cuts = cuts.withColumn("run", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(order))
        runs = cuts.groupBy("doc", "run").agg(F.min("start").alias("a"), F.max("end").alias("b"))
        per_doc = runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))
        rows = rows.join(settle(per_doc.join(lines.filter("pos = 0").select("doc", *KEY), "doc").select(*KEY, "runs")), KEY, "left")
    else:
        rows = rows.withColumn("runs", F.lit(None).cast("array<struct<a:long,b:long>>"))
    discard(lines)
    keeps = F.filter(whole, lambda _, i: ~F.exists("runs", lambda r: (i >= r["a"]) & (i < r["b"])))
    deleted = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return rows.withColumns({
        "cut": F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(keeps, "\n")),
        "n_lines": F.coalesce(F.size(whole), F.lit(0)).cast("long"),
        "n_deleted": F.coalesce(deleted, F.lit(0)),
    })


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with all their columns, later copies of repeated runs cut out of the text (an
    n_chars column follows the text); documents of which no line is left are dropped."""
    names = docs.columns
    cut = _cut(docs, min_words, names)
    left = cut.filter((F.col("n_deleted") < F.col("n_lines")) | (F.col("n_deleted") == 0))
    changed = F.col("n_deleted") > 0
    new = {"text": F.col("cut"), "n_chars": F.char_length("cut")}
    kinds = {f.name: f.dataType for f in docs.schema.fields}

    def column(name: str):
        old = F.col(KEPT).getField(name)
        return (F.when(changed, new[name].cast(kinds[name])).otherwise(old) if name in new else old).alias(name)

    return left.select(*(column(c) for c in names))
