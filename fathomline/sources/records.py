"""CSV records of text files, with quoted line breaks, whatever the splits that Spark reads them by.

Whether a line begins a record depends on all lines before it: a quoted field that is open carries on. A line is therefore taken as a function
from "are we inside a quoted field?" before it to the same after it. Without a quote that is the identity; others go by the rules of the format
(a quote opens a field only at its beginning, and is doubled within). Functions of one split are combined as it is scanned, for both ways
to enter it; the splits' functions are combined in the order of the file, of which there are as many rows as splits; then every line knows its
record. Lines that are records by themselves stay where they are; only the pieces of the others are gathered, by record.

Defined cases: blank lines between records are left out and not counted; a line break inside quotes comes as ``\\n``; a quote that is never closed
takes the rest of its file, as the format has it; an empty file has no records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import settle

QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
OPEN = re.compile(rf'(?:(?:{QUOTED}"[^,]*+|[^",][^,]*+|),)*+{QUOTED}\Z')
LINES = "source_file string, block long, line long, value string, before0 int, before1 int, after0 int, after1 int, n0 long, n1 long"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted field, if it begins inside one or not."""
    return OPEN.match('"' + line if inside else line) is not None


class Scan:
    """The lines of one split, batch by batch: for both ways to enter it (outside, inside a quoted field) the state now and the records begun so far."""

    def __init__(self):
        self.states, self.begun, self.lines = [0, 1], [0, 0], 0

    def take(self, values: pa.Array) -> list[np.ndarray]:
        """Of each line its number, the states before and after it, and the records begun up to it, each for both ways."""
        n = len(values)
        full = pc.not_equal(pc.utf8_trim_whitespace(values), "").to_numpy(zero_copy_only=False)
        before, after = np.zeros((2, n), np.int32), np.zeros((2, n), np.int32)
        at = 0
        for k in np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)).tolist():
            line = values[k].as_py()
            ends = [ends_inside(line, inside) for inside in (False, True)]
            for way in (0, 1):
                before[way, at : k + 1] = after[way, at:k] = self.states[way]
                after[way, k] = self.states[way] = int(ends[self.states[way]])
            at = k + 1
        for way in (0, 1):
            before[way, at:] = after[way, at:] = self.states[way]
        begun = np.cumsum(full & (before == 0), axis=1) + np.array(self.begun)[:, None]
        line = np.arange(self.lines, self.lines + n)
        self.lines += n
        self.begun = begun[:, -1].tolist()
        return [line, *before, *after, *begun]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, scan = None, Scan()
    for batch in batches:
        files, blocks = batch.column("source_file"), batch.column("block").to_numpy()
        new = np.flatnonzero((blocks[1:] != blocks[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
            if a == b:
                continue
            split = (files[a].as_py(), int(blocks[a]))
            if split != current:
                current, scan = split, Scan()
            piece = batch.slice(a, b - a)
            line, b0, b1, a0, a1, n0, n1 = scan.take(piece.column("value"))
            yield pa.RecordBatch.from_arrays([piece.column("source_file"), piece.column("block"), *map(pa.array, (line,)), piece.column("value"), *map(pa.array, (b0, b1, a0, a1, n0, n1))], names=[x.split()[0] for x in LINES.split(", ")])


def _text_in_order(rows: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(rows), lambda x: x["value"]), "\n")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """source_file, seq (from 0 in each file), value (the record's text) and head (the first record of the file)."""
    text = spark.read.text(path).select(F.input_file_name().alias("source_file"), F.expr("input_file_block_start()").alias("block"), "value")
    lines = text.mapInArrow(_scan, LINES)
    full = F.trim("value") != ""
    of_head = (F.col("block") == 0) & (F.col("n0") == 1) & (full | (F.col("before0") == 1))
    splits = lines.groupBy("source_file", "block").agg(
        F.max(F.struct("line", "after0", "after1", "n0", "n1")).alias("end"), F.collect_list(F.when(of_head, F.struct("line", "value"))).alias("head"),
        F.max(F.greatest("after0", 1 - F.col("after1"))).alias("quotes"),
    )
    # The state behind a split: that of the last split which ends alike whatever it begins with, turned by every split since then that turns it.
    w = Window.partitionBy("source_file").orderBy("block")
    alike = F.col("end.after0") == F.col("end.after1")
    splits = settle(splits).withColumn("turns", F.sum(F.col("end.after0") * (1 - F.col("end.after1"))).over(w))
    last = F.last(F.when(alike, F.struct(F.col("end.after0").alias("state"), F.col("turns"))), ignorenulls=True).over(w)
    splits = splits.withColumn("last", last)
    behind = F.pmod(F.coalesce(F.col("last.state"), F.lit(0)) + F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0)), F.lit(2))
    splits = splits.withColumn("behind", behind).withColumn("state", F.coalesce(F.lag("behind").over(w), F.lit(0)))
    begun = F.when(F.col("state") == 0, F.col("end.n0")).otherwise(F.col("end.n1"))
    splits = splits.withColumn("base", F.sum(begun).over(w) - begun)
    splits = settle(splits.select("source_file", "block", "state", "base", F.first(_text_in_order(F.col("head"))).over(w).alias("head"), "quotes"))

    of = lambda name: F.when(F.col("state") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    rows = lines.join(splits, ["source_file", "block"]).select("source_file", "block", "line", "value", "head", (F.col("base") + of("n") - 1).alias("seq"), of("before").alias("inside"), of("after").alias("open"))
    whole = rows.filter((F.col("inside") == 0) & (F.col("open") == 0) & full).select("source_file", "seq", "value", "head")
    if splits.filter("quotes = 1").isEmpty():  # no line ends inside quotes unless it begins there
        return whole
    pieces = rows.filter((F.col("inside") == 1) | (F.col("open") == 1)).groupBy("source_file", "seq")
    joined = pieces.agg(_text_in_order(F.collect_list(F.struct("block", "line", "value"))).alias("value"), F.first("head").alias("head"))
    return whole.unionByName(joined)
