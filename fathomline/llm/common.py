"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import fresh_path, settle

KEPT = "kept"
SLICE_BYTES = 4 << 20
BATCH_SETTING, BATCH_USUAL = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``settle``, but as packed Parquet: for tables of many rows."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove tables of ``stored`` from the shared folder; what was made of them must be settled."""
    for df in frames:
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        context = df.sparkSession.sparkContext
        for folder in folders:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def carry(docs: DataFrame, keep: list[str], *own: Column) -> DataFrame:
    """The caller's columns ``keep`` as one struct, ``KEPT``, beside the operator's own columns: whatever the caller's
    are called, none of them meets an inner one."""
    return docs.select(F.struct(*(named(c).alias(c) for c in keep)).alias(KEPT), *own)


def give_back(df: DataFrame, keep: list[str], *more: Column) -> DataFrame:
    """The caller's columns as they were, then ``more``."""
    return df.select(*(F.col(KEPT).getField(c).alias(c) for c in keep), *more)


def text_of(docs: DataFrame) -> Column:
    return named("text").cast("string").alias("text")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, as the contracts ask."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(values: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null gives b''."""
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow with a function that is built once per task and gets slices of some ``SLICE_BYTES``, so that a worker never holds
    the texts of a whole batch in several forms. What the batches took is given back when a task ends: the worker goes on to the next stage."""

    if df.sparkSession.conf.get(BATCH_SETTING) == BATCH_USUAL:  # not set by the caller; long texts fill batches of that size
        df.sparkSession.conf.set(BATCH_SETTING, f"{2 * SLICE_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
            for k in range(0, batch.num_rows, rows):
                yield step(batch.slice(k, rows))
        del step
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def map_carried(df: DataFrame, added: str, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """``KEPT`` passes through; the function gives the columns ``added`` (a DDL string) of each batch."""
    fields = StructType.fromDDL(added).fields
    names = [KEPT, *(f.name for f in fields)]

    def build():
        step = make()
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(KEPT), *step(batch)], names=names)

    return map_batches(df, StructType([df.schema[KEPT], *fields]), build)
