"""Geomagnetic coefficient files in the public column layout."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """kind, n, m, epoch, value: one row per number. Lines with ``#`` are comments; the line that begins with
    ``g/h`` names the epochs; its last column (``2020-25``) is the yearly change, filed under its end."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#"))
    header = lines.filter(F.col("value").startswith("g/h")).first()
    if header is None:
        raise ValueError(f"{path} has no line that begins with g/h")
    *names, change = header[0].split()[3:]
    m = re.match(r"(\d\d)\d\d-(\d\d)", change)
    epochs = [int(float(x)) for x in names] + [int(m[1] + m[2]) if m else int(float(change))]
    cells = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.regexp_like("value", F.lit(r"^[gh]\s+\d"))).select(cells.alias("c"))
    years = F.array(*(F.lit(e) for e in epochs))
    return rows.select(
        F.col("c")[0].alias("kind"), F.col("c")[1].cast("int").alias("n"), F.col("c")[2].cast("int").alias("m"),
        F.explode(F.arrays_zip(years.alias("epoch"), F.slice("c", 4, len(epochs)).alias("value"))).alias("x"),
    ).select("kind", "n", "m", F.col("x.epoch").alias("epoch"), F.col("x.value").cast("double").alias("value"))


def collect_model(coefficients: DataFrame) -> list[tuple]:
    """A model for the column functions; the format bounds it to some thousands of numbers."""
    return [tuple(r) for r in coefficients.select("kind", "n", "m", "epoch", "value").collect()]
