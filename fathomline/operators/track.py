"""Track analysis: each fix with the leg to the next one, and running totals.

Order is meaning: ``seq`` orders the fixes of a track (``by``), and windows are cut by track,
so shuffles move each row once and both steps share one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import format_elapsed
from ..functions.geodesy import NM, range_bearing


def with_legs(fixes: DataFrame, by: list[str], seq: list[str], radius: float = NM) -> DataFrame:
    """Add distance, bearing (degrees) and delta_seconds to the next fix; null on the last.

    ``fixes`` has lat, lon (degrees) and time (timestamp)."""
    w = Window.partitionBy(*by).orderBy(*seq)
    after = {c: F.lead(c).over(w) for c in ("lat", "lon", "time")}
    df = fixes.withColumns({f"next_{c}": v for c, v in after.items()})
    leg = range_bearing(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon"), radius)
    known = F.col("next_lat").isNotNull() & F.col("next_lon").isNotNull()
    df = df.withColumn("leg_", F.when(known, leg))
    return df.withColumns(
        {
            "distance": F.col("leg_.distance"),
            "bearing": F.col("leg_.bearing"),
            "delta_seconds": (F.unix_micros("next_time") - F.unix_micros("time")) / 1e6,
        }
    ).drop("leg_", "next_lat", "next_lon", "next_time")


def with_totals(legs: DataFrame, by: list[str], seq: list[str]) -> DataFrame:
    """Add total_distance and total_seconds up to and including each leg. Seconds are added as whole microseconds, so a total has no error of summation."""
    w = Window.partitionBy(*by).orderBy(*seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return legs.withColumns(
        {
            "total_distance": F.coalesce(F.sum("distance").over(w), F.lit(0.0)),
            "total_seconds": F.coalesce(F.sum(F.bround(F.col("delta_seconds") * 1e6).cast("long")).over(w) / 1e6, F.lit(0.0)),
        }
    )


def track_report(fixes: DataFrame, by: list[str], seq: list[str]) -> DataFrame:
    """The columns of the written report beside those of ``fixes``: distances to 5 places, whole degrees, elapsed texts."""
    df = with_totals(with_legs(fixes, by, seq), by, seq)
    return df.select(
        *fixes.columns,
        F.bround("distance", 5).alias("calc_distance"),
        F.bround("bearing", 0).alias("calc_bearing"),
        F.col("time").alias("calc_time"),
        format_elapsed(F.col("delta_seconds").cast("long")).alias("calc_elapsed"),
        F.bround("total_distance", 5).alias("calc_total_dist"),
        format_elapsed(F.col("total_seconds").cast("long")).alias("calc_total_time"),
    )
