"""Voyages: the stretches of a track between pauses, with the legs inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import NM
from .track import with_legs


def voyages(fixes: DataFrame, by: list[str], seq: list[str], gap_seconds: int, radius: float = NM) -> DataFrame:
    """``by``, voyage (from 0 in each track), started, ended (the last fix), fixes, distance and seconds under way, average_speed (knots) and longest_leg.

    A pause of more than ``gap_seconds`` between two fixes ends a voyage; the leg across it belongs to none. Fixes are cut by session windows, aggregated before and
    after the shuffle. ``fixes`` has lat, lon and time, and ``seq`` orders a track by time. Fixes without a time belong to no voyage; a voyage of one fix has distance 0 and no speed.
    """
    legs = with_legs(fixes.filter("time is not null"), by, seq, radius)
    inside = F.col("delta_seconds") <= gap_seconds
    found = legs.groupBy(*by, F.session_window("time", f"{gap_seconds} seconds").alias("span")).agg(
        F.min("time").alias("started"), F.max("time").alias("ended"), F.count(F.lit(1)).alias("fixes"),
        F.coalesce(F.sum(F.when(inside, F.col("distance"))), F.lit(0.0)).alias("distance"), F.max(F.when(inside, F.col("distance"))).alias("longest_leg"),
    )
    seconds = (F.unix_micros("ended") - F.unix_micros("started")) / 1e6
    number = F.row_number().over(Window.partitionBy(*by).orderBy("started")) - 1
    found = found.withColumns({"seconds": seconds, "voyage": number.cast("long")})
    return found.select(*by, "voyage", "started", "ended", "fixes", "distance", "seconds", F.try_divide(F.col("distance") * 3600, F.col("seconds")).alias("average_speed"), "longest_leg")
