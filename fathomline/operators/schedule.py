"""Route schedules: distance and course from the previous waypoint, course to the next, arrival times.

The variation of a leg's magnetic course is taken at the waypoint and the time before the
clock advances over the leg; that of the next course at the next waypoint and the arrival
time. Courses are not brought back to 0-360 after the variation is applied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import format_minutes
from ..functions.geodesy import NM, range_bearing

Variance = Callable[[Column, Column, Column], Column]


def constant(degrees: float) -> Variance:
    return lambda lat, lon, when: F.lit(float(degrees))


def schedule(waypoints: DataFrame, by: list[str], seq: list[str], departure: Column, speed: Column, variance: Variance, radius: float = NM) -> DataFrame:
    """Add distance, true_bearing, magnetic, speed, enroute_minutes, next_course, arrival to waypoints (lat, lon)."""
    w = Window.partitionBy(*by).orderBy(*seq)
    here = [F.col("lat"), F.col("lon")]
    moves = {f"{n}_{c}": f(c).over(w) for n, f in (("last", F.lag), ("next", F.lead)) for c in ("lat", "lon")}
    df = waypoints.withColumns(moves | {"speed_": speed.cast("double"), "departure_": departure.cast("timestamp")})
    back = range_bearing(F.col("last_lat"), F.col("last_lon"), *here, radius)
    ahead = range_bearing(*here, F.col("next_lat"), F.col("next_lon"), radius)
    df = df.withColumns({"back_": F.when(F.col("last_lat").isNotNull(), back), "ahead_": F.when(F.col("next_lat").isNotNull(), ahead)})
    df = df.withColumn("distance", F.coalesce("back_.distance", F.lit(0.0)))
    df = df.withColumn("enroute_minutes", F.when(F.col("back_").isNull(), 0.0).otherwise(60 * F.col("distance") / F.col("speed_")))
    # Each leg's time is rounded to microseconds before it is added.
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("micros_", F.sum(F.bround(F.col("enroute_minutes") * 60e6).cast("long")).over(run))
    at = F.timestamp_micros(F.unix_micros("departure_") + F.col("micros_"))
    df = df.withColumn("arrival", at).withColumn("left_", F.lag("arrival").over(w))
    return df.withColumns(
        {
            "true_bearing": F.col("back_.bearing"),
            "magnetic": F.col("back_.bearing") - variance(*here, F.col("left_")),
            "speed": F.when(F.col("back_").isNotNull(), F.col("speed_")),
            "next_course": F.col("ahead_.bearing") - variance(F.col("next_lat"), F.col("next_lon"), F.col("arrival")),
        }
    ).drop("back_", "ahead_", "micros_", "left_", "speed_", "departure_", "last_lat", "last_lon", "next_lat", "next_lon")


def _leg_distances(waypoints: DataFrame, by: list[str], seq: list[str], radius: float) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*seq)
    df = waypoints.withColumns({"last_lat": F.lag("lat").over(w), "last_lon": F.lag("lon").over(w)})
    leg = range_bearing(F.col("last_lat"), F.col("last_lon"), F.col("lat"), F.col("lon"), radius)["distance"]
    return df.withColumn("leg_", F.coalesce(leg, F.lit(0.0))).drop("last_lat", "last_lon")


def departure_for(waypoints: DataFrame, by: list[str], seq: list[str], arrival: Column, speed: Column, radius: float = NM) -> DataFrame:
    """Add departure: when a route has to begin to end at ``arrival``. Each leg's time is rounded to microseconds as ``schedule`` does it, so a schedule from there
    ends at the arrival itself. Null where the speed is null or 0; the variation of courses has no part in it."""
    df = _leg_distances(waypoints, by, seq, radius)
    micros = F.bround(F.try_divide(60 * F.col("leg_"), speed.cast("double")) * 60e6).cast("long")
    every = Window.partitionBy(*by)
    whole = F.when(F.count(micros).over(every) == F.count(F.lit(1)).over(every), F.sum(micros).over(every))
    return df.withColumn("departure", F.timestamp_micros(F.unix_micros(arrival.cast("timestamp")) - whole)).drop("leg_")


def schedule_to(waypoints: DataFrame, by: list[str], seq: list[str], arrival: Column, speed: Column, variance: Variance, radius: float = NM) -> DataFrame:
    """A schedule backwards from its end: as ``schedule`` from the departure that leads to ``arrival``; ``departure`` is added too."""
    df = departure_for(waypoints.withColumn("to_", arrival.cast("timestamp")), by, seq, F.col("to_"), speed, radius).drop("to_")
    return schedule(df, by, seq, F.col("departure"), speed, variance, radius)


def speed_for(waypoints: DataFrame, by: list[str], seq: list[str], departure: Column, arrival: Column, radius: float = NM) -> DataFrame:
    """Add speed_needed (knots): what a route takes from ``departure`` to ``arrival``, which are one a route. Null unless the arrival is the later one."""
    seconds = (F.unix_micros(arrival.cast("timestamp")) - F.unix_micros(departure.cast("timestamp"))) / 1e6
    df = _leg_distances(waypoints.withColumn("seconds_", seconds), by, seq, radius)
    needed = F.sum("leg_").over(Window.partitionBy(*by)) * 3600 / F.col("seconds_")
    return df.withColumn("speed_needed", F.when(F.col("seconds_") > 0, needed)).drop("leg_", "seconds_")


def schedule_text(scheduled: DataFrame, by: list[str], seq: list[str]) -> DataFrame:
    """The twelve printed columns: numbered legs, rounded distances and courses, elapsed and arrival texts."""
    from ..functions.angle import format_lat, format_lon

    w = Window.partitionBy(*by).orderBy(*seq)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return scheduled.select(
        *by,
        (F.row_number().over(w) - 1).alias("Leg"),
        F.col("name").alias("To"),
        format_lat(F.col("lat")).alias("Lat"),
        format_lon(F.col("lon")).alias("Lon"),
        F.col("description").alias("Desc"),
        F.when(F.col("speed").isNull(), "0").otherwise(F.bround("distance", 1).cast("string")).alias("Distance (nm)"),
        F.bround("true_bearing", 0).alias("True Bearing"),
        F.bround("magnetic", 0).alias("Magnetic Bearing"),
        F.bround(F.sum("distance").over(run), 1).alias("Distance Run"),
        format_minutes(F.col("enroute_minutes")).alias("Elapsed HH:MM"),
        F.date_format("arrival", "MMM dd HH:mm").alias("ETA"),
        F.bround("next_course", 0).alias("Course to Next"),
    )


def reverse_route(waypoints: DataFrame, by: list[str], seq: str) -> DataFrame:
    """The route backwards: ``seq`` numbered anew from 0."""
    w = Window.partitionBy(*by).orderBy(F.col(seq).desc())
    return waypoints.withColumn(seq, F.row_number().over(w) - 1)


def route_totals(scheduled: DataFrame, by: list[str]) -> DataFrame:
    """Per route: waypoints, distance, minutes under way, last arrival, average speed."""
    return scheduled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("waypoints"),
        F.sum("distance").alias("distance"),
        F.sum("enroute_minutes").alias("minutes"),
        F.max("arrival").alias("arrival"),
        F.try_divide(F.sum("distance") * 60, F.sum("enroute_minutes")).alias("average_speed"),
    )
