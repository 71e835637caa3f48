"""Solar noon, sunrise and sunset by the published almanac formulas, as one expression tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zenith angles of sunrise and of the three twilights.
ZENITHS = {"visible": 90.833, "civil": 96.0, "nautical": 102.0, "astronomical": 108.0}

# Hours from universal time of the named zones, without summer time.
ZONES = {"EST": -5.0, "CST": -6.0, "MST": -7.0, "PST": -8.0}


def sun_minutes(when: Column, lat: Column, lon: Column, offset_hours: Column, zenith: float = ZENITHS["visible"]) -> Column:
    """Struct noon, rise, set in minutes after local midnight, and state: ``day`` where the sun never sets,
    ``night`` where it never rises (rise and set are then null), else ``normal``."""

    def of_degrees(f):
        return lambda x: f(F.radians(x))

    sin, cos, tan = of_degrees(F.sin), of_degrees(F.cos), of_degrees(F.tan)
    day = F.date_trunc("day", when)
    passed = (F.unix_micros(when) - F.unix_micros(day)) / 86_400e6
    julian = F.date_diff(F.to_date(when), F.lit("1900-01-01").cast("date")) + 2 + 2415018.5 + passed - offset_hours / 24
    t = (julian - 2451545) / 36525
    mean_lon = F.pmod(280.46646 + t * (36000.76983 + 0.0003032 * t), F.lit(360.0))
    anomaly = 357.52911 + t * (35999.05029 - 0.0001537 * t)
    orbit = 0.016708634 - t * (0.000042037 + 0.0000001267 * t)
    centre = sin(anomaly) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * anomaly) * (0.019993 - 0.000101 * t) + sin(3 * anomaly) * 0.000289
    node = 125.04 - 1934.136 * t
    apparent = mean_lon + centre - 0.00569 - 0.00478 * sin(node)
    tilt = 23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * cos(node)
    declination = F.degrees(F.asin(sin(tilt) * sin(apparent)))
    y = F.pow(tan(tilt / 2), F.lit(2.0))
    equation = 4 * F.degrees(
        y * sin(2 * mean_lon)
        - 2 * orbit * sin(anomaly)
        + 4 * orbit * y * sin(anomaly) * cos(2 * mean_lon)
        - 0.5 * y * y * sin(4 * mean_lon)
        - 1.25 * orbit * orbit * sin(2 * anomaly)
    )
    height = F.cos(F.radians(F.lit(zenith))) / (cos(lat) * cos(declination)) - tan(lat) * tan(declination)
    half = F.when(F.abs(height) <= 1, F.degrees(F.acos(height)) * 4 / 1440)
    noon = (720 - 4 * lon - equation + offset_hours * 60) / 1440
    state = F.when(height < -1, "day").when(height > 1, "night").otherwise("normal")
    return F.struct((noon * 1440).alias("noon"), ((noon - half) * 1440).alias("rise"), ((noon + half) * 1440).alias("set"), state.alias("state"))


def sun_times(when: Column, lat: Column, lon: Column, offset_hours: Column, zenith: float = ZENITHS["visible"]) -> Column:
    """The same as timestamps on the local clock, to the second."""
    x = sun_minutes(when, lat, lon, offset_hours, zenith)
    midnight = F.unix_micros(F.date_trunc("day", when))
    at = lambda c: F.timestamp_micros(midnight + F.bround(x[c] * 60).cast("long") * 1_000_000).alias(c)
    return F.struct(at("noon"), at("rise"), at("set"), x["state"].alias("state"))
