"""Distances, bearings and destinations on the sphere; latitudes and longitudes are degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Earth's mean radius in kilometres, statute miles and nautical miles.
KM = 6371.009
MI = 3958.761
NM = 3440.069


def range_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = NM, wrap: bool = False) -> Column:
    """Struct distance, bearing (degrees, 0 to 360) on the equirectangular chart.

    Longitudes are taken as they are: from 179 to -179 is the long way round, unless ``wrap``.
    """
    across = F.radians(lon2) - F.radians(lon1)
    if wrap:
        across = F.pmod(across + math.pi, F.lit(2 * math.pi)) - math.pi
    up = radius * (F.radians(lat2) - F.radians(lat1))
    right = radius * F.cos((F.radians(lat1) + F.radians(lat2)) / 2) * across
    bearing = F.degrees(F.pmod(F.atan2(right, up), F.lit(2 * math.pi)))
    return F.struct(F.sqrt(up * up + right * right).alias("distance"), bearing.alias("bearing"))


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = NM, wrap: bool = False) -> Column:
    return range_bearing(lat1, lon1, lat2, lon2, radius, wrap)["distance"]


def destination(lat: Column, lon: Column, length: Column, bearing: Column, radius: float = NM) -> Column:
    """Struct lat, lon (degrees) at the end of a rhumb line."""
    phi, course, arc = F.radians(lat), F.radians(bearing), length / radius
    rise = arc * F.cos(course)
    end = phi + rise
    end = F.when(F.abs(end) > math.pi / 2, F.when(end > 0, math.pi - end).otherwise(-math.pi - end)).otherwise(end)
    stretched = F.ln(F.tan(end / 2 + math.pi / 4) / F.tan(phi / 2 + math.pi / 4))
    ratio = F.when(F.abs(rise) < 1e-6, F.cos(phi)).otherwise(rise / stretched)
    turned = F.radians(lon) + arc * F.sin(course) / ratio
    turned = F.pmod(turned + math.pi, F.lit(2 * math.pi)) - math.pi
    return F.struct(F.degrees(end).alias("lat"), F.degrees(turned).alias("lon"))


# The chartplotter's Mercator unit is a millimetre-free metre of this polar radius.
POLAR = 6356752.3142


def mercator_lon(x: Column) -> Column:
    return F.round(F.degrees(x / POLAR), 8)


def mercator_lat(y: Column) -> Column:
    return F.round(F.degrees(2 * F.atan(F.exp(y / POLAR)) - math.pi / 2), 8)
