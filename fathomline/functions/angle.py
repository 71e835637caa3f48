"""Angles: parsing, units, degree/minute/second splitting and formatting. Degrees are signed doubles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted text forms, tried in this order.
DEGREES = r"^(\d+\.\d+)[^NEWSnews]*([NEWSnews]?)"
DEGREES_MINUTES = r"^(\d+)\D+(\d+\.\d+)[^NEWSnews]*([NEWSnews]?)"
DEGREES_MINUTES_SECONDS = r"^(\d+)\D+(\d+)\D+(\d+)[^NEWSnews]*([NEWSnews]?)"


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def _signed(text: Column, pattern: str, group: int, value: Column) -> Column:
    letter = F.upper(F.regexp_extract(text, pattern, group))
    return F.when(letter.isin("S", "W"), -value).otherwise(value)


def parse_angle(text: Column) -> Column:
    """Signed degrees of ``10.5``, ``10.5N``, ``10 20.5N`` or ``10 20 30N``; null for anything else.

    Fractional seconds are dropped and integers need no hemisphere only as plain numbers.
    """
    # What ends in a hemisphere is no number: to try it would raise and catch an exception for each such text.
    plain = F.when(~F.upper(F.right(F.trim(text), F.lit(1))).isin("N", "S", "E", "W"), F.trim(text).try_cast("double"))
    plain = F.when(~F.isnan(plain) & (F.abs(plain) < F.lit(float("inf"))), plain)
    d = _signed(text, DEGREES, 2, _number(text, DEGREES, 1))
    dm = _signed(text, DEGREES_MINUTES, 3, _number(text, DEGREES_MINUTES, 1) + _number(text, DEGREES_MINUTES, 2) / 60)
    p = DEGREES_MINUTES_SECONDS
    dms = _signed(text, p, 4, _number(text, p, 1) + _number(text, p, 2) / 60 + _number(text, p, 3) / 3600)
    return F.coalesce(plain, d, dm, dms)


def degrees_of(value: Column | float | str) -> Column:
    """Signed degrees of a column (as it is), a float, or an angle's text; whole numbers and all else are an error, for they might be meant otherwise."""
    if isinstance(value, Column):
        return value
    if isinstance(value, float):
        return F.lit(value)
    if isinstance(value, str):
        return parse_angle(F.lit(value))
    raise ValueError(f"neither a column, a float nor a text: {value!r}")


def from_degrees(value: Column, hemisphere: Column) -> Column:
    """Signed degrees from a magnitude and N, S, E or W; null for another letter."""
    h = F.upper(hemisphere)
    return F.when(h.isin("S", "W"), -value).when(h.isin("N", "E"), value)


def from_degrees_minutes(degrees: Column, minutes: Column, hemisphere: Column) -> Column:
    return from_degrees(degrees + minutes / 60, hemisphere)


def north(lat: Column) -> Column:
    """Degrees from the south pole."""
    return lat + 90


def east(lon: Column) -> Column:
    """Degrees east of the prime meridian, 0 to 360."""
    return F.pmod(lon, F.lit(360.0))


def _whole(degrees: Column) -> tuple[Column, Column]:
    """Whole degrees and minutes of the magnitude; minutes within 1e-5 of 60 become the next degree."""
    size = F.abs(degrees)
    d = F.floor(size)
    m = 60 * (size - d)
    full = F.abs(m - 60) / 60 < 1e-5
    return F.when(full, d + 1).otherwise(d).cast("int"), F.when(full, F.lit(0.0)).otherwise(m)


def dm(degrees: Column) -> Column:
    """Struct d (int), m (double); the sign is on d, or on m where d is 0."""
    d, m = _whole(degrees)
    sign = F.when(degrees < 0, -1).otherwise(1)
    return F.struct((d * sign).alias("d"), (m * F.when(d == 0, sign).otherwise(1)).alias("m"))


def dms(degrees: Column) -> Column:
    """Struct d, m (ints), s (double, 3 places); the sign is on the first part that isn't 0."""
    d, minutes = _whole(degrees)
    m = F.floor(minutes).cast("int")
    s = F.round((minutes - m) * 60, 3)
    sign = F.when(degrees < 0, -1).otherwise(1)
    return F.struct(
        (d * sign).alias("d"),
        (m * F.when(d == 0, sign).otherwise(1)).alias("m"),
        (s * F.when((d == 0) & (m == 0), sign).otherwise(1)).alias("s"),
    )


def hemisphere(degrees: Column, letters: str = "+-") -> Column:
    """The first letter for values from 0, the second below: ``NS``, ``EW`` or the signs."""
    return F.when(degrees < 0, F.lit(letters[1])).otherwise(F.lit(letters[0]))


def format_angle(degrees: Column, spec: str, letters: str = "+-") -> Column:
    """Text by a format with items %<width.precision>x, x one of d, m, s (parts of the magnitude), h
    (hemisphere) and r (radians). Degrees are fractional where no minutes are asked for, and so on."""
    items = re.findall(r"%([0-9.#+ -]*)([dmshr])", spec)
    used = {x for _, x in items}
    size = F.abs(degrees)
    values = {"h": hemisphere(degrees, letters), "r": F.radians(degrees), "d": size}
    if {"d", "m", "s"} <= used:
        parts = dms(size)
        values |= {k: parts[k].cast("double") for k in "dms"}
    elif {"d", "m"} <= used:
        parts = dm(size)
        values |= {k: parts[k].cast("double") for k in "dm"}
    pattern = re.sub(r"%([0-9.#+ -]*)([dmshr])", lambda m: f"%{m[1]}{'s' if m[2] == 'h' else 'f'}", spec)
    return F.format_string(pattern, *(values[x] for _, x in items))


# The three presets.
PRESETS = {
    "dms": ("%02.0d %02.0m %04.1s%h", "%03.0d %02.0m %04.1s%h"),
    "dm": ("%02.0d %.3m%h", "%03.0d %.3m%h"),
    "d": ("%06.3d%h", "%07.3d%h"),
}


def format_lat(lat: Column, preset: str = "dm") -> Column:
    return format_angle(lat, PRESETS[preset][0], "NS")


def format_lon(lon: Column, preset: str = "dm") -> Column:
    return format_angle(lon, PRESETS[preset][1], "EW")


def floor_divide(a: Column, b: Column) -> Column:
    return F.floor(a / b)


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign."""
    return a - b * F.floor(a / b)


def degrees_minutes(degrees: Column) -> Column:
    """Struct d, m with m rounded half up to whole minutes (which may be 60); the sign is on d."""
    d = F.when(degrees < 0, F.ceil(degrees)).otherwise(F.floor(degrees)).cast("int")
    m = F.floor(F.abs(degrees - d) * 60 + 0.5).cast("int")
    return F.struct(d.alias("d"), F.when((degrees < 0) & (d == 0), -m).otherwise(m).alias("m"))
