"""Date and time texts of logs, durations, and date arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted forms in the order they are tried.
TIMES = ["HHmm", "H:mm", "h:mm a"]
YEARLESS = ["M/d", "MMM d", "d MMM", "MMM-d", "d-MMM", "MMMM d"]
OFFSET = ["yyyy-M-d'T'H:m:sXXX", "yyyy-M-d'T'H:m:sxx", "yyyy-M-d H:m:s xx", "yyyy-M-d H:m:s XXX"]
FULL = ["M/d/yyyy", "M/d/yy", "yyyy-M-d", "yy-M-d", "M-d-yyyy", "M-d-yy"]
DAYS = ["M/d/yyyy", "M/d/yy", "yyyy-M-d", "yy-M-d", "yyyy-MMM-d", "yy-MMM-d", "yyyy-MMMM-d", "yy-MMMM-d"]


def _padded(text: Column) -> Column:
    """A closing three-digit time gets its leading zero."""
    return F.regexp_replace(text, r"(^|\s)(\d{3})$", "$10$2")


# What a pattern's letters can stand for, longest first; a text of another shape is never tried, for a miss is costly.
SHAPES = {"yyyy": r"\d{4,}", "HHmm": r"\d{4}", "MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3,4}", "XXX": r"(?:Z|[+-]\d\d:\d\d)", "xx": r"[+-]\d{4}", "yy": r"\d{2}", "mm": r"\d{2}", "'T'": "T", "a": "[AaPp][Mm]"} | {x: r"0*\d{1,2}" for x in "MdHhms"}


def shape(pattern: str) -> str:
    """A regular expression that every text of a date pattern matches."""
    return "^" + re.sub("|".join(map(re.escape, SHAPES)), lambda m: SHAPES[m[0]], pattern) + "$"


def _read(text: Column, pattern: str, before: Column | None = None, pattern_before: str = "") -> Column:
    """The text, after what stands ``before`` it, read by the patterns of both."""
    whole, full = (text, pattern) if before is None else (F.concat_ws(" ", before, text), f"{pattern_before} {pattern}")
    found = F.try_to_timestamp(whole, F.lit(full))
    if "yy" in pattern and "yyyy" not in pattern:  # two-digit years from 69 on are of the last century
        found = F.when(F.year(found) >= 2069, F.add_months(found, -1200) + (found - F.date_trunc("day", found))).otherwise(found)
    return F.when(F.regexp_like(text, F.lit(shape(pattern))), found)


def parse_datetime(text: Column, default: Column) -> Column:
    """Timestamp of a log's date text; ``default`` (a date) fills what the text leaves out. Null if no form fits.

    Times without an offset are read in the session's zone. Forms are tried in a fixed order, so a
    bare number is a time of day before it is anything else.
    """
    t = _padded(F.trim(text))
    day, year = F.date_format(default, "yyyy-MM-dd"), F.date_format(default, "yyyy")
    tries = [_read(t, p, day, "yyyy-MM-dd") for p in TIMES]
    tries += [_read(t, f"{d} {p}", year, "yyyy") for d in YEARLESS for p in TIMES]
    tries += [_read(t, p) for p in OFFSET]
    for d in FULL:
        tries += [_read(t, f"{d} {p}") for p in TIMES]
        if d == "yy-M-d":
            tries.append(_read(t, "yyyy-M-d'T'H:mm"))
    tries += [_read(t, p) for p in DAYS]
    return F.coalesce(*tries)


def utc_offset_seconds(text: Column) -> Column:
    """The offset written at the end of the text (``Z``, ``-05:00``, ``+0000``); null if there is none."""
    p = r"T?\d{1,2}:\d{2}:\d{2}\s?([+-])(\d{2}):?(\d{2})$"
    sign = F.when(F.regexp_extract(text, p, 1) == "-", -1).otherwise(1)
    value = sign * (F.regexp_extract(text, p, 2).try_cast("int") * 3600 + F.regexp_extract(text, p, 3).try_cast("int") * 60)
    return F.when(F.regexp_like(text, F.lit(r"\d{2}:\d{2}Z$")), 0).when(F.regexp_like(text, F.lit(p)), value)


def decimal_year(day: Column) -> Column:
    return F.year(day) + (F.dayofyear(day) - 1) / F.lit(365.242)


def julian_to_date(day: Column) -> Column:
    """Date of a Julian day number (2440588 is 1970-01-01)."""
    return F.date_from_unix_date((day - 2440588).cast("int"))


def parse_duration(text: Column) -> Column:
    """Whole seconds of a text such as ``1d 17H 57M 3S``; of a repeated unit the last counts; no unit: 0."""
    total = F.lit(0).cast("long")
    for unit, seconds in (("d", 86400), ("H", 3600), ("M", 60), ("S", 1)):
        every = F.regexp_extract_all(text, F.lit(rf"(\d+){unit}"), F.lit(1))
        total = total + F.coalesce(F.try_element_at(every, F.lit(-1)).try_cast("long"), F.lit(0)) * seconds
    return F.when(text.isNotNull(), total)


def duration_from(days: Column | float = 0.0, hours: Column | float = 0.0, minutes: Column | float = 0.0, seconds: Column | float = 0.0) -> Column:
    """Whole seconds, cut off, of a sum of fractional parts."""
    lift = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return (((lift(days) * 24 + lift(hours)) * 60 + lift(minutes)) * 60 + lift(seconds)).cast("long")


def duration_parts(seconds: Column) -> Column:
    """Struct d, h, m, s; only d is negative for negative durations."""
    return F.struct(
        F.floor(seconds / 86400).cast("long").alias("d"),
        F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("long").alias("h"),
        F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("long").alias("m"),
        F.pmod(seconds, F.lit(60)).cast("long").alias("s"),
    )


def duration_views(seconds: Column) -> Column:
    """Struct days, hours, minutes, seconds: the whole duration in each unit, with its fraction."""
    return F.struct((seconds / 86400).alias("days"), (seconds / 3600).alias("hours"), (seconds / 60).alias("minutes"), seconds.cast("double").alias("seconds"))


def format_duration(seconds: Column) -> Column:
    p = duration_parts(seconds)
    return F.format_string("%dd %02dh %02dm %02ds", p["d"], p["h"], p["m"], p["s"])


def format_elapsed(seconds: Column) -> Column:
    """``0:45:00``, ``1 day, 2:03:04``."""
    p = duration_parts(seconds)
    clock = F.format_string("%d:%02d:%02d", p["h"], p["m"], p["s"])
    days = F.when(F.abs(p["d"]) == 1, " day, ").otherwise(" days, ")
    return F.when(p["d"] == 0, clock).otherwise(F.concat(p["d"].cast("string"), days, clock))


def format_minutes(minutes: Column) -> Column:
    """``00h 07m`` from minutes, rounded half to even."""
    whole = F.bround(minutes).cast("long")
    return F.format_string("%02dh %02dm", F.floor(whole / 60), F.pmod(whole, F.lit(60)))
