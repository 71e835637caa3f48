"""Open Location Codes as expressions: encoding, and decoding to a box."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the code's digits.
DIGITS = "23456789CFGHJMPQRVWX"


def _spread(value: Column) -> Column:
    """The digits of a number of base 20, each with a free place behind it."""
    return F.conv(F.regexp_replace(F.conv(value.cast("long"), 10, 20), "(.)", "0$1"), 20, 10).cast("long")


def _said(value: Column, size: int) -> Column:
    """A number in ``size`` of the code's digits."""
    return F.translate(F.lpad(F.conv(value.cast("long"), 10, 20), size, "0"), "0123456789ABCDEFGHIJ", DIGITS)


def olc_encode(lat: Column, lon: Column, size: int = 11) -> Column:
    """The code of a point with ``size`` digits (2 to 15), the separator after the eighth."""
    back = 20.0 ** (2 - size / 2) if size <= 10 else 20.0**-3 / 5 ** (size - 10)
    clipped = F.greatest(F.least(lat, F.lit(90.0)), F.lit(-90.0))
    up = F.when(clipped >= 90, 90 - back).otherwise(clipped) + 90
    right = F.pmod(lon + 180, F.lit(360.0))
    whole = lambda x, scale, places: F.floor(F.round(x * scale, places)).cast("long")
    # Each number is used once, in base conversions: copied for each digit the code would outgrow what the JVM compiles.
    code = _said(_spread(whole(up, 8000, 6)) * 20 + _spread(whole(right, 8000, 6)), 10)
    if size > 10:
        digits = lambda x, base: F.conv(F.conv(x, 10, base), 20, 10).cast("long")
        code = F.concat(code, _said(digits(whole(up, 8000 * 3125, 5) % 3125, 5) * 4 + digits(whole(right, 8000 * 1024, 5) % 1024, 4), 5))
    code = F.substring(code, 1, size)
    return F.regexp_replace(F.rpad(code, 8, "0") if size < 8 else code, "^(.{8})", "$1+")


def olc_decode(code: Column) -> Column:
    """Struct lat_lo, lon_lo, lat_hi, lon_hi, lat, lon: the code's box and its centre.

    The first ten digits are two numbers of base 20 by turns; the others have a row of base 5 and a column of base 4 each."""
    clean = F.replace(F.replace(F.replace(F.upper(code), F.lit("+"), F.lit("")), F.lit("0"), F.lit("")), F.lit(" "), F.lit(""))
    n = F.least(F.char_length(clean), F.lit(15))
    whole = F.rpad(F.left(clean, F.lit(15)), 15, DIGITS[0])
    pairs, fine = F.translate(F.left(whole, F.lit(10)), DIGITS, "0123456789abcdefghij"), F.right(whole, F.lit(5))
    number = lambda digits, base: F.conv(digits, base, 10).cast("double")
    up, right = number(F.regexp_replace(pairs, "(.)(.)", "$1"), 20), number(F.regexp_replace(pairs, "(.)(.)", "$2"), 20)
    row, column = number(F.translate(fine, DIGITS, "00001111222233334444"), 5), number(F.translate(fine, DIGITS, "01230123012301230123"), 4)
    lat, lon = -90 + up / 8000 + row / (8000 * 3125), -180 + right / 8000 + column / (8000 * 1024)
    coarse = F.pow(F.lit(20.0), 2 - F.floor(n / 2))
    high = F.when(n <= 10, coarse).otherwise(1 / 8000 / F.pow(F.lit(5.0), n - 10))
    wide = F.when(n <= 10, coarse).otherwise(1 / 8000 / F.pow(F.lit(4.0), n - 10))
    cut = lambda c: F.round(c, 10)
    return F.struct(
        cut(lat).alias("lat_lo"), cut(lon).alias("lon_lo"), cut(lat + high).alias("lat_hi"), cut(lon + wide).alias("lon_hi"),
        cut(lat + high / 2).alias("lat"), cut(lon + wide / 2).alias("lon"),
    )


def with_geocode(points: DataFrame, size: int = 11) -> DataFrame:
    """Waypoints with the geocode of their position, as the matching rules want them; null where there is no position."""
    return points.withColumn("geocode", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), olc_encode(F.col("lat"), F.col("lon"), size)))


class Geocode(Protocol):
    """A code of cells of the chart: equal for points of one cell."""

    def encode(self, lat: Column, lon: Column) -> Column:
        """The code of a point's cell."""

    def neighbours(self, code: Column) -> Column:
        """An array of the codes of a cell and of all that touch it."""


@dataclass(frozen=True)
class OpenLocation:
    """Open Location Codes of ``size`` digits, an even number up to ten. East of 180° lies -180°; beyond a pole lies no cell."""

    size: int = 8

    def encode(self, lat: Column, lon: Column) -> Column:
        return olc_encode(lat, lon, self.size)

    def neighbours(self, code: Column) -> Column:
        if self.size % 2 or not 2 <= self.size <= 10:
            raise ValueError(f"codes of {self.size} digits have no square cells")
        # Whole numbers and one base conversion a neighbour, not a point's whole code. A shorter code stands for its middle.
        half = self.size // 2
        high, wide = int(180 * 20.0 ** (half - 2)), int(360 * 20.0 ** (half - 2))

        def place(code: Column) -> Column:
            clean = F.regexp_replace(F.upper(code), "[+0 ]", "")
            pairs = F.translate(F.rpad(F.left(clean, F.lit(self.size)), self.size, "GG22222222"), DIGITS, "0123456789abcdefghij")
            number = lambda part: F.conv(F.regexp_replace(pairs, "(.)(.)", part), 20, 10).cast("long")
            return F.struct(number("$1").alias("up"), number("$2").alias("right"))

        def text(value: Column) -> Column:
            whole = F.rpad(_said(value, self.size), max(8, self.size), "0")
            return F.concat(F.left(whole, F.lit(8)), F.lit("+"), F.substring(whole, 9, 7))

        steps = F.array(*(F.lit(k).cast("long") for k in (0, -1, 1)))

        def around(at: Column) -> Column:
            rows = F.transform(F.filter(F.transform(steps, lambda k: at["up"] + k), lambda row: (row >= 0) & (row < high)), _spread)
            columns = F.transform(F.transform(steps, lambda k: F.pmod(at["right"] + k, F.lit(wide))), _spread)
            return F.flatten(F.transform(rows, lambda a: F.transform(columns, lambda b: text(a * 20 + b))))

        # Variables of lambdas keep the long expressions of the code from being copied for each neighbour.
        return F.array_distinct(F.flatten(F.transform(F.transform(F.array(code), place), around)))
