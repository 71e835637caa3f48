"""Cells over the chart: rows of latitude, and in each row columns of longitude that are wide enough for a distance.

A row is as high as the distance. Within a row all columns have one width: the distance at the row's latitude farthest from the equator, one row
further out, and a whole number of them goes round the earth. So two points within the distance lie in the same or in touching cells, and
the neighbours of a cell across 180° are those on the other side. Near a pole the columns get few, down to one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geodesy import NM


@dataclass(frozen=True)
class Cells:
    """Cells for a ``limit`` in the unit of ``radius``; with ``wrap`` longitudes go round, else 180° and -180° are the ends of the chart."""

    limit: float
    radius: float = NM
    wrap: bool = False

    @property
    def high(self) -> float:
        return math.degrees(self.limit / self.radius)

    def row(self, lat: Column) -> Column:
        return F.floor(lat / self.high)

    def columns(self, row: Column) -> Column:
        """How many columns go round the earth in a row."""
        out = F.least((F.abs(row + 0.5) + 2) * self.high, F.lit(90.0))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(out)) / self.high).cast("long"))

    def column(self, lon: Column, row: Column) -> Column:
        at = F.pmod(lon + 180, F.lit(360.0)) if self.wrap else lon + 180
        found = F.floor(at * self.columns(row) / 360).cast("long")
        return F.pmod(found, self.columns(row)) if self.wrap else found

    def around(self, lat: Column, lon: Column) -> Column:
        """The cells, as an array of structs (row, column), in one of which each point within the limit lies: up to nine."""

        def in_row(row: Column) -> list[Column]:
            middle = self.column(lon, row)
            places = [F.pmod(middle + k, self.columns(row)) if self.wrap else middle + k for k in (-1, 0, 1)]
            return [F.struct(row.alias("row"), place.alias("column")) for place in places]

        return F.array_distinct(F.array(*(cell for k in (-1, 0, 1) for cell in in_row(self.row(lat) + k))))

    def cell(self, lat: Column, lon: Column) -> Column:
        row = self.row(lat)
        return F.struct(row.alias("row"), self.column(lon, row).alias("column"))
