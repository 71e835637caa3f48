"""Deduplication under a rule that isn't transitive: waypoints within a distance of each other, directly or by others between them.

Points that are near are links, and the clusters are the components of these links. Not all links are made: positions that are equal are one
point; the cells are so small that all points of one are near each other, so each cell is one cluster with its least id for its name. Between two cells it
matters only whether any of their points are near. Each cell's outermost points (least and greatest latitude and longitude) are compared first; cells that are
still apart after that are compared point by point. So a place where very many points lie gives a few links a cell, not all pairs.

Defined cases: points without a position are clusters by themselves; a null id is a cluster by itself too; rows that are repeated
each stay in the table; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import NM, distance
from ..scratch import store
from .cells import Cells
from .components import components
from .match import NEAR


def _fine(lat: Column, lon: Column, high: float) -> list[Column]:
    """Row and column of the cell whose diagonal is the limit: sides of the limit by the root of two."""
    row = F.floor(lat / high)
    near_equator = F.least(F.abs(row), F.abs(row + 1)) * high
    wide = high / F.cos(F.radians(F.least(near_equator, F.lit(89.999))))
    return [row.alias("row"), F.floor((lon + 180) / wide).alias("column")]


def _linked(points: DataFrame, other: DataFrame, cells: Cells) -> DataFrame:
    """Pairs (a, b) of cell names with a point of ``points`` near a point of ``other``, a below b."""
    x = points.select(F.col("name").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.explode(cells.around(F.col("lat"), F.col("lon"))).alias("cell"), *(["root_a"] if "root_a" in points.columns else []))
    y = other.select(F.col("name").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), cells.cell(F.col("lat"), F.col("lon")).alias("cell"), *(["root_b"] if "root_b" in other.columns else []))
    near = distance(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"), cells.radius, cells.wrap) <= cells.limit
    apart = F.col("root_a") < F.col("root_b") if "root_a" in points.columns else F.col("a") < F.col("b")
    return x.join(y, (x["cell"] == y["cell"]) & apart & near).select("a", "b").distinct()


def near_clusters(points: DataFrame, limit: float = NEAR, radius: float = NM, wrap: bool = False) -> DataFrame:
    """(id, cluster) of ``points`` (id, lat, lon): the smallest id that steps of at most ``limit`` lead to."""
    cells = Cells(limit, radius, wrap)
    known = points.filter("id is not null and not isnan(lat) and not isnan(lon) and lat is not null and lon is not null")
    placed = known.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    placed = placed.select("*", *_fine(F.col("lat"), F.col("lon"), cells.high / math.sqrt(2)))
    cell = ["row", "column"]
    corner = lambda f, c: f(F.struct("lat", "lon"), F.col(c))
    named = store(placed.groupBy(*cell).agg(F.min("id").alias("name"), F.array_distinct(F.array(*(corner(f, c) for f in (F.min_by, F.max_by) for c in ("lat", "lon")))).alias("outer")), "cells")
    outer = named.select("name", F.inline("outer"))
    first, _ = components(_linked(outer, outer, cells))
    roots = store(named.select(*cell, "name").join(first.withColumnRenamed("id", "name"), "name", "left").select(*cell, "name", F.coalesce("root", "name").alias("root")), "cells")
    # A cell without a cell of another root around it is done; the points of the others meet.
    positions = store(placed.select(*cell, "lat", "lon").distinct().join(roots, cell).select("name", "lat", "lon", "root"), "positions")
    touched = _touching(positions, cells)
    left = store(positions.join(touched, "name", "left_semi"), "positions")
    more = _linked(left.withColumnRenamed("root", "root_a"), left.withColumnRenamed("root", "root_b"), cells)
    links = first.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).union(more)
    final, _ = components(links)
    clusters = roots.select(*cell, "name").join(final.withColumnRenamed("id", "name"), "name", "left").select(*cell, F.coalesce("root", "name").alias("cluster"))
    found = placed.join(clusters, cell).select("id", "cluster").distinct()
    return points.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def _touching(positions: DataFrame, cells: Cells) -> DataFrame:
    """Names of those cells that have a position in a coarse cell (three by three of them) where several roots are."""
    around = positions.select("name", "root", F.explode(cells.around(F.col("lat"), F.col("lon"))).alias("cell")).distinct()
    several = around.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("cell")
    return around.join(several, "cell", "left_semi").select("name").distinct()


def deduplicate_near(points: DataFrame, limit: float = NEAR, radius: float = NM, wrap: bool = False, preferred_only: bool = False) -> DataFrame:
    """Of each cluster the row that was updated last stays (ties: the last id); ``preferred_only`` leaves out those that had no double."""
    rows = points.join(near_clusters(points, limit, radius, wrap), "id", "left")
    at = F.coalesce("last_updated", F.lit("1900-01-01").cast("timestamp"))
    whole = F.struct(*points.columns)
    own = F.coalesce(F.col("cluster").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id()))
    best = rows.groupBy(own.alias("cluster_")).agg(F.count(F.lit(1)).alias("n"), F.max_by(whole, F.struct(at, "id")).alias("row_"))
    return (best.filter("n > 1") if preferred_only else best).select("row_.*")
