"""Track logs and routes in CSV, and the two-part route table text."""

from __future__ import annotations

import csv
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.angle import parse_angle
from ..functions.clock import parse_datetime, parse_duration
from .records import csv_records

# The columns of a log without a header, in order.
PLAIN_LOG = ["date", "latitude", "longitude", "cog", "sog", "heading", "speed", "depth", "windAngle", "windSpeed", "comment"]
LEG = ["Leg", "To waypoint", "Distance", "Bearing", "Latitude", "Longitude", "ETE", "ETA", "Speed", "Next tide event", "Description", "Course", "ETD"]


def match_header(names: list[str]) -> tuple[str, str, str] | None:
    """The names of the date, latitude and longitude columns: exact, or by beginning, whatever the case."""
    if {"date", "latitude", "longitude"} <= set(names):
        return "date", "latitude", "longitude"
    found = [next((n for n in names if n.strip().lower().startswith(b)), None) for b in ("date", "lat", "lon")]
    found[0] = found[0] or next((n for n in names if n.strip().lower().startswith("time")), None)
    return tuple(found) if all(found) else None


def cells_of(record: str) -> list[str | None]:
    """The cells of a CSV record, quotes resolved; empty ones, and all of what is no CSV, are null."""
    csv.field_size_limit(sys.maxsize)
    try:
        return [c.strip() or None for c in next(csv.reader(record.splitlines(keepends=True)), [])]
    except csv.Error:
        return []


def _layout(head: str) -> tuple[bool, list[tuple[str, int]], tuple[int, int, int]]:
    """Of a file's first record: whether it is a header, the names of the columns with their places, and the places of date, latitude and longitude.
    A name that stands twice keeps its number the second time."""
    cells = cells_of(head)
    found = match_header([c for c in cells if c])
    if not found:
        return False, list(zip(PLAIN_LOG, range(len(PLAIN_LOG)))), (0, 1, 2)
    names = [(c if cells.index(c) == k else f"{c}_{k + 1}", k) for k, c in enumerate(cells) if c]
    return True, names, tuple(cells.index(c) for c in found)


LOG_ROW = "source_file string, seq long, date_text string, lat_text string, lon_text string, source_row map<string, string>"


def _log_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    layouts: dict[str, tuple] = {}
    names = [x.split()[0] for x in LOG_ROW.split(", ")[:5]] + ["source_row"]
    for batch in batches:
        out = []
        for file, seq, value, head in zip(*(batch.column(c).to_pylist() for c in ("source_file", "seq", "value", "head"))):
            if head not in layouts:
                if len(layouts) > 1_000:
                    layouts.clear()
                layouts[head] = _layout(head)
            has_header, columns, places = layouts[head]
            if seq or not has_header:
                cells = cells_of(value)
                get = lambda k: cells[k] if k < len(cells) else None
                out.append((file, seq - has_header, *map(get, places), [(name, get(k)) for name, k in columns]))
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 3, pa.map_(pa.string(), pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out)) or [[]] * 6, kinds)], names=names)


def read_track_log(spark: SparkSession, path: str, default_date: str = "1970-01-01") -> DataFrame:
    """source_file, seq, time, lat, lon, source_row (map), ok. Each file's first record decides for that file: if it names date (or time), latitude
    and longitude it is a header, whatever their order; else the columns are the fixed eleven. Quoted cells may hold line breaks. Rows that can't be read have ok false."""
    rows = csv_records(spark, path).mapInArrow(_log_rows, LOG_ROW)
    read = F.struct(parse_datetime(F.col("date_text"), F.lit(default_date).cast("date")).alias("time"), parse_angle(F.col("lat_text")).alias("lat"), parse_angle(F.col("lon_text")).alias("lon"))
    # Behind the generator the three are columns already computed: a filter on them doesn't parse again.
    out = rows.select("source_file", "seq", F.inline(F.array(read)), "source_row")
    return out.withColumn("ok", F.col("time").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {".csv": read_track_log}


def register_reader(ending: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Files whose names end so are read by ``reader`` from now on; it gives time, lat and lon among its columns."""
    READERS[ending.lower()] = reader


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A track by the reader of its file's ending."""
    found = [r for ending, r in READERS.items() if path.lower().rstrip("/").endswith(ending)]
    if not found:
        raise ValueError(f"no reader for {path}; known endings: {', '.join(sorted(READERS))}")
    return found[0](spark, path)


def good(log: DataFrame) -> DataFrame:
    return log.filter("ok").drop("ok")


def rejected(log: DataFrame) -> DataFrame:
    """The rows that were skipped, as they stood in the file."""
    return log.filter(~F.col("ok")).select("source_file", "seq", "source_row")


ROUTE_ROW = "source_file string, seq long, value string, cells array<string>"


def _route_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = pa.array([cells_of(x) for x in batch.column("value").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("source_file", "seq", "value")), cells], names=["source_file", "seq", "value", "cells"])


def read_route_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """source_file, seq, name, lat, lon, description from four columns without a header. Other shapes and angles
    that can't be read are an error; without ``strict`` such angles are null."""
    rows = csv_records(spark, path).mapInArrow(_route_rows, ROUTE_ROW)
    shape = F.size("cells") != 4

    def angle(k: int) -> Column:
        text = F.get("cells", F.lit(k))
        value = parse_angle(text)
        return F.when(value.isNull(), F.raise_error(F.concat(F.lit("cannot read the angle "), F.coalesce(text, F.lit("null"))))).otherwise(value) if strict else value

    name = F.when(shape, F.raise_error(F.concat(F.lit("not four columns: "), "value"))).otherwise(F.get("cells", F.lit(0)))
    return rows.select("source_file", "seq", name.alias("name"), angle(1).alias("lat"), angle(2).alias("lon"), F.coalesce(F.get("cells", F.lit(3)), F.lit("")).alias("description"))


def route_tables(texts: DataFrame) -> DataFrame:
    """Of (source_file, value: whole text): source_file, title, summary (map), leg_lines (array, the first is the header)."""
    lines = F.transform(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n"), lambda x: F.rtrim(x))
    df = texts.withColumn("lines_", lines)
    lead = F.coalesce(F.array_position(F.transform("lines_", lambda x: x != ""), F.lit(True)), F.lit(1))
    df = df.withColumn("lines_", F.slice("lines_", lead, F.size("lines_")))
    blank = F.array_position(F.transform("lines_", lambda x: x == ""), F.lit(True)).cast("int")
    df = df.withColumn("head_", F.slice("lines_", F.lit(1), blank - 1)).withColumn("legs_", F.filter(F.slice("lines_", blank + 1, F.size("lines_")), lambda x: x != ""))
    pairs = F.filter("head_", lambda x: F.contains(x, F.lit("\t")))
    entry = F.transform(pairs, lambda x: F.struct(F.get(F.split(x, "\t"), 0).alias("k"), F.trim(F.get(F.split(x, "\t"), 1)).alias("v")))
    title = F.coalesce(F.get(F.filter("head_", lambda x: ~F.contains(x, F.lit("\t"))), 0), F.lit(""))
    return df.select("source_file", title.alias("title"), F.map_from_entries(entry).alias("summary"), F.col("legs_").alias("leg_lines"))


def read_route_table(spark: SparkSession, path: str) -> DataFrame:
    return route_tables(spark.read.text(path, wholetext=True).withColumn("source_file", F.input_file_name()))


def route_legs(tables: DataFrame, include_leg0: bool = False) -> DataFrame:
    """Typed legs of route tables: source_file, seq and the leg's columns. Leg 0 (``---``) is the way to the
    start and is left out unless asked for."""
    header = F.split(F.get("leg_lines", 0), "\t")
    places = F.struct(*(F.array_position("header", F.lit(name)).cast("int").alias(f"c{k}") for k, name in enumerate(LEG)))
    tables = tables.withColumn("header", header).withColumn("places", places)
    lines = F.transform(F.slice("leg_lines", F.lit(2), F.greatest(F.size("leg_lines"), F.lit(1))), lambda x: F.split(x, "\t"))
    rows = tables.select("source_file", "places", F.posexplode(lines).alias("seq", "cells"))

    def cell(k: int, name: str) -> Column:
        at = F.col("places").getField(f"c{k}")
        return F.when(at == 0, F.raise_error(F.lit(f"the table has no column {name}"))).otherwise(F.trim(F.get("cells", at - 1))).alias(name)

    def add(df: DataFrame, *values: Column) -> DataFrame:
        """Columns behind a generator: they are computed there, once, and in code of their own, which the JVM compiles where one piece for all columns would be too long."""
        return df.select("*", F.inline(F.array(F.struct(*values))))

    number = lambda name, p: F.regexp_extract(name, p, 1).try_cast("double")
    eta = r"^(?:Start: )?(.{16})\s\((\w+)\)"
    rows = rows.select("source_file", "seq", F.inline(F.array(F.struct(*(cell(LEG.index(x), x) for x in LEG if x != "ETD")))))
    rows = add(rows, parse_angle(F.col("Latitude")).alias("lat"))
    rows = add(rows, parse_angle(F.col("Longitude")).alias("lon"))
    rows = add(rows, number("Distance", r"^\s*(\d+\.?\d*)\s\w+").alias("distance_"), number("Bearing", r"^\s*(\d+)\s.\w+").alias("bearing_"))
    rows = add(rows, parse_duration(F.col("ETE")).alias("ete_seconds"))
    rows = add(rows, F.regexp_extract("ETA", eta, 1).alias("eta_"), F.regexp_extract("ETA", eta, 2).alias("eta_summary"), F.when(F.col("Course") != "Arrived", number("Course", r"^\s*(\d+)\s.\w+")).alias("course_"))
    legs = rows.select(
        "source_file",
        "seq",
        F.when(F.col("Leg") == "---", 0).otherwise(F.col("Leg").try_cast("int")).alias("leg"),
        F.col("To waypoint").alias("name"),
        "lat",
        "lon",
        F.col("Description").alias("description"),
        F.col("distance_").alias("distance"),
        F.col("bearing_").alias("bearing"),
        "ete_seconds",
        F.try_to_timestamp("eta_", F.lit("MM/dd/yyyy HH:mm")).alias("eta"),
        "eta_summary",
        F.col("Speed").try_cast("double").alias("speed"),
        F.col("Next tide event").alias("tide"),
        F.col("course_").alias("course"),
    )
    return legs if include_leg0 else legs.filter("leg <> 0")


def printed_legs(legs: DataFrame) -> DataFrame:
    """Legs under the names they have in a route table, in its order, as far as a leg has them."""
    own = dict(zip(LEG, ["leg", "name", "distance", "bearing", "lat", "lon", "ete_seconds", "eta", "speed", "tide", "description", "course"]))
    return legs.select("source_file", *(F.col(c).alias(n) for n, c in own.items()))
