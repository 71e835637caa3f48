"""Chartplotter USR files (format 6): a binary layout with lengths and counts inside.

The layout is data (``LAYOUT``), compiled by ``layout`` to a schema and a decoder. Spark hands the files over
by its binaryFile source; an Arrow function decodes each to nested rows. Icons become symbols
by a join with the table of those seen in practice.
"""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import POLAR
from .layout import Field, Layout, Repeat, text

# Field name and struct code in file order; "s:" text with its length before it, "#" a counted list.
HEADER = [("format", "I"), ("data_stream_version", "I"), ("file_title", "s:ascii"), ("file_creation_date_text", "s:ascii"), ("file_creation_date", "date"), ("file_creation_time", "ms"), ("unknown", "b"), ("unit_serial_number", "I"), ("file_description", "s:ascii")]
WAYPOINT = [("uuid", "uuid"), ("UID_unit_number", "I"), ("UID_sequence_number", "Q"), ("waypt_stream_version", "h"), ("waypt_name", "s:utf-16-le"), ("UID_unit_number_2", "I"), ("longitude", "lon"), ("latitude", "lat"), ("flags", "I"), ("icon_id", "h"), ("color_id", "h"), ("waypt_description", "s:utf-16-le"), ("alarm_radius", "f"), ("waypt_creation_date", "date"), ("waypt_creation_time", "ms"), ("unknown_2", "b"), ("depth", "f"), ("LORAN_GRI", "i"), ("LORAN_Tda", "i"), ("LORAN_Tdb", "i")]
ROUTE = [("uuid", "uuid"), ("UID_unit_number", "I"), ("UID_sequence_number", "Q"), ("route_stream_version", "h"), ("route_name", "s:utf-16-le"), ("UID_unit_number_3", "I"), ("leg_uuids", "#uuid"), ("route_unknown", "10x")]
LAYOUT = [*HEADER, ("waypoints", WAYPOINT), ("routes", ROUTE), ("number_event_markers", "i"), ("number_trails", "i")]
# Symbols by icon and colour number.
ICONS = [(3, 0, "anchor"), (2, 0, "diamond,blue"), (1, 6, "circle,white"), (0, 0, "cross,blue"), (0, 3, "cross,yellow"), (10, 4, "rocksubmerged"), (12, 6, "rock"), (21, 2, "flag"), (28, 0, "warning"), (13, 3, "portlateralmarker"), (13, 4, "portlateralmarker"), (1, 4, "circle,green")]


def _uuid(raw: bytes) -> str:
    x = raw.hex()  # as str(uuid.UUID(bytes_le=raw)), in a fourth of its time
    return f"{x[6:8]}{x[4:6]}{x[2:4]}{x[:2]}-{x[10:12]}{x[8:10]}-{x[14:16]}{x[12:14]}-{x[16:20]}-{x[20:]}"


# What a code other than a struct code stands for: struct code, conversion, SQL type.
CONVERSIONS = {
    "uuid": ("16s", _uuid, "string"),
    "date": ("I", lambda n: datetime.date(1970, 1, 1) + datetime.timedelta(days=n - 2440588), "date"),
    "ms": ("I", None, None),
    "lon": ("i", lambda x: round(math.degrees(x / POLAR), 8), "double"),
    "lat": ("i", lambda y: round(math.degrees(2 * math.atan(math.exp(y / POLAR)) - math.pi / 2), 8), "double"),
    "Q": ("Q", Decimal, None),
}


def compiled(layout: list) -> tuple[Field | Repeat, ...]:
    """The fields of a layout such as ``LAYOUT``; counts and lengths are fields that are not given."""
    out: list[Field | Repeat] = []
    for name, code in layout:
        if isinstance(code, list) or code == "#uuid":
            fields = compiled(code) if isinstance(code, list) else (Field(name, *CONVERSIONS["uuid"]),)
            out += [Field(f"_number_{name}", "i"), Repeat(name, fields, f"_number_{name}")]
        elif code.startswith("s:"):
            out += text(name, code[2:])
        elif code == "10x":
            out.append(Field(f"_{name}", "10s"))
        else:
            out.append(Field(name, *CONVERSIONS.get(code, (code,))))
    return tuple(out)


def _format(data: bytes) -> str | None:
    if len(data) < 4:
        return None
    number = int.from_bytes(data[:4], "little")
    return None if number == 6 else f"format {number} is not read" if 2 <= number <= 5 else f"unknown format {number}"


USR = Layout(compiled(LAYOUT), _format)


def decode(data: bytes) -> dict:
    """All fields of a file; formats other than 6 and broken files are an error."""
    record, problem = USR.decode(data)
    if problem == _format(data) and problem:
        raise NotImplementedError(problem) if "not read" in problem else ValueError(problem)
    if problem and not problem.endswith("after the last field"):
        raise ValueError(problem)
    return record


def decode_files(files: DataFrame) -> DataFrame:
    """One row per file of (source_file, content): source_file, the nested record, and ``problem``: null, or why and where the file can't be read to its end
    (what stands before that place is given), or how many bytes follow its last field."""
    return USR.read(files)


def read_usr(spark: SparkSession, path: str) -> DataFrame:
    return decode_files(spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"), "content"))


def with_symbol(rows: DataFrame) -> DataFrame:
    """Add sym from icon_id and color_id; pairs not in the table become ``icon,color``."""
    icons = rows.sparkSession.createDataFrame(ICONS, "icon_id int, color_id int, known string")
    joined = rows.join(F.broadcast(icons), ["icon_id", "color_id"], "left")  # twelve rows
    return joined.withColumn("sym", F.coalesce("known", F.concat_ws(",", "icon_id", "color_id"))).drop("known")


def _waypoints(points: DataFrame) -> DataFrame:
    at = F.timestamp_micros(F.unix_micros(F.col("waypt_creation_date").cast("timestamp")) + F.col("waypt_creation_time") * 1000)
    return with_symbol(points).select("source_file", "seq", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("waypt_name").alias("name"), F.col("waypt_description").alias("description"), "sym", at.alias("last_updated"), "uuid")


def _legs(legs: DataFrame, points: DataFrame) -> DataFrame:
    return legs.join(points.select("source_file", "uuid", "name", "lat", "lon"), ["source_file", "uuid"], "left")


def usr_waypoints(usr: DataFrame) -> DataFrame:
    """source_file, seq, lat, lon, name, description, sym, last_updated, uuid."""
    return _waypoints(usr.select("source_file", F.posexplode("waypoints").alias("seq", "w")).select("source_file", "seq", "w.*"))


def usr_routes(usr: DataFrame) -> DataFrame:
    """source_file, route, seq, uuid and the waypoint's name and position, in leg order; a leg whose waypoint is missing has nulls."""
    legs = usr.select("source_file", F.inline("routes")).select("source_file", F.col("route_name").alias("route"), F.posexplode("leg_uuids").alias("seq", "uuid"))
    return _legs(legs, usr_waypoints(usr))


def _read_legs(read: DataFrame) -> DataFrame:
    return read.select("source_file", F.col("routes.route_name").alias("route"), "seq", F.col("leg_uuids").alias("uuid"))


def waypoints_of_files(files: DataFrame) -> DataFrame:
    """``usr_waypoints`` of (source_file, content), record by record: no row holds a file's waypoints."""
    return _waypoints(USR.read_each(files, "waypoints"))


def routes_of_files(files: DataFrame) -> DataFrame:
    """``usr_routes`` of (source_file, content), leg by leg."""
    return _legs(_read_legs(USR.read_each(files, "routes.leg_uuids")), waypoints_of_files(files))


def waypoints_of_pieces(pieces: DataFrame) -> DataFrame:
    """``waypoints_of_files`` of files in pieces, such as ``sinks.usr.usr_pieces`` makes: no row holds a file's bytes either."""
    return _waypoints(USR.read_pieces(pieces, "waypoints"))


def routes_of_pieces(pieces: DataFrame) -> DataFrame:
    """``routes_of_files`` of files in pieces."""
    points = USR.read_pieces(pieces, "waypoints", ["uuid", "waypt_name", "latitude", "longitude"])
    return _legs(_read_legs(USR.read_pieces(pieces, "routes.leg_uuids")), points.select("source_file", "uuid", F.col("waypt_name").alias("name"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")))


def hex_lines(files: DataFrame, width: int = 16) -> DataFrame:
    """source_file, offset, hex, text: the bytes of each file, ``width`` a line; what can't be printed is a dot."""
    pairs = F.regexp_replace(F.lower(F.hex("content")), "(..)", "$1 ")
    offsets = F.sequence(F.lit(0), F.greatest(F.octet_length("content") - 1, F.lit(0)), F.lit(width))
    rows = files.filter(F.octet_length("content") > 0).select("source_file", pairs.alias("pairs"), F.decode("content", "ISO-8859-1").alias("letters"), F.explode(offsets).alias("offset"))
    line = F.trim(F.substring("pairs", F.col("offset") * 3 + 1, F.lit(3 * width)))
    text = F.regexp_replace(F.substring("letters", F.col("offset") + 1, F.lit(width)), r"[^\x20-\x7e]", ".")
    return rows.select("source_file", "offset", line.alias("hex"), text.alias("text"))


def little_endian(content: Column) -> Column:
    """The whole number of up to seven bytes, the lowest first."""
    digits = F.split(F.regexp_replace(F.hex(content), "(..)", "$1 "), " ")
    return F.aggregate(F.reverse(F.filter(digits, lambda x: x != "")), F.lit(0).cast("long"), lambda acc, x: acc * 256 + F.conv(x, 16, 10).cast("long"))


def layout_table(spark: SparkSession, layout: Layout = USR) -> DataFrame:
    """name, format, size of every field; nested names are joined by `` - ``, and lengths and counts are fields of their own."""
    return spark.createDataFrame([tuple(x.replace("{_", "{").removeprefix("_").replace(" - _", " - ") for x in row) for row in layout.table()], "name string, format string, size string")


def icon_source(lines: DataFrame) -> DataFrame:
    """icon_id, color_id, sym of the lines (value) of a C table of icons: a line of it names an icon, its symbol, and its colours in order; others are left out."""
    p = r'^\s+\{\s+(\d+),\s+"([\w\s]+)",\s+\{(.+)\}\},\s+//.*$'
    rows = lines.filter(F.regexp_like("value", F.lit(p))).select(F.regexp_extract("value", p, 1).cast("int").alias("icon_id"), F.regexp_extract("value", p, 2).alias("symbol"), F.regexp_extract_all(F.regexp_extract("value", p, 3), F.lit(r'"(\w+)"'), F.lit(1)).alias("colors"))
    return rows.select("icon_id", "symbol", F.posexplode("colors").alias("color_id", "color")).select("icon_id", "color_id", F.concat_ws(",", "symbol", "color").alias("sym"))
