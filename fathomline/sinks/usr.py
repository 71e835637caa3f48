"""USR files (format 6) from nested rows: the inverse of ``sources.usr``."""

from __future__ import annotations

import datetime
import math
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import POLAR
from ..sources.usr import LAYOUT, ROUTE, WAYPOINT

# What a field has that the row leaves out.
USUAL = {"format": 6, "data_stream_version": 10, "unknown": -1, "waypt_stream_version": 2, "route_stream_version": 1, "unknown_2": -1, "alarm_radius": 0.0, "depth": 0.0, "LORAN_GRI": -1}


# What a code of a fixed size that isn't a struct code stands for: struct code, what is packed of a value, and of none.
FIXED = {
    "uuid": ("16s", lambda x: uuid.UUID(x).bytes_le if x else bytes(16), bytes(16)),
    "date": ("I", lambda x: (x - datetime.date(1970, 1, 1)).days + 2440588 if x else 2440588, 2440588),
    "lon": ("i", lambda x: round(math.radians(x or 0.0) * POLAR), 0),
    "lat": ("i", lambda x: round(math.log(math.tan(math.pi / 4 + math.radians(x or 0.0) / 2)) * POLAR), 0),
    "10x": ("10s", lambda x: bytes(10), bytes(10)),
    "ms": ("I", lambda x: x or 0, 0),
}


def _varying(code) -> Callable[[Any], bytes]:
    """What makes the bytes of a text or list."""
    if code == "#uuid":
        return lambda ids: struct.pack("<i", len(ids := list(ids) if ids is not None else [])) + b"".join(uuid.UUID(x).bytes_le for x in ids)
    if isinstance(code, list):
        pack = packer(code)
        return lambda rows: struct.pack("<i", len(rows := list(rows) if rows is not None else [])) + b"".join(pack(x) for x in rows)
    return lambda value: struct.pack("<i", len(data := ("" if value is None else value).encode(code[2:]))) + data


def packer(layout: list) -> Callable[[dict], bytes]:
    """What makes a record's bytes; fields that it lacks have their usual values. Fields of fixed size that stand one behind the other are packed at once."""
    runs: list[tuple[str, list] | tuple[None, tuple]] = []
    for fixed, fields in groupby(layout, lambda f: not isinstance(f[1], list) and f[1] != "#uuid" and not f[1].startswith("s:")):
        if fixed:
            some = [(name, FIXED.get(code) or (code, lambda x: x or 0, 0)) for name, code in fields]
            usual = lambda name, convert, none: none if USUAL.get(name) is None else convert(USUAL[name])
            runs.append(("<" + "".join(code for _, (code, _, _) in some), [(name, convert, usual(name, convert, none)) for name, (_, convert, none) in some]))
        else:
            runs += [(None, (name, _varying(code))) for name, code in fields]

    def pack(record: dict) -> bytes:
        get = record.get
        return b"".join(struct.pack(code, *[none if (x := get(name)) is None else convert(x) for name, convert, none in part]) if code else part[1](get(part[0])) for code, part in runs)

    return pack


def encode(record: dict, layout: list = LAYOUT) -> bytes:
    """A record's bytes; fields that it lacks have their usual values."""
    return packer(layout)(record)


def usr_content(title: Column, waypoints: Column, routes: Column) -> Column:
    """The bytes of a file from its title and its arrays of waypoints and routes (structs with fields of the layout)."""

    @F.pandas_udf("binary")
    def run(title: pd.Series, waypoints: pd.Series, routes: pd.Series) -> pd.Series:
        return pd.Series([encode({"file_title": t, "waypoints": w, "routes": r}) for t, w, r in zip(title, waypoints, routes)])

    return run(title, waypoints, routes)


def _records(rows: pa.StructArray) -> Iterator[dict]:
    """``to_pylist`` of structs, their texts and numbers by numpy: a fourth of its time."""
    plain = lambda x: pa.types.is_string(x.type) or x.null_count == 0 and (pa.types.is_integer(x.type) or pa.types.is_floating(x.type))
    columns = [x.to_numpy(zero_copy_only=False).tolist() if plain(x) else x.to_pylist() for x in rows.flatten()]
    return (dict(zip(rows.type.names, row)) for row in zip(*columns))


def record_bytes(record: Column, layout: list) -> Column:
    """The bytes of a struct with fields of the layout."""

    @F.arrow_udf("binary")
    def run(records: pa.Array) -> pa.Array:
        pack = packer(layout)
        return pa.array(map(pack, _records(records)), pa.binary())

    return run(record)


def usr_pieces(files: DataFrame, waypoints: DataFrame, routes: DataFrame, legs: DataFrame) -> DataFrame:
    """Files as pieces (source_file, place, content), whose bytes by ``place`` one behind the other are the file. No row holds more than a record, however much a file has.

    ``files`` has source_file and fields of the layout's beginning; ``waypoints`` and ``routes`` have source_file, seq (their order) and fields of theirs; ``legs`` has source_file,
    route (the route's seq), seq and uuid.
    """
    number = lambda rows, name, *keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias(name))
    record = lambda rows, fields: record_bytes(F.struct(*(x for x, _ in fields if x in rows.columns)), fields)
    place = lambda part, route=0, of_route=0, seq=0: F.struct(F.lit(part).alias("part"), *(F.coalesce(x if isinstance(x, Column) else F.lit(x), F.lit(0)).cast("long").alias(n) for n, x in (("route", route), ("of_route", of_route), ("seq", seq))))
    piece = lambda rows, place, content: rows.select("source_file", place.alias("place"), content.alias("content"))

    names = [name for name, _ in LAYOUT]
    first, last = LAYOUT[: names.index("waypoints")], LAYOUT[names.index("routes") + 1 :]
    k = [name for name, _ in ROUTE].index("leg_uuids")
    counts = files.join(number(waypoints, "number_waypoints", "source_file"), "source_file", "left").join(number(routes, "number_routes", "source_file"), "source_file", "left")
    routed = routes.join(number(legs, "number_legs", "source_file", F.col("route").alias("seq")), ["source_file", "seq"], "left")
    parts = [
        piece(counts, place(0), record(counts, [*first, ("number_waypoints", "i")])),
        piece(waypoints, place(1, seq=F.col("seq")), record(waypoints, WAYPOINT)),
        piece(counts, place(2), record(counts, [("number_routes", "i")])),
        piece(routed, place(3, F.col("seq"), 0), record(routed, [*ROUTE[:k], ("number_legs", "i")])),
        piece(legs, place(3, F.col("route"), 1, F.col("seq")), record(legs, [("uuid", "uuid")])),
        piece(routed, place(3, F.col("seq"), 2), F.lit(encode({}, ROUTE[k + 1 :]))),
        piece(counts, place(4), F.lit(encode({}, last))),
    ]
    return reduce(DataFrame.unionByName, parts)
