"""GPX tracks, routes and waypoints.

A document is cut as text where its points begin, so it is read split by split, however large it is. Which track or route a point is of, and its number there, depends on all
before it: each split's points are counted by track as it is scanned, and only the counts (as many as splits and tracks) are combined in the order of the file. A document in which
such a cut could be none, because a comment or CDATA section goes over it, is read by Spark's XML source, a track or route at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import settle

POINT = "_lat string, _lon string, time string, name string, desc string, description string, sym string, type string"


def _xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(schema).load(path)
    return df.withColumns({"source_file": F.input_file_name(), "place_": F.monotonically_increasing_id()})


def _required(value: Column, what: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(f"a point has no valid {what}"))).otherwise(value)


def _point(p: str) -> list[Column]:
    return [
        _required(F.col(f"{p}._lat").try_cast("double"), "lat").alias("lat"),
        _required(F.col(f"{p}._lon").try_cast("double"), "lon").alias("lon"),
    ]


def _numbered(df: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy("source_file").orderBy(*by)
    return df.withColumn("seq", F.row_number().over(w) - 1).drop(*by)


COMMENT = re.compile(r"<!--.*?-->", re.S)
WHOLE = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>", re.S)
PIECES = "source_file string, block long, line int, at long, value string, name string, odd boolean"
RUNS = 100_000


def _line_name(text: str) -> str | None:
    """The name of a track or route, of which ``text`` is the beginning."""
    prefixes = sorted(set(re.findall(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]", text)) - {"xml", "xmlns"})
    parser = ElementTree.XMLPullParser(["start", "end"])
    depth = 0
    try:
        parser.feed("<all" + "".join(f' xmlns:{p}="{p}"' for p in prefixes) + ">" + text)
        parser.flush()
    except ElementTree.ParseError:
        pass
    try:
        for event, e in parser.read_events():
            depth += 1 if event == "start" else -1
            if event == "end" and depth == 2 and e.tag == "name":
                return "".join(e.itertext()).strip()
    except ElementTree.ParseError:
        pass
    return None


def _pieces(line: str):
    """Scan pieces of text that begin with a point each: the points, with the number of their track or route (``line``: 0 is the one that goes on from the split before) and their
    own number in it, and for each track or route that begins a row without ``value``. ``odd``: the piece's end may not be a point's beginning."""
    begins = re.compile(rf"<{line}(?=[\s/>])")
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, count = None, 0, 0
        for batch in batches:
            n, values, files = batch.num_rows, batch.column("value"), batch.column("source_file")
            if not n:
                continue
            blocks = batch.column("block").to_numpy()
            look = pc.or_(pc.match_substring(values, f"<{line}"), pc.match_substring(values, "<!")).to_numpy(zero_copy_only=False).copy()
            look[1:] |= (blocks[1:] != blocks[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
            look[0] = True
            numbers, at, is_point = np.zeros(n, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
            odd = ~pc.is_in(pc.utf8_slice_codeunits(values, 0, 1), pa.array(list(" \t\r\n/>"))).to_numpy(zero_copy_only=False)
            begun = []
            stops = np.flatnonzero(look).tolist()
            for a, b in zip(stops, [*stops[1:], n]):
                split, text = (files[a].as_py(), int(blocks[a])), values[a].as_py()
                if split != current:
                    current, number, count = split, 0, 0
                    if split[1] == 0:  # what stands before the file's first point
                        is_point[a] = odd[a] = False
                numbers[a], at[a] = number, count
                count += int(is_point[a])
                if "<!" in text:
                    odd[a] |= re.search(r"<!--|<!\[CDATA\[", WHOLE.sub("", text)) is not None
                    text = COMMENT.sub("", text)
                for m in begins.finditer(text):
                    number, count = number + 1, 0
                    begun.append((*split, number, -1, None, _line_name(text[m.start() :]), bool(odd[a])))
                if odd[a] and not is_point[a]:
                    begun.append((*split, number, -1, None, None, True))
                numbers[a + 1 : b], at[a + 1 : b] = number, np.arange(count, count + b - a - 1)
                count += b - a - 1
            rows = [files, batch.column("block"), pa.array(numbers), pa.array(at), values, pa.nulls(n, pa.string()), pa.array(odd)]
            yield pa.RecordBatch.from_arrays(rows, names=names).filter(pa.array(is_point))
            if begun:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*begun), kinds)], names=names)

    return run


def _points(spark: SparkSession, path: str, line: str, point: str, joined: bool) -> DataFrame | None:
    """source_file, line (its name), seq, p (the point's element); nothing if a document has to be read as a whole."""
    text = spark.read.text(path, lineSep=f"<{point}").select(F.input_file_name().alias("source_file"), F.expr("input_file_block_start()").alias("block"), "value")
    pieces = text.mapInArrow(_pieces(line), PIECES)
    runs = settle(pieces.groupBy("source_file", "block", "line").agg(F.count("value").alias("n"), F.max("name").alias("name"), F.max("odd").alias("odd")))
    if not runs.filter("odd").isEmpty():
        return None
    in_file = Window.partitionBy("source_file").orderBy("block", "line")
    runs = runs.withColumn("of", F.last(F.when(F.col("line") > 0, F.struct("name")), ignorenulls=True).over(in_file)).filter("of is not null")
    order = Window.partitionBy("of").orderBy("source_file", "block", "line") if joined else in_file
    runs = settle(runs.select("source_file", "block", "line", "of", (F.sum("n").over(order) - F.col("n")).alias("base")))
    few = runs.count() <= RUNS
    element = F.concat(F.lit(f"<{point}"), F.regexp_extract("value", rf"(?s)\A(?:[^>]*/>|.*?</{point}\s*>)", 0))
    rows = pieces.filter("value is not null").join(F.broadcast(runs) if few else runs, ["source_file", "block", "line"])
    return rows.select("source_file", F.col("of.name").alias("line"), (F.col("base") + F.col("at")).alias("seq"), F.from_xml(element, POINT, {"ignoreNamespace": "true"}).alias("p"))


def _whole(points: DataFrame, line: str, by: list[str], joined: bool) -> DataFrame:
    return points.withColumn("seq", F.row_number().over(Window.partitionBy(line if joined else "source_file").orderBy("source_file", *by)) - 1).drop(*by)


def read_tracks(spark: SparkSession, path: str, joined: bool = False) -> DataFrame:
    """source_file, seq, track (its name), lat, lon, time. Segments follow each other without a break; a point without
    position or time is an error. ``seq`` counts in each file; if ``joined``, tracks of one name are one track, through all files in the order of their names, and it counts there."""
    points = _points(spark, path, "trk", "trkpt", joined)
    time = _required(F.try_to_timestamp("p.time"), "time").alias("time")
    if points is not None:
        return points.select("source_file", F.col("line").alias("track"), *_point("p"), time, "seq")
    rows = _xml(spark, path, "trk", f"name string, trkseg array<struct<trkpt: array<struct<{_struct(POINT)}>>>>")
    segments = rows.select("source_file", "place_", F.col("name").alias("track"), F.posexplode("trkseg").alias("s_", "seg"))
    points = segments.select("source_file", "place_", "track", "s_", F.posexplode("seg.trkpt").alias("p_", "p"))
    return _whole(points.select("source_file", "place_", "s_", "p_", "track", *_point("p"), time), "track", ["place_", "s_", "p_"], joined)


def read_routes(spark: SparkSession, path: str, joined: bool = False) -> DataFrame:
    """source_file, seq, route (its name), name, lat, lon, description (from desc or description); ``seq`` and ``joined`` as in ``read_tracks``."""
    points = _points(spark, path, "rte", "rtept", joined)
    own = [F.col("p.name").alias("name"), *_point("p"), F.coalesce("p.desc", "p.description", F.lit("")).alias("description")]
    if points is not None:
        return points.select("source_file", F.col("line").alias("route"), *own, "seq")
    rows = _xml(spark, path, "rte", f"name string, rtept array<struct<{_struct(POINT)}>>")
    points = rows.select("source_file", "place_", F.col("name").alias("route"), F.posexplode("rtept").alias("p_", "p"))
    return _whole(points.select("source_file", "place_", "p_", "route", *own), "route", ["place_", "p_"], joined)


# Short names of the namespaces that waypoints' extensions come from.
NAMESPACES = {"http://www.topografix.com/GPX/1/1": "", "http://www.garmin.com/xmlschemas/GpxExtensions/v3": "gpxx", "http://www.opencpn.org": "opencpn"}


def _prefixes(spark: SparkSession, path: str) -> DataFrame:
    """source_file and prefixes: the namespace of each prefix that a file declares (the default one is called ``-``)."""
    p = r"""xmlns(?::([\w.-]+))?\s*=\s*["']([^"']*)["']"""
    lines = spark.read.text(path).filter(F.contains("value", F.lit("xmlns")))
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(p), F.lit(1)).alias("prefix"), F.regexp_extract_all("value", F.lit(p), F.lit(2)).alias("uri"))
    each = lines.select(F.input_file_name().alias("source_file"), F.explode(pairs).alias("x")).groupBy("source_file", F.coalesce(F.nullif("x.prefix", F.lit("")), F.lit("-")).alias("prefix")).agg(F.max("x.uri").alias("uri"))
    return each.groupBy("source_file").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "uri"))).alias("prefixes"))


def flat_elements(inner: str, prefixes: dict[str, str], namespaces: dict[str, str]) -> dict[str, str]:
    """``ns:tag`` to text and ``ns:tag.attribute`` to value of all elements, however deep, in an element's inner XML; of a name that stands several times the last counts.
    A namespace without a short name in ``namespaces`` is an error."""
    declared = "".join(f" xmlns{'' if p == '-' else ':' + p}={quoteattr(uri)}" for p, uri in prefixes.items())
    out = {}
    for e in list(ElementTree.fromstring(f"<all{declared}>{inner}</all>").iter())[1:]:
        uri, _, tag = e.tag.rpartition("}")
        uri = uri.removeprefix("{")
        if uri not in namespaces:
            raise ValueError(f"element {tag} is of the unknown namespace {uri!r}")
        name = f"{namespaces[uri]}:{tag}"
        if e.text and e.text.strip():
            out[name] = e.text.strip()
        out |= {f"{name}.{k.rpartition('}')[2]}": v for k, v in e.attrib.items()}
    return out


def extension_map(inner: Column, prefixes: Column, namespaces: dict[str, str] = NAMESPACES) -> Column:
    """``flat_elements`` of a column of inner XML, with the prefixes of its file (a map); null and empty are an empty map."""

    @F.pandas_udf("map<string, string>")
    def run(inner: pd.Series, prefixes: pd.Series) -> pd.Series:
        return pd.Series([flat_elements(x, dict(p or {}), namespaces) if x and x.strip() else {} for x, p in zip(inner, prefixes)], dtype=object)

    return run(inner, prefixes)


def read_waypoints(spark: SparkSession, path: str, namespaces: dict[str, str] = NAMESPACES) -> DataFrame:
    """source_file, seq, lat, lon, last_updated, name, description, sym, type, guid, extensions (map of ``ns:tag`` to text and ``ns:tag.attribute`` to value, by the short
    names of namespaces, whatever prefixes the file has for them; an unknown namespace is an error)."""
    # Elements are cut as text: the XML source gives an inner element's text with its entities resolved, which is no XML any more.
    ends = spark.read.text(path, lineSep="</wpt>").select(F.input_file_name().alias("source_file"), F.monotonically_increasing_id().alias("chunk_"), "value")
    cut = ends.select("source_file", "chunk_", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<wpt\b[^>]*/>|<wpt\b[^>]*[^/>]>.*"), F.lit(0))).alias("at_", "x"))
    whole = cut.select("source_file", F.struct("chunk_", "at_").alias("place_"), F.when(F.regexp_like("x", F.lit(r"(?s)\A<wpt\b[^>]*/>\z")), F.col("x")).otherwise(F.concat("x", F.lit("</wpt>"))).alias("x"))
    inner = F.regexp_extract("x", r"(?s)<extensions\b[^>]*>(.*)</extensions>", 1).alias("extensions")
    df = whole.select("source_file", "place_", F.from_xml("x", POINT, {"ignoreNamespace": "true"}).alias("w"), inner).select("source_file", "place_", "w.*", "extensions")
    df = df.join(_prefixes(spark, path), "source_file", "left").withColumn("extensions", extension_map(F.col("extensions"), F.col("prefixes"), namespaces))
    of = lambda key: F.try_element_at("extensions", F.lit(key))
    out = df.select(
        "source_file", "place_", F.col("_lat").try_cast("double").alias("lat"), F.col("_lon").try_cast("double").alias("lon"),
        F.try_to_timestamp("time").alias("last_updated"), "name", F.coalesce("desc", "description").alias("description"), "sym", "type", F.lower(F.coalesce(of("opencpn:guid"), of(":uuid"))).alias("guid"), "extensions",
    )
    return _numbered(out, ["place_"])


def _struct(ddl: str) -> str:
    return ", ".join(": ".join(x.split(" ")) for x in ddl.split(", "))
