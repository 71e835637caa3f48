"""GPX, HTML and Markdown documents, and CSV reports.

A document is one route or one set of waypoints, so its rows fit one aggregate's row; tracks and routes of any length are written by ``write_points_gpx``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(text: Column) -> Column:
    """XML text; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def _joined(df: DataFrame, by: list[str], seq: str, line: Column, between: str) -> DataFrame:
    """``by`` and text: the lines of each document in order of ``seq``."""
    rows = df.select(*by, F.struct(F.col(seq).alias("s"), line.alias("t")).alias("x"))
    lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"])
    return rows.groupBy(*by).agg(F.array_join(lines, between).alias("text"))


def waypoints_gpx(points: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """GPX 1.1 documents of waypoints (lat, lon, name, last_updated, sym, type, guid, and description if there is one); type is WPT by default."""
    time = F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tag = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"<{name}>"), escape(value), F.lit(f"</{name}>"))).otherwise("")
    line = F.concat(
        F.format_string('<wpt lat="%s" lon="%s">', F.col("lat"), F.col("lon")), tag("time", time), tag("name", F.col("name")),
        tag("description", F.col("description") if "description" in points.columns else F.lit(None).cast("string")),
        tag("sym", F.col("sym")), tag("type", F.coalesce("type", F.lit("WPT"))),
        F.when(F.col("guid").isNotNull(), F.concat(F.lit("<extensions><opencpn:guid>"), escape(F.col("guid")), F.lit("</opencpn:guid></extensions>"))).otherwise(""), F.lit("</wpt>"),
    )
    head = '<?xml version="1.0" encoding="utf-8"?>\n<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1" xmlns:opencpn="http://www.opencpn.org">\n'
    return _joined(points, by, seq, line, "\n").withColumn("text", F.concat(F.lit(head), "text", F.lit("\n</gpx>\n")))


GPX_HEAD = '<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1">'


def _points_lines(name: str, kind: str) -> tuple[Column, Column, str]:
    """A point's line, and what stands before and behind the points of a track (``trk``) or route (``rte``)."""
    tag = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(f"<{label}>"), escape(value), F.lit(f"</{label}>"))).otherwise("")
    if kind == "trk":
        point, inner, wrap = "trkpt", tag("time", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), ("<trkseg>\n", "\n</trkseg>")
    else:
        point, inner, wrap = "rtept", F.concat(tag("name", F.col("name")), tag("desc", F.col("description"))), ("", "")
    line = F.concat(F.format_string(f'<{point} lat="%s" lon="%s">', F.col("lat"), F.col("lon")), inner, F.lit(f"</{point}>"))
    return line, F.concat(F.lit(f"<{kind}>"), tag("name", F.col(name).cast("string")), F.lit("\n" + wrap[0])), f"{wrap[1]}\n</{kind}>\n"


def points_gpx(points: DataFrame, by: list[str], name: str, kind: str = "trk", seq: str = "seq") -> DataFrame:
    """GPX 1.1 documents of one track (``trk``: lat, lon, time) or route (``rte``: lat, lon, name, description) for each ``by``, called by column ``name``."""
    line, head, tail = _points_lines(name, kind)
    return _joined(points, by, seq, line, "\n").withColumn("text", F.concat(F.lit(GPX_HEAD + "\n"), head, "text", F.lit(f"{tail}</gpx>\n")))


def write_points_gpx(points: DataFrame, path: str, by: str, order: list[str], kind: str = "trk") -> None:
    """GPX 1.1 files below ``path`` with a track or route for each ``by``, called by it, its points in an order. They are dealt to the files by ranges of ``by`` and ``order``, and the files' names are in that
    order: one that is longer than a file goes on under its name in the next (``gpx.read_tracks`` and ``read_routes`` join them). Null is no key."""
    line, head, tail = _points_lines(by, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = lambda x: pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array([x], pa.string())], names=["value"])
        current = None
        for batch in batches:
            keys, heads = batch.column("key"), batch.column("head")
            new = [0, *(np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()] if batch.num_rows else []
            for a, b in zip(new, [*new[1:], batch.num_rows]):
                if keys[a].as_py() != current:
                    yield text((GPX_HEAD if current is None else tail.strip()) + "\n" + heads[a].as_py().rstrip("\n"))
                    current = keys[a].as_py()
                yield text(batch.column("line").slice(a, b - a))
        if current is not None:
            yield text(tail.strip() + "\n</gpx>")

    rows = points.dropna(subset=[by]).repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    rows.select(F.col(by).cast("string").alias("key"), head.alias("head"), line.alias("line")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def _cells(df: DataFrame, columns: list[str], make) -> list[Column]:
    return [make(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns]


def table_html(df: DataFrame, by: list[str], seq: str, columns: list[str]) -> DataFrame:
    """An HTML table for each document."""
    line = F.concat(F.lit("<tr>"), *_cells(df, columns, lambda c: F.concat(F.lit("<td>"), escape(c), F.lit("</td>"))), F.lit("</tr>"))
    head = "<table>\n<tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>\n"
    return _joined(df, by, seq, line, "\n").withColumn("text", F.concat(F.lit(head), "text", F.lit("\n</table>\n")))


def page_html(tables: DataFrame, by: list[str], title: Column, summary: dict[str, Column]) -> DataFrame:
    """A page for each table of ``table_html`` (by, text): a heading, the summary as a list of terms, then the table."""
    terms = F.concat(*(F.concat(F.lit(f"<dt>{name}</dt><dd>"), escape(value), F.lit("</dd>\n")) for name, value in summary.items()))
    return tables.select(*by, F.concat(F.lit("<html>\n<h1>"), escape(title), F.lit("</h1>\n<dl>\n"), terms, F.lit("</dl>\n"), "text", F.lit("</html>\n")).alias("text"))


# What the reports of a track and of a route are called after their input.
DISTANCE, SCHEDULE = " Distance", " Schedule"


def output_path(path: str, kind: str = "csv", suffix: str = DISTANCE) -> str:
    """Where a document made from the file ``path`` goes: beside it, its ending changed."""
    stem, dot, _ = path.rpartition(".")
    return f"{stem if dot and '/' not in path[len(stem):] else path}{suffix}.{kind}"


def table_markdown(df: DataFrame, by: list[str], seq: str, columns: list[str]) -> DataFrame:
    """A Markdown table for each document: the itinerary of a float plan."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *_cells(df, columns, lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    return _joined(df, by, seq, line, "\n").withColumn("text", F.concat(F.lit(head), "text", F.lit("\n")))


def write_documents(documents: DataFrame, path: str) -> None:
    """Every document's text in a file of its own below ``path``, by Spark's text writer."""
    documents.select(F.col("text").alias("value")).write.mode("overwrite").option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def write_csv(df: DataFrame, path: str, by: list[str], order: list[str]) -> None:
    """A report as CSV with a header; rows of one document stay together and in order."""
    df.repartition(*(F.col(c) for c in by)).sortWithinPartitions(*by, *order).write.mode("overwrite").option("header", True).csv(path)
