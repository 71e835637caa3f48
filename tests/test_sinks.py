"""Written documents can be read again."""

from fathomline.sinks import texts
from fathomline.sources import gpx


def test_gpx_round_trip(spark, tmp_path):
    rows = [("d", 1, 37.5, -76.25, "B & <C>", None, "anchor", None, None), ("d", 0, 24.4, -76.6, "ALLIGTR C", None, "cross,blue", None, "g1")]
    df = spark.createDataFrame(rows, "doc string, seq int, lat double, lon double, name string, last_updated timestamp, sym string, type string, guid string")
    texts.write_documents(texts.waypoints_gpx(df, ["doc"]), str(tmp_path / "out"))
    back = gpx.read_waypoints(spark, str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r.name, r.lat, r.sym, r.type, r.guid) for r in back] == [("ALLIGTR C", 24.4, "cross,blue", "WPT", "g1"), ("B & <C>", 37.5, "anchor", "WPT", None)]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("r", 1, "b", 2.5), ("r", 0, "a|x", None)], "route string, seq int, To string, nm double")
    html = texts.table_html(df, ["route"], "seq", ["To", "nm"]).first().text
    assert html.index("<td>a|x</td><td></td>") < html.index("<td>b</td><td>2.5</td>")
    assert texts.table_markdown(df, ["route"], "seq", ["To", "nm"]).first().text.splitlines()[2:] == ["| a\\|x |  |", "| b | 2.5 |"]
    texts.write_csv(df, str(tmp_path / "csv"), ["route"], ["seq"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
