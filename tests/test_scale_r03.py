"""What the third review found about larger tables: documents, tables and schedules whose parts are no longer one row, one task or one expression."""

import math

import pytest
from pyspark.sql import functions as F

from fathomline.operators import field
from fathomline.plans import views
from fathomline.sinks import texts
from fathomline.sinks.usr import encode
from fathomline.sources import gpx, logs, usr


@pytest.fixture
def small_splits(spark):
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_gpx_is_read_split_by_split(spark, tmp_path, small_splits):
    """many splits a document, tracks that begin anywhere, comments, points closed in their start tag."""
    points = lambda a, b: "".join(f'<trkpt lat="{k}.5" lon="-1"><time>2020-01-01T00:00:{k % 60:02d}Z</time><!-- <trk> --></trkpt>\n' for k in range(a, b))
    body = f'<trk><name>A &amp; B</name><trkseg>{points(0, 40)}</trkseg><trkseg>{points(40, 60)}</trkseg></trk><trk><extensions><x:name>no</x:name></extensions></trk>\n<trk><name><![CDATA[C]]></name><trkseg>{points(60, 85)}</trkseg></trk>'
    routes = "<rte><name>R</name>" + "".join(f'<rtept lat="{k}" lon="2"/>\n' if k % 2 else f'<rtept\nlon="2" lat="{k}"><name>n{k}</name><desc>&lt;{k}</desc></rtept>' for k in range(80)) + "</rte>"
    (tmp_path / "a.gpx").write_text(f'<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1">{body}{routes}</gpx>')
    (tmp_path / "b.gpx").write_text(f'<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><name>C</name><trkseg>{points(85, 88)}</trkseg></trk></gpx>')
    read = gpx.read_tracks(spark, str(tmp_path))
    assert "XML" not in read._jdf.queryExecution().optimizedPlan().toString().upper().replace("FROM_XML", "").replace("XMLTOSTRUCTS", "")
    name = lambda k: "A & B" if k < 60 else "C"
    assert sorted((r.source_file[-5:], r.seq, r.track, r.lat) for r in read.collect()) == [("a.gpx", k, name(k), k + 0.5) for k in range(85)] + [("b.gpx", k - 85, "C", k + 0.5) for k in range(85, 88)]
    joined = gpx.read_tracks(spark, str(tmp_path), joined=True).collect()
    assert sorted((r.track, r.seq, r.lat) for r in joined) == [("A & B", k, k + 0.5) for k in range(60)] + [("C", k - 60, k + 0.5) for k in range(60, 88)]
    found = gpx.read_routes(spark, str(tmp_path / "a.gpx")).collect()
    assert sorted((r.seq, r.route, r.lat, r.name, r.description) for r in found) == [(k, "R", float(k), None if k % 2 else f"n{k}", "" if k % 2 else f"<{k}") for k in range(80)]


def test_points_in_a_comment_are_none(spark, tmp_path):
    """A comment over a point's beginning: the document is read as a whole."""
    point = lambda k: f'<trkpt lat="{k}" lon="1"><time>2020-01-01T00:00:00Z</time></trkpt>'
    (tmp_path / "a.gpx").write_text(f"<gpx><trk><name>T</name><trkseg>{point(1)}<!-- {point(2)} -->{point(3)}</trkseg></trk></gpx>")
    for joined in (False, True):
        assert sorted((r.seq, r.lat, r.track) for r in gpx.read_tracks(spark, str(tmp_path), joined).collect()) == [(0, 1.0, "T"), (1, 3.0, "T")]


def test_a_route_is_written_over_several_files(spark, tmp_path):
    """no row and no file holds a whole route."""
    rows = spark.range(2000).select((F.col("id") % 2).alias("doc"), "id", F.col("id").cast("double").alias("lat"), F.lit(1.5).alias("lon"), F.lit("a<b").alias("name"), F.lit("d & e").alias("description"))
    path = str(tmp_path / "out")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    texts.write_points_gpx(rows.repartition(5), path, "doc", ["id"], "rte")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    whole = spark.read.format("xml").option("rowTag", "rte").option("ignoreNamespace", "true").schema("name string, rtept array<struct<_lat: double>>").load(path)
    sizes = [len(r.rtept) for r in whole.collect()]
    assert sum(sizes) == 2000 and max(sizes) < 1000 and len(sizes) > 3
    found = gpx.read_routes(spark, path, joined=True)
    assert found.filter((F.col("lat") != 2 * F.col("seq") + F.col("route").cast("int")) | (F.col("name") != "a<b") | (F.col("description") != "d & e")).isEmpty() and found.count() == 2000


def test_route_table_lines_are_cut_once(spark):
    """the plan doesn't hold a split of the line for each use of each cell."""
    text = "\nRoute 1\nDepart From\tA\n\n" + "\t".join(logs.LEG) + "\n1\tB\t1.5 NMi\t7 °M\t10.5000N\t76 20.5W\t1H 2M\t05/06/2020 10:11 (Nighttime)\t5\t\td\t9 °M\t\n"
    legs = logs.route_legs(logs.route_tables(spark.createDataFrame([("x", text)], "source_file string, value string")))
    assert legs._jdf.queryExecution().optimizedPlan().toString().count("split(") < 12
    r = legs.first()
    assert (r.leg, r.name, r.lat, r.ete_seconds, r.course, r.eta_summary) == (1, "B", 10.5, 3720, 9.0, "Nighttime") and r.lon == pytest.approx(-76 - 20.5 / 60)


def test_routes_are_dealt_by_their_rows(spark, monkeypatch):
    """the tasks of the routes are as many as the rows ask for, not as the session has partitions."""
    sf = "/root/testdata/sf0.001"
    usual = sorted(views.routes(spark, sf).collect())
    monkeypatch.setattr(views, "ROUTE_ROWS", 100)
    dealt = views.routes(spark, sf)
    assert dealt.rdd.getNumPartitions() >= len(usual) // 100 and sorted(dealt.collect()) == usual


def test_fields_are_summed_over_batches(spark):
    """no term by term expression in the plan, the points of a model aren't shuffled to one task, and a model that lacks terms has the others' sum."""
    rows = [("main", "g", 1, 0, e, -29000.0) for e in (2000, 2005, 2010)] + [("main", "g", 3, 1, e, 900.0) for e in (2000, 2005, 2010)] + [("other", "g", 1, 0, e, 5.0) for e in (2000, 2005, 2010)]
    table = spark.createDataFrame(rows, "model string, kind string, n int, m int, epoch int, value double")
    points = spark.createDataFrame([(k, ("main", "other", "none")[k % 3], None if k == 6 else 10.0 * k) for k in range(9)], "k int, model string, lat double")
    found = field.with_field(points, table, F.col("model"), F.col("lat"), F.lit(40.0), F.lit(2001.0), F.lit(6371.2), geodetic=False, in_batches=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan.split("ArrowEvalPython")[0] and plan.count("ArrowEvalPython") == 1 and plan.count("strategy=broadcast") == 2
    got = {r.k: r.field for r in found.collect()}
    assert all(got[k] is None for k in (2, 5, 6, 8))
    assert got[4].x == pytest.approx(-5 * math.cos(math.radians(40))) and got[4].y == 0
    t, a = math.radians(90 - 30), math.radians(40)  # the third degree by its formula
    p = math.sqrt(3 / 8) * math.sin(t) * (5 * math.cos(t) ** 2 - 1)
    assert got[3].z == pytest.approx(2 * 29000 * math.cos(t) - 4 * 900 * math.cos(a) * p) and got[3].y == pytest.approx(900 * math.sin(a) * p / math.sin(t))


def test_usr_records_are_read_one_by_one(spark):
    """the records of a list come in small batches, and of whole and cut files they are those of the whole decoding."""
    points = [{"waypt_name": f"n{k}", "uuid": f"00000000-0000-0000-0000-{k:012d}", "latitude": 0.001 * k} for k in range(40)]
    data = encode({"file_title": "t", "waypoints": points, "routes": [{"route_name": "r", "leg_uuids": [points[3]["uuid"]]}]})
    for cut in (0, 1, 30, 200, 1000, len(data) - 3):
        whole, _ = usr.USR.decode(data[: len(data) - cut])
        for name in ("waypoints", "routes"):
            assert list(usr.USR.each(data[: len(data) - cut], name)) == whole.get(name, [])
    files = spark.createDataFrame([("a", data), ("b", None), ("c", data[:300])], "source_file string, content binary")
    assert usr.USR.read_each(files, "waypoints", at_once=7).filter("source_file = 'a'").select("seq", "waypt_name").collect() == [(k, f"n{k}") for k in range(40)]
    key = lambda r: (r.source_file, r.seq)
    assert sorted(usr.waypoints_of_files(files).collect(), key=key) == sorted(usr.usr_waypoints(usr.decode_files(files)).collect(), key=key)
    assert [(r.route, r.seq, r.name) for r in usr.routes_of_files(files).collect()] == [("r", 0, "n3")]
