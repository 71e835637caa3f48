"""Column functions and sources against known values."""

import datetime
import struct
import uuid

import pytest
from pyspark.sql import functions as F

from fathomline.functions import angle, clock, geodesy, geocode, geomagnetic, sun
from fathomline.operators import match, schedule, track
from fathomline.sources import coefficients, gpx, logs, usr


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_angles(spark):
    texts = ["10 20 30N", "10 20.5N", "10.341666N", "Big Nope", "-12.5", "076 16.385W", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(angle.parse_angle(F.col("t"))).collect()
    want = [10.341666, 10.341666, 10.341666, None, -12.5, -76.2730833, None, None]
    for (got,), w in zip(rows, want):
        assert got is None if w is None else got == pytest.approx(w, abs=1e-5)
    lat, lon = F.lit(50 + 21 / 60 + 50 / 3600), F.lit(-(4 + 9 / 60 + 25 / 3600))
    got = one(spark, *(f(x, p) for p in ("dms", "dm", "d") for f, x in ((angle.format_lat, lat), (angle.format_lon, lon))))
    assert list(got) == ["50 21 50.0N", "004 09 25.0W", "50 21.833N", "004 9.417W", "50.364N", "004.157W"]
    assert tuple(one(spark, angle.dm(F.lit(9.999999999)))[0]) == (10, 0.0)
    assert tuple(one(spark, angle.degrees_minutes(F.lit(-5.4333)))[0]) == (-5, 26)


def test_geodesy(spark):
    leg = one(spark, geodesy.range_bearing(F.lit(37.533195), F.lit(-76.316963), F.lit(37.542961), F.lit(-76.319580)))[0]
    assert leg.distance == pytest.approx(0.59944686) and leg.bearing == pytest.approx(348.0038223)
    to = one(spark, geodesy.destination(F.lit(51 + 7 / 60 + 32 / 3600), F.lit(1 + 20 / 60 + 17 / 3600), F.lit(40.23), F.lit(116 + 38 / 60 + 10 / 3600), geodesy.KM))[0]
    assert (to.lat, to.lon) == (pytest.approx(50.96335, abs=1e-4), pytest.approx(1.85244, abs=1e-4))
    assert one(spark, geodesy.mercator_lon(F.lit(-8505883)), geodesy.mercator_lat(F.lit(2788774))) == (-76.66669595, 24.36669586)
    far = one(spark, geodesy.distance(F.lit(0.0), F.lit(179.0), F.lit(0.0), F.lit(-179.0)), geodesy.range_bearing(F.lit(0.0), F.lit(179.0), F.lit(0.0), F.lit(-179.0), wrap=True)["distance"])
    assert far[0] > 20_000 and far[1] == pytest.approx(120.08, abs=0.1)


def test_geocodes(spark):
    points = [(37.18499, -76.422203, "87955HMH+X4V"), (25.71541470, -80.22695124, "76QXPQ8F+567")]
    for lat, lon, code in points:
        got, box = one(spark, geocode.olc_encode(F.lit(lat), F.lit(lon)), geocode.olc_decode(F.lit(code)))
        assert got == code
        assert box.lat_lo - 1e-9 <= lat <= box.lat_hi + 1e-9 and box.lon_lo - 1e-9 <= lon <= box.lon_hi + 1e-9
    assert one(spark, geocode.olc_encode(F.lit(90.0), F.lit(1.0), 4))[0] == "CFX30000+"
    box = one(spark, geocode.olc_decode(F.lit("7FG49Q00+")))[0]
    assert (box.lat_lo, box.lon_lo, box.lat_hi, box.lon_hi) == (20.35, 2.75, 20.4, 2.8)


def test_sun(spark):
    s = one(spark, sun.sun_times(F.lit("2021-06-23 01:00:00").cast("timestamp"), F.lit(40.0), F.lit(-105.0), F.lit(-6.0)))[0]
    assert [x.strftime("%H:%M:%S") for x in (s.noon, s.rise, s.set)] == ["13:02:15", "05:31:53", "20:32:37"]
    s = one(spark, sun.sun_times(F.lit("2021-06-23 01:00:00").cast("timestamp"), F.lit(80.0), F.lit(0.0), F.lit(0.0)))[0]
    assert s.rise is None and s.state == "day"


def test_clock(spark):
    d = F.lit("2021-01-18").cast("date")
    for text, want in {
        "11:12 PM": (2021, 1, 18, 23, 12), "Sep 10 11:12 PM": (2021, 9, 10, 23, 12), "9-10-2021 11:12 PM": (2021, 9, 10, 23, 12),
        "2020-09-30T07:52:39Z": (2020, 9, 30, 7, 52, 39), "2013-11-08T13:53:42-05:00": (2013, 11, 8, 18, 53, 42),
        "2011-06-04 13:12:32 +0000": (2011, 6, 4, 13, 12, 32), "921": (2021, 1, 18, 9, 21), "9-10-2021 11:12 Nope": None,
    }.items():
        got = one(spark, F.unix_seconds(clock.parse_datetime(F.lit(text), d)))[0]
        assert got == (None if want is None else int(datetime.datetime(*want, tzinfo=datetime.timezone.utc).timestamp())), text
    got = one(spark, clock.format_duration(clock.parse_duration(F.lit("1d 17H 57M"))), clock.format_elapsed(F.lit(93784)), clock.format_minutes(F.lit(7.19)), clock.duration_from(hours=2.5), clock.utc_offset_seconds(F.lit("2013-11-08T13:53:42-05:00")))
    assert list(got) == ["1d 17h 57m 00s", "1 day, 2:03:04", "00h 07m", 9000, -18000]


def test_track_and_schedule(spark):
    rows = [("a", i, lat, lon, datetime.datetime(2012, 4, 18, 9, i)) for i, (lat, lon) in enumerate([(37.54001607, -76.33728421), (37.533195, -76.316963), (37.542961, -76.319580)])]
    points = spark.createDataFrame(rows, "route string, seq int, lat double, lon double, time timestamp")
    legs = track.with_legs(points, ["route"], ["seq"]).orderBy("seq").collect()
    assert [r.distance for r in legs][:2] == [pytest.approx(1.05060252), pytest.approx(0.59944686)] and legs[2].distance is None
    assert track.track_report(points.limit(1), ["route"], ["seq"]).first().calc_distance is None
    s = schedule.schedule(points, ["route"], ["seq"], F.lit("2012-04-18").cast("timestamp"), F.lit(5.0), schedule.constant(-11)).orderBy("seq").collect()
    assert [r.enroute_minutes for r in s] == [0, pytest.approx(12.6072302), pytest.approx(7.19336232)]
    assert s[2].true_bearing == pytest.approx(348.0038223) and s[2].magnetic == pytest.approx(359.0038223) and s[0].magnetic is None and s[2].next_course is None


def test_match(spark):
    cols = "id long, lat double, lon double, name string, guid string, geocode string, last_updated timestamp"
    a = spark.createDataFrame([(1, 37.18499, -76.422203, "A", "{G}", "87955HMH+X4V", None), (2, 0.0, 0.0, None, None, "x", None)], cols)
    b = spark.createDataFrame([(7, 37.1851, -76.4222, "A", "g", "87955HMH+X4V", None), (8, 10.0, 10.0, None, None, "y", None)], cols)
    edges = match.match(a, b, [match.by_name(), match.by_guid(), match.by_geocode(8), match.NearRule()])
    assert sorted(tuple(r) for r in edges.collect()) == [(1, 7, "distance"), (1, 7, "geocode8"), (1, 7, "guid"), (1, 7, "name"), (2, 8, "name")]
    near = match.match(a, b, [match.NearRule()])
    assert sorted(r.status for r in match.outer_merge(a, b, near).collect()) == ["both", "first", "second"]
    assert match.deduplicate(a.unionAll(a.withColumn("id", F.col("id") + 5))).count() == 2
    lines = [r.text for r in match.survey(a, b, [match.NearRule()]).orderBy("line_no").collect()]
    assert len(lines) == 2 and lines[1].startswith("+")


def test_near_rule_against_all_pairs(spark):
    import math
    import random

    rng = random.Random(1)
    pts = [(i, rng.uniform(-85, 85), rng.uniform(-179, 179)) for i in range(150)]
    others = [(i, lat + rng.uniform(-0.0012, 0.0012), lon + rng.uniform(-0.004, 0.004)) for i, lat, lon in pts]
    d = lambda p, q: math.hypot(3440.069 * math.radians(q[1] - p[1]), 3440.069 * math.cos(math.radians((p[1] + q[1]) / 2)) * math.radians(q[2] - p[2]))
    want = sorted((p[0], q[0]) for p in pts for q in others if d(p, q) <= 0.05)
    df = [spark.createDataFrame(x, "id long, lat double, lon double") for x in (pts, others)]
    assert sorted((r.left_id, r.right_id) for r in match.match(*df, [match.NearRule()]).collect()) == want and want


def test_field_degree_one(spark, tmp_path):
    p = tmp_path / "coeffs.txt"
    p.write_text("# comment\nc/s deg ord\ng/h n m 1995.0 2000.0 2000-05\ng 1 0 -29000 -29000 10\ng 1 1 -1500 -1500 0\nh 1 1 4600 4600 0\n")
    model = coefficients.collect_model(coefficients.read_coefficients(spark, str(p)))
    assert len(model) == 9
    f = one(spark, geomagnetic.field_column(model, F.lit(0.0), F.lit(0.0), F.lit(2000.0), F.lit(6371.2), geodetic=False))[0]
    assert (f.x, f.y) == (pytest.approx(29000), pytest.approx(-4600))
    assert one(spark, geomagnetic.declination(model, F.lit(0.0), F.lit(0.0), F.lit(2002.0)))[0] == pytest.approx(-9.02, abs=0.02)


def test_files(spark, tmp_path):
    g = tmp_path / "t.gpx"
    g.write_text('<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg><trkpt lat="37.5" lon="-76.3"><time>2010-09-06T16:50:42Z</time></trkpt></trkseg><trkseg><trkpt lat="37.6" lon="-76.3"><time>2010-09-06T16:51:42Z</time></trkpt></trkseg></trk>'
                 '<rte><rtept lat="1" lon="2"><name>A</name><desc>d</desc></rtept><rtept lat="3" lon="4"><name>B</name></rtept></rte><wpt lat="5" lon="6"><time>2020-09-30T07:52:39Z</time><name>W</name><sym>anchor</sym></wpt></gpx>')  # fmt: skip
    assert [(r.seq, r.lat) for r in gpx.read_tracks(spark, str(g)).orderBy("seq").collect()] == [(0, 37.5), (1, 37.6)]
    assert [(r.name, r.description) for r in gpx.read_routes(spark, str(g)).orderBy("seq").collect()] == [("A", "d"), ("B", "")]
    assert gpx.read_waypoints(spark, str(g)).first().sym == "anchor"
    c = tmp_path / "log.csv"
    c.write_text("Time,Lat,Lon,COG\n9:21 AM,37 50.424N,076 16.385W,None\nx,Nope,1,2\n")
    log = logs.read_track_log(spark, str(c), "2012-04-18")
    assert logs.good(log).first().lat == pytest.approx(37.8404) and logs.rejected(log).count() == 1
    t = tmp_path / "r.txt"
    t.write_text("Title\nDepart\tA\n\n" + "\t".join(logs.LEG) + "\n" + "\t".join(["1", "Herring Bay", "251.7 NMi", "192 °M", "38 44.0' N".replace("'", ""), "076 32.5 W", "1d 17H 57M", "Start: 05/26/2021 04:47 (Nighttime)", "5.0", "", "", "223 °M", ""]) + "\n")
    leg = logs.route_legs(logs.read_route_table(spark, str(t))).first()
    assert (leg.distance, leg.bearing, leg.ete_seconds, leg.eta_summary, leg.course) == (251.7, 192.0, 151020, "Nighttime", 223.0)


def test_usr(spark, tmp_path):
    u = uuid.UUID("89f2be82-8907-4a34-afe8-5155e8e61920")
    text = lambda s, e="ascii": struct.pack("<i", len(s.encode(e))) + s.encode(e)
    head = struct.pack("<II", 6, 10) + text("title") + text("06/04/2021") + struct.pack("<IIbI", 0x2586EA, 1000, -1, 7) + struct.pack("<i", -1)
    point = u.bytes_le + struct.pack("<IQh", 1, 2, 2) + text("ROCK", "utf-16-le") + struct.pack("<IiiIhh", 1, -8505883, 2788774, 4, 3, 0) + struct.pack("<i", -1) + struct.pack("<fIIbfiii", 0.0, 2459370, 1500, -1, 0.0, -1, 0, 0)
    route = u.bytes_le + struct.pack("<IQh", 1, 2, 1) + text("R", "utf-16-le") + struct.pack("<Ii", 1, 1) + u.bytes_le + bytes(10)
    p = tmp_path / "x.usr"
    p.write_bytes(head + struct.pack("<i", 1) + point + struct.pack("<i", 1) + route + struct.pack("<ii", 0, 0))
    df = usr.read_usr(spark, str(p))
    w = usr.usr_waypoints(df).first()
    assert (w.name, w.lon, w.lat, w.sym, w.uuid) == ("ROCK", -76.66669595, 24.36669586, "anchor", str(u))
    assert usr.usr_routes(df).first().name == "ROCK" and df.first().file_creation_date == datetime.date(2021, 6, 4)
    assert usr.layout_table(spark).count() > 40
