"""Documents written and read again, by SQL; readers on mixed and broken files; the field model against an independent form."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import angle, clock, geocode, geomagnetic, sun
from fathomline.operators import match
from fathomline.sinks import texts
from fathomline.sinks.usr import encode
from fathomline.sources import layout, logs, records, usr

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["gpx_tracks", "gpx_waypoints", "track_csv", "track_csv_rejected", "track_csv_breaks", "route_csv", "route_table_legs", "route_table_print", "duration_views", "usr_waypoints", "usr_routes", "layout_files", "icon_source", "hex_dump", "usr_layout", "track_report_csv", "duplicates_report", "survey_report", "field_degree2"])
def test_queries_by_sql(spark, name):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "customer", "supplier", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, SF)
    wanted = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    plain = lambda row: tuple(str(round(row[n], 9) + 0.0 if isinstance(row[n], float) else row[n]) for n in sorted(names))
    assert sorted(found.columns) == sorted(names)
    got, want = sorted(map(plain, found.collect())), sorted(plain(dict(zip(names, r))) for r in wanted.fetchall())
    assert got == want and got


def test_logs_of_mixed_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("2011-06-04 13:12:32 +0000,37.549225,-76.330536,219,3.6,,,,,,\n2011-06-04 13:12:43 +0000,Nope,-76.330681,186,3.0,,,,,,\n")
    (tmp_path / "b.csv").write_text('Time,Lat,Lon,COG\n9:21 AM,37 50.424N,076 16.385W,"a, ""b"""\n')
    (tmp_path / "c.csv").write_text("lon,x,Date,lat\n-76.5,1,2012-04-18 10:06,37.5\n\n-76.6,1,2012-04-18 10:07,37.6\n")
    log = logs.read_track_log(spark, str(tmp_path), "2012-04-18")
    rows = {(r.source_file[-5:], r.seq): r for r in log.collect()}
    assert sorted(rows) == [("a.csv", 0), ("a.csv", 1), ("b.csv", 0), ("c.csv", 0), ("c.csv", 1)]
    assert [rows[k].ok for k in sorted(rows)] == [True, False, True, True, True] and rows["a.csv", 1].source_row["latitude"] == "Nope"
    assert rows["b.csv", 0].lat == pytest.approx(37.8404) and rows["b.csv", 0].source_row["COG"] == 'a, "b"'
    assert (rows["c.csv", 1].lat, rows["c.csv", 1].lon) == (37.6, -76.6)
    logs.register_reader(".log", lambda s, p: s.createDataFrame([(p,)], "source_file string"))
    assert logs.read_tracks(spark, str(tmp_path / "x.LOG")).count() == 1
    with pytest.raises(ValueError):
        logs.read_tracks(spark, "x.unknown")


def test_strict_routes(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('A,10.5N,20.5W,"to, b"\nB,Nope,20.5W,\n')
    assert [r.lat for r in logs.read_route_csv(spark, str(p), strict=False).orderBy("seq").collect()] == [10.5, None]
    with pytest.raises(Exception, match="cannot read the angle"):
        logs.read_route_csv(spark, str(p)).collect()
    p.write_text("A,10.5N\n")
    with pytest.raises(Exception, match="not four columns"):
        logs.read_route_csv(spark, str(p), strict=False).collect()


def test_every_date_form(spark):
    """A text made by a pattern has the pattern's shape, so none is left untried."""
    forms = [*(f"{d} {t}" for d in [*clock.YEARLESS, *clock.FULL] for t in clock.TIMES), *clock.TIMES, *clock.OFFSET, *clock.DAYS]
    at = F.lit("2021-10-09 17:05:07").cast("timestamp")
    row = spark.range(1).select(*(F.date_format(at, f).alias(f"c{k}") for k, f in enumerate(forms))).first()
    shaped = spark.range(1).select(*(F.regexp_like(F.lit(x), F.lit(clock.shape(f))).alias(f"c{k}") for k, (x, f) in enumerate(zip(row, forms)))).first()
    assert all(shaped)
    read = spark.range(1).select(*(clock.parse_datetime(F.lit(x), F.lit("2021-10-09").cast("date")).alias(f"c{k}") for k, x in enumerate(row[:6]))).first()
    assert all((x.year, x.month, x.day) == (2021, 10, 9) for x in read)


def test_predicate_rule(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 5.0)], "id long, lat double")
    near = lambda: F.abs(F.col("l.lat") - F.col("r.lat")) < 2
    with pytest.raises(ValueError):
        match.match(a, a, [match.PredicateRule("near", near)])
    assert match.match(a, a, [match.PredicateRule("near", near, all_pairs=True)]).count() == 2
    assert match.match(a, a, [match.PredicateRule("near", near, lambda: F.col("id") % 2)]).count() == 2


def test_numbered_rows(spark):
    rows = match.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7), ["x"], "n")
    assert rows.filter("n <> x").isEmpty() and rows.count() == 1000


def test_geocodes_of_every_length(spark):
    points = spark.createDataFrame([(k * 0.73 - 89.9, k * 1.37 - 179.9) for k in range(240)], "lat double, lon double")
    for size in (4, 8, 10, 11, 13, 15):
        found = points.withColumn("box", geocode.olc_decode(geocode.olc_encode(F.col("lat"), F.col("lon"), size)))
        inside = (F.col("lat") >= F.col("box.lat_lo") - 1e-9) & (F.col("lat") <= F.col("box.lat_hi") + 1e-9) & (F.col("lon") >= F.col("box.lon_lo") - 1e-9) & (F.col("lon") <= F.col("box.lon_hi") + 1e-9)
        assert found.filter(~inside).isEmpty()
    assert geocode.with_geocode(points.limit(1)).first().geocode[8] == "+"


def test_field_of_degree_13(spark):
    """The field against minus the numerical gradient of the potential, made from Legendre polynomials by differentiation."""
    rng = np.random.default_rng(5)
    rows = [(k, n, m, e, float(rng.normal(0, 3000 / n**2))) for n in range(1, 14) for m in range(n + 1) for k in ("gh" if m else "g") for e in (2000, 2005, 2010)]
    value = {(k, n, m): v for k, n, m, e, v in rows if e == 2000}

    def potential(r, theta, lam):
        total = 0.0
        for n in range(1, 14):
            p = np.polynomial.legendre.Legendre.basis(n)
            for m in range(n + 1):
                schmidt = math.sqrt((1 if m == 0 else 2) * math.factorial(n - m) / math.factorial(n + m))
                q = schmidt * math.sin(theta) ** m * (p.deriv(m) if m else p)(math.cos(theta))
                total += geomagnetic.RADIUS * (geomagnetic.RADIUS / r) ** (n + 1) * (value["g", n, m] * math.cos(m * lam) + value.get(("h", n, m), 0.0) * math.sin(m * lam)) * q
        return total

    where = [(35.0, 10.0, 6400.0), (90.0, 200.0, 6371.2), (150.0, 359.0, 6800.0), (5.0, 77.0, 6500.0)]
    df = spark.createDataFrame([(90 - c, lon, r) for c, lon, r in where], "lat double, lon double, r double")
    got = df.select(geomagnetic.field_column(rows, F.col("lat"), F.col("lon"), F.lit(2000.0), F.col("r"), geodetic=False).alias("f")).collect()
    for (c, lon, r), (f,) in zip(where, got):
        t, a, d = math.radians(c), math.radians(lon), 1e-4
        north = (potential(r, t + d, a) - potential(r, t - d, a)) / (2 * d * r)
        east = -(potential(r, t, a + d) - potential(r, t, a - d)) / (2 * d * r * math.sin(t))
        down = (potential(r + 0.05, t, a) - potential(r - 0.05, t, a)) / 0.1
        assert (f.x, f.y, f.z) == (pytest.approx(north, abs=0.5), pytest.approx(east, abs=0.5), pytest.approx(down, abs=0.5))
    pole = spark.createDataFrame([(90.0, 0.0), (90.0, 90.0), (-90.0, 0.0), (-90.0, 90.0)], "lat double, lon double")
    f = [r[0] for r in pole.select(geomagnetic.field_column(rows, F.col("lat"), F.col("lon"), F.lit(2000.0))).collect()]
    for a, b in ((f[0], f[1]), (f[2], f[3])):  # at a pole the horizontal field is one vector, seen from two meridians
        assert math.hypot(a.x, a.y) == pytest.approx(math.hypot(b.x, b.y)) and a.z == pytest.approx(b.z)


def test_field_between_epochs():
    rows = [("g", 1, 0, 2000, 10.0), ("g", 1, 0, 2005, 20.0), ("g", 1, 0, 2010, 3.0)]
    g, _ = geomagnetic.at_years(rows, np.array([2000.0, 2002.5, 2005.0, 2007.0]))
    assert g[1, 0].tolist() == [10.0, 15.0, 20.0, 26.0]
    with pytest.raises(ValueError):
        geomagnetic.at_years(rows, np.array([1999.0]))


def test_usr_bytes():
    data = encode({"file_title": "t", "waypoints": [{"uuid": "89f2be82-8907-4a34-afe8-5155e8e61920", "waypt_name": "é", "longitude": -76.6, "latitude": 24.3}], "routes": None})
    back = usr.decode(data)
    assert back["waypoints"][0]["waypt_name"] == "é" and back["waypoints"][0]["latitude"] == pytest.approx(24.3, abs=1e-5) and back["routes"] == []
    with pytest.raises(NotImplementedError):
        usr.decode(encode({"format": 4}))


def test_pages_and_names(spark):
    df = spark.createDataFrame([("r<1>", 0, "a&b")], "route string, seq int, name string")
    page = texts.page_html(texts.table_html(df, ["route"], "seq", ["seq", "name"]), ["route"], F.col("route"), {"From": F.lit("x")}).first().text
    assert "<h1>r&lt;1&gt;</h1>" in page and "<dt>From</dt><dd>x</dd>" in page and "<td>a&amp;b</td>" in page
    assert texts.output_path("a/b.c/track.csv") == "a/b.c/track Distance.csv" and texts.output_path("a.b/route", "html", texts.SCHEDULE) == "a.b/route Schedule.html"


def test_coercion(spark):
    row = spark.range(1).select(angle.degrees_of(10.5), angle.degrees_of("10 30.0S"), angle.degrees_of(F.lit(1.0))).first()
    assert list(row) == [10.5, -10.5, 1.0] and sun.ZONES["EST"] == -5.0
    with pytest.raises(ValueError):
        angle.degrees_of(10)


def test_quoted_line_breaks_over_splits(spark, tmp_path):
    """Records as the csv module reads them, whatever the size of the splits."""
    import csv
    import random

    rng = random.Random(8)
    cell = lambda: rng.choice(["a", "", '"x"', '"a\nb"', '"say ""hi""\n\n,z"', 'stray " quote', '"closed"tail"', '"\n"', "é", '""', '" , "'])
    files = {f"{k}.csv": "".join(",".join(cell() for _ in range(rng.randrange(2, 6))) + rng.choice(["\n", "\n\n"]) for _ in range(60)) for k in range(8)}
    files["8.csv"] = 'a,b\n"never closed,\nx,y\n\nz'
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("37b", "200b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            rows = records.csv_records(spark, str(tmp_path)).collect()
            got = {name: [(r.seq, logs.cells_of(r.value)) for r in sorted(rows, key=lambda r: r.seq) if r.source_file.endswith("/" + name)] for name in files}
            for name, text in files.items():
                want = [r for r in csv.reader(text.splitlines(keepends=True)) if r]
                assert got[name] == [(k, [c.strip() or None for c in r]) for k, r in enumerate(want)], (size, name)
            heads = {r.source_file[-5:]: r.head for r in rows}
            assert all(logs.cells_of(heads[n]) == got[n][0][1] for n in files) or size == "37b"
    finally:
        for key, value in zip(("maxPartitionBytes", "openCostInBytes"), before):
            spark.conf.set(f"spark.sql.files.{key}", value)
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty/e.csv").write_text("\n\n")
    assert records.csv_records(spark, str(tmp_path / "empty")).count() == 0 and logs.read_track_log(spark, str(tmp_path / "empty")).count() == 0


def test_log_plan_reads_each_text_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Time,Lat,Lon,Note\n9:21 AM,37 50.424N,076 16.385W,"two\nlines"\n')
    log = logs.good(logs.read_track_log(spark, str(tmp_path)))
    assert log.first().source_row["Note"] == "two\nlines"
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Split") == 0 and len(plan) < 60_000, len(plan)


def test_broken_usr_files_are_rows(spark):
    """Files cut anywhere, lengthened, or damaged: a row with a problem each, and what stands before the place."""
    import random

    points = [{"uuid": f"89f2be82-8907-4a34-afe8-5155e8e619{k:02d}", "waypt_name": f"é{k}", "longitude": -76.6, "latitude": 24.3} for k in range(3)]
    whole = encode({"file_title": "t", "waypoints": points, "routes": [{"route_name": "r", "leg_uuids": [points[0]["uuid"]]}]})
    files = [("whole", whole), ("cut", whole[:-3]), ("long", whole + b"ab"), ("four", encode({"format": 4})), ("odd", encode({"format": 77})), ("empty", b""), ("none", None), ("short", whole[:3])]
    files += [("date", whole.replace((2440588).to_bytes(4, "little"), b"\xff\xff\xff\xff", 1))]
    rows = {r.source_file: r for r in usr.decode_files(spark.createDataFrame(files, "source_file string, content binary")).collect()}
    assert rows["whole"].problem is None and [w.waypt_name for w in rows["whole"].waypoints] == ["é0", "é1", "é2"] and rows["whole"].routes[0].leg_uuids == [points[0]["uuid"]]
    assert rows["cut"].problem.startswith("number_trails at") and len(rows["cut"].waypoints) == 3 and rows["long"].problem == "2 bytes after the last field"
    assert rows["four"].problem == "format 4 is not read" and rows["odd"].problem == "unknown format 77" and rows["none"].problem == "no content"
    assert rows["empty"].problem == "format at 0 needs 4 bytes, 0 are left" and rows["short"].problem.startswith("format at 0") and rows["date"].problem.startswith("file_creation_date at")
    rng = random.Random(2)
    damaged = []
    for k in range(300):
        data = bytearray(whole)
        for _ in range(rng.randrange(1, 5)):
            data[rng.randrange(4, len(data))] = rng.choice([0, 127, 255, rng.randrange(256)])
        damaged.append((str(k), bytes(data[: rng.randrange(len(data) + 1)])))
    found = usr.decode_files(spark.createDataFrame(damaged, "source_file string, content binary"))
    assert found.count() == 300 and found.filter("problem is not null").count() > 250
    with pytest.raises(ValueError):
        usr.decode(whole[:-3])


def test_layout_counts_and_conversions():
    inner = layout.Repeat("b", (layout.Field("x", "{n}s", bytes.decode, "string"), layout.Field("_skip", "h")), "m")
    found = layout.Layout((layout.Field("n", "b"), layout.Field("m", "b"), layout.Repeat("a", (inner,), "n")))
    assert found.decode(b"\x02\x01ab\0\0cd\0\0")[0]["a"] == [{"b": [{"x": "ab", "_skip": 0}]}, {"b": [{"x": "cd", "_skip": 0}]}]
    assert found.decode(b"\x01\xff")[0]["a"] == [{"b": []}] and found.decode(b"\xff\x01")[0]["a"] == []
    assert found.decode(b"\x01\x01\xff\0\0")[1].startswith("x at 2: ")
    assert layout.Layout((layout.Field("x", "{y}s"),)).decode(b"a")[1] == "no field y before place 0"
    assert [r[2] for r in found.table()] == ["1", "1", "varies", "2"] and found.schema().simpleString().startswith("struct<source_file:string,n:tinyint,m:tinyint,a:array<struct<b:array<struct<x:string>>>>")
