"""Field models as a table against the arrays' sum; schedules under them; voyages and streamed legs against the batch; planning backwards."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import geomagnetic
from fathomline.functions.geodesy import NM
from fathomline.operators import field, schedule, track, voyage
from fathomline.streaming import legs
from test_reconcile import by_sql


@pytest.mark.parametrize("name", ["field_models", "schedule_under_field", "voyages", "schedule_to_arrival", "route_speed_needed"])
def test_queries_by_sql(spark, name):
    by_sql(spark, name)


def test_models_of_degree_13_equal_the_arrays_sum(spark):
    rng = np.random.default_rng(5)
    models = {}
    for name, size, epochs in (("a", 13, (1995, 2000, 2005, 2010)), ("b", 4, (2000.0, 2010.0, 2015.0))):
        models[name] = [(k, n, m, e, float(rng.normal(0, 3000 / n**2))) for n in range(1, size + 1) for m in range(n + 1) for k in ("gh" if m else "g") for e in epochs]
    table = spark.createDataFrame([(name, k, n, m, float(e), v) for name, rows in models.items() for k, n, m, e, v in rows], "model string, kind string, n int, m int, epoch double, value double")
    places = [(lat, lon, y, alt) for lat, lon in ((35.0, -76.5), (90.0, 10.0), (-90.0, 200.0), (-0.1, 359.0), (89.999, -180.0)) for y, alt in ((2001.3, 0.0), (2004.999, 12.5), (2009.0, 400.0), (2017.5, 0.0))]
    points = spark.createDataFrame([(model, *p) for model in models for p in places], "model string, lat double, lon double, y double, alt double")
    found = field.with_field(points, table, F.col("model"), F.col("lat"), F.col("lon"), F.col("y"), F.col("alt"))
    for name, rows in models.items():
        both = found.filter(F.col("model") == name).select("lat", "lon", "y", "field", geomagnetic.field_column(rows, F.col("lat"), F.col("lon"), F.col("y"), F.col("alt")).alias("plain")).collect()
        assert len(both) == len(places)
        for r in both:
            assert list(r.field) == pytest.approx(list(r.plain), rel=1e-9, abs=1e-6), r
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_fields_that_are_not_there(spark):
    table = spark.createDataFrame([("m", "g", 1, 0, 2000, 10.0), ("m", "g", 1, 0, 2005, 20.0), ("m", "g", 1, 0, 2010, 3.0)], "model string, kind string, n int, m int, epoch int, value double")
    rows = [("m", 10.0, 20.0, 1999.9), ("m", None, 20.0, 2001.0), ("m", 10.0, 20.0, None), ("x", 10.0, 20.0, 2001.0), (None, 10.0, 20.0, 2001.0), ("m", 10.0, 20.0, 2001.0)]
    points = spark.createDataFrame([(*r, "kept") for r in rows], "model string, lat double, lon double, y double, row string")
    got = field.with_field(points, table, F.col("model"), F.col("lat"), F.col("lon"), F.col("y")).collect()
    assert sorted((r.field is not None, r.row) for r in got) == [(False, "kept")] * 5 + [(True, "kept")]
    assert field.with_field(points.limit(0), table, F.col("model"), F.col("lat"), F.col("lon"), F.col("y")).count() == 0
    turned = field.with_declination(points.filter("y = 2001").withColumn("t", F.lit("2001-06-01").cast("date")), table, F.lit("m"), F.col("lat"), F.col("lon"), F.col("t"))
    assert all(r.declination == pytest.approx(math.degrees(math.atan2(0.0, -1.0)), abs=180) for r in turned.filter("lat is not null").collect())


def test_voyages_at_the_very_gap(spark):
    rows = [(1, k, f"2024-01-01 00:{m:02d}:00", 10.0 + k, 20.0) for k, m in enumerate((0, 10, 20, 31, 41))] + [(2, 9, "2024-01-01 05:00:00", 1.0, 1.0), (3, 10, None, 1.0, 1.0)]
    fixes = spark.createDataFrame(rows, "user long, id long, at string, lat double, lon double").select("*", F.to_timestamp("at").alias("time"))
    got = [(r.user, r.voyage, r.fixes, r.seconds, round(r.distance, 3)) for r in voyage.voyages(fixes, ["user"], ["time", "id"], 600).orderBy("user", "voyage").collect()]
    degree = NM * math.radians(1)
    assert got == [(1, 0, 3, 1200.0, round(2 * degree, 3)), (1, 1, 2, 600.0, round(degree, 3)), (2, 0, 1, 0.0, 0.0)]


def test_streamed_legs_equal_the_batch(spark, tmp_path):
    """Fixes in several files, out of order within the delay, with a restart between them and some that are too late."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(400)
    fixes = events.select(F.col("user_id").cast("long").alias("track"), F.col("event_id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("time"), (36 + (F.col("event_id") % 997) / 500.0).cast("double").alias("lat"), (-77 + (F.col("event_id") % 991) / 400.0).cast("double").alias("lon")).toPandas()
    fixes = fixes.sort_values("time").reset_index(drop=True)
    late = fixes.iloc[[5, 9]].assign(id=[900_001, 900_002])
    end = fixes.iloc[[-1]].assign(track=-1, id=900_003, time=fixes["time"].max() + np.timedelta64(90, "D"))
    parts = [fixes[k * 100 : (k + 1) * 100].sample(frac=1, random_state=k) for k in range(4)] + [late, end]
    source = tmp_path / "in"
    source.mkdir()
    before = spark.conf.get(legs.PROVIDER)
    spark.conf.set(legs.PROVIDER, legs.ROCKS)
    try:
        for k in range(len(parts)):
            parts[k].astype({"time": "datetime64[us]"}).to_parquet(source / f"{k}.parquet", index=False)
            if k in (1, 3, 5):  # started anew each time, on the same checkpoint
                stream = spark.readStream.schema("track long, id long, time timestamp, lat double, lon double").option("maxFilesPerTrigger", 1).parquet(str(source))
                query = legs.stream_legs(stream, "1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
                assert query.awaitTermination(90)
    finally:
        spark.conf.set(legs.PROVIDER, before)
    got = sorted((r.track, r.id, round(r.distance, 6), round(r.bearing, 6), r.delta_seconds) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = track.with_legs(spark.createDataFrame(fixes), ["track"], ["time", "id"]).filter("distance is not null").collect()
    assert got == sorted((r.track, r.id, round(r.distance, 6), round(r.bearing, 6), r.delta_seconds) for r in batch) and len(got) > 350


def test_planning_backwards_gives_the_arrival_back(spark):
    rows = [("a", k, 36.0 + 0.37 * k, -76.0 - 0.11 * k * k) for k in range(6)] + [("b", 0, 10.0, 10.0)]
    points = spark.createDataFrame(rows, "route string, seq int, lat double, lon double").withColumn("wanted", F.to_timestamp(F.lit("2024-05-01 12:00:00.123456")))
    back = schedule.schedule_to(points, ["route"], ["seq"], F.col("wanted"), F.lit(5.3), schedule.constant(0.0))
    assert back.groupBy("route").agg(F.max("arrival").alias("a"), F.min("wanted").alias("w")).filter("a <> w").count() == 0
    ends = back.groupBy("route").agg(F.min("departure").alias("d"), F.min("arrival").alias("first"), F.sum("distance").alias("nm")).collect()
    assert all(r.d == r.first for r in ends)
    timed = back.join(back.groupBy("route").agg(F.min("departure").alias("from")), "route").select("route", "seq", "lat", "lon", "wanted", "from")
    speeds = {r.route: r.s for r in schedule.speed_for(timed, ["route"], ["seq"], F.col("from"), F.col("wanted")).groupBy("route").agg(F.max("speed_needed").alias("s")).collect()}
    assert speeds["a"] == pytest.approx(5.3, rel=1e-8) and speeds["b"] is None
    still = schedule.departure_for(points, ["route"], ["seq"], F.col("wanted"), F.lit(0.0)).groupBy("route").agg(F.max("departure").alias("d")).collect()
    assert [r.d for r in still] == [None, None]
    assert schedule.departure_for(points.limit(0), ["route"], ["seq"], F.col("wanted"), F.lit(5.0)).count() == 0
