"""What the third review found."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from fathomline.functions import geodesy
from fathomline.operators import match, track


def test_distance_is_the_root_that_the_sql_states(spark):
    """F2: hypot and the root differ in the last place, enough to turn a leg's microsecond."""
    rows = [(k, 36 + k * 389 % 997 / 500, -77 + k * 577 % 991 / 400, 36 + k * 31 % 997 / 500, -77 + k * 43 % 991 / 400) for k in range(2000)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double")
    up, right = F.lit(geodesy.NM) * (F.radians("c") - F.radians("a")), F.lit(geodesy.NM) * F.cos((F.radians("a") + F.radians("c")) / 2) * (F.radians("d") - F.radians("b"))
    got = df.select(geodesy.distance(*map(F.col, "abcd")).alias("got"), up.alias("up"), right.alias("right")).collect()
    assert all(r.got == math.sqrt(r.up * r.up + r.right * r.right) for r in got)


def test_total_time_has_no_error_of_summation(spark):
    """ten legs of a tenth of a second are a second, in whatever order they are added."""
    start = datetime.datetime(2020, 1, 1)
    rows = [("a", k, start + datetime.timedelta(microseconds=100_000 * k), 37.0, -76.0 + k / 1000) for k in range(11)]
    df = spark.createDataFrame(rows, "user string, k int, time timestamp, lat double, lon double")
    got = {r.k: r.calc_total_time for r in track.track_report(df, ["user"], ["time", "k"]).collect()}
    assert got[8] == "0:00:00" and got[9] == "0:00:01" and got[10] == "0:00:01"


def _points(spark, n, step):
    rows = [(k * step, f"n{k % 3}" if k % 11 else None, f"{{G{k % 4}}}" if k % 5 else None, f"87G8P27Q+{'QW'[k % 2]}C{k % 2 + 2}", 37.0, -76.0, datetime.datetime(2020, 1, 1 + k % 28)) for k in range(n)]
    return spark.createDataFrame(rows, "id long, name string, guid string, geocode string, lat double, lon double, last_updated timestamp")


def test_pairs_of_a_frequent_key_are_dealt_to_many_tasks(spark, monkeypatch):
    """A key of all rows is cut into blocks, and each pair comes once."""
    monkeypatch.setattr(match, "BLOCK", 40)
    monkeypatch.setattr(match, "PAIRS", 1000)
    a = spark.range(300).select(F.lit("k").alias("key"), F.col("id").alias("a")).union(spark.createDataFrame([("x", 7)], "key string, a long"))
    b = spark.range(100).select(F.lit("k").alias("key"), F.col("id").alias("b")).union(spark.createDataFrame([("x", 8)], "key string, b long"))
    rows = match.paired(a, b, ["key"]).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.a, r.b) for r in rows) == sorted([(i, j) for i in range(300) for j in range(100)] + [(7, 8)])
    assert len({r.task for r in rows if r.key == "k"}) > 5


def test_counts_by_key_are_those_of_the_edges(spark):
    """What is counted by key is what the edges show; edges themselves aren't shuffled to be distinct."""
    left, right = _points(spark, 60, 1), _points(spark, 40, 3)
    rules = [match.by_name(), match.by_guid(), match.by_geocode(11)]
    edges = match.match(left, right, rules)
    assert "Aggregate" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert edges.count() == edges.distinct().count() > 500
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    some = [match.by_guid(), match.by_geocode(11)]
    found = match.match(left, right, some)
    assert same(match.rank(left, right, some), match.rank_by_matches(left, found, "left_id"))
    assert same(match.crosswalk_by(left, right, some, "name"), match.crosswalk(left, right, found, "name"))
    assert same(match.outer_merge(left, right, found, some), match.outer_merge(left, right, found))
    twice = right.unionAll(right)  # ids that stand twice: the edges are made distinct
    assert match.match(left, twice, rules).count() == edges.count()


def test_survey_numbers_lines_by_counts(spark):
    """the numbers are those of the sorted lines."""
    left, right = _points(spark, 30, 1), _points(spark, 20, 3)
    got = [(r.line_no, r.text) for r in match.survey(left, right, [match.by_guid()]).collect()]
    assert sorted(k for k, _ in got) == list(range(len(got))) and sum(t.startswith("  guid ") for _, t in got) == match.match(left, right, [match.by_guid()]).count()


def test_edges_of_ids_that_stand_twice(spark):
    """copies of waypoints don't make their edges be gathered, edges between ids of several keys come once, and ids may be missing."""
    rule = match.KeyRule("k", lambda side: F.col("k"))
    points = lambda rows: spark.createDataFrame(rows, "id long, k string")
    want = lambda a, b: sorted({(x, y, "k") for x, m in a for y, n in b if m is not None and m == n}, key=str)
    a = [(i % 9, "abc"[i % 3]) for i in range(30)]  # each id has one key
    several = a + [(1, "c"), (2, "b"), (None, "a"), (None, "a"), (None, "b"), (3, None)]
    b = [(100 + i % 4, "abcd"[i % 3]) for i in range(40)] + [(None, "a"), (None, "b")]
    for left, right in ((a, b), (several, b), (several, a), (a, a)):
        edges = match.match(points(left), points(right), [rule])
        assert sorted(map(tuple, edges.collect()), key=str) == want(left, right)
        if left is a:
            plan = edges._jdf.queryExecution().optimizedPlan().toString()
            assert not any("Aggregate [left_id" in line and "right_id" in line for line in plan.splitlines())


@pytest.mark.parametrize("keys", [0, 50])
def test_waypoints_of_a_frequent_key_are_looked_up_in_many_tasks(spark, monkeypatch, keys):
    """which waypoints an edge touches is found without edges, and a frequent key's waypoints aren't sorted by one task."""
    monkeypatch.setattr(match, "ROWS", 100, raising=False)
    monkeypatch.setattr(match, "KEYS", keys, raising=False)
    rules = [match.KeyRule("k", lambda side: F.col("k"), null_matches=True), match.KeyRule("m", lambda side: F.col("m"))]
    points = lambda rows: spark.createDataFrame(rows, "id long, k string, m string")
    a = points([(i, "often" if i % 10 else f"n{i}", "lonely" if i % 3 else None) for i in range(3000)] + [(5000, None, None)])
    b = points([(10_000 + i, "often" if i < 2 else f"n{i * 10}", f"m{i}") for i in range(40)] + [(20_000, None, None), (20_001, "x", None)])
    touched = {i for i in range(3000) if i % 10 or 20 <= i < 400} | {5000}
    usual = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = match.touched(a, b, rules, "left")
        plan = ids._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner" not in plan and ("block_" in plan) == (keys == 0) and {r.id for r in ids.collect()} == touched
        rows = match.touched(a, b, rules[:1], "left").withColumn("task", F.spark_partition_id()).collect()
        assert len(rows) == len(touched) and len({r.task for r in rows if r.id % 10}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert {r.id for r in match.touched(a, b, rules, "right").collect()} == set(range(10_000, 10_040)) | {20_000}
        counts = {r.id: r.match_count for r in match.rank(a, b, rules).collect()}
        assert counts == {i: (2 if i % 10 else 1) if i in touched else 0 for i in [*range(3000), 5000]}
    finally:
        for c, v in usual.items():
            spark.conf.set(c, v)
