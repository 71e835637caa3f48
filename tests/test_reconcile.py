"""Clusters by distance against union-find, matching across 180° and near the poles against all pairs, and the new queries by SQL."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fathomline.functions.geocode import OpenLocation
from fathomline.functions.geodesy import NM
from fathomline.operators import cluster, components, match
from fathomline.sources import gpx

SF = "/root/testdata/sf0.001"


def by_sql(spark, name):
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


@pytest.mark.parametrize("name", ["near_clusters", "dedup_near", "match_by_distance_wrap", "match_by_touching_codes", "geocode_neighbours", "gpx_extensions"])
def test_queries_by_sql(spark, name):
    by_sql(spark, name)


def plain_distance(p, q, wrap):
    across = math.radians(q[1]) - math.radians(p[1])
    if wrap:
        across = (across + math.pi) % (2 * math.pi) - math.pi
    return math.hypot(NM * (math.radians(q[0]) - math.radians(p[0])), NM * math.cos((math.radians(p[0]) + math.radians(q[0])) / 2) * across)


def union_find(points, limit, wrap):
    root = {i: i for i, *_ in points}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, *p in points:
        for j, *q in points:
            if i < j and plain_distance(p, q, wrap) <= limit:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("wrap", [False, True])
def test_clusters_against_union_find(spark, wrap):
    rng = random.Random(4)
    places = [(37.0, -76.0), (-51.3, 179.9995), (89.9, 10.0), (-89.9995, 0.0), (0.0, 0.0)]
    points = []
    for lat, lon in places:
        spread = 0.004 / max(0.05, math.cos(math.radians(lat)))
        for _ in range(60):
            p = (max(-90.0, min(90.0, lat + rng.uniform(-0.004, 0.004))), (lon + rng.uniform(-spread, spread) + 180) % 360 - 180)
            points += [p] * rng.choice([1, 1, 1, 3])
    points = [(k, *p) for k, p in enumerate(rng.sample(points, len(points)))]
    df = spark.createDataFrame([*points, (9001, None, 3.0), (9002, math.nan, 3.0)], "id long, lat double, lon double")
    got = {r.id: r.cluster for r in cluster.near_clusters(df, wrap=wrap).collect()}
    assert got == union_find(points, match.NEAR, wrap) | {9001: 9001, 9002: 9002}
    assert 20 < len(set(got.values())) < len(points) - 60


def test_deduplication_keeps_the_newest_of_a_cluster(spark):
    rows = [(1, 10.0, 20.0, "2020-01-01"), (2, 10.0005, 20.0, None), (3, 10.001, 20.0, "2019-01-01"), (4, 11.0, 20.0, None), (5, None, None, "2020-02-02"), (None, 10.0, 20.0, None)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, at string").select("*", F.to_timestamp("at").alias("last_updated"))
    assert sorted(str(r.id) for r in cluster.deduplicate_near(df).collect()) == ["1", "4", "5", "None"]
    assert [r.id for r in cluster.deduplicate_near(df, preferred_only=True).collect()] == [1]
    assert cluster.deduplicate_near(df.limit(0)).count() == 0


def test_a_dense_place_makes_few_links(spark, monkeypatch):
    """Two thousand positions within one another's reach: links by cells, not the two million pairs."""
    rng = random.Random(6)
    points = spark.createDataFrame([(k, 10 + rng.uniform(0, 0.004), 20 + rng.uniform(0, 0.004)) for k in range(2_000)], "id long, lat double, lon double")
    made = []
    plain = cluster.components
    monkeypatch.setattr(cluster, "components", lambda links: made.append(links.count()) or plain(links))
    assert {r.cluster for r in cluster.near_clusters(points).collect()} == {0}
    assert sum(made) < 4_000


def test_components_of_a_long_chain(spark):
    ids = list(range(10_000))
    random.Random(3).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:])) + [(20_000, 20_001), (20_002, 20_002)], "a long, b long")
    for few in (0, 10**6):
        labels, rounds = components.components(links if few else links.limit(1_500), few)
        if few == 0:
            assert labels.select("root").distinct().count() == 1 and 1 < rounds <= 11  # about log2(1500)
    assert {(r.root, r.n) for r in labels.groupBy("root").agg(F.count(F.lit(1)).alias("n")).collect()} == {(0, 10_000), (20_000, 2)}
    assert rounds == 1
    assert components.components(links.limit(0))[0].count() == 0


@pytest.mark.parametrize("rule", [match.NearRule(wrap=True), match.NearRule(limit=30.0, wrap=True), match.NearRule(), match.CodeRule("codes", OpenLocation(6), 0.05)])
def test_matching_across_the_date_line(spark, rule):
    rng = random.Random(9)
    near_pole = rule.name == "distance"
    lats = [0.0, 55.0, -72.0, *([89.99, -89.9, 90.0] if near_pole else [])]
    sides = []
    for _ in range(2):
        sides.append([(k, max(-90.0, min(90.0, rng.choice(lats) + rng.uniform(-0.002, 0.002))), rng.choice([180.0, -180.0, 179.9995, -179.9995]) + rng.uniform(-0.0005, 0.0005)) for k in range(120)])
    left, right = (spark.createDataFrame(s, "id long, lat double, lon double") for s in sides)
    got = {(r.left_id, r.right_id) for r in match.match(left, right, [rule]).collect()}
    wrap = getattr(rule, "wrap", True)
    assert got == {(i, j) for i, *p in sides[0] for j, *q in sides[1] if plain_distance(p, q, wrap) <= rule.limit} and len(got) > 50


def test_neighbours_of_codes(spark):
    code = OpenLocation(4)
    points = spark.createDataFrame([(0.1, 179.99), (89.9, 5.0), (-89.9, -180.0), (10.0, 10.0)], "lat double, lon double")
    rows = points.select("lat", code.neighbours(code.encode(F.col("lat"), F.col("lon"))).alias("n")).collect()
    assert [len(set(r.n)) for r in rows] == [9, 6, 6, 9]
    pairs = points.select(code.encode(F.col("lat"), F.col("lon")).alias("own")).select("own", F.explode(code.neighbours(F.col("own"))).alias("c"))
    assert all(r.own in r.n for r in pairs.select("own", code.neighbours(F.col("c")).alias("n")).collect())
    with pytest.raises(ValueError):
        OpenLocation(11).neighbours(F.lit("x"))


def test_flat_elements():
    inner = '<o:a x="1"> t <o:b>deep</o:b></o:a><plain/><o:a>last</o:a>'
    prefixes = {"-": "http://www.topografix.com/GPX/1/1", "o": "http://www.opencpn.org"}
    assert gpx.flat_elements(inner, prefixes, gpx.NAMESPACES) == {"opencpn:a": "last", "opencpn:a.x": "1", "opencpn:b": "deep"}
    with pytest.raises(ValueError, match="unknown namespace"):
        gpx.flat_elements("<z:a>1</z:a>", {"z": "urn:z"}, gpx.NAMESPACES)
    assert gpx.flat_elements("<z:a>1</z:a>", {"z": "urn:z"}, {"urn:z": "zz"}) == {"zz:a": "1"}


def test_waypoints_of_every_shape(spark, tmp_path):
    (tmp_path / "a.gpx").write_text("""<?xml version="1.0"?>
<gpx xmlns="http://www.topografix.com/GPX/1/1" xmlns:x='http://www.opencpn.org'>
<wpt lat="1" lon="2"/><wpt lat="3"
 lon="4"><sym/></wpt>
<wpt lat="5" lon="6"><time>2020-09-30T07:52:39Z</time><name>A &amp; B</name><desc>d</desc><extensions><x:guid>ABC</x:guid></extensions></wpt>
<rte><rtept lat="7" lon="8"/></rte></gpx>""")
    (tmp_path / "b.gpx").write_text('<gpx><wpt lat="9" lon="10"><name>n</name></wpt></gpx>')
    (tmp_path / "c.gpx").write_text("<gpx></gpx>")
    rows = {(r.source_file[-5:], r.seq): r for r in gpx.read_waypoints(spark, str(tmp_path)).collect()}
    assert {k: (r.lat, r.lon, r.name, r.guid) for k, r in rows.items()} == {
        ("a.gpx", 0): (1.0, 2.0, None, None), ("a.gpx", 1): (3.0, 4.0, None, None), ("a.gpx", 2): (5.0, 6.0, "A & B", "abc"), ("b.gpx", 0): (9.0, 10.0, "n", None),
    }
    assert rows["a.gpx", 2].description == "d" and rows["a.gpx", 2].last_updated.year == 2020 and rows["a.gpx", 2].extensions == {"opencpn:guid": "ABC"}
    (tmp_path / "d.gpx").write_text('<gpx xmlns:z="urn:z"><wpt lat="9" lon="10"><extensions><z:a>1</z:a></extensions></wpt></gpx>')
    with pytest.raises(Exception, match="unknown namespace"):
        gpx.read_waypoints(spark, str(tmp_path)).collect()
