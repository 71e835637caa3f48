"""Queries of deduplication by distance, of matching across 180°, and of geocode neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geocode import OpenLocation
from ..operators import cluster, match
from ..scratch import fresh_path
from ..sources import gpx
from . import views
from .queries import ORACLES, QUERIES, query
from .views import leg_sql, olc_sql

# Chains of seven points some 0.038 nm apart, forty chains beside each other; every eleventh position stands twice.
_CHAIN = """select c_custkey as id, 37.0::DOUBLE + (k % 40) * 0.05::DOUBLE + ((k // 40) % 2) * 0.0002::DOUBLE as lat, -76.0::DOUBLE + (k // 40) * 0.0008::DOUBLE + (k // 280) * 0.002::DOUBLE as lon, 'WP' || c_custkey as name,
  timestamp '2020-01-01' + to_days((c_custkey * 37 % 501)::INT) as last_updated from (select *, case when c_custkey % 11 = 0 then c_custkey - 1 else c_custkey end as k from customer)"""


def _chains(spark, sf_dir):
    c = views.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 11 == 0, F.col("c_custkey") - 1).otherwise(F.col("c_custkey")).alias("k"))
    j = F.floor(F.col("k") / 40)
    return c.select(
        "id", (F.lit(37.0) + (F.col("k") % 40) * F.lit(0.05) + (j % 2) * F.lit(0.0002)).alias("lat"), (F.lit(-76.0) + j * F.lit(0.0008) + F.floor(F.col("k") / 280) * F.lit(0.002)).alias("lon"),
        F.concat(F.lit("WP"), "id").alias("name"), F.expr("timestamp'2020-01-01' + make_dt_interval(cast(id * 37 % 501 as int))").alias("last_updated"),
    )


_CLUSTERS = f"""with recursive p as ({_CHAIN}), e as (select l.id as a, r.id as b from p l join p r on abs(l.lat - r.lat) < 0.001 and abs(l.lon - r.lon) < 0.0012 where {leg_sql('l.lat', 'l.lon', 'r.lat', 'r.lon')[0]} <= 0.05),
reach(id, to_id) as (select id, id from p union select id, b from reach join e on a = to_id), c as (select id, min(to_id) as cluster from reach group by id)"""


@query(_CLUSTERS + " select id, cluster from c")
def near_clusters(spark, sf_dir):
    return cluster.near_clusters(_chains(spark, sf_dir)).select("id", "cluster")


@query(_CLUSTERS + """ select id, name, last_updated from (select p.*, row_number() over (partition by cluster order by last_updated desc, p.id desc) as o from p join c on p.id = c.id) where o = 1""")
def dedup_near(spark, sf_dir):
    return cluster.deduplicate_near(_chains(spark, sf_dir)).select("id", "name", "last_updated")


def _dateline_sql(table: str, key: str, step: float) -> str:
    x = f"(179.999::DOUBLE + ({key} % 7) * {step}::DOUBLE)"
    return f"select {key}::BIGINT as id, -60.0::DOUBLE + ({key} % 149) * 1.0::DOUBLE as lat, case when {x} >= 180 then {x} - 360 else {x} end as lon from {table}"


def _dateline(df, key: str, step: float):
    x = F.lit(179.999) + (F.col(key) % 7) * F.lit(step)
    return df.select(F.col(key).cast("long").alias("id"), (F.lit(-60.0) + (F.col(key) % 149) * F.lit(1.0)).alias("lat"), F.when(x >= 180, x - 360).otherwise(x).alias("lon"))


_LEFT, _RIGHT = _dateline_sql("customer", "c_custkey", 0.0003), _dateline_sql("supplier", "s_suppkey", 0.0004)
_TURN = "radians(r.lon) - radians(l.lon)"
_SHORT = f"(({_TURN}) + pi() - 2 * pi() * floor((({_TURN}) + pi()) / (2 * pi())) - pi())"
_APART = f"sqrt(power(3440.069::DOUBLE * (radians(r.lat) - radians(l.lat)), 2) + power(3440.069::DOUBLE * cos((radians(l.lat) + radians(r.lat)) / 2) * {_SHORT}, 2))"
_WRAPPED = f"with l as ({_LEFT}), r as ({_RIGHT}) select l.id as left_id, r.id as right_id, '{{}}' as rule from l join r on l.lat = r.lat and {_APART} <= 0.05"


def _across(rule):
    def run(spark, sf_dir):
        left, right = _dateline(views.load(spark, sf_dir, "customer"), "c_custkey", 0.0003), _dateline(views.load(spark, sf_dir, "supplier"), "s_suppkey", 0.0004)
        return match.match(left, right, [rule])

    return run


for _name, _rule in (("match_by_distance_wrap", match.NearRule(wrap=True)), ("match_by_touching_codes", match.CodeRule("touching", OpenLocation(6), 0.05))):
    QUERIES[_name], ORACLES[_name] = _across(_rule), _WRAPPED.format(_rule.name)

_SIDE = 0.0025
_shifted = ", ".join(olc_sql(f"(lat + {up} * {_SIDE}::DOUBLE)", f"(lon + {right} * {_SIDE}::DOUBLE - case when lon + {right} * {_SIDE} >= 180 then 360 when lon + {right} * {_SIDE} < -180 then -360 else 0 end)", 8) for up in (-1, 0, 1) for right in (-1, 0, 1))


@query(f"with l as (select id, (floor((lat + 90) / {_SIDE}::DOUBLE + 1e-9) + 0.5) * {_SIDE}::DOUBLE - 90 as lat, (floor((lon + 180) / {_SIDE}::DOUBLE + 1e-9) + 0.5) * {_SIDE}::DOUBLE - 180 as lon from ({_LEFT})) select id, array_to_string(list_sort(list_distinct([{_shifted}])), ' ') as codes from l")
def geocode_neighbours(spark, sf_dir):
    """The cells around points on both sides of 180°."""
    points, code = _dateline(views.load(spark, sf_dir, "customer"), "c_custkey", 0.0003), OpenLocation(8)
    return points.select("id", F.array_join(F.sort_array(code.neighbours(code.encode(F.col("lat"), F.col("lon")))), " ").alias("codes"))


@query("""select id, unnest(['opencpn:guid', 'opencpn:viz', 'opencpn:scale.UseScale', 'opencpn:scale.ScaleMin', ':depth', 'gpxx:Category'][1:case when id % 4 = 0 then 6 else 5 end]) as key,
  unnest(['g<' || id || '>', 'on', 'false', (id % 7)::VARCHAR, '00' || id, 'Marina & ' || id][1:case when id % 4 = 0 then 6 else 5 end]) as value from (select c_custkey as id from customer)""")
def gpx_extensions(spark, sf_dir):
    """Extensions nested and with attributes, under prefixes of the file's own, come back by every key."""
    k = F.col("c_custkey")
    deep = F.when(k % 4 == 0, F.format_string("<g:WaypointExtension><g:Categories><g:Category> Marina &amp; %d </g:Category></g:Categories></g:WaypointExtension>", k)).otherwise("")
    point = F.concat(F.format_string('<wpt lat="37.5" lon="-76.25"><name>%d</name><extensions><o:guid>g&lt;%d&gt;</o:guid><o:viz>on</o:viz><o:scale UseScale="false" ScaleMin="%d"/><depth>00%d</depth>', k, k, k % 7, k), deep, F.lit("</extensions></wpt>"))
    rows = views.load(spark, sf_dir, "customer").select(F.floor(k / 500).alias("doc"), k.alias("k"), point.alias("value"))
    head = '<?xml version="1.0"?>\n<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"\n xmlns:o="http://www.opencpn.org" xmlns:g=\'http://www.garmin.com/xmlschemas/GpxExtensions/v3\'>'
    docs = rows.select("doc").distinct()
    ends = docs.select("doc", F.lit(-1).alias("k"), F.lit(head).alias("value")).union(docs.select("doc", F.lit(1 << 40), F.lit("</gpx>")))
    path = fresh_path(spark, "gpx")
    rows.unionByName(ends).repartition("doc").sortWithinPartitions("doc", "k").select("doc", "value").write.partitionBy("doc").text(path)
    back = gpx.read_waypoints(spark, path)
    return back.select(F.col("name").cast("long").alias("id"), F.explode("extensions").alias("key", "value"))
