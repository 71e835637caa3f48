"""One query per operator and function family, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angle, clock, geodesy, geocode, geomagnetic, sun
from ..operators import match, schedule, track
from . import views
from .views import FIXES, LEFT, RIGHT, ROUTES, leg_sql, olc_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


r6 = lambda c: F.round(c, 6)
BY, SEQ = ["user_id"], ["time", "event_id"]
_d, _b = leg_sql("lat", "lon", "nlat", "nlon")
_LEGS = f"""with f as ({FIXES}), n as (select *, lead(lat) over w as nlat, lead(lon) over w as nlon, lead(time) over w as nt from f window w as (partition by user_id order by time, event_id)),
g as (select *, {_d} as d, {_b} as b, (epoch_us(nt) - epoch_us(time)) / 1e6 as s from n)"""


@query(_LEGS + " select user_id, event_id, round(d, 6) as distance, round(b, 6) as bearing, round(s, 6) as delta_seconds from g")
def track_legs(spark, sf_dir):
    df = track.with_legs(views.fixes(spark, sf_dir), BY, SEQ)
    return df.select("user_id", "event_id", r6("distance").alias("distance"), r6("bearing").alias("bearing"), r6("delta_seconds").alias("delta_seconds"))


@query(_LEGS + """ select user_id, event_id, round(coalesce(sum(d) over w, 0), 3) as total_distance, round(coalesce(sum(s) over w, 0), 1) as total_seconds
from g window w as (partition by user_id order by time, event_id rows unbounded preceding)""")
def track_running_totals(spark, sf_dir):
    df = track.with_totals(track.with_legs(views.fixes(spark, sf_dir), BY, SEQ), BY, SEQ)
    return df.select("user_id", "event_id", F.round("total_distance", 3).alias("total_distance"), F.round("total_seconds", 1).alias("total_seconds"))


_bd, _bb = leg_sql("plat", "plon", "lat", "lon")
_ad, _ab = leg_sql("lat", "lon", "nlat", "nlon")
_SCHEDULE = f"""with r as ({ROUTES}), n as (select *, lag(lat) over w as plat, lag(lon) over w as plon, lead(lat) over w as nlat, lead(lon) over w as nlon from r window w as (partition by route order by seq)),
g as (select *, coalesce({_bd}, 0) as distance, {_bb} as true_bearing, {_ab} as ahead from n),
h as (select *, case when plat is null then 0 else 60 * distance / 5.0 end as ete from g),
s as (select *, sum(round_even(ete * 60000000, 0)::BIGINT) over (partition by route order by seq rows unbounded preceding) as us from h)"""


def _scheduled(spark, sf_dir):
    return schedule.schedule(views.routes(spark, sf_dir), ["route"], ["seq"], F.col("departure"), F.lit(5.0), schedule.constant(-11.0))


@query(_SCHEDULE + """ select route, seq, round(distance, 6) as distance, round(true_bearing, 6) as true_bearing, round(true_bearing + 11, 6) as magnetic, round(ete, 6) as enroute_minutes,
  round(ahead + 11, 6) as next_course, strftime(departure + to_microseconds(us::BIGINT), '%Y-%m-%d %H:%M') as arrival from s""")
def route_schedule(spark, sf_dir):
    df = _scheduled(spark, sf_dir)
    return df.select("route", "seq", *(r6(c).alias(c) for c in ("distance", "true_bearing", "magnetic", "enroute_minutes", "next_course")), F.date_format("arrival", "yyyy-MM-dd HH:mm").alias("arrival"))


@query(_SCHEDULE + """ select route, count(*) as waypoints, round(sum(distance), 5) as distance, round(sum(ete), 5) as minutes,
  case when sum(ete) <> 0 then round(sum(distance) * 60 / sum(ete), 5) end as average_speed from s group by route""")
def route_totals(spark, sf_dir):
    df = schedule.route_totals(_scheduled(spark, sf_dir), ["route"])
    return df.select("route", "waypoints", *(F.round(c, 5).alias(c) for c in ("distance", "minutes", "average_speed")))


@query(f"with r as ({ROUTES}) select route, (row_number() over (partition by route order by seq desc) - 1) as seq, name from r")
def reciprocal_route(spark, sf_dir):
    return schedule.reverse_route(views.routes(spark, sf_dir), ["route"], "seq").select("route", F.col("seq").cast("long").alias("seq"), "name")


def _range(radius):
    def run(spark, sf_dir):
        r = views.routes(spark, sf_dir)
        leg = geodesy.range_bearing(F.lit(36.5), F.lit(-76.25), F.col("lat"), F.col("lon"), radius)
        return r.select("route", "seq", leg.alias("leg")).select("route", "seq", r6("leg.distance").alias("distance"), r6("leg.bearing").alias("bearing"))

    return run


for _name, _radius in (("nm", geodesy.NM), ("km", geodesy.KM), ("mi", geodesy.MI)):
    _x, _y = leg_sql("36.5::DOUBLE", "-76.25::DOUBLE", "lat", "lon", _radius)
    QUERIES[f"range_bearing_{_name}"] = _range(_radius)
    ORACLES[f"range_bearing_{_name}"] = f"with r as ({ROUTES}) select route, seq, round({_x}, 6) as distance, round({_y}, 6) as bearing from r"


@query(f"""with r as ({ROUTES}), a as (select *, radians(lat) as p, radians((seq * 37 + 5)::DOUBLE) as c, (seq * 11)::DOUBLE / 3440.069 as arc from r),
e as (select *, arc * cos(c) as rise, p + arc * cos(c) as q from a),
z as (select *, case when abs(rise) < 1e-6 then cos(p) else rise / ln(tan(q / 2 + pi() / 4) / tan(p / 2 + pi() / 4)) end as ratio from e)
select route, seq, round(degrees(q), 6) as to_lat, round(degrees(radians(lon) + arc * sin(c) / ratio), 6) as to_lon from z""")
def destination_rhumb(spark, sf_dir):
    to = geodesy.destination(F.col("lat"), F.col("lon"), (F.col("seq") * 11).cast("double"), (F.col("seq") * 37 + 5).cast("double"))
    df = views.routes(spark, sf_dir).select("route", "seq", to.alias("to"))
    return df.select("route", "seq", r6("to.lat").alias("to_lat"), r6("to.lon").alias("to_lon"))


_TEXTS = """select o_orderkey as k, case o_orderkey % 4 when 0 then (o_orderkey % 89) || ' ' || (o_orderkey % 60) || '.' || (100 + o_orderkey % 900) || 'N'
  when 1 then (o_orderkey % 179) || ' ' || (o_orderkey % 60) || ' ' || (o_orderkey % 59) || 'W' when 2 then (o_orderkey % 89) || '.' || (10 + o_orderkey % 90) || 'S' else 'Due North' end as t from orders"""


def _texts(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    t = F.when(k % 4 == 0, F.concat(s(k % 89), F.lit(" "), s(k % 60), F.lit("."), s(100 + k % 900), F.lit("N")))
    t = t.when(k % 4 == 1, F.concat(s(k % 179), F.lit(" "), s(k % 60), F.lit(" "), s(k % 59), F.lit("W")))
    t = t.when(k % 4 == 2, F.concat(s(k % 89), F.lit("."), s(10 + k % 90), F.lit("S"))).otherwise("Due North")
    return views.load(spark, sf_dir, "orders").select(k.alias("k"), t.alias("t"))


_PARSED = f"""with t as ({_TEXTS}) select k, t, case k % 4 when 0 then split_part(t, ' ', 1)::DOUBLE + replace(split_part(t, ' ', 2), 'N', '')::DOUBLE / 60
  when 1 then -(split_part(t, ' ', 1)::DOUBLE + split_part(t, ' ', 2)::DOUBLE / 60 + replace(split_part(t, ' ', 3), 'W', '')::DOUBLE / 3600) when 2 then -(replace(t, 'S', '')::DOUBLE) end as deg from t"""


@query(f"select k, t, round(deg, 6) as degrees from ({_PARSED})")
def angle_parse(spark, sf_dir):
    return _texts(spark, sf_dir).select("k", "t", r6(angle.parse_angle(F.col("t"))).alias("degrees"))


_WHOLE = f"""with p as ({FIXES}), a as (select event_id, lon, abs(lon) as x from p), b as (select *, floor(x)::INT as d0, 60 * (x - floor(x)) as m0 from a),
c as (select *, case when abs(m0 - 60) / 60 < 1e-5 then d0 + 1 else d0 end as d, case when abs(m0 - 60) / 60 < 1e-5 then 0 else m0 end as m, case when lon < 0 then -1 else 1 end as sg from b)"""


@query(_WHOLE + " select event_id, d * sg as d, round(m * case when d = 0 then sg else 1 end, 6) as m from c")
def angle_dm(spark, sf_dir):
    df = views.fixes(spark, sf_dir).select("event_id", angle.dm(F.col("lon")).alias("x"))
    return df.select("event_id", "x.d", r6("x.m").alias("m"))


@query(_WHOLE + """ select event_id, d * sg as d, (floor(m) * case when d = 0 then sg else 1 end)::INT as m,
  round((m - floor(m)) * 60, 3) * case when d = 0 and floor(m) = 0 then sg else 1 end as s from c""")
def angle_dms(spark, sf_dir):
    df = views.fixes(spark, sf_dir).select("event_id", angle.dms(F.col("lon")).alias("x"))
    return df.select("event_id", "x.d", "x.m", "x.s")


@query("""select p_partkey as k, printf('%02d %.3f%s', (p_partkey % 80)::INT, (p_partkey % 60)::DOUBLE + 0.25, case when p_partkey % 2 = 0 then 'N' else 'S' end) as lat_dm,
  printf('%07.3f%s', (p_partkey % 170)::DOUBLE + 0.125, 'W') as lon_d from part""")
def angle_format_lat_lon(spark, sf_dir):
    k = F.col("p_partkey")
    lat = ((k % 80) + ((k % 60) + F.lit(0.25)) / 60) * F.when(k % 2 == 0, 1).otherwise(-1)
    lat = F.when((lat == 0) & (k % 2 != 0), F.lit(-0.0)).otherwise(lat)
    return views.load(spark, sf_dir, "part").select(k.alias("k"), angle.format_lat(lat, "dm").alias("lat_dm"), angle.format_lon(-((k % 170) + F.lit(0.125)), "d").alias("lon_d"))


@query("select p_partkey as k, (p_partkey % 180 - 90)::BIGINT as d0, case when x < 0 then ceil(x) else floor(x) end::INT as d, floor(abs(x - case when x < 0 then ceil(x) else floor(x) end) * 60 + 0.5)::INT * case when x < 0 and ceil(x) = 0 then -1 else 1 end as m from (select p_partkey, (p_partkey % 180 - 90) + (p_partkey % 7) * 0.125::DOUBLE as x from part)")
def deg2dm(spark, sf_dir):
    k = F.col("p_partkey")
    df = views.load(spark, sf_dir, "part").select(k.alias("k"), (k % 180 - 90).cast("long").alias("d0"), angle.degrees_minutes((k % 180 - 90) + (k % 7) * F.lit(0.125)).alias("x"))
    return df.select("k", "d0", "x.d", "x.m")


@query(f"with f as ({FIXES}) select event_id, {olc_sql('lat', 'lon', 11)} as code11, {olc_sql('lat', 'lon', 10)} as code10 from f")
def olc_encode(spark, sf_dir):
    f = views.fixes(spark, sf_dir)
    return f.select("event_id", geocode.olc_encode(F.col("lat"), F.col("lon"), 11).alias("code11"), geocode.olc_encode(F.col("lat"), F.col("lon"), 10).alias("code10"))


@query(f"with f as ({FIXES}) select event_id, round(floor(round((lat + 90) * 8000, 6)) / 8000 - 90, 8) as lat_lo, round(floor(round((lon + 180) * 8000, 6)) / 8000 - 180, 8) as lon_lo, round((floor(round((lat + 90) * 8000, 6)) + 1) / 8000 - 90, 8) as lat_hi, round((floor(round((lon + 180) * 8000, 6)) + 1) / 8000 - 180, 8) as lon_hi from f")
def olc_decode(spark, sf_dir):
    f = views.fixes(spark, sf_dir).select("event_id", geocode.olc_decode(geocode.olc_encode(F.col("lat"), F.col("lon"), 10)).alias("box"))
    return f.select("event_id", *(F.round(f"box.{c}", 8).alias(c) for c in ("lat_lo", "lon_lo", "lat_hi", "lon_hi")))


@query("""select event_id, date_trunc('minute', ts) as at from events""")
def date_parse(spark, sf_dir):
    e = views.load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    text = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "h:mm a")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "MMM d HH:mm")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "M-d-yyyy h:mm a")).otherwise(F.date_format("ts", "M/d/yyyy HHmm"))
    return e.select("event_id", clock.parse_datetime(text, F.to_date("ts")).alias("at"))


_DURATION = "(select o_orderkey as k, (o_orderkey % 5) as d, (o_orderkey % 24) as h, (o_orderkey % 60) as m, (o_orderkey % 59) as s from orders)"


def _durations(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.format_string("%dd %dH %dM %dS", k % 5, k % 24, k % 60, k % 59)
    return views.load(spark, sf_dir, "orders").select(k.alias("k"), clock.parse_duration(text).alias("seconds"))


@query(f"select k, ((d * 24 + h) * 60 + m) * 60 + s as seconds, printf('%dd %02dh %02dm %02ds', d, h, m, s) as text from {_DURATION}")
def duration_parse(spark, sf_dir):
    return _durations(spark, sf_dir).select("k", "seconds", clock.format_duration(F.col("seconds")).alias("text"))


@query(f"select k, ((d * 24 + h) * 60 + m) * 60 + s - 86400 as seconds, floor((((d * 24 + h) * 60 + m) * 60 + s - 86400) / 86400.0)::BIGINT as d, (h)::BIGINT as h, (m)::BIGINT as m, (s)::BIGINT as s from {_DURATION}")
def duration_arith(spark, sf_dir):
    df = _durations(spark, sf_dir).withColumn("seconds", F.col("seconds") - 86400)
    return df.select("k", "seconds", clock.duration_parts(F.col("seconds")).alias("p")).select("k", "seconds", "p.*")


_SUN = f"""with f as ({FIXES}), a as (select event_id, lat, lon, date_diff('day', date '1900-01-01', time::DATE) + 2 + 2415018.5 + (epoch_us(time) - epoch_us(date_trunc('day', time))) / 86400e6 + 5 / 24.0::DOUBLE as jd from f),
b as (select *, (jd - 2451545) / 36525 as t from a),
c as (select *, 280.46646::DOUBLE + t * (36000.76983::DOUBLE + 0.0003032::DOUBLE * t) as i0, radians(357.52911::DOUBLE + t * (35999.05029::DOUBLE - 0.0001537::DOUBLE * t)) as j, 0.016708634::DOUBLE - t * (0.000042037::DOUBLE + 0.0000001267::DOUBLE * t) as k, radians(125.04::DOUBLE - 1934.136::DOUBLE * t) as nd from b),
d as (select *, i0 - 360 * floor(i0 / 360) as i from c),
e as (select *, radians(i + sin(j) * (1.914602::DOUBLE - t * (0.004817::DOUBLE + 0.000014::DOUBLE * t)) + sin(2 * j) * (0.019993::DOUBLE - 0.000101::DOUBLE * t) + sin(3 * j) * 0.000289::DOUBLE - 0.00569::DOUBLE - 0.00478::DOUBLE * sin(nd)) as p,
 radians(23 + (26 + (21.448::DOUBLE - t * (46.815::DOUBLE + t * (0.00059::DOUBLE - t * 0.001813::DOUBLE))) / 60) / 60 + 0.00256::DOUBLE * cos(nd)) as r from d),
g as (select *, asin(sin(r) * sin(p)) as dec, tan(r / 2) * tan(r / 2) as y from e),
h as (select *, 4 * degrees(y * sin(2 * radians(i)) - 2 * k * sin(j) + 4 * k * y * sin(j) * cos(2 * radians(i)) - 0.5 * y * y * sin(4 * radians(i)) - 1.25 * k * k * sin(2 * j)) as eq,
 degrees(acos(cos(radians(90.833::DOUBLE)) / (cos(radians(lat)) * cos(dec)) - tan(radians(lat)) * tan(dec))) * 4 / 1440 as half from g),
z as (select *, (720 - 4 * lon - eq - 300) / 1440 as x from h)"""


@query(_SUN + " select event_id, round(x * 1440, 2) as noon, round((x - half) * 1440, 2) as rise, round((x + half) * 1440, 2) as \"set\" from z")
def sun_times(spark, sf_dir):
    f = views.fixes(spark, sf_dir)
    x = f.select("event_id", "time", sun.sun_minutes(F.col("time"), F.col("lat"), F.col("lon"), F.lit(-5.0)).alias("x"))
    return x.select("event_id", *(F.round(f"x.{c}", 2).alias(c) for c in ("noon", "rise", "set")))


@query("select event_id, round(year(ts) + (dayofyear(ts) - 1) / 365.242::DOUBLE, 6) as y from events")
def decimal_year(spark, sf_dir):
    return views.load(spark, sf_dir, "events").select("event_id", r6(clock.decimal_year(F.to_date("ts"))).alias("y"))


@query("select p_partkey as k, round(round(degrees((p_partkey * 1000 - 8505883) / 6356752.3142::DOUBLE), 8), 6) as lon, round(round(degrees(2 * atan(exp((p_partkey * 100 + 2788774) / 6356752.3142::DOUBLE)) - pi() / 2), 8), 6) as lat from part")
def mercator_to_degrees(spark, sf_dir):
    k = F.col("p_partkey")
    return views.load(spark, sf_dir, "part").select(k.alias("k"), r6(geodesy.mercator_lon(k * 1000 - 8505883)).alias("lon"), r6(geodesy.mercator_lat(k * 100 + 2788774)).alias("lat"))


_SIDES = f"with l as ({LEFT}), r as ({RIGHT})"
_EDGE = {
    "name": "l.name is not distinct from r.name",
    "guid": "l.guid = r.guid",
    "geocode8": "substr(l.geocode, 1, 8) = substr(r.geocode, 1, 8)",
    "distance": f"{leg_sql('l.lat', 'l.lon', 'r.lat', 'r.lon')[0]} <= 0.05 and abs(l.lat - r.lat) < 0.01",
}
_RULES = {"name": match.by_name(), "guid": match.by_guid(), "geocode8": match.by_geocode(8), "distance": match.NearRule()}


def _matching(rule):
    return lambda spark, sf_dir: match.match(views.left_points(spark, sf_dir), views.right_points(spark, sf_dir), [rule])


for _name, _on in _EDGE.items():
    QUERIES[f"match_by_{_name}"] = _matching(_RULES[_name])
    ORACLES[f"match_by_{_name}"] = f"{_SIDES} select l.id as left_id, r.id as right_id, '{_name}' as rule from l join r on {_on}"

_EDGES = _SIDES + ", e as (" + " union ".join(f"select l.id as left_id, r.id as right_id, '{n}' as rule from l join r on {_EDGE[n]}" for n in ("guid", "geocode8")) + ")"


_BOTH = [match.by_guid(), match.by_geocode(8)]


def _edges(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return left, right, match.match(left, right, _BOTH)


def _sides(spark, sf_dir):
    return views.left_points(spark, sf_dir), views.right_points(spark, sf_dir)


@query(_EDGES + """ select left_id::VARCHAR as left_id, right_id::VARCHAR as right_id, rule, 'both' as status from e union all select id::VARCHAR, null, null, 'first' from l where id not in (select left_id from e)
union all select null, id::VARCHAR, null, 'second' from r where id not in (select right_id from e)""")
def match_outer_merge(spark, sf_dir):
    merged = match.outer_merge(*_edges(spark, sf_dir), _BOTH)
    return merged.select(F.col("left_id").cast("string").alias("left_id"), F.col("right_id").cast("string").alias("right_id"), "rule", "status")


@query(_EDGES + " select id, name, geocode from r where id not in (select right_id from e)")
def match_left_anti_new(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return right.join(match.touched(left, right, _BOTH, "right"), "id", "left_anti").select("id", "name", "geocode")


@query(_EDGES + " select l.id, count(e.left_id) as match_count from l left join e on l.id = e.left_id group by l.id")
def match_rank(spark, sf_dir):
    return match.rank(*_sides(spark, sf_dir), _BOTH)


@query(_EDGES + " select left_id, rule, array_to_string(list_sort(list(distinct right_id)), ',') as right_ids from e group by left_id, rule")
def matches_by_rule(spark, sf_dir):
    _, _, edges = _edges(spark, sf_dir)
    return match.matches_by_rule(edges).select("left_id", "rule", F.array_join(F.col("right_ids").cast("array<string>"), ",").alias("right_ids"))


@query(f"with l as ({LEFT}) select id, name, geocode from (select *, row_number() over (partition by substr(geocode, 1, 10) order by last_updated desc, id desc) as o from l) where o = 1")
def dedup_keep_latest(spark, sf_dir):
    return match.deduplicate(views.left_points(spark, sf_dir)).select("id", "name", "geocode")


@query("""select p_partkey as k, case when i = 3 and c = 0 then 'anchor' when i = 2 and c = 0 then 'diamond,blue' when i = 1 and c = 6 then 'circle,white' when i = 0 and c = 0 then 'cross,blue' when i = 0 and c = 3 then 'cross,yellow'
  when i = 1 and c = 4 then 'circle,green' else i || ',' || c end as sym from (select p_partkey, p_partkey % 4 as i, p_partkey % 7 as c from part)""")
def icon_lookup(spark, sf_dir):
    from ..sources.usr import with_symbol

    k = F.col("p_partkey")
    df = views.load(spark, sf_dir, "part").select(k.alias("k"), (k % 4).cast("int").alias("icon_id"), (k % 7).cast("int").alias("color_id"))
    return with_symbol(df).select("k", "sym")


@query("""with a as (select p_partkey as k, radians(30 + p_partkey % 120)::DOUBLE as th, radians((p_partkey % 360)::DOUBLE) as la, power(6371.2::DOUBLE / (6371.2 + p_partkey % 50), 3) as q from part)
select k, round(q * (29000 * sin(th) + (-1500 * cos(la) + 4600 * sin(la)) * cos(th)), 3) as x, round(q * (-1500 * sin(la) - 4600 * cos(la)), 3) as y,
  round(-2 * q * (-29000 * cos(th) + (-1500 * cos(la) + 4600 * sin(la)) * sin(th)), 3) as z from a""")
def igrf_degree1(spark, sf_dir):
    rows = [(k, n, m, e, v) for k, n, m, v in (("g", 1, 0, -29000.0), ("g", 1, 1, -1500.0), ("h", 1, 1, 4600.0)) for e in (2000, 2005)]
    rows = [(k, n, m, e, v if e == 2000 else 0.0) for k, n, m, e, v in rows]
    k = F.col("p_partkey")
    df = views.load(spark, sf_dir, "part").select(k.alias("k"), geomagnetic.field_column(rows, 90 - (30 + k % 120).cast("double"), (k % 360).cast("double"), F.lit(2000.0), 6371.2 + (k % 50), geodetic=False).alias("f"))
    return df.select("k", *(F.round(f"f.{c}", 3).alias(c) for c in "xyz"))


def survey_report(spark, sf_dir):
    return match.survey(views.left_points(spark, sf_dir), views.right_points(spark, sf_dir), [match.by_name(), match.by_guid(), match.by_geocode(8)])


QUERIES["survey_report"] = survey_report
