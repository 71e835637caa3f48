"""Queries of field models as a table, of schedules under them, and of voyages cut by gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import field, schedule, voyage
from . import views
from .documents import _MODEL, _across, _around, _c
from .queries import _LEGS, _SCHEDULE, query


def _models(spark, sf_dir):
    """Two models of degree 2 in one table, which the second halves; their names come from the parts."""
    places = [F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n"), F.lit(m).alias("m"), F.lit(e).alias("epoch"), F.lit(float(v)).alias("value")) for k, n, m, e, v in _MODEL]
    names = views.load(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, "main").otherwise("half").alias("model")).distinct()
    rows = names.select("model", F.inline(F.array(*places)))
    return rows.withColumn("value", F.when(F.col("model") == "half", F.col("value") / 2).otherwise(F.col("value")))


def _inner(at: str) -> str:
    """North and down of a degree-2 field in SQL, at colatitude th, longitude la and ratio q (its names of a table ``at``)."""
    return f"""select *, power(q, 3) * (-({_c['g', 1, 0]}) * sin(th) + {_around(1, 1)} * cos(th)) + power(q, 4) * (-3 * ({_c['g', 2, 0]}) * cos(th) * sin(th) + sqrt(3.0::DOUBLE) * {_around(2, 1)} * cos(2 * th) + sqrt(3.0::DOUBLE) * {_around(2, 2)} * sin(th) * cos(th)) as xx,
  power(q, 3) * {_across(1, 1)} + power(q, 4) * (sqrt(3.0::DOUBLE) * {_across(2, 1)} * cos(th) + sqrt(3.0::DOUBLE) * {_across(2, 2)} * sin(th)) as yy,
  -2 * power(q, 3) * (({_c['g', 1, 0]}) * cos(th) + {_around(1, 1)} * sin(th)) - 3 * power(q, 4) * (({_c['g', 2, 0]}) * (3 * cos(th) * cos(th) - 1) / 2 + sqrt(3.0::DOUBLE) * {_around(2, 1)} * sin(th) * cos(th) + sqrt(3.0::DOUBLE) / 2 * {_around(2, 2)} * sin(th) * sin(th)) as zz from {at}"""


@query(f"""with a as (select p_partkey as k, radians(30 + p_partkey % 120)::DOUBLE as th, radians((p_partkey % 360)::DOUBLE) as la, 2000 + (p_partkey % 97) / 10.0::DOUBLE as y, 6371.2::DOUBLE / (6371.2 + p_partkey % 50) as q, case when p_partkey % 2 = 0 then 1.0::DOUBLE else 0.5::DOUBLE end as w from part),
b as ({_inner('a')}) select k, round(w * xx, 3) as x, round(w * yy, 3) as y, round(w * zz, 3) as z from b""")
def field_models(spark, sf_dir):
    """Two models in one table, between epochs and after the last one."""
    k = F.col("p_partkey")
    points = views.load(spark, sf_dir, "part").select(k.alias("k"), F.when(k % 2 == 0, "main").otherwise("half").alias("model"), (90 - (30 + k % 120)).cast("double").alias("lat"), (k % 360).cast("double").alias("lon"), (2000 + (k % 97) / F.lit(10.0)).alias("y"), (6371.2 + (k % 50)).cast("double").alias("r"))
    found = field.with_field(points, _models(spark, sf_dir), F.col("model"), F.col("lat"), F.col("lon"), F.col("y"), F.col("r"), geodetic=False)
    return found.select("k", *(F.round(f"field.{c}", 3).alias(c) for c in "xyz"))


def _declined(name: str, lat: str, lon: str, at: str, source: str) -> str:
    """Common table expressions that add the declination ``name`` at a place and time to the rows of ``source``."""
    return f"""{name}_a as (select *, radians(90 - {lat}) as t0, radians({lon} - 360 * floor({lon} / 360)) as la, year({at}) + (dayofyear({at}) - 1) / 365.242::DOUBLE as y from {source}),
{name}_b as (select *, sqrt(40680631.6::DOUBLE * sin(t0) * sin(t0) + 40408296.0::DOUBLE * cos(t0) * cos(t0)) as rho, sqrt((40680631.6::DOUBLE * 40680631.6::DOUBLE * sin(t0) * sin(t0) + 40408296.0::DOUBLE * 40408296.0::DOUBLE * cos(t0) * cos(t0)) / (40680631.6::DOUBLE * sin(t0) * sin(t0) + 40408296.0::DOUBLE * cos(t0) * cos(t0))) as r from {name}_a),
{name}_c as (select *, rho / r as cd, (40680631.6::DOUBLE - 40408296.0::DOUBLE) / rho * cos(t0) * sin(t0) / r as sd, 6371.2::DOUBLE / r as q from {name}_b),
{name}_d as (select *, atan2(sin(t0) * cd + cos(t0) * sd, cos(t0) * cd - sin(t0) * sd) as th from {name}_c),
{name}_e as ({_inner(f'{name}_d')}),
{name}_f as (select route, seq, degrees(atan2(yy, xx * cd + zz * sd)) as {name} from {name}_e)"""


# Orders are some years before the model's epochs; the schedule leaves twelve years later.
_TIMES = _SCHEDULE + """, s1 as (select *, departure + interval 12 year + to_microseconds(us::BIGINT) as arrival from s),
s2 as (select *, lag(arrival) over (partition by route order by seq) as gone from s1)"""


@query(f"""{_TIMES}, {_declined('v1', 'lat', 'lon', 'gone', 's2')}, {_declined('v2', 'nlat', 'nlon', 'arrival', 's2')}
select s2.route, s2.seq, round(true_bearing - v1, 4) as magnetic, round(ahead - v2, 4) as next_course, strftime(arrival, '%Y-%m-%d %H:%M') as arrival from s2 join v1_f using (route, seq) join v2_f using (route, seq)""")
def schedule_under_field(spark, sf_dir):
    rows = views.routes(spark, sf_dir).withColumn("departure", F.col("departure") + F.expr("interval 12 year"))
    df = field.schedule_under_field(rows, ["route"], ["seq"], F.col("departure"), F.lit(5.0), _models(spark, sf_dir))
    return df.select("route", "seq", F.round("magnetic", 4).alias("magnetic"), F.round("next_course", 4).alias("next_course"), F.date_format("arrival", "yyyy-MM-dd HH:mm").alias("arrival"))


_GAP = 36 * 3600


@query(_LEGS + f""", o as (select *, lag(time) over (partition by user_id order by time, event_id) as before from g),
i as (select *, sum(case when before is null or epoch_us(time) - epoch_us(before) > {_GAP}000000 then 1 else 0 end) over (partition by user_id order by time, event_id rows unbounded preceding) - 1 as voyage from o),
v as (select user_id, voyage::BIGINT as voyage, min(time) as started, max(time) as ended, count(*) as fixes, coalesce(sum(case when s <= {_GAP} then d end), 0) as distance, max(case when s <= {_GAP} then d end) as longest from i group by user_id, voyage)
select user_id, voyage, started, ended, fixes, round(distance, 5) as distance, case when ended > started then round(distance * 3600 / ((epoch_us(ended) - epoch_us(started)) / 1e6), 6) end as average_speed, round(longest, 6) as longest_leg from v""")
def voyages(spark, sf_dir):
    v = voyage.voyages(views.fixes(spark, sf_dir), ["user_id"], ["time", "event_id"], _GAP)
    return v.select("user_id", "voyage", "started", "ended", "fixes", F.round("distance", 5).alias("distance"), F.round("average_speed", 6).alias("average_speed"), F.round("longest_leg", 6).alias("longest_leg"))


_WHOLE = _SCHEDULE + """, t as (select *, sum(round_even(ete * 60000000, 0)::BIGINT) over (partition by route) as all_us, sum(distance) over (partition by route) as all_nm, departure + interval 10 day as wanted from s)"""


@query(_WHOLE + """ select route, seq, wanted - to_microseconds(all_us::BIGINT) as departure, wanted - to_microseconds((all_us - us)::BIGINT) as arrival, round(true_bearing + 11, 6) as magnetic from t""")
def schedule_to_arrival(spark, sf_dir):
    """Routes planned backwards: the arrival of the last waypoint is the one that was asked for."""
    rows = views.routes(spark, sf_dir).withColumn("wanted", F.col("departure") + F.expr("interval 10 day")).drop("departure")
    df = schedule.schedule_to(rows, ["route"], ["seq"], F.col("wanted"), F.lit(5.0), schedule.constant(-11.0))
    return df.select("route", "seq", "departure", "arrival", F.round("magnetic", 6).alias("magnetic"))


@query(_WHOLE + """ select route, seq, round(all_nm / 240, 6) as speed_needed from t""")
def route_speed_needed(spark, sf_dir):
    df = schedule.speed_for(views.routes(spark, sf_dir), ["route"], ["seq"], F.col("departure"), F.col("departure") + F.expr("interval 10 day"))
    return df.select("route", "seq", F.round("speed_needed", 6).alias("speed_needed"))
