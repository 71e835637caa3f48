"""Navigation inputs made by arithmetic from the star-schema tables, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


ROUTE_ROWS = 250_000  # rows of a task


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track fixes: track user_id, order time and event_id."""
    e = load(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("time"), (36 + (F.col("event_id") % 997) / F.lit(500.0)).alias("lat"), (-77 + (F.col("event_id") % 991) / F.lit(400.0)).alias("lon"))


FIXES = "select user_id, event_id, ts as time, 36.0::DOUBLE + (event_id % 997) / 500.0::DOUBLE as lat, -77.0::DOUBLE + (event_id % 991) / 400.0::DOUBLE as lon from events"


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route waypoints: route l_orderkey, order l_linenumber, departure the order's date."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # A task sorts its part several times (join, numbers, what comes after), so the parts are as many as the rows ask for, whatever the session's usual number.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROUTE_ROWS + 1)
    rows = rows.repartition(parts, "l_orderkey")
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("timestamp").alias("departure")).repartition(parts, "l_orderkey")
    return rows.join(orders, "l_orderkey").select(
        F.col("l_orderkey").alias("route"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("seq"), "departure",
        (36 + (F.col("l_partkey") % 997) / F.lit(500.0)).alias("lat"), (-77 + (F.col("l_suppkey") % 991) / F.lit(400.0)).alias("lon"),
        F.concat(F.lit("WP"), F.col("l_partkey")).alias("name"), F.lit("").alias("description"),
    )


ROUTES = """select l_orderkey as route, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey))::INT as seq, o_orderdate::TIMESTAMP as departure,
  36.0::DOUBLE + (l_partkey % 997) / 500.0::DOUBLE as lat, -77.0::DOUBLE + (l_suppkey % 991) / 400.0::DOUBLE as lon, 'WP' || l_partkey as name
  from lineitem join orders on l_orderkey = o_orderkey"""


def _waypoints(df: DataFrame, key: str, shift: float, away: float = 0.0) -> DataFrame:
    """``away``: so far north is every seventh point, which has no guid."""
    k = F.col(key)
    far = (k % 7 == 3) & F.lit(away > 0)
    lat = F.lit(37.001) + (k % 313) / F.lit(100.0) + shift + F.when(far, away).otherwise(0.0)
    lon = F.lit(-75.999) - (k % 17) / F.lit(100.0) - shift
    from ..functions.geocode import olc_encode

    rows = df.select(k.cast("long").alias("id"), lat.alias("lat"), lon.alias("lon"), F.concat(F.lit("WP"), k % 500).alias("name"), F.when((k % 3 == 0) & ~far, F.md5((k % 700).cast("string"))).alias("guid"), (k % 997).cast("int").alias("days"), k.alias("k"))
    return rows.select("id", "lat", "lon", "name", "guid", olc_encode(F.col("lat"), F.col("lon")).alias("geocode"), F.expr("timestamp'2020-01-01' + make_dt_interval(days)").alias("last_updated"))


def left_points(spark: SparkSession, sf_dir: str, parts: int = 1) -> DataFrame:
    """``parts``: so many tasks make them, if it is more than one; otherwise as the table is read."""
    keys = load(spark, sf_dir, "customer").select("c_custkey")
    return _waypoints(keys.repartition(parts, "c_custkey") if parts > 1 else keys, "c_custkey", 0.0)


def right_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waypoints(load(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 0.0003, 20.0)


DIGITS = "23456789CFGHJMPQRVWX"


def olc_sql(lat: str, lon: str, size: int = 11) -> str:
    """The geocode of two SQL expressions (no points at the pole)."""
    letters = []
    for k in (4, 3, 2, 1, 0):
        for x in (f"({lat} + 90)", f"({lon} + 180)"):
            letters.append(f"substr('{DIGITS}', ((floor(round({x} * 8000, 6))::BIGINT // {20**k}) % 20)::INT + 1, 1)")
    for k in (4, 3, 2, 1, 0):
        up = f"((floor(round(({lat} + 90) * 25000000, 5))::BIGINT % 3125) // {5**k}) % 5"
        right = f"((floor(round(({lon} + 180) * 8192000, 5))::BIGINT % 1024) // {4**k}) % 4"
        letters.append(f"substr('{DIGITS}', (({up}) * 4 + ({right}))::INT + 1, 1)")
    code = f"substr({' || '.join(letters)}, 1, {size})"
    return f"(substr({code}, 1, 8) || '+' || substr({code}, 9))"


def _points_sql(table: str, key: str, shift: float, away: float = 0.0) -> str:
    far = f"({key} % 7 = 3 and {away} > 0)"
    return f"""select id, lat, lon, name, guid, {olc_sql('lat', 'lon')} as geocode, last_updated from (
      select {key}::BIGINT as id, 37.001::DOUBLE + ({key} % 313) / 100.0::DOUBLE + {shift}::DOUBLE + case when {far} then {away}::DOUBLE else 0.0::DOUBLE end as lat, -75.999::DOUBLE - ({key} % 17) / 100.0::DOUBLE - {shift}::DOUBLE as lon,
      'WP' || ({key} % 500) as name, case when {key} % 3 = 0 and not {far} then md5(({key} % 700)::VARCHAR) end as guid,
      timestamp '2020-01-01' + to_days(({key} % 997)::INT) as last_updated from {table})"""


LEFT = _points_sql("customer", "c_custkey", 0.0)
RIGHT = _points_sql("supplier", "s_suppkey", 0.0003, 20.0)


def leg_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = 3440.069) -> tuple[str, str]:
    """Distance and bearing (degrees) expressions."""
    up = f"({radius}::DOUBLE * (radians({lat2}) - radians({lat1})))"
    right = f"({radius}::DOUBLE * cos((radians({lat1}) + radians({lat2})) / 2) * (radians({lon2}) - radians({lon1})))"
    turn = f"atan2({right}, {up})"
    return f"sqrt({up} * {up} + {right} * {right})", f"degrees(case when {turn} < 0 then {turn} + 2 * pi() else {turn} end)"
