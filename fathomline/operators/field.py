"""The geomagnetic field with its models as a table: any number of models in one join.

``coefficients`` has model, kind (g or h), n, m, epoch and value; of each model the last epoch holds the yearly change after the one before it. The models
become a dimension with a row for each epoch: its terms beside those of the next, in the order of the recursion. A point meets the epoch at or before its date by
an as-of join: its model's epochs (a short array) say which, and (model, epoch) is the key. Recursion and sum are higher-order functions over the terms, or,
for many points, an Arrow function: of each batch the points of one (model, epoch) are one array, so a term costs a few operations a batch and not some dozen expressions a point.

Defined cases: a point without position, date or model, of a model that the table lacks, or of a date before its first epoch has a null field.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import decimal_year
from ..functions.geodesy import NM
from ..functions.geomagnetic import A2, B2, RADIUS
from ..scratch import settle
from . import schedule

EPOCHS = 2_000  # so many rows of the models' dimension, some hundred terms each, are sent to all tasks; more are shuffled


def model_epochs(coefficients: DataFrame) -> DataFrame:
    """model, epoch, change (years to the next epoch, null where the next holds a yearly change), terms (n, m, g, h, and g and h of the next epoch); a row for each epoch that a date can follow."""
    value = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value").cast("double"))), F.lit(0.0)).alias(kind)
    key = [F.col(c).cast("double").alias(c) for c in ("epoch", "n", "m")]
    cells = coefficients.select("model", "kind", "value", *key).groupBy("model", "epoch", "n", "m").agg(value("g"), value("h"))
    epochs = cells.groupBy("model", "epoch").agg(F.array_sort(F.collect_list(F.struct("n", "m", "g", "h"))).alias("terms"))  # a model's terms: some hundreds
    w = Window.partitionBy("model").orderBy("epoch")
    pairs = epochs.withColumns({"next": F.lead("terms").over(w), "then": F.lead("epoch").over(w), "last": F.lead("epoch", 2).over(w).isNull()}).filter("next is not null")
    following = lambda t: F.try_element_at(F.filter("next", lambda x: (x["n"] == t["n"]) & (x["m"] == t["m"])), F.lit(1))
    both = F.transform("terms", lambda t: F.struct(t["n"].alias("n"), t["m"].alias("m"), t["g"].alias("g"), t["h"].alias("h"), F.coalesce(following(t)["g"], F.lit(0.0)).alias("g1"), F.coalesce(following(t)["h"], F.lit(0.0)).alias("h1")))
    return pairs.select("model", "epoch", F.when(~F.col("last"), F.col("then") - F.col("epoch")).alias("change"), both.alias("terms"))


def _legendre(terms: Column, ct: Column, st: Column) -> Column:
    """Struct p, q: the functions of the terms (behind that of degree 0) and their derivatives by the colatitude, half normalized."""

    def add(acc: Column, t: Column) -> Column:
        n, m = t["n"], t["m"]
        at = (n * (n + 1) / 2 + m).cast("int")
        back = lambda which, by: F.coalesce(F.get(acc[which], at - by.cast("int")), F.lit(0.0))
        lower = F.when(n - 2 >= m, F.sqrt((n - 1) * (n - 1) - m * m)).otherwise(0.0)
        norm, scale = F.sqrt(n * n - m * m), F.when(n == 1, 1.0).otherwise(F.sqrt(1 - 1 / (2 * n)))
        p = F.when(m == n, scale * st * back("p", n + 1)).otherwise(((2 * n - 1) * ct * back("p", n) - lower * back("p", 2 * n - 1)) / norm)
        q = F.when(m == n, scale * (st * back("q", n + 1) + ct * back("p", n + 1))).otherwise(((2 * n - 1) * (ct * back("q", n) - st * back("p", n)) - lower * back("q", 2 * n - 1)) / norm)
        return F.struct(F.concat(acc["p"], F.array(p)).alias("p"), F.concat(acc["q"], F.array(q)).alias("q"))

    return F.aggregate(terms, F.struct(F.array(F.lit(1.0)).alias("p"), F.array(F.lit(0.0)).alias("q")), add)


def legendre(degree: int, ct: np.ndarray, st: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By n and m the functions up to a degree and their derivatives by the colatitude, half normalized."""
    none = np.zeros_like(ct)
    out = {(0, 0): (none + 1, none)}
    for n in range(1, degree + 1):
        for m in range(n + 1):
            if m == n:
                (p, q), scale = out[n - 1, m - 1], 1.0 if n == 1 else math.sqrt(1 - 1 / (2 * n))
                out[n, m] = scale * st * p, scale * (st * q + ct * p)
            else:
                (p, q), (p2, q2) = out[n - 1, m], out.get((n - 2, m), (none, none))
                lower, norm = math.sqrt((n - 1) ** 2 - m * m), math.sqrt(n * n - m * m)
                out[n, m] = ((2 * n - 1) * ct * p - lower * p2) / norm, ((2 * n - 1) * (ct * q - st * p) - lower * q2) / norm
    return out


def harmonics(terms: list[dict], here: np.ndarray, ahead: np.ndarray, lam: np.ndarray, ct: np.ndarray, st: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """North, east and down of points, in the sphere's directions: the sum over the terms of one model and epoch."""
    x, y, z = np.zeros_like(ct), np.zeros_like(ct), np.zeros_like(ct)
    pole = np.abs(st) < 1e-12
    functions = legendre(max((int(t["n"]) for t in terms), default=0), ct, st)
    for t in terms:
        n, m = int(t["n"]), int(t["m"])
        p, q = functions[n, m]
        g, h = here * t["g"] + ahead * t["g1"], here * t["h"] + ahead * t["h1"]
        c, s, fall = np.cos(m * lam), np.sin(m * lam), ratio ** (n + 2)
        along, across = fall * (g * c + h * s), fall * (g * s - h * c)
        x += along * q
        y += across * m * np.where(pole, q * np.sign(ct), p / np.where(pole, 1.0, st))
        z -= along * (n + 1) * p
    return x, y, z


def _sums(key: Column, terms: Column, *values: Column) -> Column:
    """Struct x, y, z of ``harmonics``; rows of one ``key`` have the same terms. Null where a value is missing."""

    @F.arrow_udf("struct<x: double, y: double, z: double>")
    def run(key: pa.Array, terms: pa.Array, here: pa.Array, ahead: pa.Array, lam: pa.Array, ct: pa.Array, st: pa.Array, ratio: pa.Array) -> pa.Array:
        values = (here, ahead, lam, ct, st, ratio)
        there = pc.is_valid(terms).to_numpy(zero_copy_only=False)
        for v in (key, *values):
            there &= pc.is_valid(v).to_numpy(zero_copy_only=False)
        numbers = [v.to_numpy(zero_copy_only=False) for v in values]
        out = np.zeros((3, len(key)))
        keys = pc.dictionary_encode(pc.fill_null(key, "")).indices.to_numpy(zero_copy_only=False)
        for k in np.unique(keys[there]):
            at = np.flatnonzero((keys == k) & there)
            out[:, at] = harmonics(terms[int(at[0])].as_py(), *(v[at] for v in numbers))
        return pa.StructArray.from_arrays([pa.array(v) for v in out], names=list("xyz"), mask=pa.array(~there))

    return run(key, terms, *values)


def with_field(points: DataFrame, coefficients: DataFrame, model: Column, lat: Column, lon: Column, year: Column, altitude: Column | None = None, geodetic: bool = True, name: str = "field", in_batches: bool = False) -> DataFrame:
    """Add a struct x, y, z, f (north, east, down, total; nT) to ``points``: of the model at latitude, longitude (degrees), decimal year and altitude in km (or radius, if not ``geodetic``).
    ``in_batches``: for many points, by an Arrow function; else in the JVM, point by point."""
    whole = F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("row")
    rows = points.select(whole, model.cast("string").alias("model"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), year.cast("double").alias("year"), (F.lit(0.0) if altitude is None else altitude.cast("double")).alias("alt"))
    dimension = settle(model_epochs(coefficients.withColumn("model", F.col("model").cast("string"))))
    few = F.broadcast if dimension.count() <= EPOCHS else (lambda df: df)  # a model's points never meet in one task
    known = dimension.groupBy("model").agg(F.collect_list("epoch").alias("epochs"))
    rows = rows.join(few(known), "model", "left").withColumn("epoch", F.array_max(F.filter("epochs", lambda e: e <= F.col("year")))).drop("epochs")
    rows = rows.join(few(dimension), ["model", "epoch"], "left")

    here = F.when(F.col("change").isNull(), 1.0).otherwise(1 - (F.col("year") - F.col("epoch")) / F.col("change"))
    ahead = F.when(F.col("change").isNull(), F.col("year") - F.col("epoch")).otherwise((F.col("year") - F.col("epoch")) / F.col("change"))
    rows = rows.withColumns({"here": here, "ahead": ahead, "lam": F.radians(F.pmod("lon", F.lit(360.0))), "c": F.cos(F.radians(90 - F.col("lat"))), "s": F.sin(F.radians(90 - F.col("lat")))})
    c, s, alt = F.col("c"), F.col("s"), F.col("alt")

    def given(found: Column) -> DataFrame:
        return rows.select("row", found.alias("found")).select(*(F.col("row").getField(k).alias(k) for k in points.columns if k != name), F.col("found").alias(name))

    if geodetic:
        one, two = A2 * s * s, B2 * c * c
        rows = rows.withColumn("rho", F.sqrt(one + two))
        rows = rows.withColumn("r", F.sqrt(alt * (alt + 2 * F.col("rho")) + (A2 * one + B2 * two) / (one + two)))
        rows = rows.withColumns({"cd": (alt + F.col("rho")) / F.col("r"), "sd": (A2 - B2) / F.col("rho") * c * s / F.col("r")})
    else:
        rows = rows.withColumns({"r": alt, "cd": F.lit(1.0), "sd": F.lit(0.0)})
    rows = rows.withColumns({"ct": c * F.col("cd") - s * F.col("sd"), "st": s * F.col("cd") + c * F.col("sd")})

    def turned_back(t: Column) -> Column:
        x, y, z = t["x"] * F.col("cd") + t["z"] * F.col("sd"), t["y"], t["z"] * F.col("cd") - t["x"] * F.col("sd")
        return F.when(x.isNotNull(), F.struct(x.alias("x"), y.alias("y"), z.alias("z"), F.sqrt(x * x + y * y + z * z).alias("f")))

    if in_batches:
        key = F.concat_ws(" ", F.col("epoch").cast("string"), "model")
        rows = rows.withColumn("t", _sums(key, F.col("terms"), F.col("here"), F.col("ahead"), F.col("lam"), F.col("ct"), F.col("st"), RADIUS / F.col("r")))
        return given(turned_back(F.col("t")))
    rows = rows.withColumns({"ratio": RADIUS / F.col("r"), "pole": F.abs("st") < 1e-12})

    def term(acc: Column, t: Column) -> Column:
        u, p, q = t["terms"], t["p"], t["q"]
        g, h = F.col("here") * u["g"] + F.col("ahead") * u["g1"], F.col("here") * u["h"] + F.col("ahead") * u["h1"]
        turn = u["m"] * F.col("lam")
        fall = F.pow("ratio", u["n"] + 2)
        along, across = fall * (g * F.cos(turn) + h * F.sin(turn)), fall * (g * F.sin(turn) - h * F.cos(turn))
        east = across * u["m"] * F.when(F.col("pole"), q * F.signum("ct")).otherwise(p / F.when(~F.col("pole"), F.col("st")))
        return F.struct((acc["x"] + along * q).alias("x"), (acc["y"] + east).alias("y"), (acc["z"] - along * (u["n"] + 1) * p).alias("z"))

    size, zero = F.size("terms"), F.struct(*(F.lit(0.0).alias(k) for k in "xyz"))

    def total(pq: Column) -> Column:
        return F.aggregate(F.arrays_zip(F.col("terms").alias("terms"), F.slice(pq["p"], F.lit(2), size).alias("p"), F.slice(pq["q"], F.lit(2), size).alias("q")), zero, term)

    # As a lambda's variable an expression is computed once; as a column each of its many uses would compute it anew.
    functions = F.array(_legendre(F.col("terms"), F.col("ct"), F.col("st")))
    found = F.get(F.transform(F.transform(functions, total), turned_back), F.lit(0))
    return given(found)


def with_declination(points: DataFrame, coefficients: DataFrame, model: Column, lat: Column, lon: Column, when: Column, name: str = "declination") -> DataFrame:
    """Add the variation in degrees, east positive, at a place and a time (a date or timestamp)."""
    df = with_field(points, coefficients, model, lat, lon, decimal_year(F.to_date(when)), name=name, in_batches=True)
    return df.withColumn(name, F.degrees(F.atan2(F.col(name)["y"], F.col(name)["x"])))


def schedule_under_field(waypoints: DataFrame, by: list[str], seq: list[str], departure: Column, speed: Column, coefficients: DataFrame, model: Column | str = "main", radius: float = NM) -> DataFrame:
    """As ``schedule.schedule``, under the variation of a model (its name, or a column of names) from a table: of the course to here at this waypoint and the time before the leg, of the next course at the next
    waypoint and the time of arrival. Arrival times don't depend on the variation, so the schedule comes first."""
    df = schedule.schedule(waypoints, by, seq, departure, speed, schedule.constant(0.0), radius)
    w = Window.partitionBy(*by).orderBy(*seq)
    df = df.withColumns({"left_": F.lag("arrival").over(w), "next_lat_": F.lead("lat").over(w), "next_lon_": F.lead("lon").over(w), "model_": F.lit(model) if isinstance(model, str) else model})
    df = with_declination(df, coefficients, F.col("model_"), F.col("lat"), F.col("lon"), F.col("left_"), "here_")
    df = with_declination(df, coefficients, F.col("model_"), F.col("next_lat_"), F.col("next_lon_"), F.col("arrival"), "there_")
    return df.withColumns({"magnetic": F.col("magnetic") - F.col("here_"), "next_course": F.col("next_course") - F.col("there_")}).drop("left_", "next_lat_", "next_lon_", "model_", "here_", "there_")
