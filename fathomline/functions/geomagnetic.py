"""The geomagnetic main field by spherical harmonics, and magnetic variation.

Coefficients come from a table (see ``sources.coefficients``): kind g or h, degree n, order m, epoch,
value. Between epochs they are interpolated; after the last one its yearly change applies. The
sum runs in NumPy over Arrow batches: its recursion is too deep for an expression tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Squared axes of the WGS84 ellipsoid (km^2) and the reference radius (km).
A2, B2, RADIUS = 40680631.6, 40408296.0, 6371.2


def at_years(rows: list[tuple], years: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(g, h) arrays [n, m, place] for decimal years, from (kind, n, m, epoch, value) rows. The row with the
    largest epoch holds the yearly change after the epoch before it."""
    epochs = np.array(sorted({r[3] for r in rows}), float)
    if len(epochs) < 2 or (years < epochs[0]).any():
        raise ValueError(f"no coefficients for {years.min() if len(years) else 'any year'}")
    size, place = max(r[1] for r in rows) + 1, {e: k for k, e in enumerate(epochs)}
    table = {"g": np.zeros((size, size, len(epochs))), "h": np.zeros((size, size, len(epochs)))}
    for kind, n, m, epoch, value in rows:
        table[kind][n, m, place[epoch]] += value
    k = np.minimum(np.searchsorted(epochs, years, "right") - 1, len(epochs) - 2)
    last = k == len(epochs) - 2  # here the next column is a change a year
    part = np.where(last, years - epochs[k], (years - epochs[k]) / (epochs[k + 1] - epochs[k]))
    here = np.where(last, 1.0, 1 - part)
    return tuple(here * table[kind][:, :, k] + part * table[kind][:, :, k + 1] for kind in "gh")


def field(g: np.ndarray, h: np.ndarray, colatitude: np.ndarray, longitude: np.ndarray, altitude: np.ndarray, geodetic: bool = True):
    """North, east, down and total intensity (nT); angles in degrees, altitude in km (or radius, if not geodetic)."""
    theta, lam = np.radians(colatitude), np.radians(longitude)
    ct, st = np.cos(theta), np.sin(theta)
    cd, sd, r = np.ones_like(ct), np.zeros_like(ct), altitude
    if geodetic:
        one, two = A2 * st * st, B2 * ct * ct
        rho = np.sqrt(one + two)
        r = np.sqrt(altitude * (altitude + 2 * rho) + (A2 * one + B2 * two) / (one + two))
        cd, sd = (altitude + rho) / r, (A2 - B2) / rho * ct * st / r
        ct, st = ct * cd - st * sd, st * cd + ct * sd
    size = g.shape[0]
    p = {(0, 0): np.ones_like(ct)}
    dp = {(0, 0): np.zeros_like(ct)}
    for n in range(1, size):
        scale = 1.0 if n == 1 else np.sqrt(1 - 1 / (2 * n))
        p[n, n] = scale * st * p[n - 1, n - 1]
        dp[n, n] = scale * (st * dp[n - 1, n - 1] + ct * p[n - 1, n - 1])
        for m in range(n):
            below = np.sqrt((n - 1) ** 2 - m * m) if n - 2 >= m else 0.0
            norm = np.sqrt(n * n - m * m)
            p[n, m] = ((2 * n - 1) * ct * p[n - 1, m] - (below * p[n - 2, m] if below else 0)) / norm
            dp[n, m] = ((2 * n - 1) * (ct * dp[n - 1, m] - st * p[n - 1, m]) - (below * dp[n - 2, m] if below else 0)) / norm
    x, y, z = np.zeros_like(ct), np.zeros_like(ct), np.zeros_like(ct)
    pole = np.abs(st) < 1e-12
    safe = np.where(pole, 1.0, st)
    for n in range(1, size):
        fall = (RADIUS / r) ** (n + 2)
        for m in range(n + 1):
            along = g[n, m] * np.cos(m * lam) + h[n, m] * np.sin(m * lam)
            across = g[n, m] * np.sin(m * lam) - h[n, m] * np.cos(m * lam)
            x += fall * along * dp[n, m]
            y += fall * across * m * np.where(pole, dp[n, m] * np.sign(ct), p[n, m] / safe)
            z -= fall * (n + 1) * along * p[n, m]
    x, z = x * cd + z * sd, z * cd - x * sd
    return x, y, z, np.sqrt(x * x + y * y + z * z)


def field_column(rows: list[tuple], lat: Column, lon: Column, year: Column, altitude: Column | None = None, geodetic: bool = True) -> Column:
    """Struct x, y, z, f. ``rows`` are a model's coefficients: some thousands of numbers, shipped with the task."""

    @F.pandas_udf("x double, y double, z double, f double")
    def run(lat: pd.Series, lon: pd.Series, year: pd.Series, alt: pd.Series) -> pd.DataFrame:
        out = np.full((len(lat), 4), np.nan)
        good = (lat.notna() & lon.notna() & year.notna()).to_numpy()
        for k in range(0, len(out), 2_048):  # coefficients of so many places at once
            at = k + np.flatnonzero(good[k : k + 2_048])
            if len(at):
                g, h = at_years(rows, year.to_numpy(float)[at])
                out[at] = np.stack(field(g, h, 90 - lat.to_numpy(float)[at], lon.to_numpy(float)[at] % 360, alt.to_numpy(float)[at], geodetic), 1)
        return pd.DataFrame(out, columns=list("xyzf"))

    return run(lat, lon, year, F.lit(0.0) if altitude is None else altitude)


def declination(rows: list[tuple], lat: Column, lon: Column, year: Column) -> Column:
    """Variation in degrees, east positive."""
    f = field_column(rows, lat, lon, year)
    return F.degrees(F.atan2(f["y"], f["x"]))


def variance(rows: list[tuple]):
    """A schedule's variance function from a model's coefficients."""
    from .clock import decimal_year

    return lambda lat, lon, when: declination(rows, lat, lon, decimal_year(F.to_date(when)))
