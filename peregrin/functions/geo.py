"""Geography as SQL expressions over columns, named by strings so that plans stay inside whole-stage code generation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS, RAD, AXIS, METRES_PER_DEGREE = "6371000e0", "0.017453292519943295e0", "6378137e0", 111320.0


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Metres on a sphere of radius 6371000; null if a coordinate is."""
    f1, f2 = f"({lat1})*{RAD}", f"({lat2})*{RAD}"
    df, dl = f"(({lat2})-({lat1}))*{RAD}/2e0", f"(({lon2})-({lon1}))*{RAD}/2e0"
    h = f"sin({df})*sin({df}) + cos({f1})*cos({f2})*sin({dl})*sin({dl})"
    return f"(2e0*{RADIUS}*asin(sqrt(case when {h} > 1e0 then 1e0 else {h} end)))"  # least() would pass over a null


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> Column:
    return F.expr(haversine_sql(lon1, lat1, lon2, lat2))


def mercator_sql(lon: str, lat: str) -> tuple[str, str]:
    """EPSG:3857 metres."""
    return f"{AXIS}*({lon})*{RAD}", f"{AXIS}*ln(tan(pi()/4e0 + ({lat})*{RAD}/2e0))"


def mercator(lon: str, lat: str) -> tuple[Column, Column]:
    x, y = mercator_sql(lon, lat)
    return F.expr(x), F.expr(y)


def utm_zone(lon: str, lat: str) -> Column:
    """EPSG code of the UTM zone: 326zz north, 327zz south."""
    return F.expr(f"cast(floor((({lon})+180e0)/6e0) as int) + 1 + case when ({lat}) >= 0 then 32600 else 32700 end")


def utm(lon: str, lat: str, zone: str) -> tuple[Column, Column]:
    """Easting and northing in metres by the third-order Krueger series of the WGS-84 ellipsoid."""
    east, north = utm_sql(lon, lat, zone)
    return F.expr(east), F.expr(north)


def utm_sql(lon: str, lat: str, zone: str) -> tuple[str, str]:
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    al = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * float(np.sqrt(n)) / (1 + n)
    lam = f"((({lon}) - ((({zone}) % 100)*6e0 - 183e0))*{RAD})"
    s = f"sin(({lat})*{RAD})"
    t = f"sinh(atanh({s}) - {e!r}D*atanh({e!r}D*{s}))"
    xi, eta = f"atan2({t}, cos{lam})", f"atanh(sin{lam}/sqrt(1e0+({t})*({t})))"
    east = f"500000e0 + {a!r}D*({eta} + " + " + ".join(f"{c!r}D*cos({2 * j}*{xi})*sinh({2 * j}*{eta})" for j, c in enumerate(al, 1)) + ")"
    north = f"case when ({lat}) < 0 then 1e7 else 0e0 end + {a!r}D*({xi} + " + " + ".join(f"{c!r}D*sin({2 * j}*{xi})*cosh({2 * j}*{eta})" for j, c in enumerate(al, 1)) + ")"
    return east, north


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment; to its point if it is degenerate."""
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    u = F.when(long2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / long2))).otherwise(0.0)
    return F.sqrt((px - ax - u * dx) ** 2 + (py - ay - u * dy) ** 2)


def vincenty(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Metres on the WGS-84 ellipsoid (Vincenty's inverse); NaN for latitudes out of range or no convergence."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    lon1, lat1, lon2, lat2 = (np.asarray(x, float) for x in (lon1, lat1, lon2, lat2))
    bad = (np.abs(lat1) > 90) | (np.abs(lat2) > 90)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    d = np.radians(lon2 - lon1)
    lam, done = d.copy(), np.zeros(d.shape, bool)
    with np.errstate(all="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(np.cos(u2) * sl, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * cl)
            cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * cl
            sg = np.arctan2(ss, cs)
            sa = np.where(ss > 0, np.cos(u1) * np.cos(u2) * sl / ss, 0.0)
            c2 = 1 - sa**2
            cm = np.where(c2 > 0, cs - 2 * np.sin(u1) * np.sin(u2) / c2, 0.0)
            c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
            new = d + (1 - c) * f * sa * (sg + c * ss * (cm + c * cs * (2 * cm**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if done.all():
                break
        k = c2 * (a * a - b * b) / (b * b)
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        ds = small * ss * (cm + small / 4 * (cs * (2 * cm**2 - 1) - small / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
        out = b * big * (sg - ds)
    return np.where(bad | ~done, np.nan, np.where(ss == 0, 0.0, out))


def geodesic(lon1: str, lat1: str, lon2: str, lat2: str) -> Column:
    """Vincenty's metres as a vectorised function; null where not defined."""

    def metres(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = vincenty(a, b, c, d)
        return pd.Series(out).where(~np.isnan(out))

    return F.pandas_udf(metres, "double", F.PandasUDFType.SCALAR)(lon1, lat1, lon2, lat2)
