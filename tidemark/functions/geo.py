"""Geometry as column expressions, and geodesics as vectorised UDFs."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

AMBER_METRES, RED_METRES = 5000.0, 2000.0
KNOT = 0.514444
_A, _F = 6378137.0, 1 / 298.257223563  # fixed values of the ellipsoid


def contains(ring: Column, lat: Column, lon: Column) -> Column:
    """Ray casting, half-open in latitude: bottom edges are inside, top edges outside, a point on a crossing is inside."""
    n = F.size(ring)

    def step(acc: Column, i: Column) -> Column:
        a, b = ring[i], ring[(i + 1) % n]
        crosses = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return F.struct((acc["inside"] != (crosses & (lon < at))).alias("inside"), (acc["hit"] | (crosses & (lon == at))).alias("hit"))

    zero = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("hit"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), zero, lambda acc, i: F.coalesce(step(acc, i), acc), lambda acc: acc["inside"] | acc["hit"])


def nearest_segment(line: list[tuple[float, float]], lat: Column, lon: Column) -> Column:
    """struct(d2, i, lat, lon, cross): the first nearest segment of a polyline in degree space."""
    parts = []
    for i, ((y1, x1), (y2, x2)) in enumerate(zip(line, line[1:])):
        dx, dy = x2 - x1, y2 - y1
        t = ((lon - F.lit(x1)) * F.lit(dx) + (lat - F.lit(y1)) * F.lit(dy)) / F.lit(dx * dx + dy * dy)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        py, px = F.lit(y1) + t * F.lit(dy), F.lit(x1) + t * F.lit(dx)
        cross = F.lit(dx) * (lat - F.lit(y1)) - F.lit(dy) * (lon - F.lit(x1))
        parts.append(F.struct(((lat - py) * (lat - py) + (lon - px) * (lon - px)).alias("d2"), F.lit(i).alias("i"), py.alias("lat"), px.alias("lon"), cross.alias("cross")))
    return F.array_min(F.array(*parts))


def side(nearest: Column) -> Column:
    return F.when(nearest["cross"] > 0, "sri_lanka").otherwise("india")


def band(metres: Column, crossed: Column | None = None) -> Column:
    found = F.when(metres <= RED_METRES, "red").when(metres <= AMBER_METRES, "amber").otherwise("clear")
    return found if crossed is None else F.when(crossed, "crossed").otherwise(found)


def flat_km2(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos_lat: Column | float) -> Column:
    """Squared equirectangular distance in km: enough to rank neighbours."""
    north, east = (lat2 - lat1) * 110.57, (lon2 - lon1) * 111.32 * cos_lat
    return north * north + east * east


def vincenty_inverse(lat1, lon1, lat2, lon2):
    """Metres and initial bearing on the WGS84 ellipsoid (Vincenty's published iteration), NaN where it doesn't converge."""
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(x, dtype=float)) for x in (lat1, lon1, lat2, lon2))
    b = _A * (1 - _F)
    u1, u2, length = np.arctan((1 - _F) * np.tan(lat1)), np.arctan((1 - _F) * np.tan(lat2)), lon2 - lon1
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, change = length.copy(), np.full_like(length, np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(100):
            sin_l, cos_l = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sin_l, c1 * s2 - s1 * c2 * cos_l)
            cs = s1 * s2 + c1 * c2 * cos_l
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, c1 * c2 * sin_l / np.where(ss == 0, 1, ss))
            ca2 = 1 - sa * sa
            cm = np.where(ca2 == 0, 0.0, cs - 2 * s1 * s2 / np.where(ca2 == 0, 1, ca2))
            c = _F / 16 * ca2 * (4 + _F * (4 - 3 * ca2))
            new = length + (1 - c) * _F * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
            change, lam = np.abs(new - lam), new
            if not len(change) or np.nanmax(change) < 1e-12:
                break
        k2 = ca2 * (_A * _A - b * b) / (b * b)
        big = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
        small = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
        delta = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        metres = np.where(change < 1e-9, b * big * (sigma - delta), np.nan)
        bearing = np.degrees(np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))) % 360
    return metres, bearing


def vincenty_direct(lat, lon, course, metres):
    """Where a course of so many metres ends."""
    lat, lon, course, metres = (np.asarray(x, dtype=float) for x in (lat, lon, course, metres))
    b, a1 = _A * (1 - _F), np.radians(course)
    u1 = np.arctan((1 - _F) * np.tan(np.radians(lat)))
    s1, c1 = np.sin(u1), np.cos(u1)
    sigma1, sa = np.arctan2(np.tan(u1), np.cos(a1)), c1 * np.sin(a1)
    ca2 = 1 - sa * sa
    k2 = ca2 * (_A * _A - b * b) / (b * b)
    big = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
    small = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
    first = sigma = metres / (b * big)
    for _ in range(20):
        cm, ss, cs = np.cos(2 * sigma1 + sigma), np.sin(sigma), np.cos(sigma)
        before, sigma = sigma, first + small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        if np.array_equal(before, sigma, equal_nan=True):  # later rounds would change nothing
            break
    cm, ss, cs = np.cos(2 * sigma1 + sigma), np.sin(sigma), np.cos(sigma)
    lat2 = np.arctan2(s1 * cs + c1 * ss * np.cos(a1), (1 - _F) * np.hypot(sa, s1 * ss - c1 * cs * np.cos(a1)))
    lam = np.arctan2(ss * np.sin(a1), c1 * cs - s1 * ss * np.cos(a1))
    c = _F / 16 * ca2 * (4 + _F * (4 - 3 * ca2))
    length = lam - (1 - c) * _F * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
    return np.degrees(lat2), lon + np.degrees(length)


def ecef(lat, lon):
    """x, y, z in metres on the ellipsoid."""
    lat, lon = np.radians(lat), np.radians(lon)
    e2 = _F * (2 - _F)
    n = _A / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    return n * np.cos(lat) * np.cos(lon), n * np.cos(lat) * np.sin(lon), n * (1 - e2) * np.sin(lat)


def longest_arc(chord):
    """No shortest line over the ellipsoid between points so many metres apart in space is longer (Schur: it bends no more than
    a circle of the smallest radius of curvature)."""
    least = _A * (1 - _F) ** 2
    return 2 * least * np.arcsin(np.minimum(1.0, chord / (2 * least)))


def nearest_on(line: list[tuple[float, float]], lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nearest_segment() for arrays: lat and lon of the nearest point, and cross of its segment."""
    least = at_lat = at_lon = side_of = None
    for (y1, x1), (y2, x2) in zip(line, line[1:]):
        dx, dy = x2 - x1, y2 - y1
        t = np.clip(((lon - x1) * dx + (lat - y1) * dy) / (dx * dx + dy * dy), 0.0, 1.0)
        py, px = y1 + t * dy, x1 + t * dx
        d2 = (lat - py) * (lat - py) + (lon - px) * (lon - px)
        cross = dx * (lat - y1) - dy * (lon - x1)
        if least is None:
            least, at_lat, at_lon, side_of = d2, py, px, cross
        else:
            nearer = d2 < least
            for old, new in ((least, d2), (at_lat, py), (at_lon, px), (side_of, cross)):
                np.copyto(old, new, where=nearer)
    return at_lat, at_lon, side_of


def pair(a: str, b: str) -> StructType:
    return StructType([StructField(a, DoubleType()), StructField(b, DoubleType())])


@F.pandas_udf(pair("metres", "bearing"))
def geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
    metres, bearing = vincenty_inverse(lat1, lon1, lat2, lon2)
    return pd.DataFrame({"metres": metres, "bearing": bearing})


@F.pandas_udf(pair("lat", "lon"))
def advance(lat: pd.Series, lon: pd.Series, course: pd.Series, metres: pd.Series) -> pd.DataFrame:
    a, b = vincenty_direct(lat, lon, course, metres)
    return pd.DataFrame({"lat": a, "lon": b})


def ground_velocity(heading: Column, speed: Column, east: Column, north: Column) -> Column:
    """struct(course, speed): heading and speed through water plus a current."""
    e, n = speed * F.sin(F.radians(heading)) + east, speed * F.cos(F.radians(heading)) + north
    return F.struct(F.pmod(F.degrees(F.atan2(e, n)), F.lit(360.0)).alias("course"), F.hypot(e, n).alias("speed"))


def degrees_minutes(degrees: int, minutes: float) -> float:
    if not 0 <= minutes < 60:
        raise ValueError("minutes are out of range")
    return degrees + minutes / 60.0


def wkt_point(lat: Column, lon: Column) -> Column:
    return F.format_string("POINT(%.6f %.6f)", lon, lat)


def wkt_line(line: list[tuple[float, float]]) -> str:
    return "LINESTRING(" + ", ".join(f"{x:.6f} {y:.6f}" for y, x in line) + ")"


def ring_from_geojson(ring: Column) -> Column:
    """[[lon, lat], ...] to structs without the closing vertex."""
    points = F.transform(ring, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    closed = (F.size(points) > 1) & (points[0] == F.element_at(points, -1))
    return F.when(closed, F.slice(points, 1, F.size(points) - 1)).otherwise(points)


def cap_polygon(ring: Column) -> Column:
    """lat,lon pairs to four places, the first repeated."""
    return F.array_join(F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.format_string("%.4f,%.4f", p["lat"], p["lon"])), " ")


