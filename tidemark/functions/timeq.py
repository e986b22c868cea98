"""Predicates on time, boxes and seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float, tolerance: float = 0.0) -> Column:
    """Inclusive on all four edges."""
    return lat.between(south - tolerance, north + tolerance) & lon.between(west - tolerance, east + tolerance)


def boxes_touch(south: Column, north: Column, west: Column, east: Column, box: tuple[float, float, float, float]) -> Column:
    """Boxes overlap; touching edges count; no antimeridian."""
    s, n, w, e = box
    return (south <= n) & (north >= s) & (west <= e) & (east >= w)


def in_window(moment: Column, start: Column, end: Column) -> Column:
    """Half-open."""
    return (moment >= start) & (moment < end)


def age_seconds(moment: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(moment.cast("timestamp"))) / 1e6


def is_stale(issued: Column, now: Column, limit_seconds: Column) -> Column:
    """Strictly older than period plus grace."""
    return age_seconds(issued, now) > limit_seconds


def covers_time(starts: Column, ends: Column, at: Column) -> Column:
    """Inclusive; a null end is live, a null start open."""
    return (starts.isNull() | (starts <= at)) & (ends.isNull() | (at <= ends))


def in_season(day: Column, m1: Column, d1: Column, m2: Column, d2: Column) -> Column:
    """Inclusive month-day range that may wrap the year's end."""
    at, a, b = F.month(day) * 100 + F.dayofmonth(day), m1 * 100 + d1, m2 * 100 + d2
    return F.when(a <= b, at.between(a, b)).otherwise((at >= a) | (at <= b))
