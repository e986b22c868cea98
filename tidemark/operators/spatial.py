"""Joins of positions with areas, shelters and the boundary."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tidemark.functions import geo
from tidemark.sources.store import stored

CELL = 1.0  # degrees of the coarse grid that equi-joins points with ring boxes
TRACKS = 256  # vessels whose steps are held at once
SLACK_M = 0.001  # for rounding of chords


def cells_of_rings(areas: DataFrame, cell: float = CELL) -> DataFrame:
    """One row for each grid cell that an area's bounding box touches."""
    lat, lon = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    span = lambda x: F.sequence(F.floor(F.array_min(x) / cell).cast("int"), F.floor(F.array_max(x) / cell).cast("int"))
    return areas.withColumn("cell_lat", F.explode(span(lat))).withColumn("cell_lon", F.explode(span(lon)))


def containing(points: DataFrame, areas: DataFrame, cell: float = CELL, few: bool = False) -> DataFrame:
    """Pairs of points with the areas that hold them: an equi-join on grid cells, then ray casting. few: areas are so few
    that they go to the points; else Spark may send the points to the areas' tasks, which then hold all that is found."""
    at = points.withColumn("cell_lat", F.floor(F.col("lat") / cell).cast("int")).withColumn("cell_lon", F.floor(F.col("lon") / cell).cast("int"))
    cells = cells_of_rings(areas, cell)
    joined = at.join(F.broadcast(cells) if few else cells, ["cell_lat", "cell_lon"])
    return joined.where(geo.contains(F.col("ring"), F.col("lat"), F.col("lon"))).drop("cell_lat", "cell_lon", "ring")


def strongest(points: DataFrame, rings: DataFrame, id_: str) -> DataFrame:
    """Largest knots over the rings that hold each point; null if none does."""
    found = containing(points, rings).groupBy(id_).agg(F.max("knots").alias("knots"))
    return points.select(id_).join(found, id_, "left")


def nearest(points: DataFrame, places: DataFrame, id_: str, place_id: str, cell: float | None = None, widen: int = 8) -> DataFrame:
    """The nearest place of each point by flat distance, east-west scaled at the mean latitude; ties go to the smaller id.

    Places stand in the nine grid cells around theirs, points in their own only, and they meet by cell. Cells are made so
    that about two places fall into one (`cell` sets their size else). Points whose find may be beaten from outside, or
    that find nothing, look again in cells `widen` times as large, until four cells cover the globe: then nothing is
    outside. Unsettled points are written once a round. Points and places without a position have no part.
    """
    q = places.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy(F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")).agg(F.min(place_id).alias("place"))
    box = q.agg(F.count("*").alias("n"), (F.max("q_lat") - F.min("q_lat")).alias("high"), (F.max("q_lon") - F.min("q_lon")).alias("wide")).first()
    rest = points.select(id_, "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL")
    size = cell or max(1e-3, (2 * max(box.high or 0, 1e-3) * max(box.wide or 0, 1e-3) / max(1, box.n)) ** 0.5)
    d2 = geo.flat_km2(F.col("lat"), F.col("lon"), F.col("q_lat"), F.col("q_lon"), F.cos(F.radians((F.col("lat") + F.col("q_lat")) / 2)))
    number = lambda c, x: F.floor(F.col(c) / x).cast("int")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    found = []
    while True:
        at = q.select("*", around.alias("o")).select("q_lat", "q_lon", "place", (number("q_lat", size) + F.col("o.i")).alias("a"), (number("q_lon", size) + F.col("o.j")).alias("b"))
        met = rest.withColumn("a", number("lat", size)).withColumn("b", number("lon", size)).join(at, ["a", "b"], "left")
        best = met.groupBy(id_, "lat", "lon").agg(F.min(F.when(F.col("place").isNotNull(), F.struct(d2.alias("d2"), "place"))).alias("m"))
        if size >= 360:  # every place was looked at
            found.append(best.where("m IS NOT NULL"))
            break
        best = stored(best, "nearest")
        # a place outside is at least one cell away, north-south or east-west at no more than this latitude
        steep = F.cos(F.radians(F.least(F.lit(90.0), F.abs("lat") + size / 2)))
        sure = F.least(F.lit(size * 110.57), steep * (size * 111.32))
        settled = F.coalesce(F.col("m.d2") < sure * sure, F.lit(False))
        found.append(best.where(settled))
        rest = best.where(~settled).select(id_, "lat", "lon")
        if not box.n or rest.isEmpty():
            break
        size *= widen
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.select(id_, F.col("m.place").alias(place_id), F.col("m.d2").alias("d2"))


def boundary(points: DataFrame, line: list[tuple[float, float]], home_side: str | None = None) -> DataFrame:
    """Nearest boundary point in degree space, its geodesic distance and bearing, the side and the warning band."""
    near = points.withColumn("_n", geo.nearest_segment(line, F.col("lat"), F.col("lon")))
    g = near.withColumn("_g", geo.geodesic("lat", "lon", "_n.lat", "_n.lon"))
    side = geo.side(F.col("_n"))
    crossed = None if home_side is None else side != home_side
    return g.select(*points.columns, F.col("_n.lat").alias("nearest_lat"), F.col("_n.lon").alias("nearest_lon"), F.col("_g.metres").alias("metres"), F.col("_g.bearing").alias("bearing"), side.alias("side"), geo.band(F.col("_g.metres"), crossed).alias("band"))


def drift(points: DataFrame, line: list[tuple[float, float]], horizon_s: int = 3600, step_s: int = 60, tolerance_s: int = 5) -> DataFrame:
    """When each vessel first stands on the other side of the boundary within the horizon, and its closest approach.

    points: id, lat, lon, heading_deg, speed_ms, current_east_ms, current_north_ms. A grid of steps finds the interval;
    a grid of tolerance_s within it refines the crossing. A vessel's whole track is looked at where its row is, TRACKS
    vessels at a time: no row is made for a step, and nothing is shuffled. Without a position nothing is known.
    """
    v = geo.ground_velocity(F.col("heading_deg"), F.col("speed_ms"), F.col("current_east_ms"), F.col("current_north_ms"))
    kind = StructType([StructField("home", StringType()), StructField("crossing_s", IntegerType()), StructField("closest_m", DoubleType()), StructField("closest_s", IntegerType())])

    @F.pandas_udf(kind)
    def along(lat: pd.Series, lon: pd.Series, course: pd.Series, speed: pd.Series) -> pd.DataFrame:
        columns = [x.to_numpy(dtype=float) for x in (lat, lon, course, speed)]
        parts = [tracks(*(x[i : i + TRACKS] for x in columns), line, horizon_s, step_s, tolerance_s) for i in range(0, max(1, len(lat)), TRACKS)]
        return pd.concat(parts, ignore_index=True)

    wide = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small file is one task's rows, and many seconds of them
    rows = points.select("id", "lat", "lon", v.alias("v")).repartition(wide, "id")
    return rows.withColumn("r", along("lat", "lon", "v.course", "v.speed")).select("id", "r.*")


def tracks(lat: np.ndarray, lon: np.ndarray, course: np.ndarray, speed: np.ndarray, line: list[tuple[float, float]], horizon_s: int, step_s: int, tolerance_s: int) -> pd.DataFrame:
    """drift() of some vessels: home, crossing_s, closest_m, closest_s.

    The closest step is the one of the least geodesic. A geodesic is no shorter than its chord and no longer than longest_arc(),
    so only steps whose chord is within the arc of the least chord are measured, which is one or two of them.
    """

    def step(some: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = lambda x: x[some][:, None]
        return geo.vincenty_direct(one(lat), one(lon), one(course), one(speed) * t)

    times = np.arange(0, horizon_s + 1, step_s)
    every = np.arange(len(lat))
    home = geo.nearest_on(line, lat, lon)[2] > 0
    y, x = step(every, times[None, :])
    n_lat, n_lon, cross = geo.nearest_on(line, y, x)
    other = ((cross > 0) != home[:, None]) & np.isfinite(cross)
    first = np.where(other.any(axis=1), times[other.argmax(axis=1)], -1)

    chord = np.sqrt(sum((p - q) ** 2 for p, q in zip(geo.ecef(y, x), geo.ecef(n_lat, n_lon))))
    measurable = np.isfinite(chord)
    bound = geo.longest_arc(np.where(measurable, chord, np.inf).min(axis=1, initial=np.inf))
    who, when = np.nonzero(measurable & (chord <= bound[:, None] + SLACK_M))
    metres = geo.vincenty_inverse(y[who, when], x[who, when], n_lat[who, when], n_lon[who, when])[0]
    order = np.lexsort((when, metres, who))
    found, at = np.unique(who[order], return_index=True)
    closest, closest_t = np.full(len(lat), np.nan), np.zeros(len(lat), dtype=np.int64)
    closest[found], closest_t[found] = metres[order][at], times[when[order][at]]

    crossing = first.copy()
    late = np.flatnonzero(first > 0)
    if len(late):
        back = np.arange(-step_s, 1, tolerance_s)
        t = first[late][:, None] + back[None, :]
        over = (geo.nearest_on(line, *step(late, t))[2] > 0) != home[late][:, None]
        crossing[late] = np.where(over.any(axis=1), t[np.arange(len(late)), over.argmax(axis=1)], first[late])
    side = np.where(home, "sri_lanka", "india").astype(object)
    return pd.DataFrame({"home": side, "crossing_s": pd.Series(crossing, dtype="Int32").where(crossing >= 0), "closest_m": closest, "closest_s": closest_t.astype("int32")})


def first_in_group(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
