"""Points in multipolygons with holes, by a quadtree cover.

Each region is covered by cells of a quadtree: a cell that an edge touches is split until LEVELS, one that no edge touches
is inside as a whole or outside as a whole. Points meet the cells of the levels that occur, in one equi-join on (level, row,
column). A point in an inside cell is in the region without looking at its shape; only points in cells with an edge are held
against the rings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.buffers import inside

ROOT, LEVELS = 16.0, 7  # degrees of a cell of level 0; the finest cells are ROOT / 2**LEVELS degrees
GEOMETRY = "array<array<array<struct<lat:double,lon:double>>>>"  # polygons of rings, the first the outer one


def cover_cells(polygons: list[list[np.ndarray]], levels: int = LEVELS) -> list[tuple[int, int, int, bool]]:
    """level, row, column and whether the whole cell is inside."""
    edges = np.concatenate([np.hstack([r, np.roll(r, -1, axis=0)]) for p in polygons for r in p])
    low, high = edges.reshape(-1, 2).min(axis=0), edges.reshape(-1, 2).max(axis=0)
    first, last = np.floor(low / ROOT).astype(int), np.floor(high / ROOT).astype(int)
    todo = [(0, a, b, np.arange(len(edges))) for a in range(first[0], last[0] + 1) for b in range(first[1], last[1] + 1)]
    out = []
    while todo:
        level, a, b, held = todo.pop()
        size = ROOT / 2**level
        at = touching(edges[held], a * size, b * size, size)
        if not at.any():
            centre = np.array([[(a + 0.5) * size, (b + 0.5) * size]])
            if any(inside(p[0], centre)[0] and not any(inside(h, centre)[0] for h in p[1:]) for p in polygons):
                out.append((level, a, b, True))
        elif level == levels:
            out.append((level, a, b, False))
        else:
            todo += [(level + 1, 2 * a + i, 2 * b + j, held[at]) for i in (0, 1) for j in (0, 1)]
    return out


def touching(edges: np.ndarray, lat: float, lon: float, size: float) -> np.ndarray:
    """Which edges touch a closed square: their boxes overlap, and its corners aren't all on one side."""
    y1, x1, y2, x2 = edges.T
    over = (np.minimum(y1, y2) <= lat + size) & (np.maximum(y1, y2) >= lat) & (np.minimum(x1, x2) <= lon + size) & (np.maximum(x1, x2) >= lon)
    sides = [(x2 - x1) * (lat + i * size - y1) - (y2 - y1) * (lon + j * size - x1) for i in (0, 1) for j in (0, 1)]
    return over & (np.minimum.reduce(sides) <= 0) & (np.maximum.reduce(sides) >= 0)


def cover(regions: DataFrame, id_: str, geom: str, levels: int = LEVELS) -> DataFrame:
    """id, level, a, b, whole of each region's cells; regions without a geometry have none."""
    kind = regions.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, polygons in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                cells = cover_cells([[np.array([(p["lat"], p["lon"]) for p in ring]) for ring in polygon] for polygon in polygons], levels)
                if cells:
                    level, a, b, whole = zip(*cells)
                    names = pa.array([name.as_py()] * len(cells), name.type)
                    yield pa.RecordBatch.from_arrays([names, *(pa.array(x, pa.int32()) for x in (level, a, b)), pa.array(whole)], names=[id_, "level", "a", "b", "whole"])

    rows = regions.where(F.col(geom).isNotNull() & (F.size(geom) > 0)).select(id_, geom)
    return rows.mapInArrow(run, f"{id_} {kind}, level int, a int, b int, whole boolean")


def within(polygons: Column, lat: Column, lon: Column) -> Column:
    """Ray casting in any polygon's outer ring and none of its holes."""
    rest = lambda p: F.slice(p, 2, F.size(p))
    return F.exists(polygons, lambda p: geo.contains(p[0], lat, lon) & ~F.exists(rest(p), lambda h: geo.contains(h, lat, lon)))


def containing(points: DataFrame, regions: DataFrame, id_: str, geom: str, levels: int = LEVELS) -> DataFrame:
    """Points (lat, lon, ...) with the id of each region that holds them. regions are few: their cells and shapes go to the
    points, never the points to them, however small the points' file looks. Points in cells with an edge are dealt out evenly
    before they are held against the shapes, not by region."""
    at = points.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    row = lambda c: F.floor(F.col(c) * F.pow(F.lit(2.0), "level") / ROOT).cast("int")
    met = at.withColumn("a", row("lat")).withColumn("b", row("lon")).join(F.broadcast(cover(regions, id_, geom, levels)), ["level", "a", "b"]).drop("level", "a", "b")
    sure = met.where("whole").drop("whole")
    shapes = regions.select(F.col(id_).alias("_id"), F.col(geom).alias("_g"))
    wide = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = met.where("NOT whole").drop("whole").repartition(wide)
    edge = near.join(F.broadcast(shapes), F.col(id_) == F.col("_id")).where(within(F.col("_g"), F.col("lat"), F.col("lon"))).drop("_id", "_g")
    return sure.union(edge.select(*sure.columns))


def admissible(docs: DataFrame, points: DataFrame, regions: DataFrame, region: str, geom: str, doc_region: str, point_id: str) -> DataFrame:
    """The region gate for many points at once: point, and the region that admits documents there (null: those without one).

    Join it with documents by region, null-safe; documents of no region are admissible everywhere."""
    everywhere = points.select(point_id, F.lit(None).cast(regions.schema[region].dataType).alias(doc_region))
    return containing(points, regions, region, geom).select(point_id, F.col(region).alias(doc_region)).union(everywhere)


def parse_wkt(text: str) -> list[list[list[tuple[float, float]]]]:
    """POLYGON or MULTIPOLYGON text as polygons of rings of (lat, lon) without the closing point; anything else is an error."""
    body = re.sub(r"^\s*SRID=\d+;", "", text).strip()
    made = re.match(r"(?i)^(MULTI)?POLYGON\s*(\(.*\))$", body, re.S)
    if not made:
        raise ValueError("not a polygon")
    rings = re.compile(r"\(([^()]+)\)")
    inner = made[2] if made[1] else f"({made[2]})"
    polygons = []
    for part in re.findall(r"\(\s*(?:\([^()]+\)\s*,?\s*)+\)", inner):
        polygon = []
        for ring in rings.findall(part):
            points = [tuple(float(x) for x in reversed(p.split())) for p in ring.split(",")]
            if len(points) < 4 or points[0] != points[-1]:
                raise ValueError("a ring closes and has four points at least")
            if any(not (-90 <= y <= 90 and -180 <= x <= 180) for y, x in points):
                raise ValueError("a point is off the globe")
            polygon.append(points[:-1])
        polygons.append(polygon)
    if not polygons:
        raise ValueError("no ring")
    return polygons
