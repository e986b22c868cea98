from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import buffers, geo
from tidemark.operators import regions
from tidemark.sources import dimensions as dim

LINE = [(lat, lon) for _, lat, lon in dim.BOUNDARY]


def distance_to(line, lat, lon):
    """Metres to the nearest point of a line that is straight in degrees, by fine samples."""
    best = np.full(len(lat), np.inf)
    for (y1, x1), (y2, x2) in zip(line, line[1:]):
        k = np.cos(np.radians(lat))
        dx, dy, px, py = (x2 - x1) * k, y2 - y1, (lon - x1) * k, lat - y1
        t = np.clip((px * dx + py * dy) / (dx * dx + dy * dy), 0, 1)
        best = np.minimum(best, geo.vincenty_inverse(lat, lon, y1 + t * (y2 - y1), x1 + t * (x2 - x1))[0])
    return best


def holds(polygons, points):
    out = np.zeros(len(points), dtype=bool)
    for p in polygons:
        here = buffers.inside(np.array(p[0]), points)
        for h in p[1:]:
            here &= ~buffers.inside(np.array(h), points)
        out |= here
    return out


@pytest.mark.parametrize("metres", [2000.0, 5000.0, 60_000.0])
@pytest.mark.parametrize("line", [LINE, [(8.0, 79.0), (8.0, 79.5)], [(8.0, 79.0), (8.5, 79.0), (8.05, 79.05)], [(5.0, 77.0), (5.0, 77.1), (5.1, 77.1), (5.1, 77.0), (5.001, 77.0)]])
def test_a_point_is_in_the_band_if_it_is_within_the_distance(line, metres):
    polygons = buffers.buffer(line, metres)
    rng = np.random.default_rng(int(metres))
    spine = np.array(line)[rng.integers(0, len(line) - 1, 4000)]
    reach = metres / 110_000
    points = spine + rng.uniform(-2.2, 2.2, (4000, 2)) * reach
    far = distance_to(line, points[:, 0], points[:, 1])
    clear = np.abs(far - metres) > 0.005 * metres + 3  # the tolerance: half a percent and three metres
    assert (holds(polygons, points)[clear] == (far < metres)[clear]).all()
    assert 0.05 < (far < metres).mean() < 0.95


def test_a_loop_has_a_hole_and_text_reads_back():
    line = [(5.0, 77.0), (5.0, 77.2), (5.2, 77.2), (5.2, 77.0), (5.001, 77.0)]
    polygons = buffers.buffer(line, 2000.0)
    assert len(polygons) == 1 and len(polygons[0]) == 2 and buffers.area(polygons[0][0]) > 0 > buffers.area(polygons[0][1])
    back = regions.parse_wkt(buffers.wkt(polygons))
    assert [len(r) for r in back[0]] == [len(r) for r in polygons[0]] and np.allclose(back[0][0], polygons[0][0], atol=1e-6)
    two = regions.parse_wkt("SRID=4326;MULTIPOLYGON(((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1)), ((9 9, 10 9, 10 10, 9 9)))")
    assert [[len(r) for r in p] for p in two] == [[4, 3], [3]] and two[1][0][1] == (9.0, 10.0)
    for bad in ("POINT(1 2)", "POLYGON((0 0, 1 1, 2 2))", "POLYGON((0 0, 1 0, 1 200, 0 0))", "POLYGON EMPTY"):
        with pytest.raises(ValueError):
            regions.parse_wkt(bad)


def shapes():
    square = lambda y, x, h: [(y - h, x - h), (y - h, x + h), (y + h, x + h), (y + h, x - h)]
    return {
        "ring": [[square(8.0, 79.0, 1.5), square(8.0, 79.0, 0.7)], [square(8.0, 79.0, 0.21)]],  # an island in the hole
        "star": [[[(7.0, 77.0), (8.0, 78.9), (9.0, 77.0), (8.2, 79.7), (9.7, 80.9), (8.0, 80.1), (6.1, 81.3), (7.3, 79.2)]]],
        "far": [[square(-40.0, -120.0, 3.0)]],
        "small": [[square(8.001, 79.002, 0.0007)]],
    }


def test_the_cover_gives_what_ray_casting_gives(spark):
    made = [(k, [[[{"lat": y, "lon": x} for y, x in r] for r in p] for p in v]) for k, v in shapes().items()] + [("none", None), ("empty", [])]
    areas = spark.createDataFrame(made, f"region string, geom {regions.GEOMETRY}")
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.uniform((6, 76.5), (10, 81.5), (3000, 2)), rng.normal((8.001, 79.002), 0.0006, (60, 2)), rng.uniform((-44, -124), (-36, -116), (100, 2)), [(8.0, 79.0), (-6.5, 77.5)]])
    rows = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(points)] + [(-1, None, 1.0)], "id int, lat double, lon double")
    got = {(r.id, r.region) for r in regions.containing(rows, areas, "region", "geom").collect()}
    want = {(i, k) for k, v in shapes().items() for i in np.flatnonzero(holds(v, points)).tolist()}
    assert got == want and len(want) > 500
    cells = regions.cover(areas, "region", "geom")
    shares = {r.region: r.s for r in cells.groupBy("region").agg(F.sum(F.when(F.col("whole"), F.pow(F.lit(0.25), "level")).otherwise(0.0)).alias("s")).collect()}
    assert shares["ring"] * regions.ROOT**2 > 0.7 * (9 - 1.96 + 0.1764) and set(shares) == set(shapes())
    assert regions.containing(rows, areas.limit(0), "region", "geom").count() == 0


def test_the_gate_admits_documents_of_no_region_everywhere(spark):
    areas = spark.createDataFrame([("r", [[[{"lat": 0.0, "lon": 0.0}, {"lat": 0.0, "lon": 2.0}, {"lat": 2.0, "lon": 2.0}, {"lat": 2.0, "lon": 0.0}]]])], f"region string, geom {regions.GEOMETRY}")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, None, None)], "point int, lat double, lon double")
    docs = spark.createDataFrame([(10, "r"), (11, None)], "doc int, place string")
    gate = regions.admissible(docs, points, areas, "region", "geom", "place", "point")
    got = {(r.point, r.doc) for r in gate.withColumnRenamed("place", "_p").join(docs, F.col("place").eqNullSafe(F.col("_p"))).collect()}
    assert got == {(1, 10), (1, 11), (2, 11), (3, 11)}


def test_points_are_never_sent_to_the_regions(spark):
    """The points' file may look small: still the regions go to them, and no join deals points by region."""
    from tidemark.plans import places

    plan = places.vessels_in_bands(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
