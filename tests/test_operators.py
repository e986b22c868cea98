from __future__ import annotations

import random
import re

import datetime as dt
import heapq
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import alerts, geo, kernels, speech, text, timeq
from tidemark.operators import asof, catalog, retrieve, route, sessions, spatial, trust, watch, zones
from tidemark.plans import catalogue
from tidemark.sources import dimensions, readers
from tidemark.streaming import alerts as machine
from tidemark.streaming import windows

T0 = dt.datetime(2024, 5, 1)


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


OBS = "event_id long, variable string, value double, lat double, lon double, depth_m double, valid_time timestamp_ntz, issued_time timestamp_ntz, source string, quality string"


def observation(i, value, issued_h, source="a", lat=9.6, variable="v", depth=None):
    return (i, variable, value, lat, 79.4, depth, T0, T0 + dt.timedelta(hours=issued_h), source, "observed")


def test_as_of_before_after_and_between_revisions(spark):
    rows = spark.createDataFrame([observation(1, 1.2, 0), observation(2, 3.4, 12), observation(3, 9.0, 12, depth=5.0)], OBS)
    at = lambda h: F.lit(str(T0 + dt.timedelta(hours=h))).cast("timestamp_ntz")
    assert values(asof.as_of(rows, at(-1)), "value") == []
    assert values(asof.as_of(rows, at(6)), "value") == [(1.2,)]
    assert sorted(values(asof.as_of(rows, at(12)), "value")) == [(3.4,), (9.0,)]


def test_as_of_join_takes_the_last_row_before(spark):
    left = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 9, "z")], "k int, t int, name string")
    right = spark.createDataFrame([(1, 2, 20), (1, 5, 50), (1, 6, 60)], "k int, at int, v int")
    got = asof.as_of_join(left, right, ["k"], "t", "at", ["v"])
    assert sorted(values(got, "name", "_r_v")) == [("x", 50), ("y", None), ("z", None)]


def test_fallback_and_attempts(spark):
    rows = spark.createDataFrame([observation(1, None, 0, "a"), observation(2, 2.0, 47, "b"), observation(3, 3.0, 47, "c")], OBS)
    now = F.lit(str(T0 + dt.timedelta(hours=48))).cast("timestamp_ntz")
    cadence = {"a": 72, "b": 24, "c": 24}
    assert values(asof.fallback(rows, {"a": 1, "b": 2, "c": 3}, cadence, now), "source", "value") == [("a", None)]  # a null satisfies
    assert values(asof.fallback(rows, {"a": 1, "b": 2, "c": 3}, {"a": 1, "b": 24, "c": 24}, now), "source") == [("b",)]
    assert sorted(values(asof.attempts(rows, {"a": 1, "b": 24, "c": 24}, now), "source", "outcome")) == [("a", "stale"), ("b", "success"), ("c", "success")]


def test_upsert_keeps_first_dataset(spark):
    old = spark.createDataFrame([(1, "k", "d0", 1.0)], "seq int, key string, dataset string, value double")
    new = spark.createDataFrame([(2, "k", "d1", 2.0), (3, "k", "d2", 3.0), (4, "n", "d3", 4.0)], old.schema)
    assert sorted(values(asof.upsert(old, new, ["key"], "seq", keep_first=("dataset",)), "key", "dataset", "value")) == [("k", "d0", 3.0), ("n", "d3", 4.0)]


def test_quarantine(spark):
    rows = spark.createDataFrame([("missing", None), ("missing", 1.0), ("observed", None), ("observed", math.nan), ("observed", math.inf), ("observed", 1.0)], "quality string, value double")
    good, bad = asof.split_expectation(rows, asof.quarantine_reason())
    assert good.count() == 2 and sorted(x[0] for x in values(bad, "reason")) == ["missing_with_value", "not_finite", "not_finite", "value_without_missing"]


def test_scan_spec_refuses_nothing_asked():
    with pytest.raises(ValueError):
        asof.ScanSpec((0, 1, 0, 1), "a", "b", frozenset())


def test_registry_reasons(spark):
    rows = catalog.judged(dimensions.datasets(spark), "click", (5.0, 9.0, 77.0, 80.0), F.lit("2024-01-20").cast("date"), 5.0, credentials=frozenset({"src4"}))
    got = dict(values(rows, "dataset_id", "reason"))
    assert got == {"d_click": None, "d_view": "variable_not_served", "d_arch": "outside_temporal_coverage", "d_paid": "over_budget", "d_auth": None, "d_far": "outside_coverage", "d_alt": None}


@pytest.mark.parametrize("day, inside", [("2024-11-20", True), ("2024-12-31", True), ("2024-01-31", True), ("2024-02-01", False), ("2024-11-19", False)])
def test_season_wraps(spark, day, inside):
    row = spark.range(1).select(timeq.in_season(F.lit(day).cast("date"), F.lit(11), F.lit(20), F.lit(1), F.lit(31)).alias("x")).first()
    assert row.x is inside


@pytest.mark.parametrize("point, inside", [((0.5, 0.5), True), ((0.0, 0.5), True), ((1.0, 0.5), False), ((0.5, 0.0), True), ((0.5, 1.0), True), ((0.5, 1.5), False)])
def test_polygon_edges(spark, point, inside):
    ring = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)],)], "ring array<struct<lat:double,lon:double>>")
    assert ring.select(geo.contains(F.col("ring"), F.lit(point[0]), F.lit(point[1])).alias("x")).first().x is inside


def test_geodesics_round_trip():
    metres, bearing = geo.vincenty_inverse([13.1], [80.3], [13.1], [80.4])
    assert metres[0] == pytest.approx(10844, abs=1)
    lat, lon = geo.vincenty_direct([13.1], [80.3], bearing, metres)
    assert lat[0] == pytest.approx(13.1, abs=1e-9) and lon[0] == pytest.approx(80.4, abs=1e-9)
    assert geo.vincenty_inverse([1.0], [2.0], [1.0], [2.0])[0][0] == 0


@pytest.mark.parametrize("metres, band", [(500, "red"), (2000, "red"), (2000.1, "amber"), (5000, "amber"), (5000.1, "clear"), (50000, "clear")])
def test_bands(spark, metres, band):
    assert spark.range(1).select(geo.band(F.lit(float(metres))).alias("x")).first().x == band


def test_boundary_and_drift(spark):
    line = [(lat, lon) for _, lat, lon in dimensions.BOUNDARY]
    rows = spark.createDataFrame([(1, 9.30, 79.28), (2, 9.9, 80.1)], "id long, lat double, lon double")
    got = {r.id: r for r in spatial.boundary(rows, line, home_side="india").collect()}
    assert got[1].side == "india" and got[2].side == "sri_lanka" and got[2].band == "crossed"
    vessels = rows.where("id = 1").selectExpr("id", "9.5D lat", "79.40D lon", "90.0D heading_deg", "9.0D speed_ms", "0.0D current_east_ms", "0.0D current_north_ms")
    r = spatial.drift(vessels, line).first()
    east = geo.vincenty_direct([9.5], [79.40], [90.0], [9.0 * r.crossing_s])
    assert r.home == "india" and 0 < r.crossing_s <= 3600 and east[1][0] > 79.42


@pytest.mark.parametrize("low, high, far", [(0, 6, 0), (55, 80, 0), (0, 6, 120)])
def test_nearest_like_brute_force(spark, low, high, far):
    """Near, at high latitudes (narrow degrees), and far from every place; rows without a position have no part."""
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"id": range(60), "lat": rng.uniform(low, high, 60), "lon": rng.uniform(0, 6, 60)})
    q = pd.DataFrame({"place": range(15), "lat": rng.uniform(low, high, 15), "lon": rng.uniform(far, far + 40, 15)})
    points = spark.createDataFrame(p).union(spark.createDataFrame([(60, None, 1.0)], "id long, lat double, lon double"))
    places = spark.createDataFrame(q).union(spark.createDataFrame([(15, None, None)], "place long, lat double, lon double"))
    got = dict(values(spatial.nearest(points, places, "id", "place"), "id", "place"))
    want = {}
    for r in p.itertuples():
        d2 = ((q.lat - r.lat) * 110.57) ** 2 + ((q.lon - r.lon) * 111.32 * np.cos(np.radians((q.lat + r.lat) / 2))) ** 2
        want[r.id] = int(d2.idxmin())
    assert got == want


def test_frontier_and_spread(spark):
    rows = spark.createDataFrame([(1, 9.0, 1.0, 5.0), (2, 8.0, 1.0, 5.0), (3, 1.0, 9.0, 9.0), (4, 2.0, 2.0, 1.0), (5, 3.0, 3.0, 4.0), (1, 9.0, 0.5, 5.0)], "id int, catch double, safe double, cost double")
    front = zones.frontier(rows, "id", ["catch", "safe"], ["cost"])
    assert sorted(x[0] for x in values(front, "id")) == [1, 1, 3, 4, 5]  # rows of one id don't dominate each other
    assert [x[0] for x in values(zones.spread(front.where("safe <> 0.5"), "id", "catch", "safe", "cost"), "id")] == [1, 4, 3]


def test_runs(spark):
    flags = {"five": [1] * 5, "four": [1] * 4 + [0], "split": [1, 1, 1, 0, 1, 1], "ten": [0] + [1] * 10, "none": [0, 0]}
    rows = spark.createDataFrame([(k, i, float(x)) for k, xs in flags.items() for i, x in enumerate(xs)], "k string, i int, x double")
    got = {r.k: (r.longest, r.flag) for r in zones.longest_runs(rows, ["k"], "i", F.col("x") > 0).collect()}
    assert got == {"five": (5, "medium"), "four": (4, None), "split": (3, None), "ten": (10, "high"), "none": (0, None)}


def grid(spark, n=6, blocked=()):
    return spark.createDataFrame([(r, c, float((r * 3 + c) % 4), 5.0, (r, c) in blocked, None) for r in range(n) for c in range(n)], "row int, col int, wave_height_m double, wind_speed_ms double, blocked boolean, depth_m double")


def test_routes_agree_and_walls_hold(spark):
    wall = {(2, c) for c in range(5)}
    cells = route.navigable(grid(spark, 6, wall), 2.0)
    best = {(r.row, r.col): r.cost for r in route.relax(spark, cells, (0, 0)).collect()}
    one = cells.selectExpr("1 AS g", "*", "0 AS start_row", "0 AS start_col", "5 AS goal_row", "0 AS goal_col")
    assert route.routes(one, "g").first().cost == pytest.approx(best[5, 0])
    shut = route.navigable(grid(spark, 6, wall | {(2, 5)}), 2.0)
    reached = {(r.row, r.col) for r in route.relax(spark, shut, (0, 0)).collect()}
    assert (5, 0) not in reached and (1, 5) in reached


def heap_costs(cells, start):
    """Least costs of all cells by one heap search."""
    best, heap = {start: 0.0}, [(0.0, start)] if start in cells else []
    while heap:
        cost, (r, c) = heapq.heappop(heap)
        for a, b in route.STEPS:
            to = (r + a, c + b)
            if cost <= best[r, c] and to in cells:
                wave, wind = cells[to]
                new = cost + max(0.1, 1.0 + 2.0 * wave + 0.6 * (wind / 10.0)) * math.hypot(a, b)
                if new < best.get(to, math.inf):
                    best[to] = new
                    heapq.heappush(heap, (new, to))
    return best if start in cells else {}


def test_route_cost_of_all_events(spark, tmp_path):
    n, side, cells = 6000, 79, {}  # more than one tile
    spark.range(n).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    for i in range(n):
        if i % 13 and (i % 5 == 0 or i % 20 >= 2):
            cells[i % side, i // side] = (i * 5 % 32 * 0.125, float(i % 9))
    expected = {k: math.floor(x * 1000.0 + 0.5) for k, x in heap_costs(cells, (5, 0)).items()}
    got = {(r.row, r.col): r.cost_milli for r in catalogue.queries()["route_cost"](spark, str(tmp_path)).collect()}
    assert len(got) > 4000 and got.keys() == expected.keys() and all(abs(got[k] - expected[k]) <= 1 for k in got)


def test_long_walls_are_followed_to_the_end(spark):
    n = 70  # a corridor that turns at each second row: over 2,000 steps, crossing the tiles' border again and again
    wall = {(r, c) for r in range(1, n, 2) for c in range(n) if c != (n - 1 if r % 4 == 1 else 0)}
    cells = route.navigable(grid(spark, n, wall), 2.0)
    expected = heap_costs({(r, c): (float((r * 3 + c) % 4), 5.0) for r in range(n) for c in range(n) if (r, c) not in wall}, (0, 0))
    got = {(r.row, r.col): r.cost for r in route.relax(spark, cells, (0, 0)).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
    with pytest.raises(RuntimeError):
        route.relax(spark, cells, (0, 0), rounds=2)


def test_tiles_grow_with_the_grid_and_a_round_settles_only_its_own(spark, monkeypatch):
    for name, value in (("TILE", 4), ("MOST_TILE", 32), ("TILES_A_SIDE", 2)):
        monkeypatch.setattr(route, name, value, raising=False)
    n, wall = 60, {(r, c) for r in range(60) for c in range(60) if (r * 7 + c * 11) % 13 == 4}
    cells = route.navigable(grid(spark, n, wall), 2.0).selectExpr("row - 20 AS row", "col - 31 AS col", "wave_height_m", "wind_speed_ms")  # rows and columns below 0 too
    expected = heap_costs({(r - 20, c - 31): (float((r * 3 + c) % 4), 5.0) for r in range(n) for c in range(n) if (r, c) not in wall}, (-20, -31))
    got = {(r.row, r.col): r.cost for r in route.relax(spark, cells, (-20, -31), rounds=9).collect()}  # tiles of 4 would take 15 at least
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)


def test_path_baseline_and_currents(spark):
    wall = {(2, c) for c in range(5)}
    cells = route.navigable(grid(spark, 6, wall), 2.0)
    cells = route.checkpointed(cells.withColumn("current_east_ms", (F.col("col") % 3) * 0.5).withColumn("current_north_ms", F.lit(-0.4)), "cells")
    best = route.relax(spark, cells, (0, 0))
    one = cells.selectExpr("1 AS g", "*", "0 AS start_row", "0 AS start_col", "5 AS goal_row", "0 AS goal_col")
    cost = {(r.row, r.col): r.cost for r in best.collect()}
    assert route.routes(one, "g").first().cost == pytest.approx(cost[5, 0])
    path = sorted(values(route.trace(cells, best, (5, 0), 2.0), "leg", "row", "col", "cost", "distance_nm"))
    step = {(r.r0, r.c0, r.row, r.col): r.cost for r in route.neighbours(cells).collect()}
    assert path[0] == (0, 0, 0, 0.0, 0.0) and path[-1][1:4] == (5, 0, cost[5, 0]) and [p[0] for p in path] == list(range(len(path)))
    assert sum(step[a[1:3] + b[1:3]] for a, b in zip(path, path[1:])) == pytest.approx(cost[5, 0]) and path[-1][4] == 2.0 * (len(path) - 1)
    assert route.trace(cells, best, (2, 0)).count() == 0
    assert route.straight(spark, cells, (0, 0), (5, 0)).first().cost is None and route.straight(spark, cells, (1, 1), (1, 1)).first().cost == 0.0
    line = [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4)]  # a quarter of a row a step, the half goes to the even row 0
    assert route.straight(spark, cells, (0, 0), (1, 4)).first().cost == pytest.approx(sum(step[a + b] for a, b in zip(line, line[1:])))


def test_shared_cells_and_no_events(spark):
    ids = spark.createDataFrame([(0,), (1,), (10,)], "event_id long")  # a side of 3
    got = {(r.row, r.col): (r.wave_height_m, r.wind_speed_ms, r.blocked, r.depth_m) for r in route.grid_of(ids).collect()}
    assert got == {(0, 0): (0.0, 0.0, True, None), (1, 0): (1.4375, 1.0, False, 1.0)}
    assert route.relax(spark, route.navigable(route.grid_of(ids.limit(0)), 2.0), (5, 0)).count() == 0


def test_levels_and_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "source_id string, target_id string")
    assert dict(values(route.levels(spark, edges), "node", "level")) == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {x[0] for x in values(route.closure(spark, edges).where("target = 'd'"), "ancestor")} == {"a", "b", "c"}


def test_levels_and_closure_have_no_depth_limit(spark):
    deep = 52  # layers of two nodes: 2 ** 51 paths
    layers = spark.createDataFrame([(f"{a}{k}", f"{b}{k + 1}") for k in range(deep) for a in "xy" for b in "xy"], "source_id string, target_id string")
    assert dict(values(route.levels(spark, layers), "node", "level")) == {f"{a}{k}": k for k in range(deep + 1) for a in "xy"}
    chain = spark.createDataFrame([(k, k + 1) for k in range(24)], "source_id int, target_id int")
    assert sorted(values(route.closure(spark, chain), "target", "ancestor")) == [(t, a) for t in range(25) for a in range(t)]


def test_levels_and_closure_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "source_id string, target_id string")
    assert sorted(values(route.closure(spark, edges).where("target = 'b'"), "ancestor")) == [("a",), ("b",), ("c",)]
    with pytest.raises(ValueError):
        route.levels(spark, edges)
    with pytest.raises(ValueError):
        route.levels(spark, edges.where("source_id <> 'a'"))


def test_conflicts(spark):
    rows = spark.createDataFrame([("w", "a", 1.0, 0.9), ("w", "b", 1.4, 0.5), ("x", "b", 1.0, 0.9), ("x", "a", 3.0, 0.9), ("y", "a", 1.0, 0.1), ("y", "b", 9.0, 0.9), ("z", "a", 5.0, 0.5)], "variable string, source string, value double, reliability double")
    got = {r.variable: r for r in trust.resolve_conflicts(rows, ["variable"], F.lit(0.5)).collect()}
    assert (got["w"].chosen_source, got["w"].conflict) == ("a", False)
    assert (got["x"].chosen_source, got["x"].conflict, got["x"].irreconcilable, got["x"].lower, got["x"].upper) == ("a", True, False, 1.0, 3.0)
    assert (got["y"].chosen_value, got["y"].irreconcilable) == (9.0, True) and not got["z"].conflict


def test_replay(spark):
    good = spark.createDataFrame([("a" * 64,)], "sha256 string").limit(0)
    archive = spark.createDataFrame([(bytearray(b"x"),)], "content binary").withColumn("sha256", F.sha2("content", 256))
    mine = archive.select("sha256")
    assert trust.replay_outcome(mine, archive, 0, 0).first().outcome == "identical"
    assert trust.replay_outcome(mine, archive.withColumn("content", F.lit(b"y")), 0, 0).first().outcome == "evidence_tampered"
    assert trust.replay_outcome(mine, archive.limit(0), 0, 0).first().outcome == "evidence_unavailable"
    assert trust.replay_outcome(good, archive, 1, 0).first().outcome == "formula_changed"
    assert trust.replay_outcome(good, archive, 0, 2).first().outcome == "output_differs"


def test_graph_checks(spark):
    nodes = spark.createDataFrame([("r", "a", 0, "payload", "A"), ("r", "b", 1, "output", "B")], "run_id string, node_id string, k int, kind string, label string")
    edges = spark.createDataFrame([("r", "a", "b", "derives"), ("r", "b", "a", "derives"), ("r", "a", "gone", "derives")], "run_id string, source_id string, target_id string, relation string")
    assert sorted(values(trust.bad_edges(nodes, edges, F.col("k")), "source_id", "target_id")) == [("a", "gone"), ("b", "a")]
    one = trust.graph_fingerprint(nodes, edges).first().fingerprint
    assert trust.graph_fingerprint(nodes.orderBy(F.desc("node_id")), edges).first().fingerprint == one


def test_text_functions(spark):
    assert np.linalg.norm(text.hashed(["a", "b"])) == pytest.approx(1) and not text.hashed([]).any()
    rows = spark.createDataFrame([("வணக்கம் hello",), ("123 !",), ("Привет",)], "t string")
    got = [r.s for r in rows.select(text.script_shares(F.col("t")).alias("s")).collect()]
    assert set(got[0]) == {"TAMIL", "LATIN"} and got[1] is None and got[2] == {"LATIN": 1.0}
    assert rows.select(text.normal_name(F.lit("É-cole 3")).alias("x")).first().x == "ecole3"
    assert rows.select(text.fill_slots(F.lit("{a} to {b}"), F.create_map(F.lit("a"), F.lit("x"))).alias("x")).first().x == "x to {b}"


def test_places(spark):
    places = spark.createDataFrame([(1, "chennai"), (2, "madurai"), (3, "maduraj"), (4, "rameswaram")], "place_id long, name string")
    asked = spark.createDataFrame([("chennai",), ("chenai",), ("madurax",), ("rameswram",), ("delhi",), ("ramexwarxm",)], "query string")
    got = {r.query: (r.status, r.place_id) for r in retrieve.resolve_places(asked, places).collect()}
    assert got == {"chennai": ("resolved", 1), "chenai": ("resolved", 1), "madurax": ("ambiguous", None), "rameswram": ("resolved", 4), "delhi": ("unknown", None), "ramexwarxm": ("resolved", 4)}


def test_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank long")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, rank long")
    assert values(retrieve.fuse({"lexical": a, "vector": b}, "id"), "id", "mode") == [("y", "hybrid"), ("x", "lexical"), ("z", "vector")]


def test_sessions_never_carry_the_window(spark):
    turns = spark.createDataFrame([(1, 1, "a", "w"), (1, 2, None, None), (1, 3, "b", None)], "s int, t int, place string, window string")
    profile = spark.createDataFrame([(1, "home", "pw")], "s int, place string, window string").drop("window").withColumn("window", F.lit(None).cast("string"))
    got = sorted(values(sessions.carry_over(turns, "s", "t", ["place", "window"], never=["window"], profile=profile), "t", "place", "window", "origin_place"))
    assert got == [(1, "a", "w", "turn"), (2, "a", None, "carried"), (3, "b", None, "turn")]


def minute(m):
    return m * 60_000_000


def test_alert_decisions():
    step = lambda s, m, out, sev, mins=None, rule="wave": machine.decide(s, minute(m), rule, out, sev, mins)
    d, s = step(None, 0, "warning", "Severe")
    assert d == "send_new"
    assert step(s, 14, "warning", "Severe")[0] == "suppress_duplicate" and step(s, 15, "warning", "Severe")[0] == "send_update"
    assert step(s, 1, "emergency", "Extreme")[0] == "send_escalation"
    assert step(s, 1, "unevaluated", "Unknown") == ("send_cancel", None)
    _, watch = step(None, 0, "watch", "Moderate")
    assert step(watch, 1, "clear", "Minor") == ("nothing_to_do", watch)
    assert step(s, 12 * 60 + 1, "warning", "Severe")[0] == "send_new"
    _, drift = step(None, 0, "warning", "Severe", 18.0, "geofence_drift")
    assert step(drift, 1, "warning", "Severe", 9.0, "geofence_drift")[0] == "send_update"
    assert step(drift, 1, "warning", "Severe", 9.1, "geofence_drift")[0] == "suppress_duplicate"


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(3)), "wave", "h", T0 + dt.timedelta(minutes=3 * i), str(rng.choice(["clear", "watch", "warning", "emergency"])), "x", None) for i in range(120)]
    frame = spark.createDataFrame(rows, machine.IN.replace("severity string", "severity string")).withColumn("severity", alerts.severity(F.col("outcome")))
    for k in range(3):  # three files in order: three micro-batches
        frame.where((F.minute("at") >= 0) & (F.col("at") >= T0 + dt.timedelta(minutes=120 * k)) & (F.col("at") < T0 + dt.timedelta(minutes=120 * (k + 1)))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = sorted(values(machine.decide_batch(frame), *[x.split()[0] for x in machine.OUT.split(", ")]))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "1 day")
    got = windows.run_all(machine.decide_stream(stream), "alerts_test", str(tmp_path / "state"))
    assert sorted(values(got, *[x.split()[0] for x in machine.OUT.split(", ")])) == batch


def test_rules(spark):
    one = spark.range(1)
    first = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert first(alerts.threshold_rule(lit(None).cast("double"), lit(1.0), lit(2.0), lit(0))) == "unevaluated"
    assert first(alerts.threshold_rule(lit(2.0), lit(1.0), lit(2.0), lit(3 * 3600))) == "warning"
    assert first(alerts.threshold_rule(lit(2.0), lit(1.0), lit(2.0), lit(3 * 3600 + 1))) == "unevaluated"
    assert first(alerts.lightning_rule(lit(10), lit(1.0))) == "emergency" and first(alerts.lightning_rule(lit(10), lit(1.2))) == "warning"
    assert first(alerts.drift_rule(lit(10.0))) == "emergency" and first(alerts.cyclone_rule(lit(34))) == "warning"
    assert first(alerts.worst(F.array(*[F.struct(lit(r).alias("rule"), lit(o).alias("outcome")) for r, o in (("a", "clear"), ("b", "watch"), ("c", "watch"))])))["rule"] == "b"
    assert first(alerts.skip_reason(lit(True), lit(True), lit(1800), lit(1))) is None and first(alerts.skip_reason(lit(True), lit(True), lit(1801), lit(0))) == "stale"
    assert first(kernels.pfz_weight(lit(84.0))) == 0.5 and first(kernels.bloom_flag(lit(5.0), lit(1.0))) == "high" and first(kernels.bloom_flag(lit(5.0), lit(0.0))) is None


def test_cadence_cache(spark):
    rows = spark.createDataFrame([("a", T0, True), ("a", T0 + dt.timedelta(hours=1), False), ("a", T0 + dt.timedelta(hours=3), False), ("b", T0, False)], "key string, at timestamp_ntz, is_write boolean")
    got = windows.cadence_cache(rows.withColumn("issued", F.col("at")), "key", "at", "issued", F.lit(7200.0))
    assert sorted(values(got, "key", "found")) == [("a", "hit"), ("a", "stale"), ("b", "miss")]


def test_hourly_json_and_grid_csv(spark, tmp_path):
    payload = '{"latitude": 9.5, "longitude": 79.4, "hourly_units": {"wave": "m", "temp": "F"}, "hourly": {"time": ["2024-05-01T00:00", "2024-05-01T01:00"], "wave": [1.5, null], "temp": [80.0, 81.0]}}'
    rows = readers.hourly_json(spark.createDataFrame([(payload,)], "body string"), "body", {"wave": ("significant_wave_height", "m"), "temp": ("sea_surface_temperature", "degC")})
    assert sorted(values(rows, "variable", "value", "quality"), key=str) == [("significant_wave_height", 1.5, "observed"), ("significant_wave_height", None, "missing")]
    (tmp_path / "g.csv").write_text("time,latitude,longitude,sst\nUTC,degrees,degrees,C\n2024-05-01T00:00:00Z,9.5,281.0,28.5\n2024-05-01T00:00:00Z,9.5,80.0,NaN\nbad,9.5,80.0,1\n2024-05-01T00:00:00Z,,80.0,1\n")
    got = readers.grid_csv(spark, str(tmp_path / "g.csv"), "sea_surface_temperature", "degC", "sst")
    assert sorted(values(got, "lon", "value", "quality")) == [(-79.0, 28.5, "observed"), (80.0, None, "missing")]


def test_archive_and_tables(spark, tmp_path):
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text("{}")
    rows = readers.archive(spark, str(tmp_path / "*.json"), "src", F.lit("2024-05-01").cast("date")).collect()
    assert len(rows) == 1 and rows[0].key.startswith("raw/src/2024/05/01/") and rows[0].key.endswith(".json")
    readers.ensure_tables(spark, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/observations")).count() == 0 and len(readers.schema_export()) == 5


def plain_chunks(t, longest, shortest):
    """Chunks by trying every sentence on the open chunk."""
    out, merged = [], []
    for p in re.split(r"\n\s*\n", t):
        p = " ".join(p.split())
        for i, x in enumerate(([p] if len(p) <= longest else re.split(r"(?<=[.!?]) ", p)) if p else []):
            if i and len(out[-1] + " " + x) <= longest:
                out[-1] += " " + x
            else:
                out.append(x)
    for x in out:
        merged[-1:] = [merged[-1] + " " + x] if merged and len(x) < shortest else [*merged[-1:], x]
    return merged


def test_chunks_like_a_plain_loop(spark):
    rng = random.Random(2)
    made = lambda: "".join(rng.choices(["ab", "c", ". ", "! ", " ", "\n", "\n\n", "\n \n", "é", "\x1c"], [6, 6, 2, 1, 4, 1, 1, 1, 2, 1], k=rng.randrange(200)))
    texts = ["", "a" * 100 + "\n\ntiny", "One. Two three.\n\n" + "word " * 300 + "end. " + "More words here. " * 40, *(made() for _ in range(80))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "i int, t string")
    for longest, shortest in ((40, 8), (400, 20)):
        got = {r.i: r.c for r in rows.select("i", text.chunks(F.col("t"), longest, shortest).alias("c")).collect()}
        assert got == {i: plain_chunks(t, longest, shortest) for i, t in enumerate(texts)} | {999: []}


def test_signed_numbers(spark):
    row = spark.range(1).select(text.numbers(F.lit("from -3.5 to 1.5-2.0 m, 5.6.7, x-4, --2 and 10")).alias("n")).first()
    assert row.n == ["-3.5", "1.5", "2.0", "5.6", "-4", "-2", "10"]


def test_input_state_and_anomalies(spark):
    kind = "array<struct<name:string,value:int,age:int,stale:boolean,required:boolean>>"
    rows = [(0, [("a", None, 5, False, True), ("b", 1, 9, True, True), ("c", 1, 9, True, True)]), (1, [("b", None, None, False, True), ("a", None, 3, False, True)]), (2, [("a", None, None, True, False)]), (3, [])]
    got = {r.i: tuple(r.s) for r in spark.createDataFrame(rows, f"i int, x {kind}").select("i", watch.input_state(F.col("x")).alias("s")).collect()}
    assert got == {0: (9, "b,c", "stale_input", "b"), 1: (3, "", "missing_required_input", "a,b"), 2: (0, "a", None, None), 3: (0, "", None, None)}


def test_areas_without_seasons_are_always_closed(spark):
    inside = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id int, area_id string")
    seasons = spark.createDataFrame([("x", "hard", None, None, None, None), ("y", "soft", 11, 20, 1, 31), ("z", "hard", 6, 1, 7, 31)], "area_id string, severity string, m1 int, d1 int, m2 int, d2 int")
    got = {(r.id, r.area_id, r.blocks) for r in watch.closed_areas(inside, seasons, F.lit("2024-01-05").cast("date")).collect()}
    assert got == {(1, "x", True), (1, "y", False)}


@pytest.mark.parametrize(
    "given, language, point, want, units, drifted",
    [
        ("Waves 1.5-2.0 m.", "en", False, "Waves 1.5 to 2.0 metres.", ["m"], False),
        ("Swell 1m, then -1 km and 2.5kn", "en", False, "Swell 1 metre, then -1 kilometre and 2.5 knots", ["m", "km", "kn"], False),
        ("Water 28.5\u00b0C; bearing 90\u00b0", "en", True, "Water 28 point 5 degrees Celsius; bearing 90 degrees", ["degC", "deg"], False),
        ("3 h\u0964", "hi", False, "3 \u0918\u0902\u091f\u0947\u0964", ["h"], False),
        ("1 \u2013 3 xyz ...", "en", False, "1 to 3 xyz ...", [], False),
        ("2 point 5", "en", True, "2 point 5", [], True),  # reads back as 2.5
        ("", "en", False, "", [], False),
        (None, "en", False, None, None, False),
    ],
)
def test_spoken(spark, given, language, point, want, units, drifted):
    r = spark.createDataFrame([(given,)], "t string").select(speech.spoken(F.col("t"), language, point).alias("s")).first().s
    assert (r.text, r.units, r.drifted) == (want, units, drifted)


def test_cap_issues_and_circle(spark):
    infos = "array<struct<language:string,headline:string,instruction:string,effective:timestamp,expires:timestamp,areas:int>>"
    good = ("en", "Gale", "Stay", T0, T0 + dt.timedelta(hours=1), 1)
    cases = {
        "": ("tm-1", "me", [good]),
        "identifier,sender": ("a b", None, []),
        "info/language,info/headline,info/instruction,info/expires,info/area": ("tm-1", "me", [good, ("en", "x" * 161, None, T0, T0, None)]),
    }
    rows = spark.createDataFrame([(k, *v) for k, v in cases.items()], f"want string, i string, s string, infos {infos}")
    for r in rows.select("want", F.array_join(alerts.cap_issues(F.col("i"), F.col("s"), F.col("infos")), ",").alias("got")).collect():
        assert r.got == r.want
    assert spark.range(1).select(alerts.circle(F.lit(9.5), F.lit(79.25), F.lit(12.0)).alias("c")).first().c == "9.5000,79.2500 12.0"


def test_places_in_like_brute_force(spark):
    names = {"portblair": {1}, "port": {2}, "blair": {3, 4}, "sassoondock": {5}, "dock": {6}, "madras": {7}, "chennai": {7}}
    rng = random.Random(4)
    words = ["Port", "Blair", "Sassoon", "Dock", "Madras,", "Chenn\u00e4i.", "the", "sea"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(80)] + ["", None, " ,. ", "port " * 3000 + "blair"]
    want = set()
    for n, t in enumerate(texts):
        w, i, seen = re.sub("[,.]", " ", t or "").split(), 0, []
        while i < len(w):
            for k in (3, 2, 1):
                phrase = " ".join(w[i : i + k])
                found = names.get(phrase.replace(" ", "").lower().replace("\u00e4", "a"))
                if i + k <= len(w) and found:
                    row = (phrase, "exact", min(found)) if len(found) == 1 else (phrase, "ambiguous", None)
                    if (row[2] or phrase) not in [x[2] or x[0] for x in seen]:
                        seen.append(row)
                    i += k
                    break
            else:
                i += 1
        want |= {(n, o, *row) for o, row in enumerate(seen)}
    aliases = spark.createDataFrame([(a, p) for a, ps in names.items() for p in ps], "alias string, place_id long")
    got = retrieve.places_in(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", aliases)
    assert set(values(got, "id", "ordinal", "phrase", "kind", "place_id")) == want


def test_phrases_are_not_shuffled_to_a_small_gazetteer(spark, monkeypatch):
    texts = spark.createDataFrame([(i, "port blair and dock " * (i % 4)) for i in range(40)], "id long, text string")
    aliases = spark.createDataFrame([("portblair", 1), ("port", 2), ("dock", 3), ("dock", 4)], "alias string, place_id long")
    made = lambda: retrieve.places_in(texts, "id", "text", aliases)
    plan = made()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    few = sorted(values(made(), "id", "ordinal", "phrase", "kind"))
    monkeypatch.setattr(retrieve, "MOST_SENT", 2)
    assert "SortMergeJoin" in made()._jdf.queryExecution().executedPlan().toString() and sorted(values(made(), "id", "ordinal", "phrase", "kind")) == few and len(few) == 60


def test_lexical_asks_for_every_word_and_phrase(spark):
    docs = spark.createDataFrame([(1, "the sea of storms"), (2, "of the sea"), (3, "sea of the storms and rain"), (4, None), (5, "the sea")], "id long, text string")
    assert values(retrieve.lexical(docs, "id", ["sea", "the", "of"], every=True), "id") == [(1,), (2,), (3,)]
    assert values(retrieve.lexical(docs, "id", ["sea", "the"], every=True, phrases=["of the"], without=["rain"]), "id") == [(2,)]


def test_drift_looks_at_tracks_where_the_rows_are(spark):
    """Against every step's geodesic; one row a vessel through the plan, and an unknown speed or position crosses nothing."""
    line = [(lat, lon) for _, lat, lon in dimensions.BOUNDARY]
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"id": range(300), "lat": rng.uniform(8, 10.5, 300), "lon": rng.uniform(78, 81, 300), "heading_deg": rng.uniform(0, 360, 300), "speed_ms": rng.uniform(0, 15, 300)})
    rows = spark.createDataFrame(p).union(spark.createDataFrame([(300, None, 80.5, 0.0, 9.0), (301, 10.0, 81.0, 0.0, None)], "id long, lat double, lon double, heading_deg double, speed_ms double"))
    made = spatial.drift(rows.selectExpr("*", "0.5D current_east_ms", "0.0D current_north_ms"), line)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    got = {r.id: r for r in made.collect()}
    assert len(got) == 302 and all(got[i].crossing_s is None and got[i].closest_m is None for i in (300, 301))
    for r in p.itertuples():
        e, n = r.speed_ms * np.sin(np.radians(r.heading_deg)) + 0.5, r.speed_ms * np.cos(np.radians(r.heading_deg))
        t = np.arange(0, 3601, 60)
        y, x = geo.vincenty_direct(np.full(61, r.lat), np.full(61, r.lon), np.full(61, np.degrees(np.arctan2(e, n)) % 360), np.hypot(e, n) * t)
        at, on, _ = geo.nearest_on(line, y, x)
        metres = geo.vincenty_inverse(y, x, at, on)[0]
        assert got[r.id].closest_m == pytest.approx(metres.min(), abs=1e-3) and metres[got[r.id].closest_s // 60] == pytest.approx(metres.min(), abs=1e-3)


def test_a_text_is_looked_at_once_for_its_language(spark):
    from tidemark.plans import catalogue

    plan = catalogue.queries()["language_detect"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(text") == 1 and plan.count("regexp_replace(text") == 2
    rows = [(1, "of अब कख que"), (2, "தமிழ் தமிழ் der"), (3, "der la of"), (4, ""), (5, None), (6, "ab 1")]
    got = {r.id: (r.language, r.method, r.code_mixed) for r in retrieve.detect_language(spark.createDataFrame(rows, "id int, text string"), "text", catalogue.MARKERS).collect()}
    assert got == {1: ("ta", "romanized_lexicon", True), 2: ("ta", "script", True), 3: ("hi", "romanized_lexicon", True), 4: ("en", "default", False), 5: ("ta", "romanized_lexicon", False), 6: ("en", "default", False)}
