from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DIR}/{name}'")
    return con


def cell(x):
    try:
        if pd.isna(x):
            return None
    except (TypeError, ValueError):
        pass
    try:
        return x if isinstance(x, bool) else int(x) if float(x) == int(x) else float(x)
    except (TypeError, ValueError, OverflowError):
        return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(repr([cell(x) for x in r]) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, oracle, name):
    got = catalogue.queries()[name](spark, DIR).toPandas()
    if name in catalogue.oracle_sql():
        assert rows(got) == rows(oracle.sql(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("files", [0, 2])
def test_stream_reads_a_file_or_a_folder(spark, tmp_path, files):
    events = spark.read.parquet(f"{DIR}/events.parquet").where("event_id < 60")
    if files:
        events.repartition(files).write.parquet(str(tmp_path / "events.parquet"))
    else:
        events.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    batch, stream = (sorted(map(tuple, catalogue.queries()[f"alert_dedup_{kind}"](spark, str(tmp_path)).collect())) for kind in ("batch", "stream"))
    assert batch == stream and len(batch) == 60


def test_the_stream_has_one_state_a_user(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.streaming import alerts as machine

    rows = catalogue._results(spark, DIR).where("user_id < 3")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("at", "12 hours")
    q = machine.decide_stream(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    users, keys = rows.agg(F.countDistinct("user_id"), F.countDistinct("user_id", "rule")).first()
    updated = q.recentProgress[0]["stateOperators"][0]["numRowsUpdated"]
    assert 0 < updated <= users < keys


def test_the_life_of_alerts_is_the_same_in_both_forms(spark):
    batch, stream = (sorted((tuple(r) for r in catalogue.queries()[f"alert_life_{kind}"](spark, DIR).collect()), key=str) for kind in ("batch", "stream"))
    assert batch == stream and len(batch) == 2 * spark.read.parquet(f"{DIR}/events.parquet").count()


def test_bands_hold_the_vessels_within_their_distance(spark):
    from tidemark.functions import geo
    from tidemark.operators import spatial
    from tidemark.plans import places
    from tidemark.sources.views import view

    vessels = view(spark, DIR, "vessels").select("vessel_id", "lat", "lon")
    far = {r.vessel_id: r.metres for r in spatial.boundary(vessels, catalogue.LINE).collect()}
    held = {(r.vessel_id, r.band) for r in places.vessels_in_bands(spark, DIR).collect()}
    near = {k: {(v, k) for v, m in far.items() if m < w * 0.99} for k, w in places.BANDS.items()}
    wide = {(v, k) for k, w in places.BANDS.items() for v, m in far.items() if m < w * 1.01}  # the nearest point is taken in degrees
    assert set().union(*near.values()) <= held <= wide and near["far"] and geo.AMBER_METRES == places.BANDS["amber"]


def test_the_full_tick_is_the_worst_of_all_rules(spark):
    from tidemark.functions.alerts import RANKS
    from tidemark.operators import spatial
    from tidemark.plans import watch

    worst = {}
    for r in watch._tick_results(spark, DIR).collect():
        worst.setdefault(r.vessel_id, []).append((-RANKS[r.outcome], r.rule, r.hazard, r.outcome))
    under_way = watch._under_way(spark, DIR)
    for r in spatial.boundary(under_way.select("vessel_id", "lat", "lon"), catalogue.LINE).collect():
        outcome = "warning" if r.metres <= 2000 else "watch" if r.metres <= 5000 else "clear"
        worst[r.vessel_id].append((-RANKS[outcome], "geofence_proximity", "", outcome))
    for r in spatial.drift(under_way.withColumnRenamed("vessel_id", "id"), catalogue.LINE).collect():
        minutes = None if r.crossing_s is None else r.crossing_s / 60
        outcome = "clear" if minutes is None else "emergency" if minutes <= 10 else "warning" if minutes <= 20 else "watch"
        worst[r.id].append((-RANKS[outcome], "geofence_drift", "", outcome))
    skipped = {r.vessel_id for r in watch._skips(spark, DIR).where("skip IS NOT NULL").collect()}
    want = {v: min(x)[1:] for v, x in worst.items() if v not in skipped and min(x)[0] < 0}
    got = {r.vessel_id: (r.rule, r.hazard, r.outcome) for r in catalogue.queries()["full_tick"](spark, DIR).collect()}
    assert got == want and any(rule.startswith("geofence") for rule, _, _ in got.values())


def test_plans_have_no_nested_loops_and_no_window_in_one_task(spark):
    for name in ("nearest_shelter", "pareto_frontier", "pareto_spread", "points_in_regions"):
        plan = catalogue.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Window" not in plan, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_task_has_all_vessels_of_a_system(spark):
    plan = catalogue.queries()["cyclone_rules"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(hazard" not in plan
    assert plan.count("BuildRight") >= 2 and "BuildLeft" not in plan  # rings and cones go to the vessels, not vessels to them
