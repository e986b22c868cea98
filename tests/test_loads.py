from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.operators import records, regions, watch
from tidemark.sources import loads

SQUARE = "POLYGON((77 5, 79 5, 79 7, 77 7, 77 5), (77.5 5.5, 78 5.5, 78 6, 77.5 6, 77.5 5.5))"


def areas(spark, rows):
    return spark.createDataFrame([(i, n, "reserve", s, "a", "c", w) for i, n, s, w in rows], loads.AREA)


def test_areas_are_loaded_by_key_and_keep_their_holes(spark, tmp_path):
    path = str(tmp_path / "areas")
    with pytest.raises(loads.NotLoaded, match="protected areas is not loaded"):
        loads.current(spark, path, "protected areas")
    assert loads.load_areas(spark, path, areas(spark, [("a", "old", "hard", SQUARE), ("b", "kept", "soft", "SRID=4326;MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)))")])) == 1
    assert loads.load_areas(spark, path, areas(spark, [("a", "new", "soft", SQUARE), ("c", "more", "hard", "POLYGON((0 0, 1 0, 1 1, 0 0))")])) == 2
    now = loads.current(spark, path)
    assert {(r.area_id, r.name, r.severity, len(r.geom[0])) for r in now.collect()} == {("a", "new", "soft", 2), ("b", "kept", "soft", 1), ("c", "more", "hard", 1)}
    points = spark.createDataFrame([(1, 5.2, 77.2), (2, 5.7, 77.7), (3, 9.0, 77.7)], "id int, lat double, lon double")
    assert {(r.id, r.area_id) for r in regions.containing(points, now, "area_id", "geom").collect()} == {(1, "a")}


def test_a_faulty_shape_or_a_failed_write_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "areas")
    loads.load_areas(spark, path, areas(spark, [("a", "old", "hard", SQUARE)]))
    with pytest.raises(ValueError, match="polygon.*: x, y"):
        loads.load_areas(spark, path, areas(spark, [("y", "n", "hard", "POLYGON((0 0, 1 1))"), ("x", "n", "hard", None), ("z", "n", "hard", SQUARE)]))
    os.makedirs(f"{path}/v2")  # a writer that didn't get to commit
    assert loads.versions(spark, path) == [1] and loads.current(spark, path).count() == 1
    for k in range(4):
        assert loads.load_areas(spark, path, areas(spark, [("a", f"n{k}", "hard", SQUARE)])) == 2 + k
    assert loads.versions(spark, path) == [4, 5]


def test_bans(spark, tmp_path):
    ban = lambda i, *days: (i, "n", "J0", "a", "c", "hard", *days)
    path = str(tmp_path / "bans")
    loads.load_bans(spark, path, spark.createDataFrame([ban("e", 4, 15, 6, 14), ban("w", 2, 29, 12, 31)], loads.BAN))
    loads.load_bans(spark, path, spark.createDataFrame([ban("e", 4, 1, 6, 1)], loads.BAN))
    assert {(r.ban_id, r.start_day) for r in loads.current(spark, path).collect()} == {("e", 1), ("w", 29)}
    for bad in (ban("x", 2, 30, 3, 1), ban("x", 13, 1, 3, 1), ban("x", None, 1, 3, 1), ban("x", 4, 1, 6, 31)):
        with pytest.raises(ValueError, match="no such day: x"):
            loads.load_bans(spark, path, spark.createDataFrame([bad], loads.BAN))


def test_ingested_documents_replace_their_chunks(spark, tmp_path):
    path = str(tmp_path / "corpus")
    long = "One sentence of some length that is here. " * 90
    docs = lambda rows: spark.createDataFrame(rows, "document_id string, text string, title string")
    first = loads.ingest(spark, path, docs([("a", long, "t"), ("b", "short text", "t"), ("c", None, "t")]))
    chunks = loads.current(spark, f"{path}/chunks")
    assert first == chunks.count() and chunks.where("document_id = 'a'").count() > 2
    assert loads.ingest(spark, path, docs([("a", "much shorter now", "u"), ("d", "new", "t")])) == 2
    now = {(r.document_id, r.text) for r in loads.current(spark, f"{path}/chunks").collect()}
    assert now == {("a", "much shorter now"), ("b", "short text"), ("d", "new")}
    assert {(r.document_id, r.title) for r in loads.current(spark, f"{path}/documents").collect()} == {("a", "u"), ("b", "t"), ("c", "t"), ("d", "t")}


def test_lookups_and_coherence(spark):
    rows = [(1, 2.0, None, None), (2, None, "stale_input", "old"), (3, 1.0, "stale_input", "old"), (4, None, "stale_input", ""), (5, None, None, None)]
    made = spark.createDataFrame(rows, "id int, value double, reason string, detail string").select("id", kernels.coherence(F.col("value"), F.col("reason"), F.col("detail")).alias("issue"))
    assert {r.id: r.issue for r in made.collect()} == {1: None, 2: None, 3: "an abstention returns a value", 4: "an abstention does not explain itself", 5: "no value and no reason"}
    ends = spark.createDataFrame([([("sms", True), ("push", False)],), ([],), (None,)], "e array<struct<channel:string,active:boolean>>")
    assert [[x.channel for x in r[0]] for r in ends.select(watch.active_endpoints(F.col("e"))).collect()] == [["sms"], [], []]
    asked = spark.createDataFrame([(1,), (2,)], "user_id int")
    seen = spark.createDataFrame([(1, 2.5), (3, 1.0)], "user_id int, wave double")
    assert {(r.user_id, r.wave) for r in watch.conditions_for(asked, seen, "user_id").collect()} == {(1, 2.5), (2, None)}
    boats = spark.createDataFrame([(1, True, True, True), (2, True, False, False), (3, False, True, True), (4, True, True, False)], "id int, sea boolean, known boolean, here boolean")
    reached = lambda area: {r.id for r in boats.where(records.recall_reaches(F.col("sea"), F.col("known"), F.col("here"), area)).collect()}
    assert reached(True) == {1} and reached(False) == {1, 4}


def test_fingerprints_tell_apart_names_and_values_with_separators(spark):
    kind = "array<struct<name:string,value:string>>"
    rows = [(1, [("a", "1;b=2")]), (2, [("a", "1"), ("b", "2")]), (3, [("b", "2"), ("a", "1")]), (4, [("a=1", "")]), (5, [("a", "1=")]), (6, [("a", None)]), (7, [("a", "")])]
    got = {r.id: r.f for r in spark.createDataFrame(rows, f"id int, i {kind}").select("id", watch.input_fingerprint(F.col("i")).alias("f")).collect()}
    assert got[2] == got[3] and len(set(got.values())) == 6
