from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from tidemark.plans import archives
from tidemark.sources import discover, payloads

UNITS = {"wave_height": "m", "wave_direction": "degree"}
DAY = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def observations(spark):
    rows = []
    for i in range(400):
        variable = ("wave_height", "wave_direction", "sst")[i % 3]
        rows.append((f"s{i % 2}", f"d{i % 4}", variable, None if i % 11 == 0 else i / 8, 4.0 + i % 12, 70.0 + i % 9, DAY + timedelta(days=i % 10, hours=i % 24), DAY + timedelta(days=20, minutes=i), i))
    return spark.createDataFrame(rows, "source string, dataset_id string, variable string, value double, lat double, lon double, valid_time timestamp_ntz, issued_time timestamp_ntz, event_id long")


@pytest.fixture(scope="module")
def archive(spark, observations, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive") / "payloads")
    payloads.write_archive(observations, path, UNITS | {"sst": "degC"}, tile=4.0)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def parts(df):
    """Partitions that rows come from; the report's may have none."""
    files = {r[0] for r in df.where("archive_uri IS NOT NULL").select("archive_uri").distinct().collect()}
    return len(files)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("event_id", "source", "variable", "value", "lat", "lon", "valid_time", "issued_time").collect())


def records(df):
    return sorted(tuple(r) for r in df.where("status = 'record'").select("record_id", "source", "variable", "value", "lat", "lon", "valid_time", "issued_time").collect())


def test_an_archive_gives_back_what_was_put_in(spark, observations, archive):
    read = lambda: payloads.read_archive(spark, archive, {})
    assert records(read()) == as_rows(observations)
    assert read().where("status = 'record'").select("quality").distinct().count() == 2
    assert read().where("status <> 'record'").count() == 0


@pytest.mark.parametrize(
    "condition",
    [
        "variable = 'sst'",
        "variable IN ('sst', 'wave_height') AND lat BETWEEN 5 AND 8",
        "source = 's1' AND lon > 73 AND lon < 75",
        "valid_time >= TIMESTAMP_NTZ'2024-01-03' AND valid_time < TIMESTAMP_NTZ'2024-01-05'",
        "lat = 6 AND valid_time > TIMESTAMP_NTZ'2024-01-02 06:00:00'",
        "value > 20 AND lat <= 7",
        "variable = 'sst' AND variable IN ('wave_height')",
        "lat > 7 AND lat < 6",
    ],
)
def test_filters_give_what_a_scan_gives(spark, observations, archive, condition):
    assert records(payloads.read_archive(spark, archive, {}).where(condition)) == as_rows(observations.where(condition))


def test_filters_are_taken_over_and_prune_files(spark, archive):
    asked = payloads.fetch(spark, archive, {}, (4.0, 9.0, 70.0, 74.0), "2024-01-02", "2024-01-04", ["sst"])
    text = plan(asked)
    assert "Filter" not in text.replace("RuntimeFilters", ""), text  # Spark filters nothing again
    whole, few = (parts(x) for x in (payloads.read_archive(spark, archive, {}), payloads.fetch(spark, archive, {}, (4.0, 9.0, 70.0, 74.0), "2024-01-02", "2024-01-04", ["sst"])))
    files = payloads.manifest(spark, archive)
    fits = files.where("source IS NOT NULL AND array_contains(fields, 'sst') AND south <= 9 AND north >= 4 AND west <= 74 AND east >= 70 AND starts <= TIMESTAMP_NTZ'2024-01-04' AND ends >= TIMESTAMP_NTZ'2024-01-02'")
    assert whole == files.count() and 0 < few <= fits.count() < whole / 4
    reader = payloads.PayloadReader(archive, {})
    assert len(reader.partitions()) == files.count() + 1  # a partition a file, and the report
    left = list(reader.pushFilters([D.In(("variable",), ("sst",)), D.GreaterThanOrEqual(("lat",), 4.0), D.LessThanOrEqual(("lat",), 9.0), D.LessThan(("valid_time",), datetime(2024, 1, 4)), D.GreaterThan(("value",), 3.0), D.LessThanOrEqual(("lon",), 74.0), D.GreaterThanOrEqual(("valid_time",), datetime(2024, 1, 2))]))
    assert [f.attribute for f in left] == [("value",)] and {p.file for p in reader.partitions()[:-1]} == {r.file for r in fits.collect()}
    partly = payloads.read_archive(spark, archive, {}).where("value > 3 AND lat < 5")
    assert "Filter" in plan(partly).replace("RuntimeFilters", "")  # on value, which no manifest knows


def test_what_a_source_lacks_comes_as_rows(spark, archive):
    asked = payloads.fetch(spark, archive, {}, (0.0, 90.0, 0.0, 180.0), "2024-02-01", "2024-03-01", ["sst", "storm"])
    got = {(r.status, r.source, r.variable) for r in asked.collect()}
    assert got == {("ended", "s0", None), ("ended", "s1", None), ("missing", "s0", "storm"), ("missing", "s1", "storm")}
    summary = {r.source: r for r in payloads.outcome(asked).collect()}
    assert summary["s0"].records == 0 and summary["s0"].missing_variables == ["storm"] and "2024-01-09" in " ".join(summary["s0"].warnings)


def test_other_units_and_broken_lines_are_refused(spark, archive, tmp_path):
    folder = tmp_path / "a" / "source=x" / "day=2024-01-01" / "tile=0_0"
    folder.mkdir(parents=True)
    point = {"source": "x", "dataset_id": "d", "license": "open", "latitude": 13.125, "longitude": 80.25, "hourly_units": {"wave_height": "ft", "wave_direction": "degree"}}
    point["hourly"] = {"time": ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01T02:00"], "wave_height": [1, 2, 3], "wave_direction": [135, None, 140.5]}
    (folder / "part-0.txt").write_text("\n".join([json.dumps(point), "{not json", '{"latitude": 1}', json.dumps(point | {"hourly": {"time": ["2024-01-01"], "wave_direction": [1, 2]}})]))
    payloads.write_manifest(spark, str(tmp_path / "a"))
    read = lambda: payloads.read_archive(spark, str(tmp_path / "a"), UNITS)
    rows = read().collect()
    assert [(r.variable, r.value, r.quality, r.unit, r.lat, r.lon) for r in rows if r.status == "record"] == [("wave_direction", 135.0, "observed", "degree", 13.125, 80.25), ("wave_direction", None, "missing", "degree", 13.125, 80.25), ("wave_direction", 140.5, "observed", "degree", 13.125, 80.25)]
    refused = sorted((r.variable or "", r.note) for r in rows if r.status == "refused")
    assert len(refused) == 4 and refused[-1] == ("wave_height", "unit ft is not the expected m")
    assert all(r.issued_time == r.valid_time for r in rows if r.status == "record")  # without its own issue an archive's time is both
    late = read().where("valid_time >= TIMESTAMP_NTZ'2024-01-01 02:00:00' AND variable = 'wave_direction'")
    assert [r.value for r in late.collect() if r.status == "record"] == [140.5]


def test_the_session_stays_as_it_was(spark, archive):
    payloads.read_archive(spark, archive, {}).count()
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled") == "false"


def test_supports(spark, archive):
    sources = payloads.descriptors(payloads.manifest(spark, archive))
    able = {r.source: r for r in payloads.supports(sources, (0.0, 5.0, 60.0, 70.0), ["sst", "fog"]).collect()}
    assert able["s0"].covers and able["s0"].unsupported == ["fog"] and not able["s0"].supports
    assert all(r.supports for r in payloads.supports(sources, (4.0, 5.0, 70.0, 71.0), ["sst"]).collect())
    assert not any(r.covers for r in payloads.supports(sources, (40.0, 50.0, 70.0, 71.0), ["sst"]).collect())


# --- metadata ------------------------------------------------------------------------------------------------------


def document(dimensions, variables, columns=("Row Type", "Variable Name", "Attribute Name", "Data Type", "Value"), **attributes):
    rows = [["dimension", d, "", "double", ""] for d in dimensions] + [["variable", v, "", "float", ""] for v in variables] + [["attribute", "NC_GLOBAL", k, "String", v] for k, v in attributes.items()]
    rows += [["attribute", "latitude", "actual_range", "double", "-5.5, 30.25"]]
    order = [("Row Type", "Variable Name", "Attribute Name", "Data Type", "Value").index(c) for c in columns]
    return json.dumps({"table": {"columnNames": list(columns), "rows": [[r[i] for i in order] for r in rows]}})


def test_discover_and_requests(spark):
    docs = [
        ("noaa", document(("time", "zlev", "latitude", "longitude"), ("SST", "WSPD_LF"), license="open " * 60, time_coverage_start="1997-12-07T00:00:00Z", time_coverage_end="2030-12-31T00:00:00Z", geospatial_lon_min=0, geospatial_lon_max=359.75)),
        ("ended", document(("time", "latitude", "longitude"), ("SST",), time_coverage_end="2014-12-31T00:00:00Z", geospatial_lon_max="80.5")),
        ("moved", document(("longitude", "time", "lat"), ("qc", "wind_speed"), columns=("Value", "Variable Name", "Row Type", "Data Type", "Attribute Name"), time_coverage_end="no time", geospatial_lon_max="NaNx")),
        ("other", document(("time",), ("salinity",))),
        ("broken", "{"),
        ("nothing", None),
        ("shapeless", "[1, 2]"),
    ]
    found = discover.discover(spark.createDataFrame(docs, "dataset string, document string"), "document")
    got = {r.dataset: r for r in found.collect()}
    assert got["noaa"].dimensions == ["time", "zlev", "latitude", "longitude"] and got["noaa"].variables == ["SST", "WSPD_LF"]
    assert len(got["noaa"].license) == 200 and got["noaa"].starts == datetime(1997, 12, 7) and got["noaa"].lon_max == 359.75
    assert got["noaa"].ranges == {"latitude": [-5.5, 30.25]} and got["moved"].ranges == {}
    assert got["moved"].dimensions == ["longitude", "time", "lat"] and got["moved"].license == "unspecified" and got["moved"].ends is None and got["moved"].lon_max is None
    assert [got[x].readable for x in ("broken", "nothing", "shapeless")] == [False] * 3 and got["broken"].dimensions == []

    aliases = {"SST": ("sea_surface_temperature", "degC"), "wind_speed": ("wind_speed", "m s-1")}
    made = {r.dataset: r for r in discover.requests(found, "dataset", "https://x.example/erddap/", aliases, ["sea_surface_temperature", "wind_speed"], (5.0, 10.0, -70.0, -60.0), "2026-09-18", "2026-09-19").collect()}
    assert made["noaa"].url == "https://x.example/erddap/griddap/noaa.csv?SST[(2026-09-18T00:00:00Z):1:(2026-09-19T00:00:00Z)][0][(5.0):1:(10.0)][(290.0):1:(300.0)]"
    assert made["noaa"].missing == ["wind_speed"]
    assert made["moved"].url.endswith("?wind_speed[(-70.0):1:(-60.0)][(2026-09-18T00:00:00Z):1:(2026-09-19T00:00:00Z)][(5.0):1:(10.0)]")
    assert made["ended"].url is None and "2014-12-31" in made["ended"].note and "historical archive" in made["ended"].note and len(made["ended"].missing) == 2
    assert made["other"].note == "none of its variables is wanted" and made["broken"].note == "the metadata can't be read"
    shape = discover.shapes(spark.createDataFrame(docs, "dataset string, document string"), "document").first()
    assert shape.unreadable == 2 and shape.documents == 7


def test_grid_records(spark, tmp_path):
    head = "time,latitude,longitude,SST\nUTC,degrees_north,degrees_east,{}\n"
    (tmp_path / "a.csv").write_text(head.format("degree_C") + "2014-12-30T00:00:00Z,13.125,280.25,28.7\n2014-12-30T00:00:00Z,13.375,80.25,NaN\nbad,1,2,3\n2014-12-30T00:00:00Z,x,2,3\n2014-12-31T00:00:00Z,1,2,\n")
    (tmp_path / "b.csv").write_text(head.format("K") + "2014-12-30T00:00:00Z,13.125,80.25,301.7\n")
    got = {(r.file, r.status, r.value, r.lon, r.quality, r.note) for r in discover.grid_records(spark, str(tmp_path), "d", "SST", "sea_surface_temperature", "degC", "open").collect()}
    assert got == {("a.csv", "record", 28.7, -79.75, "observed", None), ("a.csv", "record", None, 80.25, "missing", None), ("a.csv", "record", None, 2.0, "missing", None), ("b.csv", "refused", None, None, None, "SST: unit K is not the expected degC")}
    rows = discover.grid_records(spark, str(tmp_path / "a.csv"), "d", "SST", "sea_surface_temperature", "degC", "open").where("status = 'record'").collect()
    assert all(r.issued_time == r.valid_time and r.unit == "degC" and r.license == "open" for r in rows)
    lacking = discover.grid_records(spark, str(tmp_path), "d", "chl", "chlorophyll", "mg m-3", "open").collect()
    assert {(r.status, r.note) for r in lacking} == {("refused", "the answer lacks chl")}


def test_documents_are_made_of_every_part(spark):
    d = "/root/testdata/sf0.001"
    assert archives.metadata_documents(spark, d).count() == spark.read.parquet(f"{d}/part.parquet").count()
    assert archives.metadata_documents(spark, d).where(F.try_parse_json("document").isNull()).count() > 0
