"""Queries over archived payloads and metadata documents, both made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.catalogue import BOX, query
from tidemark.sources import discover, payloads
from tidemark.sources.store import new_path
from tidemark.sources.views import cte, view

WANTED = ("click", "storm", "view")
START, END = "2024-01-05", "2024-01-12"
UNITS = {"click": "m", "view": "s", "purchase": "degC"}


def archive_of(spark: SparkSession, d: str) -> str:
    """Archive the observations below the shared folder."""
    path = new_path(spark, "payloads")
    payloads.write_archive(view(spark, d, "obs"), path, UNITS)
    return path


_WITHIN = f"valid_time >= TIMESTAMP '{START}' AND valid_time < TIMESTAMP '{END}' AND lat BETWEEN {BOX[0]} AND {BOX[1]} AND lon BETWEEN {BOX[2]} AND {BOX[3]}"
_ASKED = "[" + ", ".join(f"'{v}'" for v in WANTED) + "]"
_HAS = "h AS (SELECT source, list_sort(list(DISTINCT variable)) AS variables, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, min(valid_time) AS starts, max(valid_time) AS ends FROM obs GROUP BY source)"
_UNIT = "CASE variable " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in UNITS.items()) + " ELSE '1' END"


@query("payload_fetch", f"""{cte('obs')}, {_HAS}
 SELECT 'record' AS status, source, variable, {_UNIT} AS unit, valid_time, issued_time, lat, lon, value, event_id AS record_id, quality FROM obs WHERE variable IN ('click', 'storm', 'view') AND {_WITHIN}
 UNION ALL SELECT 'missing', source, w, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM h, (SELECT unnest({_ASKED}) AS w) WHERE NOT list_contains(variables, w)
 UNION ALL SELECT 'ended', source, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM h WHERE ends < TIMESTAMP '{START}'""")  # fmt: skip
def payload_fetch(spark: SparkSession, d: str) -> DataFrame:
    """One request over an archive of all observations: records, and what sources lack."""
    rows = payloads.fetch(spark, archive_of(spark, d), UNITS, BOX, START, END, WANTED)
    return rows.select("status", "source", "variable", "unit", "valid_time", "issued_time", "lat", "lon", "value", "record_id", "quality")


@query("payload_outcomes", f"""{cte('obs')}, {_HAS}, r AS (SELECT source, count(*) AS records, count(*) FILTER (quality = 'missing') AS gaps FROM obs WHERE variable IN ('click', 'storm', 'view') AND {_WITHIN} GROUP BY source)
 SELECT source, coalesce(records, 0) AS records, coalesce(gaps, 0) AS gaps, array_to_string(list_filter({_ASKED}, lambda w: NOT list_contains(variables, w)), ',') AS missing FROM h LEFT JOIN r USING (source)""")  # fmt: skip
def payload_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What one request came to by source."""
    rows = payloads.fetch(spark, archive_of(spark, d), UNITS, BOX, START, END, WANTED)
    return payloads.outcome(rows).select("source", "records", "gaps", F.array_join("missing_variables", ",").alias("missing"))


@query("archive_supports", f"""{cte('obs')}, {_HAS}, c AS (SELECT *, south <= 9.0 AND north >= 5.0 AND west <= 80.0 AND east >= 77.0 AS covers, list_filter(['click', 'view'], lambda w: NOT list_contains(variables, w)) AS lacking FROM h)
 SELECT source, array_to_string(variables, ',') AS variables, starts, ends, covers, array_to_string(lacking, ',') AS unsupported, covers AND len(lacking) = 0 AS supports FROM c""")  # fmt: skip
def archive_supports(spark: SparkSession, d: str) -> DataFrame:
    """Which sources could serve a request, decided from the archive's manifest alone."""
    path = archive_of(spark, d)
    able = payloads.supports(payloads.descriptors(payloads.manifest(spark, path)), BOX, ["click", "view"])
    return able.select("source", F.array_join("variables", ",").alias("variables"), "starts", "ends", "covers", F.array_join("unsupported", ",").alias("unsupported"), "supports")


# --- metadata documents --------------------------------------------------------------------------------------------

_ROW = lambda *cells: "[" + ", ".join(f'"{c}"' for c in cells) + "]"
_DIMENSIONS = [("time", "latitude", "longitude"), ("time", "zlev", "latitude", "longitude"), ("longitude", "time", "lat"), ("depth", "time", "latitude", "lon")]
_FIELDS = [("SST", "WSPD_LF"), ("qc", "chlor_a"), ("salinity",), ("wind_speed", "analysed_sst", "err")]
ALIASES = {"SST": ("sea_surface_temperature", "degC"), "sst": ("sea_surface_temperature", "degC"), "analysed_sst": ("sea_surface_temperature", "degC"), "chlor_a": ("chlorophyll", "mg m-3"), "chlorophyll": ("chlorophyll", "mg m-3"), "wind_speed": ("wind_speed", "m s-1"), "WSPD_LF": ("wind_speed", "m s-1")}
ASKED = ["sea_surface_temperature", "chlorophyll"]
WEST_BOX = (5.0, 10.0, -70.0, -60.0)


def _documents_sql() -> str:
    """One metadata document a part: orders of dimensions, fields, coverage and grids differ; some are cut off."""
    case = lambda by, options: f"CASE {by} % {len(options)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(options)) + " END"
    dims = case("p_partkey", [", ".join(_ROW("dimension", x, "", "double", "") for x in d) for d in _DIMENSIONS])
    fields = case("p_size", [", ".join(_ROW("variable", x, "", "float", "") for x in f) for f in _FIELDS])
    ends = "concat(CAST(2005 + p_partkey % 25 AS STRING), '-06-30T00:00:00Z')"
    lon_max = "CASE WHEN p_partkey % 3 = 0 THEN '359.75' ELSE '100.0' END"
    head = '{"table": {"columnNames": ["Row Type", "Variable Name", "Attribute Name", "Data Type", "Value"], "rows": [["attribute", "NC_GLOBAL", "license", "String", "'
    text = f"""concat('{head}', p_brand, '"], ["attribute", "NC_GLOBAL", "time_coverage_end", "String", "', {ends}, '"], ["attribute", "NC_GLOBAL", "geospatial_lon_max", "double", "', {lon_max}, '"], ', {dims}, ', ', {fields}, ']}}}}')"""
    return f"SELECT concat('ds', CAST(p_partkey AS STRING)) AS dataset_id, CASE WHEN p_partkey % 19 = 0 THEN substring({text}, 1, 200) ELSE {text} END AS document FROM part"


def metadata_documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_escaped(_documents_sql()), p=view(spark, d, "part"))


def _escaped(sql: str) -> str:
    """For sql(): braces of the text are doubled, the table is a parameter."""
    return sql.replace("{", "{{").replace("}", "}}").replace("FROM part", "FROM {p}")


_D = "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in d) + "]" for d in _DIMENSIONS) + "][p_partkey % 4 + 1]"
_F = "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in f) + "]" for f in _FIELDS) + "][p_size % 4 + 1]"
_META = f"m AS (SELECT concat('ds', p_partkey) AS dataset_id, p_partkey % 19 <> 0 AS readable, p_brand, {_D} AS dims, {_F} AS fields, make_timestamp(2005 + p_partkey % 25, 6, 30, 0, 0, 0.0) AS ends, p_partkey % 3 = 0 AS wraps FROM part)"


@query("metadata_discover", f"""WITH {_META} SELECT dataset_id, readable, CASE WHEN readable THEN array_to_string(dims, ',') ELSE '' END AS dimensions, CASE WHEN readable THEN array_to_string(fields, ',') ELSE '' END AS variables,
 CASE WHEN readable THEN p_brand END AS license, CASE WHEN readable THEN ends END AS ends, CASE WHEN readable THEN CASE WHEN wraps THEN 359.75 ELSE 100.0 END::DOUBLE END AS lon_max FROM m""")  # fmt: skip
def metadata_discover(spark: SparkSession, d: str) -> DataFrame:
    found = discover.discover(metadata_documents(spark, d), "document")
    return found.select("dataset_id", "readable", F.array_join("dimensions", ",").alias("dimensions"), F.array_join("variables", ",").alias("variables"), "license", "ends", "lon_max")


@query("griddap_requests", f"""WITH {_META}, s AS (SELECT *, CASE fields[1] WHEN 'SST' THEN 'SST' WHEN 'qc' THEN 'chlor_a' WHEN 'wind_speed' THEN 'analysed_sst' END AS f FROM m),
 n AS (SELECT *, CASE WHEN NOT readable THEN 'the metadata can''t be read' WHEN f IS NULL THEN 'none of its variables is wanted' WHEN ends < TIMESTAMP '2014-01-01' THEN concat('coverage ends ', strftime(ends, '%Y-%m-%d'), ', before the window starting 2014-01-01: a historical archive, not a live feed') END AS note FROM s),
 c AS (SELECT *, array_to_string(list_transform(dims, lambda x: CASE WHEN x = 'time' THEN '[(2014-01-01T00:00:00Z):1:(2014-01-31T00:00:00Z)]' WHEN x IN ('lat', 'latitude') THEN '[(5.0):1:(10.0)]' WHEN x IN ('lon', 'longitude') THEN CASE WHEN wraps THEN '[(290.0):1:(300.0)]' ELSE '[(-70.0):1:(-60.0)]' END ELSE '[0]' END), '') AS q FROM n)
 SELECT dataset_id, CASE WHEN note IS NULL THEN concat('https://data.example/griddap/', dataset_id, '.csv?', f, q) END AS url, CASE WHEN note IS NULL THEN CASE f WHEN 'chlor_a' THEN 'sea_surface_temperature' ELSE 'chlorophyll' END ELSE 'chlorophyll,sea_surface_temperature' END AS missing, note FROM c""")  # fmt: skip
def griddap_requests(spark: SparkSession, d: str) -> DataFrame:
    """The request that fits each dataset, or why there is none."""
    found = discover.discover(metadata_documents(spark, d), "document")
    rows = discover.requests(found, "dataset_id", "https://data.example/", ALIASES, ASKED, WEST_BOX, "2014-01-01", "2014-01-31")
    return rows.select("dataset_id", "url", F.array_join("missing", ",").alias("missing"), "note")
