"""Readers of payload archives and writers of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATION = "variable string, value double, unit string, lat double, lon double, depth_m double, valid_time timestamp_ntz, issued_time timestamp_ntz, source string, dataset_id string, quality string, kind string, license string, archive_uri string"
DOCUMENT = "document_id string, kind string, title string, source string, url string, issued_time timestamp_ntz, valid_until timestamp_ntz, authority_rank int, license string, language string, region_codes array<string>, content_sha256 string"
CHUNK = "chunk_id string, document_id string, ordinal int, text string, embedding array<float>, token_count long"
PROVENANCE_NODE = "run_id string, node_id string, kind string, label string, occurred_at timestamp_ntz, attributes string"
PROVENANCE_EDGE = "run_id string, source_id string, target_id string, relation string"
SCHEMAS = {"observations": OBSERVATION, "documents": DOCUMENT, "document_chunks": CHUNK, "provenance_nodes": PROVENANCE_NODE, "provenance_edges": PROVENANCE_EDGE}


def schema_export() -> dict[str, str]:
    """JSON of every table's schema."""
    return {name: T.StructType.fromDDL(schema).json() for name, schema in SCHEMAS.items()}


def ensure_tables(spark: SparkSession, root: str) -> None:
    """Write an empty table of each schema where there is none."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def hourly_json(payloads: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Point payloads {latitude, longitude, hourly_units, hourly: {time: [], field: []}} to long rows.

    fields maps a payload field to (variable, unit); a null is a missing row, a field in another unit is left out.
    """
    lists = ", ".join(f"`{f}`: array<double>" for f in fields)
    schema = f"struct<latitude: double, longitude: double, hourly_units: map<string,string>, hourly: struct<time: array<string>, {lists}>>"
    j = payloads.withColumn("_j", F.from_json(column, schema)).drop(column)
    rows = []
    for f, (variable, unit) in fields.items():
        own = j.where(F.coalesce(F.try_element_at("_j.hourly_units", F.lit(f)), F.lit(unit)) == unit)
        pairs = F.arrays_zip(F.col("_j.hourly.time").alias("t"), F.col(f"_j.hourly.{f}").alias("v"))
        own = own.select(*j.drop("_j").columns, F.col("_j.latitude").alias("lat"), F.col("_j.longitude").alias("lon"), F.explode(pairs).alias("p"))
        rows.append(own.select("*", F.lit(variable).alias("variable"), F.lit(unit).alias("unit"), F.col("p.v").alias("value"), F.try_to_timestamp(F.replace("p.t", F.lit("T"), F.lit(" "))).cast("timestamp_ntz").alias("valid_time"), F.when(F.col("p.v").isNull(), "missing").otherwise("observed").alias("quality")).drop("p"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.where("valid_time IS NOT NULL")


def grid_csv(spark: SparkSession, path: str, variable: str, unit: str, field: str) -> DataFrame:
    """Gridded CSV with a header and a units row: bad times and places are dropped, '' and NaN are missing, longitudes are -180..180."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    lat, lon, value = (F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in ("latitude", "longitude", field))
    at = F.expr("try_cast(regexp_replace(time, 'Z$', '') AS TIMESTAMP_NTZ)")
    rows = raw.select(at.alias("valid_time"), lat.alias("lat"), lon.alias("lon"), F.when(F.isnan(value), None).otherwise(value).alias("value")).where("valid_time IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    rows = rows.withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")))
    return rows.select(F.lit(variable).alias("variable"), "value", F.lit(unit).alias("unit"), "lat", "lon", "valid_time", F.col("valid_time").alias("issued_time"), F.when(F.col("value").isNull(), "missing").otherwise("observed").alias("quality"))


def archive(spark: SparkSession, paths: str, source: str, retrieved: Column) -> DataFrame:
    """Raw payload files as rows named by content: equal bytes have equal keys."""
    raw = spark.read.format("binaryFile").load(paths)
    digest = F.sha2("content", 256)
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    key = F.concat_ws("/", F.lit("raw"), F.lit(source), F.date_format(retrieved, "yyyy/MM/dd"), F.concat_ws(".", digest, ext))
    return raw.select(digest.alias("sha256"), key.alias("key"), "content", F.col("length").alias("bytes")).dropDuplicates(["sha256"])


def write_by_day(observations: DataFrame, path: str) -> None:
    """Days that occur in observations are written anew, others stay."""
    rows = observations.withColumn("day", F.to_date("valid_time"))
    rows.repartition("day").sortWithinPartitions("variable", "lat", "lon").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def payload_url(base: str, lat_lon: tuple[float, float], fields: list[str], start: str, end: str) -> str:
    return f"{base}?latitude={lat_lon[0]:.4f}&longitude={lat_lon[1]:.4f}&hourly={','.join(sorted(fields))}&start_date={start}&end_date={end}"
