"""What a gridded dataset is, read from its own metadata document, and the request that fits it.

A document is JSON of a table: {"table": {"columnNames": [...], "rows": [[row type, variable, attribute, type, value], ...]}}.
Documents differ in columns, in the order of dimensions and in the types of their values, so they are parsed to VARIANT
and read by path; columns are found by name. Nothing about a dataset is assumed: each dimension that the server reports
gets a constraint in the server's order, and those without a meaning for us (levels, depths) are pinned to their first
index, as leaving one out would shift all later ones to another axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: column names of a metadata table, and the names under which units of temperature may be reported
ROW_TYPE, VARIABLE, ATTRIBUTE, VALUE = "Row Type", "Variable Name", "Attribute Name", "Value"
SAME_UNITS = {"degC": ("degree_C", "degrees_C", "Celsius")}
GLOBAL = "NC_GLOBAL"
LICENSE_CHARS = 200


def discover(documents: DataFrame, column: str) -> DataFrame:
    """Add readable, dimensions, variables, license, starts, ends, lat_min, lat_max, lon_min, lon_max and ranges (of each
    dimension, as [least, most]); unreadable documents have nulls and empty lists."""
    v = F.col("_v")
    names = F.coalesce(F.try_variant_get(v, "$.table.columnNames", "array<string>"), F.array(*map(F.lit, (ROW_TYPE, VARIABLE, ATTRIBUTE, "Data Type", VALUE))))
    rows = documents.withColumn("_v", F.try_parse_json(column)).withColumn("_rows", F.try_variant_get(v, "$.table.rows", "array<array<string>>"))
    for i, name in enumerate((ROW_TYPE, VARIABLE, ATTRIBUTE, VALUE)):
        rows = rows.withColumn(f"_at{i}", (F.array_position(names, name) - 1).cast("int"))
    cell = lambda r, i: F.get(r, F.col(f"_at{i}"))
    named = lambda kind: F.coalesce(F.transform(F.filter("_rows", lambda r: cell(r, 0) == kind), lambda r: cell(r, 1)), F.array().cast("array<string>"))
    pairs = F.transform(F.filter("_rows", lambda r: (cell(r, 1) == GLOBAL) & cell(r, 2).isNotNull()), lambda r: F.struct(cell(r, 2), cell(r, 3)))
    spans = F.transform(F.filter("_rows", lambda r: (cell(r, 2) == "actual_range") & F.array_contains(named("dimension"), cell(r, 1))), lambda r: F.struct(cell(r, 1), F.transform(F.split(cell(r, 3), ","), lambda x: F.trim(x).try_cast("double"))))
    rows = rows.withColumn("_a", _last_wins(pairs))
    attribute = lambda name: F.try_element_at("_a", F.lit(name))
    when = lambda name: F.try_to_timestamp(F.regexp_replace(attribute(name), "Z$", "")).cast("timestamp_ntz")
    number = lambda name: attribute(name).try_cast("double")
    found = rows.select(
        *documents.columns, F.col("_rows").isNotNull().alias("readable"), named("dimension").alias("dimensions"), named("variable").alias("variables"),
        F.when(F.col("_rows").isNotNull(), F.substring(F.coalesce(attribute("license"), F.lit("unspecified")), 1, LICENSE_CHARS)).alias("license"), when("time_coverage_start").alias("starts"), when("time_coverage_end").alias("ends"),
        *[number(f"geospatial_{x}").alias(x) for x in ("lat_min", "lat_max", "lon_min", "lon_max")], _last_wins(spans).alias("ranges"),
    )
    return found


def _last_wins(pairs: Column) -> Column:
    """A map of pairs; of equal keys the last counts."""
    reverse = F.reverse(pairs)
    keys = F.transform(reverse, lambda p: p["col1"])
    firsts = F.filter(reverse, lambda p, i: F.array_position(keys, p["col1"]) == i + 1)
    return F.map_from_entries(firsts)


def shapes(documents: DataFrame, column: str) -> DataFrame:
    """The schema that covers all readable documents, and how many are unreadable: one row."""
    v = F.try_parse_json(column)
    return documents.agg(F.schema_of_variant_agg(v).alias("shape"), F.count_if(v.isNull()).alias("unreadable"), F.count("*").alias("documents"))


def wraps(lon_max: Column) -> Column:
    """Whether a grid counts longitudes 0..360."""
    return F.coalesce(lon_max > 180, F.lit(False))


def constraints(dimensions: Column, lon_max: Column, box: tuple[Column, Column, Column, Column], start: Column, end: Column) -> Column:
    """One constraint a dimension, in the server's order."""
    south, north, west, east = box
    turned = lambda x: F.when(wraps(lon_max), F.pmod(x, F.lit(360.0))).otherwise(x).cast("string")
    span = lambda a, b: F.concat(F.lit("[("), a, F.lit("):1:("), b, F.lit(")]"))
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def one(name: Column) -> Column:
        low = F.lower(name)
        found = F.when(low == "time", span(stamp(start), stamp(end))).when(low.isin("latitude", "lat"), span(south.cast("string"), north.cast("string")))
        return found.when(low.isin("longitude", "lon"), span(turned(west), turned(east))).otherwise("[0]")

    return F.array_join(F.transform(dimensions, one), "")


def requests(datasets: DataFrame, dataset_id: str, base: str, aliases: dict[str, tuple[str, str]], wanted: list[str], box: tuple[float, float, float, float], start: str, end: str) -> DataFrame:
    """For each discovered dataset the request for the first of its fields that stands for a wanted variable: dataset, field,
    variable, unit, url, or why there is none (note), and the wanted variables that it can't give."""
    from tidemark.operators.records import served

    at = lambda t: F.lit(t).cast("timestamp_ntz")
    rows = datasets.withColumn("_s", served(F.col("variables"), aliases, wanted))
    ended = F.coalesce(F.col("ends") < at(start), F.lit(False))
    note = F.when(~F.col("readable"), "the metadata can't be read").when(F.col("_s").isNull(), "none of its variables is wanted")
    note = note.when(ended, F.concat(F.lit("coverage ends "), F.date_format("ends", "yyyy-MM-dd"), F.lit(f", before the window starting {start[:10]}: a historical archive, not a live feed")))
    subset = F.concat(F.col("_s.field"), constraints(F.col("dimensions"), F.col("lon_max"), tuple(map(F.lit, box)), at(start), at(end)))
    url = F.concat(F.lit(f"{base.rstrip('/')}/griddap/"), F.col(dataset_id), F.lit(".csv?"), subset)
    asked = F.array(*map(F.lit, sorted(set(wanted))))
    missing = F.when(note.isNull(), F.array_except(asked, F.array(F.col("_s.variable")))).otherwise(asked)
    rows = rows.withColumn("note", note)
    return rows.select(dataset_id, *[F.when(F.col("note").isNull(), F.col(f"_s.{x}")).alias(x) for x in ("field", "variable", "unit")], F.when(F.col("note").isNull(), url).alias("url"), missing.alias("missing"), "note")


GRID = "status string, variable string, value double, unit string, lat double, lon double, valid_time timestamp_ntz, issued_time timestamp_ntz, dataset_id string, license string, quality string, note string, file string"


def _as_grid(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows of GRID: the named columns, null else."""
    kinds = [c.strip().split() for c in GRID.split(",")]
    return rows.select(*[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds])


def grid_records(spark: SparkSession, paths: str | list[str], dataset_id: str, field: str, variable: str, unit: str, license: str) -> DataFrame:
    """CSV answers (a header, a row of units, data) as rows: records, or one refused row for a file whose field has another
    unit, or no such column. Issued when valid: an archive has no later revision, and the time of retrieval would make old
    data look fresh. Rows whose time or place can't be read are left out; '' and NaN are gaps; longitudes are -180..180."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(paths).select("*", F.substring_index("_metadata.file_path", "/", -1).alias("_file"))
    known = {c.strip(): c for c in raw.columns}
    lat, lon = (next((known[c] for c in names if c in known), None) for names in (("latitude", "lat"), ("longitude", "lon")))
    said = {"variable": F.lit(variable), "dataset_id": F.lit(dataset_id), "license": F.lit(license)}
    lacks = [c for c in ("time", field) if c not in known] + ["a place"] * (lat is None or lon is None)
    if lacks:
        return _as_grid(raw.select("_file").distinct(), status=F.lit("refused"), unit=F.lit(unit), note=F.lit(f"the answer lacks {', '.join(lacks)}"), file=F.col("_file"), **said)
    rows = raw.select("_file", F.try_to_timestamp(F.regexp_replace(F.trim(F.col(known["time"])), "Z$", "")).cast("timestamp_ntz").alias("at"), F.trim(F.col(lat)).try_cast("double").alias("y"), F.trim(F.col(lon)).try_cast("double").alias("x"), F.trim(F.col(known[field])).alias("text"))
    units = rows.where("y IS NULL AND x IS NULL AND at IS NULL").groupBy(F.col("_file").alias("_f")).agg(F.max("text").alias("u"))
    other = units.where((F.col("u") != "") & ~F.col("u").isin(unit, *SAME_UNITS.get(unit, ())))
    refused = _as_grid(other, status=F.lit("refused"), unit=F.col("u"), note=F.concat(F.lit(f"{field}: unit "), F.col("u"), F.lit(f" is not the expected {unit}")), file=F.col("_f"), **said)
    good = rows.where("at IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL").join(other, F.col("_file") == F.col("_f"), "left_anti")
    number = F.col("text").try_cast("double")
    good = good.withColumn("v", F.when(~F.isnan(number), number))
    quality = F.when(F.col("v").isNull(), "missing").otherwise("observed")
    place = {"lat": F.col("y"), "lon": F.when(F.col("x") > 180, F.col("x") - 360).otherwise(F.col("x")), "valid_time": F.col("at"), "issued_time": F.col("at")}
    return _as_grid(good, status=F.lit("record"), value=F.col("v"), unit=F.lit(unit), quality=quality, file=F.col("_file"), **place, **said).unionByName(refused)
