"""Keyed loads of dimensions and documents: each load writes a new version of the table, readers take the newest whole one.

A load reads the version before it and writes the next, so a failure leaves the table as it was; a version counts once its
writer has committed it. One writer at a time. A table that was never loaded is an error, not an empty table: no areas
would read as no restrictions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.regions import GEOMETRY, parse_wkt

AREA = "area_id string, name string, kind string, severity string, authority string, citation string, wkt string"
BAN = "ban_id string, name string, jurisdiction string, authority string, citation string, severity string, start_month int, start_day int, end_month int, end_day int"
KEPT = 2  # versions: the newest and the one that a reader may still hold
SHOWN = 20  # faulty rows that an error names
DAYS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


class NotLoaded(LookupError):
    """A layer that nothing has been loaded into."""


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions of a table, ascending."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [s.getPath().getName() for s in system.listStatus(root) if s.isDirectory()]
    found = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    return sorted(v for v in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}/_SUCCESS")))


def current(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """The newest version of a table."""
    known = versions(spark, path)
    if not known:
        raise NotLoaded(f"{layer or path} is not loaded; load it first")
    return spark.read.parquet(f"{path}/v{known[-1]}")


def load(spark: SparkSession, path: str, rows: DataFrame, key: str, order: Column | None = None) -> int:
    """Insert or update rows by key; of several rows of a key the last by `order` wins. The number of the new version."""
    last = W.partitionBy(key).orderBy(F.desc(key) if order is None else order.desc())
    fresh = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    known = versions(spark, path)
    if known:
        before = spark.read.parquet(f"{path}/v{known[-1]}")
        fresh = before.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
    version = known[-1] + 1 if known else 1
    fresh.write.mode("overwrite").parquet(f"{path}/v{version}")
    for old in known[: -(KEPT - 1)]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return version


def refuse(faulty: DataFrame, key: str, reason: str) -> None:
    """An error that names some of the faulty rows, if there are any."""
    some = [str(r[0]) for r in faulty.select(key).orderBy(key).limit(SHOWN).collect()]
    if some:
        raise ValueError(f"{reason}: {', '.join(some)}")


def with_geometry(areas: DataFrame) -> DataFrame:
    """Areas with `geom` of their wkt; null where it isn't a polygon or multipolygon."""
    kept = [c for c in areas.columns if c != "wkt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))))
        for batch in batches:
            shapes = []
            for text in batch.column(len(kept)).to_pylist():
                try:
                    shapes.append([[[{"lat": y, "lon": x} for y, x in ring] for ring in polygon] for polygon in parse_wkt(text or "")])
                except ValueError:
                    shapes.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(shapes, kind)], names=[*kept, "geom"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in areas.schema if f.name != "wkt")
    return areas.select(*kept, "wkt").mapInArrow(run, f"{schema}, geom {GEOMETRY}")


def load_areas(spark: SparkSession, path: str, areas: DataFrame, order: Column | None = None) -> int:
    """Protected areas with their holes; a shape that can't be read refuses the whole load."""
    made = with_geometry(areas)
    refuse(made.where("geom IS NULL"), "area_id", "not a closed polygon or multipolygon on the globe")
    return load(spark, path, made, "area_id", order)


def load_bans(spark: SparkSession, path: str, bans: DataFrame, order: Column | None = None) -> int:
    """Seasonal bans; a day that no year has refuses the whole load."""
    most = lambda month: F.get(F.array(*map(F.lit, DAYS)), F.col(month) - 1)
    fine = lambda x: F.coalesce(F.col(f"{x}_month").between(1, 12) & F.col(f"{x}_day").between(1, most(f"{x}_month")), F.lit(False))
    refuse(bans.where(~(fine("start") & fine("end"))), "ban_id", "no such day")
    return load(spark, path, bans, "ban_id", order)


def ingest(spark: SparkSession, path: str, documents: DataFrame, order: Column | None = None) -> int:
    """Documents (document_id, text, ...) and their chunks: a document that comes again replaces its chunks. The number of
    chunks written for these documents."""
    last = W.partitionBy("document_id").orderBy(F.desc("text") if order is None else order.desc())
    docs = documents.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    parts = docs.select("document_id", F.posexplode(T.chunks("text")).alias("ordinal", "text"))
    chunks = parts.select(F.concat("document_id", F.lit("#"), F.lpad(F.col("ordinal").cast("string"), 4, "0")).alias("chunk_id"), "document_id", "ordinal", "text", F.sha2("text", 256).alias("content_sha256"), T.token_estimate(F.col("text")).alias("token_count"))
    known = versions(spark, f"{path}/chunks")
    held = chunks
    if known:
        before = spark.read.parquet(f"{path}/chunks/v{known[-1]}")
        held = before.join(docs.select("document_id"), "document_id", "left_anti").unionByName(chunks)
    version = known[-1] + 1 if known else 1
    held.write.mode("overwrite").parquet(f"{path}/chunks/v{version}")
    load(spark, f"{path}/documents", docs.withColumn("content_sha256", F.sha2("text", 256)).drop("text"), "document_id", order)
    return spark.read.parquet(f"{path}/chunks/v{version}").join(docs.select("document_id"), "document_id", "left_semi").count()
