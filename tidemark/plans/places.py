"""Queries over regions with holes and boundary bands, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import buffers
from tidemark.functions import kernels
from tidemark.operators import regions
from tidemark.plans.catalogue import LINE, _gate, query
from tidemark.sources import loads
from tidemark.sources.store import new_path
from tidemark.sources.views import cte, view

OUTER, HOLE, ISLAND = 0.9, 0.5, 0.2  # half sides in degrees
BANDS = {"red": 2000.0, "amber": 5000.0, "far": 60_000.0}


def nation_regions(spark: SparkSession, d: str) -> DataFrame:
    """A region a nation: a square with a hole, and an island in the hole."""
    n = F.col("n_nationkey")
    y, x = 8.03 + (n % 5) * 0.6, 78.03 + (n % 7) * 0.55
    ring = lambda h: F.array(*[F.struct((y + a * h).cast("double").alias("lat"), (x + b * h).cast("double").alias("lon")) for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1))])
    return view(spark, d, "nation").select(F.concat(F.lit("n"), n.cast("string")).alias("region"), F.array(F.array(ring(OUTER), ring(HOLE)), F.array(ring(ISLAND))).alias("geom"))


_AT = lambda h: f"(abs(lat - (8.03::DOUBLE + (n_nationkey % 5) * 0.6::DOUBLE)) < {h} AND abs(lon - (78.03::DOUBLE + (n_nationkey % 7) * 0.55::DOUBLE)) < {h})"
_IN = f"(({_AT(OUTER)} AND NOT {_AT(HOLE)}) OR {_AT(ISLAND)})"


@query("points_in_regions", f"{cte('vessels')} SELECT vessel_id, concat('n', n_nationkey) AS region FROM vessels, nation WHERE {_IN}")
def points_in_regions(spark: SparkSession, d: str) -> DataFrame:
    return regions.containing(view(spark, d, "vessels").select("vessel_id", "lat", "lon"), nation_regions(spark, d), "region", "geom").select("vessel_id", "region")


@query("gated_by_place", f"""{cte('docs', 'shelters')}, g AS (SELECT doc_id, kind, CASE WHEN doc_id % 40 < 25 THEN CAST(doc_id % 40 AS INTEGER) END AS place FROM docs WHERE issued_time <= TIMESTAMP '2024-01-20 00:00:00' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-20 00:00:00') AND kind IN ('k1', 'k2', 'k3') AND (region IS NULL OR region IN ('R1', 'R2'))),
 b AS (SELECT place, kind, count(*) AS n FROM g GROUP BY ALL), p AS (SELECT shelter_id, n_nationkey AS place FROM shelters, nation WHERE {_IN} UNION ALL SELECT shelter_id, NULL FROM shelters)
 SELECT shelter_id, kind, CAST(sum(n) AS BIGINT) AS documents FROM p JOIN b ON p.place IS NOT DISTINCT FROM b.place GROUP BY ALL""")  # fmt: skip
def gated_by_place(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each kind may be shown at each shelter: those in force, of its codes, and whose region holds it."""
    n = F.col("doc_id")
    docs = view(spark, d, "docs").where(_gate().predicate()).select("kind", F.when(n % 40 < 25, F.concat(F.lit("n"), (n % 40).cast("string"))).alias("place"))
    counted = docs.groupBy(F.col("place").alias("_p"), "kind").agg(F.count("*").alias("n"))
    gate = regions.admissible(docs, view(spark, d, "shelters").select("shelter_id", "lat", "lon"), nation_regions(spark, d), "region", "geom", "place", "shelter_id")
    return gate.join(counted, F.col("place").eqNullSafe(F.col("_p"))).groupBy("shelter_id", "kind").agg(F.sum("n").alias("documents"))


@query("vessels_in_bands")
def vessels_in_bands(spark: SparkSession, d: str) -> DataFrame:
    """Which buffered bands of the boundary hold each vessel; the bands are the polygons that a map would draw."""
    made = [(name, [[[{"lat": a, "lon": b} for a, b in ring] for ring in polygon] for polygon in buffers.buffer(LINE, metres)]) for name, metres in BANDS.items()]
    bands = spark.createDataFrame(made, f"band string, geom {regions.GEOMETRY}")
    return regions.containing(view(spark, d, "vessels").select("vessel_id", "lat", "lon"), bands, "band", "geom").select("vessel_id", "band")


@query("loaded_areas", f"{cte('vessels')} SELECT vessel_id, concat('n', n_nationkey) AS area_id, CASE WHEN n_nationkey % 3 = 0 THEN 'soft' ELSE 'hard' END AS severity FROM vessels, nation WHERE {_AT(OUTER)} AND NOT {_AT(HOLE)}")
def loaded_areas(spark: SparkSession, d: str) -> DataFrame:
    """Areas loaded by key from their texts, a third of them twice, and the vessels that they hold."""
    n = F.col("n_nationkey")
    y, x = 8.03 + (n % 5) * 0.6, 78.03 + (n % 7) * 0.55
    corner = lambda h, a, b: F.concat((x + b * h).cast("double").cast("string"), F.lit(" "), (y + a * h).cast("double").cast("string"))
    ring = lambda h: F.concat(F.lit("("), F.concat_ws(", ", *[corner(h, a, b) for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1))]), F.lit(")"))
    text = F.concat(F.lit("SRID=4326;POLYGON("), ring(OUTER), F.lit(", "), ring(HOLE), F.lit(")"))
    made = lambda severity: [F.concat(F.lit("n"), n.cast("string")).alias("area_id"), F.col("n_name").alias("name"), F.lit("reserve").alias("kind"), F.lit(severity).alias("severity"), F.lit("a").alias("authority"), F.lit("c").alias("citation"), text.alias("wkt")]
    nations, path = view(spark, d, "nation"), new_path(spark, "areas")
    loads.load_areas(spark, path, nations.select(*made("hard")))
    loads.load_areas(spark, path, nations.where(n % 3 == 0).select(*made("soft")))
    return regions.containing(view(spark, d, "vessels").select("vessel_id", "lat", "lon"), loads.current(spark, path), "area_id", "geom").join(loads.current(spark, path).select("area_id", "severity"), "area_id").select("vessel_id", "area_id", "severity")


@query("kernel_coherence", """WITH v AS (SELECT c_custkey AS vessel_id, CASE WHEN c_custkey % 3 <> 0 THEN 1.0 END AS value, CASE WHEN c_custkey % 4 = 0 THEN 'stale_input' END AS reason, CASE WHEN c_custkey % 5 <> 0 THEN 'old' END AS detail FROM customer),
 i AS (SELECT CASE WHEN reason IS NOT NULL AND value IS NOT NULL THEN 'an abstention returns a value' WHEN reason IS NOT NULL AND coalesce(detail, '') = '' THEN 'an abstention does not explain itself' WHEN reason IS NULL AND value IS NULL THEN 'no value and no reason' END AS issue FROM v) SELECT issue, count(*) AS n FROM i GROUP BY issue""")  # fmt: skip
def kernel_coherence(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey")
    issue = kernels.coherence(F.when(n % 3 != 0, 1.0), F.when(n % 4 == 0, "stale_input"), F.when(n % 5 != 0, "old"))
    return view(spark, d, "customer").groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))
