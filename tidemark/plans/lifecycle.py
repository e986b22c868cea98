"""Queries over the life of alerts: results, reports of delivery, and what both come to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import alerts as A
from tidemark.plans.catalogue import query
from tidemark.sources.store import new_path, remove
from tidemark.sources.views import view
from tidemark.streaming import lifecycle

HALF = "2024-01-16 00:00:00"


def alert_events(spark: SparkSession, d: str) -> DataFrame:
    """A result an event, and a minute later a report on the alert that it would have sent: three of four are delivered,
    one of ten can't be built."""
    e, n = view(spark, d, "events"), F.col("event_id")
    at = F.col("ts").cast("timestamp")
    rule = F.when(F.col("event_type") == "click", "geofence_drift").otherwise(F.col("event_type"))
    outcome = F.element_at(F.array(*map(F.lit, ("clear", "watch", "warning", "emergency", "unevaluated"))), (n % 5 + 1).cast("int"))
    key = ["user_id", rule.alias("rule"), F.lit("h").alias("hazard")]
    name = F.concat(F.lit("tm-"), F.substring(F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), rule, F.lit("h"), F.unix_micros(at).cast("string")), 256), 1, 16))
    none = lambda kind: F.lit(None).cast(kind)
    results = e.select(*key, at.alias("at"), (2 * n).alias("seq"), F.lit("result").alias("kind"), outcome.alias("outcome"), A.severity(outcome).alias("severity"), F.when(n % 3 == 0, (n % 30).cast("double")).alias("minutes"), (n % 10 != 7).alias("built"), none("string").alias("identifier"), none("boolean").alias("delivered"))
    reports = e.select(*key, (at + F.expr("INTERVAL 1 MINUTE")).alias("at"), (2 * n + 1).alias("seq"), F.lit("report").alias("kind"), none("string").alias("outcome"), none("string").alias("severity"), none("double").alias("minutes"), none("boolean").alias("built"), name.alias("identifier"), (n % 4 != 1).alias("delivered"))
    return lifecycle.typed(results.union(reports))


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("alert_life_batch")
def alert_life_batch(spark: SparkSession, d: str) -> DataFrame:
    """All decisions, commits and retirements at once."""
    return _plain(lifecycle.live_batch(alert_events(spark, d)))


@query("alert_life_stream")
def alert_life_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream that is stopped in the middle and started again from its checkpoint."""
    events, source, out, state = alert_events(spark, d), new_path(spark, "alert-events"), new_path(spark, "alert-life"), new_path(spark, "alert-life-state")
    own = lifecycle.lifecycle_session(spark)
    for k, part in enumerate((F.col("at") < F.lit(HALF).cast("timestamp"), F.col("at") >= F.lit(HALF).cast("timestamp"))):
        events.where(part).write.parquet(f"{source}/{k}")
        rows = own.readStream.schema(lifecycle.IN).parquet(f"{source}/*").withWatermark("at", "12 hours")
        lifecycle.run_to_end(lifecycle.live_stream(rows), out, state)
    remove(spark, state)
    remove(spark, source)
    return _plain(lifecycle.decisions_of(spark, out))


@query("alert_life_summary")
def alert_life_summary(spark: SparkSession, d: str) -> DataFrame:
    """What all events came to, by rule."""
    rows = lifecycle.live_batch(alert_events(spark, d))
    return rows.groupBy("rule", "decision").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
