"""Bitemporal observations: scans, as-of selection, upserts, fallback across ranked sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.timeq import in_box, in_window, is_stale

KEY = ("source", "variable", "valid_time", "lat", "lon", "depth_key")


@dataclass(frozen=True)
class ScanSpec:
    """What to scan: an inclusive box, a half-open window, and at least one variable."""

    box: tuple[float, float, float, float]  # south, north, west, east
    start: object
    end: object
    variables: frozenset[str]

    def __post_init__(self):
        if not self.variables:
            raise ValueError("a scan names at least one variable")
        if self.box[0] > self.box[1] or self.box[2] > self.box[3]:
            raise ValueError("a box's edges are out of order")

    def predicate(self) -> Column:
        start, end = F.lit(self.start).cast("timestamp_ntz"), F.lit(self.end).cast("timestamp_ntz")
        return F.col("variable").isin(sorted(self.variables)) & in_window(F.col("valid_time"), start, end) & in_box(F.col("lat"), F.col("lon"), *self.box)


def scan(observations: DataFrame, spec: ScanSpec) -> DataFrame:
    """Pushed to the Parquet scan as it is."""
    return observations.where(spec.predicate())


def scan_report(rows: DataFrame, spec: ScanSpec) -> DataFrame:
    """Requested variables without a row."""
    wanted = F.array(*map(F.lit, sorted(spec.variables)))
    return rows.agg(F.array_sort(F.array_except(wanted, F.collect_set("variable"))).alias("missing_variables"), F.count("*").alias("rows"))


def with_depth_key(observations: DataFrame) -> DataFrame:
    return observations.withColumn("depth_key", F.coalesce("depth_m", F.lit(-1.0)))


def as_of(observations: DataFrame, moment: Column, key: Sequence[str] = KEY, tie: str = "event_id", source: str | None = None) -> DataFrame:
    """The newest issue of each key that was known at a moment. One shuffle on the key, with a group limit before it."""
    rows = with_depth_key(observations).where(F.col("issued_time") <= moment)
    if source is not None:
        rows = rows.where(F.col("source") == source)
    newest = W.partitionBy(*key).orderBy(F.desc("issued_time"), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, keep: Sequence[str]) -> DataFrame:
    """For each left row the last right row at or before it: a union, one shuffle and a running last value. No pairs are made."""
    names = [f"_r_{c}" for c in keep]
    packed = F.struct(*[F.col(c) for c in keep])
    a = left.select(*on, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_right"))
    b = right.select(*on, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), packed.alias("_right"))
    running = W.partitionBy(*on).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(running)).where("_side = 1")
    return both.select("_row.*", *[F.col(f"_right.{c}").alias(n) for c, n in zip(keep, names)])


def latest_issue(observations: DataFrame, moment: Column) -> DataFrame:
    return observations.where(F.col("issued_time") <= moment).groupBy("variable", "source").agg(F.max("issued_time").alias("latest"), F.count("*").alias("n"))


def upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str], order: str, keep_first: Sequence[str] = ()) -> DataFrame:
    """Merge by key: the last incoming row wins, but keep_first columns stay as they were first written."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    last = W.partitionBy(*key).orderBy(F.desc("_new"), F.desc(order))
    first = W.partitionBy(*key).orderBy("_new", order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    for c in keep_first:
        both = both.withColumn(f"_{c}", F.first(c).over(first))
    rows = both.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return rows.select(*[F.col(f"_{c}").alias(c) if c in keep_first else F.col(c) for c in stored.columns])


def replace_by_key(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Drop all stored rows of the incoming keys, then append: how chunks of a document are replaced."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def quarantine_reason(units: Column | None = None, unit: Column | None = None) -> Column:
    """Why an observation is refused, or null. Missing means null; values are finite (NaN and infinities aren't)."""
    value, missing = F.col("value"), F.col("quality") == "missing"
    reason = F.when(missing & value.isNotNull(), "missing_with_value").when(~missing & value.isNull(), "value_without_missing")
    reason = reason.when(F.isnan(value) | (F.abs(value) == float("inf")), "not_finite")
    return reason if units is None else reason.when(units != unit, "wrong_unit")


def split_expectation(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and refused rows with their reason."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def with_staleness(observations: DataFrame, cadences: dict[str, float], now: Column) -> DataFrame:
    """Add stale by the source's cadence (hours with grace); unknown sources are never stale."""
    pairs = [x for k, v in sorted(cadences.items()) for x in (F.lit(k), F.lit(float(v) * 3600))]
    limit = F.try_element_at(F.create_map(*pairs), F.col("source"))
    return observations.withColumn("stale", F.coalesce(is_stale(F.col("issued_time"), now, limit), F.lit(False)))


def fallback(observations: DataFrame, ranks: dict[str, int], cadences: dict[str, float], now: Column) -> DataFrame:
    """Each variable from its first source in rank that has any fresh row; null values satisfy it too."""
    fresh = with_staleness(observations, cadences, now).where(~F.col("stale"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in sorted(ranks.items()) for x in (F.lit(k), F.lit(v))]), F.col("source")), F.lit(5))
    ranked = fresh.withColumn("source_rank", rank)
    best = ranked.groupBy("variable").agg(F.min(F.struct("source_rank", "source")).alias("best"))
    return ranked.join(best.select("variable", "best.source"), ["variable", "source"], "left_semi")


def attempts(observations: DataFrame, cadences: dict[str, float], now: Column) -> DataFrame:
    """One row a source: what a fetch of it came to."""
    rows = with_staleness(observations, cadences, now).groupBy("source").agg(F.count("*").alias("n_rows"), F.sum(F.col("stale").cast("long")).alias("n_stale"), F.max("issued_time").alias("newest"))
    outcome = F.when(F.col("n_rows") == 0, "empty").when(F.col("n_stale") == F.col("n_rows"), "stale").otherwise("success")
    return rows.withColumn("outcome", outcome)


def provenance_id(source: Column, variable: Column, valid: Column, lat: Column, lon: Column) -> Column:
    """Stable id of a key: four places of coordinates, no depth."""
    return F.concat_ws(":", source, variable, F.date_format(valid, "yyyy-MM-dd'T'HH:mm:ss"), F.format_string("%.4f", lat), F.format_string("%.4f", lon))
