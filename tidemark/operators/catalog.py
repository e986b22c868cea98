"""Choice of datasets with a stated reason for every rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeq import boxes_touch, covers_time


def judged(datasets: DataFrame, variable: str, box: tuple[float, float, float, float], at: Column, max_cost: float | None = None, allow_auth: bool = True, credentials: frozenset[str] = frozenset()) -> DataFrame:
    """Add reason: the first hard predicate that fails, null if none."""
    touch = boxes_touch(F.col("south"), F.col("north"), F.col("west"), F.col("east"), box)
    live = covers_time(F.col("starts").cast("date"), F.col("ends").cast("date"), at)
    over = F.lit(False) if max_cost is None else F.col("cost") > max_cost
    known = F.col("source_id").isin(sorted(credentials)) if credentials else F.lit(False)
    reason = (
        F.when(~F.array_contains("variables", variable), "variable_not_served")
        .when(~touch, "outside_coverage")
        .when(~live, "outside_temporal_coverage")
        .when(over, "over_budget")
        .when(F.col("requires_auth") & ~(F.lit(allow_auth) & known), "requires_auth")
    )
    return datasets.withColumn("reason", reason)


def select(datasets: DataFrame, *args, **kwargs) -> DataFrame:
    """Survivors, best first."""
    return judged(datasets, *args, **kwargs).where("reason IS NULL").orderBy("authority_rank", F.desc("reliability_prior"), "cost", "dataset_id")


def duplicates(datasets: DataFrame) -> DataFrame:
    """Ids registered more than once; a registry has none."""
    return datasets.groupBy("dataset_id").agg(F.count("*").alias("n")).where("n > 1")
