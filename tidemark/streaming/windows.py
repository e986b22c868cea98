"""Event-time windows, cadence caches and run-to-completion helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, time: str, length: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts and decimal sums of value by event-time window; works on streams with a watermark and on batches."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    rows = events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), (F.sum(F.col("value").cast("decimal(18,2)")) * 100).cast("long").alias("total_cents"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total_cents")


def sessions(events: DataFrame, time: str, gap: str, by: str) -> DataFrame:
    rows = events.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), by, "n")


def cadence_cache(reads: DataFrame, key: str, time: str, issued: str, limit_seconds: Column) -> DataFrame:
    """Batch form of the cadence cache: what each read finds, hit while the last write before it is within its cadence, else stale or miss."""
    last = F.last(F.when(F.col("is_write"), F.struct(F.col(issued).alias("issued"), limit_seconds.alias("limit"))), ignorenulls=True)
    w = W.partitionBy(key).orderBy(time, F.desc("is_write")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = reads.withColumn("_last", last.over(w)).where("NOT is_write")
    age = F.col(time).cast("timestamp").cast("double") - F.col("_last.issued").cast("timestamp").cast("double")
    return rows.withColumn("found", F.when(F.col("_last").isNull(), "miss").when(age > F.col("_last.limit"), "stale").otherwise("hit")).drop("_last")


def cadence_stream(rows: DataFrame, key: str) -> DataFrame:
    """Streaming form: rows of key, at (timestamp), is_write, limit_seconds; state is the last write, dropped when stale."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        out = []
        for r in pd.concat(list(frames)).sort_values(["at", "is_write"], ascending=[True, False], kind="stable").itertuples():
            at = pd.Timestamp(r.at).value // 1000
            if r.is_write:
                held = (at, float(r.limit_seconds))
            else:
                stale = held is not None and (at - held[0]) / 1e6 > held[1]
                out.append((k[0], r.at, "miss" if held is None else "stale" if stale else "hit"))
                held = None if stale else held
        if held is not None:
            state.update(held)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "at", "found"])

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at timestamp, found string", "at long, seconds double", "append", GroupStateTimeout.NoTimeout)


def run_all(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a memory table (tests and small reports)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
