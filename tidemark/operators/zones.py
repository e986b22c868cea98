"""Trade-off frontiers and runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


SQUARE = 512  # rows compared with rows at once
MERGE = 8


def undominated(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the rows of x (larger is better) that no row of another id dominates, ascending.

    Rows are taken in order of their sums, so a dominating row stands before what it dominates. A block is held against
    what is kept so far, a square at a time, then against itself.
    """
    order = np.argsort(-x.sum(axis=1), kind="stable")
    kept = np.zeros(0, dtype=np.int64)

    def beaten(some: np.ndarray, by: np.ndarray) -> np.ndarray:
        a, b = x[some][:, None, :], x[by][None, :, :]
        return ((b >= a).all(axis=2) & (b > a).any(axis=2) & (ids[by][None, :] != ids[some][:, None])).any(axis=1)

    for at in range(0, len(order), SQUARE):
        block = order[at : at + SQUARE]
        for k in range(0, len(kept), SQUARE):
            if not len(block):
                break
            block = block[~beaten(block, kept[k : k + SQUARE])]
        if len(block):
            kept = np.append(kept, block[~beaten(block, block)])
    return np.sort(kept)


def frontier(rows: DataFrame, id_: str, larger: Sequence[str], smaller: Sequence[str]) -> DataFrame:
    """Rows that no row of another id dominates (at least as good in all, better in one).

    Each partition drops what its own rows dominate; the frontiers then meet in rounds, MERGE partitions at a time, as in a
    tournament, so what reaches the last round is about the frontier itself. Only that must fit into a task.
    """

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in frames:
            both = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            x = np.column_stack([both[c].to_numpy(float) for c in larger] + [-both[c].to_numpy(float) for c in smaller])
            kept = both.iloc[undominated(x, both[id_].to_numpy())].reset_index(drop=True)
        if kept is not None:
            yield kept

    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    front = rows.mapInPandas(local, rows.schema)
    while wide > 1:
        wide = -(-wide // MERGE)
        front = front.repartition(wide).mapInPandas(local, rows.schema)
    return front


def spread(front: DataFrame, id_: str, catch: str, safety: str, cost: str, most: int = 3) -> DataFrame:
    """Best catch, safest and cheapest of a frontier, filled up in order of catch; at most `most` rows."""
    first = [F.desc(catch), F.asc(id_)]
    pick = lambda order, n, turn: front.orderBy(*order).limit(n).select("*", F.lit(turn).alias("_turn"))
    some = pick(first, 1, 0).unionAll(pick([F.desc(safety), *first], 1, 1)).unionAll(pick([F.asc(cost), *first], 1, 2)).unionAll(pick(first, most, 3))
    rows = some.groupBy(*front.columns).agg(F.min("_turn").alias("_turn"))  # at most `most` + 3
    return rows.orderBy("_turn", *first).limit(most).drop("_turn").orderBy(*first)


def longest_runs(series: DataFrame, by: list[str], order: str, holds: Column, least: int = 5, high: int = 10) -> DataFrame:
    """Longest run of consecutive rows for which holds is true, and its flag."""
    rows = series.select(*by, order, F.coalesce(holds, F.lit(False)).alias("_h"))
    w = W.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("_i", F.row_number().over(w) - F.sum(F.col("_h").cast("int")).over(w))
    runs = rows.where("_h").groupBy(*by, "_i").agg(F.count("*").alias("n"))
    best = runs.groupBy(*by).agg(F.max("n").alias("longest"))
    every = rows.select(*by).distinct().join(best, by, "left").withColumn("longest", F.coalesce("longest", F.lit(0).cast("long")))
    return every.withColumn("flag", F.when(F.col("longest") >= high, "high").when(F.col("longest") >= least, "medium"))
