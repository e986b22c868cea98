"""Least-cost routes, levels and closures by iteration."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.kernels import step_cost
from tidemark.sources.store import dropped, new_path, remove, shared_dir, stored

STEPS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
DIAGONAL = math.sqrt(2.0)
TILE, MOST_TILE, TILES_A_SIDE = 64, 512, 12  # cells a side of what one heap search settles: at least, at most; tiles aimed at
TILES = 1 << 20  # tiles along a row are fewer


def navigable(cells: DataFrame, min_depth: float) -> DataFrame:
    return cells.where(~F.col("blocked") & (F.col("depth_m").isNull() | (F.col("depth_m") >= min_depth)))


def entry_cost(columns: list[str], north: Column, east: Column) -> Column:
    """Cost of entering a cell by a step; a following current lowers it, with a floor."""
    length = F.when((north != 0) & (east != 0), DIAGONAL).otherwise(1.0)
    flows = {"current_east_ms", "current_north_ms"} <= set(columns)
    current = (F.col("current_east_ms") * east + F.col("current_north_ms") * north) / length if flows else F.lit(0.0)
    return step_cost(F.col("wave_height_m"), F.col("wind_speed_ms"), current) * length


def neighbours(cells: DataFrame) -> DataFrame:
    """Directed edges with costs."""
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in STEPS])
    steps = cells.select(F.col("row").alias("r0"), F.col("col").alias("c0"), F.explode(table).alias("s"))
    steps = steps.select("r0", "c0", (F.col("r0") + F.col("s.a")).alias("row"), (F.col("c0") + F.col("s.b")).alias("col"), F.col("s.a").alias("north"), F.col("s.b").alias("east"))
    return steps.join(cells, ["row", "col"]).select("r0", "c0", "row", "col", entry_cost(cells.columns, F.col("north"), F.col("east")).alias("cost"))


def grid_of(events: DataFrame) -> DataFrame:
    """All events as the cells of a square grid whose side follows their count; events that share a cell are one.

    A cell has the mean wave height and wind, is blocked if any of its events is, and as deep as its shallowest known.
    The side has no factor in common with the periods of blocked (13) and shallow (20) ids, else whole rows are walls.
    """
    side = math.isqrt(max(events.count() - 1, 0)) + 1
    while math.gcd(side, 13 * 20) > 1:
        side += 1
    i = F.col("event_id")
    rows = events.select(
        F.pmod(i, F.lit(side)).cast("int").alias("row"), F.pmod(F.floor(i / side), F.lit(side)).cast("int").alias("col"), (F.pmod(i * 5, F.lit(32)) * 0.125).alias("wave"), F.pmod(i, F.lit(9)).cast("double").alias("wind"),
        (F.pmod(i, F.lit(13)) == 0).alias("shut"), F.when(F.pmod(i, F.lit(5)) != 0, F.pmod(i, F.lit(20)).cast("double")).alias("depth"),
    )
    return rows.groupBy("row", "col").agg(F.avg("wave").alias("wave_height_m"), F.avg("wind").alias("wind_speed_ms"), F.max("shut").alias("blocked"), F.min("depth").alias("depth_m"))


def tile_of(row: Any, col: Any, side: int) -> Any:
    """The number of a cell's tile; of columns and of arrays."""
    down, along = (F.floor(row / side).cast("long"), F.floor(col / side).cast("long")) if isinstance(row, Column) else (row // side, col // side)
    return down * TILES + along + TILES // 2


def settle(cells: pd.DataFrame, known: pd.DataFrame, side: int) -> pd.DataFrame:
    """Heap search inside one tile from its fresh offers, over a dense array of the tile and one cell around it.

    cells: the tile's and those around it, w0 to w7 their costs by the step that enters them; known: cost or offer of own
    cells. Gives all costs of the tile, apart those along its border, and offers to cells of other tiles.
    """
    wide = side + 2
    tile = int(known["tile"].iloc[0])
    top, left = tile // TILES * side - 1, (tile % TILES - TILES // 2) * side - 1
    place = lambda frame: ((frame["row"] - top) * wide + frame["col"] - left).to_numpy("int64")
    at, entries = place(cells), []
    for i in range(len(STEPS)):
        w = np.full(wide * wide, np.inf)
        w[at] = cells[f"w{i}"].to_numpy("float64")
        entries.append(w.tolist())
    moves = list(zip([a * wide + b for a, b in STEPS], entries))
    known = known.assign(at=place(known))
    had, came = known[known["offer"].isna()], known[known["offer"].notna()]
    costs = np.full(wide * wide, np.inf)
    costs[had["at"].to_numpy()] = had["cost"].to_numpy("float64")
    best, heap = costs.tolist(), []
    for k, offer in zip(came["at"].tolist(), came["offer"].tolist()):
        if offer < best[k]:
            best[k] = offer
            heap.append((offer, k))
    heapq.heapify(heap)
    own = np.zeros((wide, wide), bool)
    own[1:-1, 1:-1] = True
    inside = own.ravel().tolist()
    while heap:
        cost, k = heapq.heappop(heap)
        if cost > best[k]:
            continue
        for move, w in moves:
            to = k + move
            new = cost + w[to]
            if new < best[to]:
                best[to] = new
                if inside[to]:
                    heapq.heappush(heap, (new, to))
    costs = np.array(best)
    own[2:-2, 2:-2] = False  # the border is left
    where = np.flatnonzero(costs < np.inf)
    row, col = where // wide + top, where % wide + left
    kind = np.where(~np.array(inside)[where], "offer", np.where(own.ravel()[where], "edge", "inner"))
    return pd.DataFrame({"kind": kind, "tile": tile_of(row, col, side), "row": row, "col": col, "value": costs[where]})


def relax(spark: SparkSession, cells: DataFrame, start: tuple[int, int], rounds: int | None = None) -> DataFrame:
    """row, col, cost of every cell that start reaches, until nothing improves; a bound on rounds that is hit is an error.

    The grid is dealt in square tiles, each stored with the cells around it in a folder of its own. A round reads and
    settles only the tiles that got a better offer from outside, each by a heap search, and passes offers over their
    borders. Tiles grow with the grid (up to MOST_TILE cells a side), so rounds follow the tiles on a path, not its cells.
    """
    types, columns = dict(cells.dtypes), cells.columns
    at = f"row {types['row']}, col {types['col']}"
    cells = stored(cells, "cells")
    top, low, left, right = cells.agg(*[f(c) for c in ("row", "col") for f in (F.min, F.max)]).first()
    begun = cells.where((F.col("row") == start[0]) & (F.col("col") == start[1]))
    if begun.isEmpty():
        return begun.select("row", "col", F.lit(0.0).alias("cost"))
    side = min(MOST_TILE, max(TILE, max(low - top, right - left) // TILES_A_SIDE))
    around = F.array_distinct(F.array(*[tile_of(F.col("row") + a, F.col("col") + b, side) for a, b in [(0, 0), *STEPS]]))
    entries = [entry_cost(columns, F.lit(a), F.lit(b)).alias(f"w{i}") for i, (a, b) in enumerate(STEPS)]
    dealt, work = new_path(spark, "tiles"), new_path(spark, "costs")
    cells.select(F.explode(around).alias("tile"), "row", "col", *entries).repartition("tile").write.partitionBy("tile").parquet(dealt)
    tiles = spark.read.schema(f"{at}, {', '.join(f'w{i} double' for i in range(len(STEPS)))}, tile long").parquet(dealt)
    made, held = [], {}  # each round's table; the round that has a tile's costs

    def costs(of: Iterable[int], *kinds: str) -> list[DataFrame]:
        by: dict[int, list[int]] = {}
        for t in of:
            if t in held:
                by.setdefault(held[t], []).append(t)
        return [made[k].where(F.col("tile").isin(ts) & F.col("kind").isin(*kinds)).select("tile", "row", "col", F.col("value").alias("cost")) for k, ts in sorted(by.items())]

    none = lambda name: F.lit(None).cast("double").alias(name)
    fresh = stored(begun.select(tile_of(F.col("row"), F.col("col"), side).alias("tile"), "row", "col", F.lit(0.0).alias("offer")), "offers")
    while active := [t for (t,) in fresh.select("tile").distinct().collect()]:
        if len(made) == rounds:
            raise RuntimeError(f"costs still change after {rounds} rounds")
        known = fresh.select("tile", "row", "col", none("cost"), "offer")
        for had in costs(active, "edge", "inner"):
            known = known.union(had.select("tile", "row", "col", "cost", none("offer")))
        step = tiles.where(F.col("tile").isin(active)).groupBy("tile").cogroup(known.groupBy("tile")).applyInPandas(lambda x, y: settle(x, y, side), f"kind string, tile long, {at}, value double")
        step.write.partitionBy("tile", "kind").parquet(f"{work}/{len(made)}")
        made.append(spark.read.schema(f"{at}, value double, tile long, kind string").parquet(f"{work}/{len(made)}"))
        for t in active:
            if t in held:
                remove(spark, f"{work}/{held[t]}/tile={t}")
            held[t] = len(made) - 1
        dropped(fresh)
        offers = made[-1].where("kind = 'offer'").groupBy("tile", "row", "col").agg(F.min("value").alias("offer"))
        met = [t for (t,) in offers.select("tile").distinct().collect()]
        for had in costs(met, "edge"):
            offers = offers.join(had, ["tile", "row", "col"], "left").where("cost IS NULL OR offer < cost").drop("cost")
        fresh = stored(offers, "offers")
    remove(spark, dealt)
    dropped(cells, fresh)
    return reduce(DataFrame.union, costs(held, "edge", "inner")).select("row", "col", "cost")


def checkpointed(df: DataFrame, _name: str) -> DataFrame:
    """Cut the lineage in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def trace(cells: DataFrame, best: DataFrame, goal: tuple[int, int], cell_nm: float = 1.0, table: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """leg, row, col, cost, distance_nm of the cells from the start of relax() to goal; no rows if goal isn't reached.

    A cell's predecessor is the neighbour that its least cost comes from (costs grow on the way, so there are no cycles).
    The path doubles with each round. As in the reference, a leg counts one cell size, diagonal or not.
    """
    keep = table or checkpointed
    base = best.select(F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("cost").alias("base"))
    offers = base.join(neighbours(cells), ["r0", "c0"]).groupBy("row", "col").agg(F.min(F.struct((F.col("base") + F.col("cost")).alias("cost"), "r0", "c0")).alias("m"))
    jump = keep(offers.join(best.where("cost > 0").select("row", "col"), ["row", "col"]).select("row", "col", "m.r0", "m.c0"), "jump")
    path, reach = keep(best.where((F.col("row") == goal[0]) & (F.col("col") == goal[1])).select("row", "col", F.lit(0).alias("back")), "path"), 1
    while not (more := path.join(jump, ["row", "col"]).select(F.col("r0").alias("row"), F.col("c0").alias("col"), F.col("back") + reach)).isEmpty():
        path = keep(path.union(more), "path")
        on = jump.select(F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("r0").alias("r1"), F.col("c0").alias("c1"))
        jump, reach = keep(jump.join(on, ["r0", "c0"]).select("row", "col", F.col("r1").alias("r0"), F.col("c1").alias("c0")), "jump"), 2 * reach
    last = path.agg(F.max("back")).first()[0] or 0
    leg = F.lit(last) - F.col("back")
    return path.join(best, ["row", "col"]).select(leg.alias("leg"), "row", "col", "cost", (leg * cell_nm).alias("distance_nm"))


def straight(spark: SparkSession, cells: DataFrame, start: tuple[int, int], goal: tuple[int, int]) -> DataFrame:
    """cost of the rasterised straight line between two cells (rounded half to even); null if it leaves the navigable cells."""
    n = max(abs(goal[0] - start[0]), abs(goal[1] - start[1]))
    if n == 0:
        return cells.where((F.col("row") == start[0]) & (F.col("col") == start[1])).agg(F.when(F.count("*") > 0, 0.0).alias("cost"))
    at = lambda k, i: (F.lit(start[k]) + F.rint(F.lit(goal[k] - start[k]) * i / n)).cast("int")
    i = F.col("id")
    line = spark.range(1, n + 1).select(at(0, i - 1).alias("r0"), at(1, i - 1).alias("c0"), at(0, i).alias("row"), at(1, i).alias("col"))
    return line.join(neighbours(cells), ["r0", "c0", "row", "col"], "left").agg(F.when(F.count("cost") == n, F.sum("cost")).alias("cost"))


def routes(grids: DataFrame, by: str) -> DataFrame:
    """Cost from (start_row, start_col) to (goal_row, goal_col) in each of many small grids: one heap search a group."""

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        still = [0.0] * len(frame)
        flows = (frame["current_east_ms"], frame["current_north_ms"]) if {"current_east_ms", "current_north_ms"} <= set(frame.columns) else (still, still)
        cells = {(r, c): x for r, c, *x in zip(frame["row"], frame["col"], frame["wave_height_m"], frame["wind_speed_ms"], *flows)}
        first = frame.iloc[0]
        start, goal = (first["start_row"], first["start_col"]), (first["goal_row"], first["goal_col"])
        best, heap = {start: 0.0}, [(0.0, start)] if start in cells and goal in cells else []
        while heap:
            cost, at = heapq.heappop(heap)
            if at == goal:
                return pd.DataFrame({by: [first[by]], "cost": [cost]})
            if cost > best[at]:
                continue
            for a, b in STEPS:
                to = (at[0] + a, at[1] + b)
                if to in cells:
                    wave, wind, east, north = cells[to]
                    length = DIAGONAL if a and b else 1.0
                    new = cost + max(0.1, 1.0 + 2.0 * wave + 0.6 * (wind / 10.0) - (east * b + north * a) / length) * length
                    if new < best.get(to, math.inf):
                        best[to] = new
                        heapq.heappush(heap, (new, to))
        return pd.DataFrame({by: [first[by]], "cost": [None]})

    return grids.groupBy(by).applyInPandas(search, f"{by} {dict(grids.dtypes)[by]}, cost double")


def levels(spark: SparkSession, edges: DataFrame, table: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """node, level: length of the longest path that ends in it (0 for roots). A cycle is an error.

    A round places the nodes whose sources are all placed, so its number is their level and each node is one row.
    """
    keep = table or checkpointed
    edges = keep(edges.where("source_id IS NOT NULL AND target_id IS NOT NULL").select("source_id", "target_id").distinct(), "edges")
    level = lambda k: F.lit(k).cast("long").alias("level")
    placed = keep(edges.select(F.col("source_id").alias("node")).distinct().join(edges.select(F.col("target_id").alias("node")), "node", "left_anti").select("node", level(0)), "placed")
    done = 0
    while True:
        rest = edges.join(placed.select(F.col("node").alias("source_id")), "source_id", "left_anti")
        last = placed.where(F.col("level") == done).select(F.col("node").alias("source_id"))
        free = edges.join(last, "source_id", "left_semi").select("target_id").distinct().join(rest, "target_id", "left_anti")
        grown = keep(placed.union(free.select("target_id", level(done + 1))), "placed")
        if grown.where(F.col("level") == done + 1).isEmpty():
            break
        placed, done = grown, done + 1
    if not rest.isEmpty():
        raise ValueError("the edges hold a cycle")
    return placed


def closure(spark: SparkSession, edges: DataFrame, table: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """target, ancestor: everything that each node derives from, at any depth; only pairs that are new go on, so cycles end."""
    keep = table or checkpointed
    edges = keep(edges.select("target_id", "source_id").distinct(), "edges")
    known = keep(edges.select(F.col("target_id").alias("target"), F.col("source_id").alias("ancestor"), F.lit(0).alias("turn")), "pairs")
    done = 0
    while True:
        last = known.where(F.col("turn") == done).join(edges, F.col("ancestor") == F.col("target_id")).select("target", F.col("source_id").alias("ancestor")).distinct()
        grown = keep(known.union(last.join(known, ["target", "ancestor"], "left_anti").select("target", "ancestor", F.lit(done + 1))), "pairs")
        if grown.where(F.col("turn") == done + 1).isEmpty():
            return known.select("target", "ancestor")
        known, done = grown, done + 1
