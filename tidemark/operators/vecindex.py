"""A stored vector index that gives the exact nearest vectors by inner product and leaves most cells unread.

Vectors are dealt to the cells of a k-means model, which is fitted on at most SAMPLE rows; every row is indexed. Each cell
knows its radius, the largest distance of a member from the centre, so no member's product with a query q can be above
q . centre + |q| * radius (the triangle inequality). A search looks into the most promising cells first, until they hold
as many vectors as are asked for; the worst of those is a threshold, and only cells whose bound reaches it are read then.

Cells are stored in blocks of about BLOCK vectors, split over files, so a cell with a third of all rows is many rows. Small
cells lie together in a tile, a large one has a tile for each of its parts of PART blocks at most. Queries meet tiles in
chunks of up to CHUNK: a chunk is sent once to each tile that any of its queries looks into, and which of its queries look
into which of the tile's cells is told from the bounds again where they meet. A task holds one block, one chunk and STEP
products at a time, however many queries and vectors there are.
A matrix product finds which vectors can be among the best; their own products are added in the order of the dimensions, as
a scan would, so equal vectors have equal scores and ties are ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.store import dropped, stored

SAMPLE, CELLS, BLOCK, CHUNK, PART = 20_000, 1024, 2048, 1024, 64
TILE, TILES = 32_768, 64  # vectors of a tile at most, unless a part has more; tiles that smaller indexes are split into
STEP = 2**18
BATCH, PAIRS = "spark.sql.execution.arrow.maxRecordsPerBatch", 8
READ = "spark.sql.parquet.columnarReaderBatchSize"
SEED = 11
SLACK = 1e-9  # for rounding of bounds


def fit(rows: DataFrame, id_: str, vector: str, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Centres of at most `cells` cells, from the `sample` rows that come first by a hash of their id."""
    chosen = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(id_), id_).limit(sample).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=SEED, maxIter=15).fit(chosen)
    return np.array([c for c in model.clusterCenters()])


def cells_for(n: int) -> int:
    """About the square root of the number of vectors, CELLS at most."""
    return int(min(CELLS, max(2, round(n**0.5))))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)


def slices(n: int, width: int) -> Iterator[slice]:
    """n rows in slices of about STEP values, a row having `width`."""
    step = max(1, STEP // max(1, width))
    return (slice(i, i + step) for i in range(0, n, step))


def products(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Columns of a by columns of b, those at `row` by those at `col`, added dimension by dimension."""
    out = np.zeros(len(row))
    for j in range(len(a)):
        out += a[j][row] * b[j][col]
    return out


def top(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Where the best `most` of each `of` stand (ties: id), in order of `of`."""
    order = np.lexsort((ids, -scores, of))
    new = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])[: len(order)]
    place = np.arange(len(order)) - np.repeat(new, np.diff(np.r_[new, len(order)]))
    return order[place < most]


def nearest(q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, id and score of the best `most` vectors x of each row, of those that reach its `least`."""
    found = []
    longest = np.sqrt((x**2).sum(axis=1).max())
    turned = np.ascontiguousarray(x.T)
    for s in slices(len(q), len(x)):
        near = q[s] @ x.T
        # a rounded sum of d products is off by d * eps * |q| * |x| at most, whatever its order
        slack = 4 * (x.shape[1] + 1) * np.finfo(float).eps * np.sqrt((q[s] ** 2).sum(axis=1)) * longest
        floor = least[s]
        if len(x) > most:
            floor = np.maximum(floor, np.partition(near, len(x) - most, axis=1)[:, len(x) - most] - slack)
        row, col = np.nonzero(near >= (floor - slack)[:, None])
        score = products(np.ascontiguousarray(q[s].T), turned, row, col)
        row = row + s.start
        row, col, score = (v[score >= least[row]] for v in (row, col, score))
        best_ = top(row, ids[col], score, most)
        found.append((row[best_], ids[col[best_]], score[best_]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def write_index(rows: DataFrame, id_: str, vector: str, path: str, cells: int | None = None) -> None:
    """Index all rows with a vector below path: `blocks` by cell, and `cells` with centre, radius and size."""
    rows = rows.where(F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    centres = fit(rows, "id", "v", cells or cells_for(rows.count()))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squares = (centres**2).sum(axis=1)
        for frame in frames:
            x = matrix(frame["v"])
            cell = np.concatenate([np.argmin(squares[None, :] - 2 * (x[s] @ centres.T), axis=1) for s in slices(len(x), len(centres))] or [np.zeros(0, int)])
            far = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
            yield frame.assign(cell=cell.astype("int32"), far=far)

    dealt = stored(rows.mapInPandas(deal, "id long, v array<double>, cell int, far double"), "vectors")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # CELLS rows at most
    at = F.pmod(F.monotonically_increasing_id(), F.col("blocks")).cast("int")  # the files' order is fixed
    numbered = dealt.join(F.broadcast(sizes), "cell").withColumn("block", at)
    blocks = numbered.groupBy("cell", "block").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("m"), F.max("far").alias("radius"), F.count("*").alias("size"))
    blocks = blocks.select("cell", "block", F.col("m.id").alias("ids"), F.flatten("m.v").alias("v"), "radius", "size")
    blocks.withColumn("part", F.floor(F.col("block") / PART).cast("int")).repartition("cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
    dropped(dealt)
    spark = rows.sparkSession
    held = spark.read.parquet(f"{path}/blocks").groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("size").alias("size"), (F.max("part") + 1).alias("parts"))
    # one row a cell, CELLS at most
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    known.join(held, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def tiles_of(size: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The tile of each cell; one of many parts has as many tiles from there on, and no other cell is in them."""
    most = min(TILE, max(BLOCK, int(size.sum()) // TILES))
    first, tile, held = [], 0, 0
    for n, k in zip(size.tolist(), parts.tolist(), strict=True):
        if held and (k > 1 or held + n > most):
            tile, held = tile + 1, 0
        first.append(tile)
        tile, held = (tile + k, 0) if k > 1 else (tile, held + n)
    return np.array(first)


class Cells:
    """What a search knows of the cells: CELLS rows at most, whatever is indexed."""

    def __init__(self, rows: list) -> None:
        self.number = np.array([c.cell for c in rows])
        self.centres, self.radius, self.size, self.parts = (np.array([c[name] for c in rows]) for name in ("centre", "radius", "size", "parts"))
        self.tile, self.chunk = tiles_of(self.size, self.parts), CHUNK

    def bounds(self, q: np.ndarray, at: int | slice = slice(None)) -> np.ndarray:
        length = np.sqrt((q**2).sum(axis=1))[:, None]
        b = q @ np.atleast_2d(self.centres[at]).T + length * np.atleast_1d(self.radius[at])[None, :]
        return b + SLACK * (1 + np.abs(b))

    def first(self, q: np.ndarray, most: int) -> np.ndarray:
        """The bound from which on each query looks first: the best cells hold `most` vectors."""
        b = self.bounds(q)
        order = np.argsort(-b, axis=1, kind="stable")
        last = (np.cumsum(self.size[order], axis=1) < most).sum(axis=1).clip(max=len(self.size) - 1)
        least = b[np.arange(len(q)), order[np.arange(len(q)), last]]
        return least - SLACK * (1 + np.abs(least))

    def chunks(self, query: np.ndarray, q: np.ndarray, least: np.ndarray) -> Iterator[pd.DataFrame]:
        """For each tile its queries, those with a bound of at least `least` in one of its cells, CHUNK in a row at most."""
        looks = np.concatenate([self.bounds(q[s]) >= least[s, None] for s in slices(len(q), len(self.size))])
        for tile in np.unique(self.tile).tolist():
            cells = np.flatnonzero(self.tile == tile)
            at = np.flatnonzero(looks[:, cells].any(axis=1))
            for i in range(0, len(at), self.chunk):
                some = at[i : i + self.chunk]
                for t in range(tile, tile + int(self.parts[cells].max())):
                    yield pd.DataFrame({"tile": [t], "queries": [query[some]], "q": [q[some].ravel()], "least": [least[some]]})


def search(spark: SparkSession, path: str, queries: DataFrame, id_: str, vector: str, most: int = 50) -> DataFrame:
    """query, id, rank, score: the exact top `most` of each query (ties: id), for all queries in one plan."""
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("q"))
    asked = asked.repartition("query")  # a file has few of them; chunks are to be full
    rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)  # CELLS rows at most
    if not rows:
        return spark.createDataFrame([], "query long, id long, score double, rank long")
    cells = Cells(rows)

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                q = matrix(frame["q"])
                yield from cells.chunks(frame["query"].to_numpy(), q, np.concatenate([cells.first(q[s], most) for s in slices(len(q), len(cells.size))]))

    def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield from cells.chunks(frame["query"].to_numpy(), matrix(frame["q"]), frame["least"].to_numpy())

    probe = "tile int, queries array<long>, q array<double>, least array<double>"
    near = met(spark, path, cells, asked.mapInPandas(begin, probe), most, False)
    least = best(near, most).groupBy("query").agg(F.min("score").alias("s"), F.count("*").alias("n"))
    least = least.select("query", F.when(F.col("n") >= most, F.col("s")).otherwise(float("-inf")).alias("least"))
    # what is among the best reaches `least`, and so does its cell's bound: the cells of the first look are met again with the others
    far = met(spark, path, cells, asked.join(least, "query").select("query", "q", "least").mapInPandas(rest, probe), most, True)
    dropped(near)
    return best(far, most)


def met(spark: SparkSession, path: str, cells: Cells, chunks: DataFrame, most: int, scored: bool) -> DataFrame:
    """query, id, score: the best of each tile for each query that looks into it; `least` is of bounds, or of scores too."""
    chunks = stored(chunks, "chunks")  # made in batches of the session's size
    places = [(int(c), part, int(t) + part) for c, t, k in zip(cells.number, cells.tile, cells.parts, strict=True) for part in range(int(k))]
    tiles = spark.createDataFrame(places, "cell int, part int, tile int")  # a row a cell, or part of a large one
    blocks = spark.read.schema("block int, ids array<long>, v array<double>, part int, cell int").parquet(f"{path}/blocks")
    blocks = blocks.join(F.broadcast(tiles), ["cell", "part"]).select("tile", "cell", "ids", "v")
    pairs = chunks.join(blocks, "tile").select("tile", "queries", "q", "least", "cell", "ids", "v")

    def told(query: np.ndarray, held: tuple) -> pd.DataFrame:
        return pd.DataFrame({"query": query[held[0]], "id": held[1], "score": held[2]})

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, held = None, None  # a tile's blocks come one after the other for a chunk, if the join leaves it so
        for frame in frames:
            for tile, query, q, bound, cell, ids, v in frame.itertuples(index=False):
                if chunk is None or tile != chunk[0] or not np.array_equal(query, chunk[1]):
                    if held:
                        yield told(chunk[1], held)
                    chunk, held, least = (tile, query), None, bound.copy() if scored else np.full(len(query), -np.inf)
                q, x = q.reshape(len(query), -1), v.reshape(len(ids), -1)
                at = np.flatnonzero(cells.bounds(q, int(np.searchsorted(cells.number, cell)))[:, 0] >= bound)
                if not len(at):
                    continue
                row, id_, score = nearest(q[at], least[at], ids, x, most)
                new = at[row], id_, score
                both = tuple(np.concatenate(p) for p in zip(held, new, strict=True)) if held else new
                held = tuple(p[top(*both, most)] for p in both)
                full = np.flatnonzero(np.bincount(held[0], minlength=len(query)) == most)
                worst = np.full(len(query), np.inf)
                np.minimum.at(worst, held[0], held[2])
                least[full] = np.maximum(least[full], worst[full])
        if held:
            yield told(chunk[1], held)

    # a pair holds a block and a chunk, so few of them may stand in a task's memory at once; the session's settings are left as they were
    before = {key: spark.conf.get(key) for key in (BATCH, READ)}
    for key in before:
        spark.conf.set(key, str(PAIRS))
    try:
        return stored(pairs.mapInPandas(meet, "query long, id long, score double"), "met")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
        dropped(chunks)


def best(rows: DataFrame, most: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)


def read_share(spark: SparkSession, path: str, queries: DataFrame, id_: str, vector: str, most: int = 50) -> float:
    """The share of all (query, vector) products that search() forms, by cells' sizes and bounds against the true threshold."""
    found = search(spark, path, queries, id_, vector, most)
    least = found.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n")).collect()
    cells = spark.read.parquet(f"{path}/cells").collect()
    vectors = {r[0]: np.array(r[1], dtype=float) for r in queries.where(F.col(vector).isNotNull()).select(F.col(id_), vector).collect()}
    total = sum(c["size"] for c in cells)
    read = sum(c["size"] for r in least for c in cells if float(vectors[r.query] @ np.array(c.centre)) + float(np.linalg.norm(vectors[r.query])) * c.radius >= (r.least if r.n >= most else -np.inf))
    return read / (total * max(1, len(least)))
