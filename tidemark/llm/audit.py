"""Operator 12, audit of how filters interact under every order.

Each document becomes a 5-bit mask of the filters that it fails. A table made once holds, for each of the 32 masks and
each of the 120 orders, the step that removes such a document. Tasks count masks by part and label, index the table
with the masks they hold, add up removals by order, step and label with np.bincount, and emit partial arrays, which Spark
sums. Since every figure is a sum over documents, so is each column, the Shapley total included.

Copies are judged table-wide: the least doc_id of each text's SHA-256 is a partial aggregate, so a text that a third of
all rows share costs a task one row. It meets the documents by (doc_id, text), not by text, and labels meet them by
doc_id, so neither join has a hot key; rows without doc_id stay out of both.

Cases: null text counts as empty; null parts are the part ''; rows without doc_id fail no copy filter, make nothing else
fail it, and have no labels; repeated rows of one doc_id are no copies of each other (no doc_id is smaller) but count
each; a doc_id with several label rows has quality or toxic if any row says so; null labels count as 0; very long texts
are read in blocks (memory grows with their distinct words); ties can't be; an empty table gives an empty result; only
the named columns are read, so others may be named anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import slices, texts, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
KEPT = len(FILTERS)  # the step of documents that no filter removes
MASKS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT, MOST_CAPITALS = 200, 50, 3  # words; percent of words; percent of characters
JUNK = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
PARTS_HELD = 256  # parts that a task holds arrays of; then it emits them
BLOCK = 1 << 20
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def first_failures(filters: str = FILTERS) -> np.ndarray:
    """For each mask and order the step, from 0, of the first filter that fails; KEPT if none does."""
    masks = np.arange(1 << len(filters))
    table = np.full((len(masks), len(ORDERS)), len(filters), dtype=np.int8)
    for o, order in enumerate(permutations(range(len(filters)))):
        for step in reversed(range(len(filters))):  # the earliest is written last
            table[masks >> order[step] & 1 == 1, o] = step
    return table


def vocabulary(raw: bytes) -> tuple[int, int]:
    """Words and distinct words, parted at bytes 9 to 13 and 32."""
    if len(raw) <= BLOCK:
        words = raw.split()
        return len(words), len(set(words))
    n, seen, rest = 0, set(), b""
    for at in range(0, len(raw), BLOCK):
        block = rest + raw[at : at + BLOCK]
        words = block.split()
        rest = words.pop() if words and not block[-1:].isspace() else b""
        n += len(words)
        seen.update(words)
    if rest:
        n += 1
        seen.add(rest)
    return n, len(seen)


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode()
    n, distinct = vocabulary(raw)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    junk = len(raw) - len(raw.translate(None, JUNK))
    return (n < MIN_WORDS) | (100 * distinct < MIN_DISTINCT * n) << 1 | (100 * capitals > MOST_CAPITALS * len(text)) << 2 | (junk > 0) << 3


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of A to D, digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (x for batch in batches for x in slices(batch)):
            found = [(failures(t), hashlib.sha256(t.encode()).digest()) for t in (x.as_py() for x in rows.column(1))]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([f for f, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], names=["doc_id", "part", "mask", "digest"])

    docs = texts(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of all five filters, good and toxic of each document."""
    rows = written(masks(docs), "masks")  # some 60 bytes a document; texts are read once
    known = rows.where("doc_id IS NOT NULL")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("digest", "first_digest")
    copy = F.col("first_id").isNull().cast("int") * (1 << FILTERS.index("E"))
    known = known.join(firsts, (F.col("doc_id") == F.col("first_id")) & (F.col("digest") == F.col("first_digest")), "left")
    says = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.join(says, F.col("doc_id") == F.col("label_id"), "left")
    flag = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    known = known.select("part", (F.col("mask") + copy).alias("mask"), flag("good"), flag("toxic"))
    return known.union(rows.where("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def partial(parts: list[str], held: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
    """All figures of the documents counted in held[part, mask, label]: a row for each part, order and step."""
    n, orders, steps = len(parts), len(ORDERS), len(FILTERS)
    order_of = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    part, mask, label = np.nonzero(held)
    count = held[part, mask, label]
    at = ((part[:, None] * orders + np.arange(orders)) * (steps + 1) + table[mask]) * 4 + label[:, None]
    size = n * orders * (steps + 1) * 4
    # weights are added as doubles: exact below 2^53 documents a task
    lost = np.bincount(at.ravel(), np.repeat(count, orders), size).astype(np.int64).reshape(n, orders, steps + 1, 4)[:, :, :steps]
    removed = lost.sum(axis=3)
    by_mask = held.sum(axis=2)
    bits = np.arange(MASKS)[:, None] >> np.arange(steps) & 1
    fails = (by_mask @ bits)[:, order_of]
    only = by_mask[:, 1 << np.arange(steps)][:, order_of]
    shapley = np.zeros((n, steps), np.int64)
    for f in range(steps):
        shapley[:, f] = removed[:, order_of == f].sum(axis=1)
    kept = by_mask.sum(axis=1)[:, None, None] - np.cumsum(removed, axis=2)
    figures = (kept, removed, fails - removed, only, lost[..., 1] + lost[..., 3], lost[..., 2] + lost[..., 3], shapley[:, order_of])
    names = pa.array(np.repeat(np.array(parts, dtype=object), orders * steps), pa.string())
    order = pa.array(np.tile(np.repeat(np.array(ORDERS, dtype=object), steps), n), pa.string())
    step = pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), n * orders))
    return pa.RecordBatch.from_arrays([names, order, step, *(pa.array(f.ravel()) for f in figures)], names=["part", "filter_order", "step", *FIGURES])


def interactions(rows: DataFrame) -> DataFrame:
    """The audit of judged rows: part, filter_order, step and the figures."""
    table = first_failures()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, int] = {}
        held = np.zeros((PARTS_HELD, MASKS, 4), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_HELD):
                names, mask, good, toxic = (batch.column(i).slice(at, PARTS_HELD) for i in range(4))
                coded = names.dictionary_encode()
                if len(parts) + len(coded.dictionary) > PARTS_HELD:
                    yield partial(list(parts), held[: len(parts)], table)
                    parts, held[:] = {}, 0
                place = np.array([parts.setdefault(p, len(parts)) for p in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
                label = good.to_numpy() + 2 * toxic.to_numpy()
                held += np.bincount((place * MASKS + mask.to_numpy()) * 4 + label, minlength=held.size).reshape(held.shape)
        if parts:
            yield partial(list(parts), held[: len(parts)], table)

    partials = rows.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES))
    return partials.groupBy("part", "filter_order", "step").agg(*(F.sum(f).alias(f) for f in FIGURES))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    steps = range(1, len(FILTERS) + 1)
    later = "CASE " + " ".join(f"WHEN fails[substr(filter_order, {k}, 1)] THEN {k}" for k in steps) + " ELSE 6 END"
    return f"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
 l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(ws) < {MIN_WORDS} AS a, 100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws) AS b,
  100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e FROM t LEFT JOIN l USING (doc_id)),
 g AS (SELECT part, good, toxic, MAP {{'A': a, 'B': b, 'C': c, 'D': d, 'E': e}} AS fails, count(*) AS n FROM m GROUP BY ALL),
 f AS (SELECT unnest(string_split('{",".join(FILTERS)}', ',')) AS x),
 p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 r AS (SELECT g.*, filter_order, {later} AS out FROM g, p),
 q AS (SELECT r.*, k AS step, fails[substr(filter_order, k, 1)] AS failing, len(list_filter(map_values(fails), lambda z: z)) = 1 AS alone FROM r, (SELECT unnest(range(1, 6)) AS k)),
 s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter, sum(n) FILTER (out > step) AS kept, sum(n) FILTER (out = step) AS removed, sum(n) FILTER (failing AND out < step) AS redundant,
  sum(n) FILTER (failing AND alone) AS unique_fails, sum(n) FILTER (out = step AND good) AS good_lost, sum(n) FILTER (out = step AND toxic) AS toxic_lost FROM q GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in FIGURES[:-1])},
 CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM s"""


QUERIES = {"op12_filter_audit": op12}
SQL = {"op12_filter_audit": _sql()}
