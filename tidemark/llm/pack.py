"""Operator 6, packing by non-negative least squares.

A document's ids (with the end id) are cut into whole windows and one rest. Documents are dealt by a hash of doc_id to
shards of about SHARD_DOCS documents; each shard enumerates combinations of up to three rest lengths that fill a window,
solves their repeat counts against its histogram of rests by non-negative least squares, rounds to the nearest (as far as
its rests reach), lays out those sequences and packs what is left greedily (longest first, into the fullest sequence with room). A shard's size doesn't
grow with the corpus; only piece lengths are shuffled, never ids.

Ids are those of the tokenizers library for the same vocabulary; they are made by tiktoken, which takes a fifth of its time.

Cases: null text counts as empty, an empty text is the end id alone; a very long text is many whole windows and a rest;
rows without doc_id are packed together like one document's; repeated rows and ties are packed as separate
pieces (ordered by doc_id and start); an empty table gives no pieces; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import texts, written

WINDOW = 1024
SHARD_DOCS = 4000
CLOSE = 1.0  # repeat counts are solved when no projected gradient is larger (in pieces of a length)
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def encoder(ranks: str, special: str, special_id: int) -> tiktoken.Encoding:
    with open(public_tokenizers.path(ranks), "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={special: special_id})


def cut_documents(docs: DataFrame, window: int = WINDOW, ranks: str = "byte_bpe_50k.tiktoken", special: str = "<|endoftext|>", special_id: int = 50256) -> DataFrame:
    """Token ids of each text and an end id, cut at multiples of the window: one row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks, special, special_id)
        for batch in batches:
            docs_, starts, lengths, sums, totals = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = own.encode(text, allowed_special="all") if special in text else own.encode_ordinary(text)
                ids.append(END_ID)
                raw = np.array(ids, dtype="<u4").tobytes()
                for at in range(0, len(ids), window):
                    docs_.append(doc)
                    starts.append(at)
                    lengths.append(min(window, len(ids) - at))
                    sums.append(zlib.crc32(raw[4 * at : 4 * (at + window)]))
                    totals.append(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs_, starts, lengths, sums, totals)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts(docs).mapInArrow(run, PIECES)


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c) of present lengths with a <= b <= c and a + b + c = window; a may be 0 (pairs)."""
    present = np.flatnonzero(histogram)
    there = np.zeros(window + 1, dtype=bool)
    there[present] = True
    b = present[2 * present <= window]
    pairs = np.stack([np.zeros_like(b), b, window - b], 1)
    pairs = pairs[there[pairs[:, 2]]]
    x, y = (v.ravel() for v in np.meshgrid(present, present, indexing="ij"))
    keep = (x <= y) & (window - x - y >= y)
    x, y = x[keep], y[keep]
    triples = np.stack([x, y, window - x - y], 1)
    return np.concatenate([pairs, triples[there[triples[:, 2]]]])


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative x that makes the lengths used by combos as near as can be to the histogram (accelerated projected gradient)."""
    if not len(combos):
        return np.zeros(0)
    size = len(histogram)
    flat = combos.ravel()
    goal = histogram.astype(float)
    used = np.bincount(flat, minlength=size).astype(float)
    step = 1.0 / max(1.0, 3.0 * used[1:].max() if size > 1 else 1.0)
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(rounds):
        made = np.bincount(flat, weights=np.repeat(y, 3), minlength=size)
        gap = made - goal
        gap[0] = 0.0
        new = np.maximum(0.0, y - step * gap[combos].sum(1))
        if np.abs(new - y).max() < CLOSE * step:
            return new
        u = (1 + math.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / u * (new - x), u
    return x


def lay_out(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    sequence, offset = np.full(len(lengths), -1, dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    whole = np.flatnonzero(lengths == window)
    sequence[whole] = np.arange(len(whole))
    n = len(whole)
    free: dict[int, list[int]] = defaultdict(list)
    for i in np.flatnonzero(lengths < window)[::-1].tolist():
        free[int(lengths[i])].append(i)
    histogram = np.bincount(lengths[lengths < window], minlength=window + 1)
    combos = combinations(histogram, window)
    counts = repeat_counts(combos, histogram)
    for k in np.argsort(-counts, kind="stable").tolist():
        if (times := round(counts[k])) < 1:
            break
        need = [int(v) for v in combos[k] if v]
        for _ in range(times):
            if any(len(free[v]) < need.count(v) for v in need):
                break
            at = 0
            for v in need[::-1]:
                i = free[v].pop()
                sequence[i], offset[i] = n, at
                at += v
            n += 1
    room: dict[int, list[int]] = defaultdict(list)  # open sequences by free tokens
    for v in range(window - 1, 0, -1):
        for i in free[v][::-1]:
            left = next((r for r in range(v, window) if room.get(r)), 0)
            s, at = (room[left].pop(), window - left) if left else (n, 0)
            n += not left
            sequence[i], offset[i] = s, at
            if window - at - v:
                room[window - at - v].append(s)
    return sequence, offset


def pack(pieces: DataFrame, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Add sequence_id and offset to pieces. Pieces are written once, so that tokenizing isn't repeated for the count."""
    kept = written(pieces, "pieces")
    shards = max(1, math.ceil(kept.where("start = 0").count() / shard_docs))

    def run(table: pa.Table) -> pa.Table:  # Arrow keeps null ids apart from numbers
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending")])
        sequence, offset = lay_out(table.column("length").to_numpy(), window)
        base = table.column("shard")[0].as_py() << 40
        return table.drop_columns("shard").append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    return pack(cut_documents(docs, window), window)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_nnls_packing": op6}
SQL: dict[str, str] = {}
