"""Operator 4, quality by a factorisation machine.

Inputs are hashed words (counts damped by a logarithm, normalised per text), structure statistics and the text's size.
The score is w0 + sum w x + half of sum over factors of ((sum v x)^2 - sum (v x)^2), so time is linear in a text's
distinct words. The machine is fitted by AdaGrad on the driver from a bounded sample (MOST_ROWS labelled rows outside
the held-out fifth, in hash order; their features are computed by Spark); every whole text is scored in Arrow batches.

Cases: null and empty texts have no words and are scored from the structure statistics; a very long text is scored whole,
by itself; a row's sums have a fixed order, so repeated rows get equal scores in any batch; rows without doc_id are
scored, but never learnt from; of equal hashes the smaller doc_id is sampled first;
without labelled rows of both labels every score is the share of label 1 (1 if there are none, so nothing is thrown
out); an empty table gives an empty result; only doc_id and text are read, so other columns may be named anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.labelled import held_out, sample
from tidemark.llm.shared import Words, slices, texts

MOST_ROWS = 6_000
BITS = 12
RANK = 8
STRUCTURE = ["symbols", "bars", "capitals", "digits", "marks", "exclamations", "word_length", "distinct", "repeats", "repeated_pairs", "log_words", "log_chars", "line_words", "short_words", "marked_words"]
_BARS, _SYMBOLS, _MARKS = (np.isin(np.arange(256), list(x)) for x in (b"|", b"#*$%&|<>", b"!?.,;:"))
_CODES = np.arange(256)
_CAPS, _DIGITS, _BANG = (_CODES >= 65) & (_CODES <= 90), (_CODES >= 48) & (_CODES <= 57), _CODES == 33


def describe(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text structure statistics [n, len(STRUCTURE)]; as triples document, hashed word, damped count."""
    w = Words(column)
    n = len(w.offsets) - 1
    h, doc = w.hashes(), w.doc()
    size = np.maximum(1, np.diff(w.offsets)).astype(float)
    words = np.diff(w.first).astype(float)
    some = np.maximum(1, words)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[w.data])])
        return np.diff(total[w.offsets]) / size

    length = (w.end - w.start).astype(float)
    last = w.data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    per = lambda x: np.bincount(doc, weights=x, minlength=n) / some
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    key = h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.zeros(n)
    _, at = np.unique(key, return_index=True)
    distinct += np.bincount(doc[at], minlength=n)
    pair = key[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]
    inside = doc[1:] == doc[:-1]
    _, at = np.unique(pair[inside], return_index=True)
    pairs = np.bincount(doc[1:][inside], minlength=n).astype(float)
    new_pairs = np.bincount(doc[1:][inside][at], minlength=n)
    lines = np.diff(np.concatenate([[0], np.cumsum(w.data == 10)])[w.offsets]) + 1.0
    stats = np.stack([
        share(_SYMBOLS), share(_BARS), share(_CAPS), share(_DIGITS), share(_MARKS), share(_BANG), per(length), distinct / some, per(same),
        1 - new_pairs / np.maximum(1, pairs), np.log1p(words), np.log1p(np.diff(w.offsets)), np.log1p(words / lines), per((length <= 2).astype(float)), per((_SYMBOLS | _BANG)[last].astype(float)),
    ], 1)
    cell, count = np.unique(doc * (1 << BITS) + (h >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    owner, word = cell >> BITS, cell & ((1 << BITS) - 1)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=n))
    return stats, owner, word, value / np.maximum(1e-9, norm[owner])


@dataclass
class Machine:
    """A fitted factorisation machine; None weights give the prior."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    bias: float = 0.0
    weights: np.ndarray | None = None  # structure statistics first, then hashed words
    factors: np.ndarray | None = None

    def score(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        if self.weights is None:
            return np.full(n, self.prior)
        stats, owner, word, value = describe(column)
        x = np.clip((stats - self.mean) / self.scale, -4, 4)
        k = x.shape[1]
        total = self.bias + (x * self.weights[:k]).sum(1) + np.bincount(owner, weights=self.weights[k + word] * value, minlength=n)
        for f in range(self.factors.shape[1]):  # sum-of-squares identity
            v = self.factors[:, f]
            vx = v[k + word] * value
            one = (x * v[:k]).sum(1) + np.bincount(owner, weights=vx, minlength=n)
            two = (x * x * v[:k] ** 2).sum(1) + np.bincount(owner, weights=vx * vx, minlength=n)
            total += 0.5 * (one * one - two)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train_machine(stats: np.ndarray, cells: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.05, decay: float = 1e-4, seed: int = 1) -> Machine:
    """AdaGrad on the log loss, label by label weighted by the root of its rarity."""
    rng = np.random.default_rng(seed)
    mean, scale = stats.mean(0), np.maximum(1e-6, stats.std(0))
    k, size = stats.shape[1], stats.shape[1] + (1 << BITS)
    w, v, bias = np.zeros(size), rng.normal(0, 0.02, (size, RANK)), float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
    gw, gv, gb = np.full(size, 1e-3), np.full((size, RANK), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x = np.zeros((len(rows), size))
            x[:, :k] = np.clip((stats[rows] - mean) / scale, -4, 4)
            for i, r in enumerate(rows):
                x[i, k + cells[r][0]] = cells[r][1]
            one = x @ v
            z = bias + x @ w + 0.5 * (one * one - (x * x) @ (v * v)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
            dw = x.T @ g + decay * w
            dv = x.T @ (g[:, None] * one) - v * ((x * x).T @ g)[:, None] + decay * v
            gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + g.sum() ** 2
            w, v, bias = w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv), bias - rate * g.sum() / np.sqrt(gb)
    return Machine(float(labels.mean()), mean, scale, bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Machine:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in slices(b)):
            stats, owner, word, value = describe(part.column(1))
            cut = np.searchsorted(owner, np.arange(len(part) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(2), pa.array(list(stats), pa.list_(pa.float64())),
                    pa.array([word[a:b].astype("<u2").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([value[a:b].astype("<f4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                ],
                names=["doc_id", "label", "stats", "words", "counts"],
            )

    rows = sample(docs, labels, "quality", most).select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, stats array<double>, words binary, counts binary").toPandas().sort_values("doc_id", kind="stable")
    if rows["label"].nunique() < 2:
        return Machine(float(rows["label"].mean()) if len(rows) else 1.0)
    cells = [(np.frombuffer(a, "<u2").astype(int), np.frombuffer(b, "<f4").astype(float)) for a, b in zip(rows["words"], rows["counts"])]
    return train_machine(np.array(rows["stats"].tolist(), float), cells, rows["label"].to_numpy(float))


def score_documents(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, threshold: float = 0.3) -> DataFrame:
    machine = fit(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in slices(b)):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(machine.score(part.column(1)), pa.float64())], names=["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op4_quality_fm": op4}
SQL: dict[str, str] = {}
