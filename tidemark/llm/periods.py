"""Operator 13, periodic runs of words by Lyndon arrays on an ordered alphabet.

A run is a maximal stretch whose words repeat with a smallest period. Each run has a Lyndon root under one of the two
orders of the alphabet, the one in which the word that ends the run is the smaller; its root is the longest Lyndon word
at its place there. So for both orders the Lyndon array (next smaller suffix) is built from left to right on a stack,
with the match length of each edge. A match that reaches past everything matched so far is kept as a window: comparisons
inside it are copies of earlier ones, whose lengths are looked up, and only words after its end are compared. Words are
numbered by first occurrence, which is an order as good as any. There are no suffix structures and no hashes, and word
comparisons to the right are linear in the text. Left extensions are made once a run and are shorter than its period.

Each row is its own text, so nothing is shuffled; memory grows with the longest text of a task, not with its rows.

Cases: null text counts as empty (no words, no runs, hash of the empty string); rows without doc_id are kept (and never
planted by the query); very long texts stay linear, also one word a million times; ties for the strongest run go to the
smallest start, then period; repeated rows give equal rows; an empty table gives an empty result; only doc_id and text
are read, so others may be named anything.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.shared import slices, texts

LEAST_PERIODS, LEAST_WORDS = 4, 6


@dataclass(frozen=True)
class Run:
    start: int
    length: int
    period: int


def numbered(words: list[bytes]) -> list[int]:
    """Words as numbers by first occurrence."""
    seen: dict[bytes, int] = {}
    return [seen.setdefault(w, len(seen)) for w in words]


def lyndon(t: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next smaller suffix (the end of the longest Lyndon word there; the empty suffix is the least)
    and how far both suffixes match.

    The stack is the chain of previous smaller suffixes. `since`, `shift` and `end` are the window: t[since:end] equals
    t[since - shift : end - shift], and everything compared within it has been compared `shift` places before.
    """
    n = len(t)
    following, follows, preceding, precedes = [n] * n, [0] * n, [-1] * n, [0] * n
    since = shift = end = 0
    for x in range(1, n):
        y, known, settled = x - 1, 0, False
        while True:
            if not settled:
                if x < end and y >= since:  # within the window: look up the edge that was made there
                    at, before = x - shift, y - shift
                    known = precedes[at] if preceding[at] == before else follows[before]
                    if x + known > end:
                        known = end - x
                if x + known >= end:  # nothing after the window has been compared
                    to, off = x + known, y - x
                    while to < n and t[to] == t[to + off]:
                        to += 1
                    known = to - x
                    if known:
                        since, shift, end = x, -off, to
            if x + known < n and t[y + known] < t[x + known]:
                preceding[x], precedes[x] = y, known
                break
            following[y], follows[y] = x, known
            below = preceding[y]
            if below < 0:
                break
            match = precedes[y]
            if match < known:  # below differs from y, and so from x, at `match`, where it is the smaller
                preceding[x], precedes[x] = below, match
                break
            settled, y = match > known, below  # a longer match: below is larger than x at `known`, as y is
    return following, follows


def runs_of(t: list[int], periods: int = LEAST_PERIODS, words: int = LEAST_WORDS) -> list[Run]:
    """Runs of at least `periods` periods (3 or more) and `words` words, by start, then period."""
    if periods < 3:
        raise ValueError("a root is found once a run from three periods on")
    n, found = len(t), set()
    for values in (t, [-v for v in t]):
        following, follows = lyndon(values)
        for y in range(n):
            right = follows[y]
            if not right:
                continue
            to = following[y]
            period = to - y
            if right <= (periods - 2) * period:  # less than a period can be added on the left
                continue
            if y >= period and following[y - period] == y and follows[y - period] >= period:
                continue  # not the run's first root
            left = y
            while left and t[left - 1] == t[left - 1 + period]:
                left -= 1
            length = to + right - left
            if length >= words and length >= periods * period:
                found.add((left, period, length))
    return [Run(start, length, period) for start, period, length in sorted(found)]


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exact length / period; ties: the smallest start, then period."""
    best = None
    for run in runs:  # in order of start and period
        if best is None or run.length * best.period > best.length * run.period:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    kept, at = [], 0
    for start, end in sorted((r.start + r.period, r.start + r.length) for r in runs):
        if start > at:
            kept += words[at:start]
        at = max(at, end)
    return kept + words[at:]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's texts: a tenth of the documents, chosen by a checksum of the id, repeat themselves from some word on."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_runs(docs: DataFrame, plant: bool = False, listed: bool = False) -> DataFrame:
    """Runs of each text: their number, the strongest, hashes of the list and of the collapsed text. `listed` adds the
    runs themselves and the collapsed text; `plant` first applies planted()."""
    names = [x.split()[0] for x in OUT.split(", ")] + ["runs", "collapsed"] * listed
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    if listed:
        kinds += [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]

    def described(doc_id: int | None, text: str) -> tuple:
        words = text.encode().split()  # at bytes 9 to 13 and 32
        if plant:
            words = planted(words, doc_id)
        runs = runs_of(numbered(words))
        best, kept = strongest(runs), b" ".join(collapsed(words, runs))
        lines = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
        first = (best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4
        row = (doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        return row + (([vars(r) for r in runs], kept.decode()) if listed else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            rows = [described(doc, text.as_py()) for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], names=names)

    more = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if listed else ""
    return texts(docs).mapInArrow(run, OUT + more)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)


QUERIES = {"op13_word_runs": op13}
SQL: dict[str, str] = {}
