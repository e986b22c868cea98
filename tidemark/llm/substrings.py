"""Operator 10, substring dedup by matching statistics over a compressed FM-index per shard.

Shards are made by content, so that equal windows of WINDOW words always meet: a window belongs to its least GRAM-word
hash (its minimiser), and a run of windows with one minimiser is one segment of words. Only segments whose minimiser
occurs in another document go on; equal segments are one row with their smallest document, the others lose all of it.
A shard keeps the Burrows-Wheeler transform of its segments and the ranks of their smallest documents in suffix order,
both as bit-packed wavelet matrices (no suffix array). Every segment is streamed against it by backward search from each
of its words: the matching statistic is the longest run ending there that a smaller document holds, and intervals of
WINDOW words and more are reported. Word numbers in a shard come from the words themselves, not from hashes. Documents
after the first of a segment lose all of its words because the whole segment is known to be equal (a class of copies, not a
matching statistic). Results meet their documents by 128 bits of SHA-256 of the segment's words.

A minimiser with more than HOT different segments (the surroundings of a passage that very many documents share) is
split into single windows, which are dealt by their own hash and searched likewise, so that no shard has an unbounded
group; the result is the same.

Cases: null text counts as empty; documents of under WINDOW words lose nothing; of repeated rows with one doc_id none
is smaller, so they lose the same words; a very long text is many segments, a very long run of one word is one long
segment in one shard (a shard ends where a minimiser does, so its size follows that segment's); ties between equal windows go to the smallest doc_id; an empty table gives an empty result; rows without doc_id
lose nothing; only doc_id and text are read, so other columns may be named anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import Words, discard, grams, mixed, ragged, repeated_keys, slices, texts, width, written

WINDOW = 13
GRAM = 4
HOT = 200
SHARD_WORDS = 1_000_000
PRUNE = (5, 9)  # lengths at which runs that no smaller document holds are given up


def runs(w: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one minimiser in one document: document, first window, windows, minimiser."""
    n = max(0, len(w.start) - window + 1)
    if not n:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    g, doc = grams(w.hashes(), GRAM), w.doc()
    least = g[:n].copy()
    for j in range(1, window - GRAM + 1):
        np.minimum(least, g[j : n + j], out=least)
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    own, key = doc[at], least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    return own[first], at[first], np.diff(np.append(first, len(at))), key[first]


def minimisers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    doc, _, _, key = runs(Words(column))
    return doc, key


def single_spaced(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space after each; where each begins (and the end)."""
    length = w.end - w.start + 1
    places = np.concatenate([[0], np.cumsum(length)])
    data = np.append(w.data, np.uint8(32))[ragged(w.start, length)]
    data[places[1:] - 1] = 32
    return data, places


def segments(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, key, start (in words), words of each segment whose minimiser another document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            w = Words(part.column(1))
            doc, at, count, key = runs(w)
            listed = part.column(2).to_pylist()
            held = [np.frombuffer(x, np.uint64) for x in listed]
            owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
            pair = lambda d, k: mixed(k ^ mixed(d.astype(np.uint64) + np.uint64(1)))
            keep = np.isin(pair(doc, key), pair(owner, np.concatenate([np.zeros(0, np.uint64), *held])))
            doc, at, count, key = doc[keep], at[keep], count[keep], key[keep]
            data, places = single_spaced(w)
            raw, ids = data.tobytes(), part.column(0).to_numpy(zero_copy_only=False)
            begin, end = places[at].tolist(), (places[at + count + WINDOW - 1] - 1).tolist()
            for i in range(0, len(doc), 20_000):
                j = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc[j]], pa.int64()), pa.array(key[j].view(np.int64)), pa.array((at - w.first[doc])[j], pa.int64()), pa.array([raw[a:b] for a, b in zip(begin[j], end[j])], pa.string())],
                    names=["doc_id", "key", "start", "words"],
                )

    joined = docs.join(hits, "doc_id").select("doc_id", "text", "keys")
    return joined.mapInArrow(run, "doc_id long, key long, start long, words string")


def split_hot(rows: DataFrame, hot: DataFrame, window: int = WINDOW) -> DataFrame:
    """Segments of hot minimisers become single windows, keyed by their own hash."""
    marked = rows.join(hot, "key", "left")
    split = F.split("words", " ")
    single = F.transform(F.sequence(F.lit(0), F.size(split) - window), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(split, i + 1, window), " ").alias("words")))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.col("words").alias("words")))
    out = marked.select("doc_id", "key", "start", "hot", F.explode(F.when(F.col("hot"), single).otherwise(whole)).alias("x"))
    key = F.when(F.col("hot"), F.xxhash64("x.words")).otherwise(F.col("key"))
    return out.select("doc_id", key.alias("key"), (F.col("start") + F.col("x.i")).alias("start"), F.col("x.words").alias("words"))


def name_of(words: Column) -> Column:
    """128 bits of SHA-256 that stand for a segment's words in joins."""
    return F.unhex(F.substring(F.sha2(words, 256), 1, 32)).alias("name")


class Wavelet:
    """Wavelet matrix over bit-packed levels: rank of a symbol before a place, smallest symbol of an interval, for arrays."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        n = len(symbols)
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.zeros((n + 64) // 64 * 8, dtype=np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            self.bits.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.uint32))
            self.zeros.append(n - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.base = self.walk(np.arange(size), np.zeros(size, dtype=np.int64))

    def ones(self, k: int, place: np.ndarray) -> np.ndarray:
        """Set bits of level k before each place."""
        block = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[k][block].astype(np.int64) + np.bitwise_count(self.bits[k][block] & below)

    def walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones(k, place)
            place = np.where(symbol >> level & 1, self.zeros[k] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.walk(symbol, place) - self.base[symbol]

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest symbol of each interval; none may be empty."""
        out = np.zeros(len(low), dtype=np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            a, b = self.ones(k, low), self.ones(k, high)
            one = high - b == low - a  # no zero inside
            out |= one.astype(np.int64) << level
            low, high = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, high - b)
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places by the words from there to the end of their sequence (mark 0), by doubling; ties keep their places' order."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # words before the end mark
    rank, k, classes = symbols.astype(np.int64), 1, 0
    while True:
        later = np.zeros(n, dtype=np.int64)
        inside = np.flatnonzero(to_end >= k)
        later[inside] = rank[inside + k] + 1
        found, rank = np.unique(rank * (int(rank.max(initial=0)) + n + 2) + later, return_inverse=True)
        if len(found) == classes or len(found) == n:
            return np.argsort(rank, kind="stable")
        k, classes = 2 * k, len(found)


class Index:
    """Compressed FM-index of word sequences: symbols 1.. are words, 0 ends a sequence; owner is the rank of each place's sequence."""

    def __init__(self, symbols: np.ndarray, size: int, owner: np.ndarray):
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        self.words = Wavelet(symbols[order - 1], size)
        self.owners = Wavelet(owner[order], int(owner.max(initial=0)) + 1)

    def statistics(self, symbols: np.ndarray, ends: np.ndarray, starts: np.ndarray, own: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics: for each end the length (up to `most`) of the longest run of words that ends there, begins
        at its start or later and occurs in a sequence of a smaller rank than own, where that is at least `least`; 0 and
        an upper bound of it elsewhere."""
        out, bound = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), least - 1)
        c = symbols[ends]
        live, low, high, length = np.arange(len(ends)), self.less[c], self.less[c + 1], 1
        while True:
            if length >= least or length in PRUNE:
                held = self.owners.least(low, high) < own[live]
                bound[live[~held]] = length - 1
                live, low, high = live[held], low[held], high[held]
                if length >= least:
                    out[live] = length
            inside = ends[live] - length >= starts[live]
            live, low, high = live[inside], low[inside], high[inside]
            if not len(live) or length == most:
                return out, np.minimum(bound, least - 1)
            c = symbols[ends[live] - length]
            both = self.words.rank(np.concatenate([c, c]), np.concatenate([low, high]))
            low, high = self.less[c] + both[: len(c)], self.less[c] + both[len(c) :]
            length += 1


def repeated_intervals(words: pa.Array, first_doc: np.ndarray, asked: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the asked segments that a segment with a smaller document holds: segment, first word, words.

    A run longer than 2 * window words is reported as overlapping intervals. An end whose statistic is n rules out the
    window - n - 1 ends after it, so every (window - n)-th end is searched first, n being the shortest given up.
    """
    split = pc.split_pattern(words, " ")
    count = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    begin = np.cumsum(count + 1) - count - 1  # a mark follows each segment
    symbols = np.zeros(int(count.sum()) + len(count), dtype=np.int32)
    symbols[ragged(begin, count)] = coded.indices.to_numpy() + 1
    rank = np.unique(first_doc, return_inverse=True)[1].astype(np.int32)
    index = Index(symbols, len(coded.dictionary) + 1, np.repeat(rank, count + 1))
    windows = np.where(asked, np.maximum(0, count - window + 1), 0)
    owner = np.repeat(np.arange(len(count)), windows)
    place = ragged(np.zeros(len(count), np.int64), windows)
    ends = begin[owner] + place + window - 1
    length, stride = np.zeros(len(ends), dtype=np.int64), window - PRUNE[0] + 1

    def search(at: np.ndarray) -> np.ndarray:
        bounds = [np.zeros(0, np.int64)]
        for i in range(0, len(at), 200_000):
            some = at[i : i + 200_000]
            length[some], bound = index.statistics(symbols, ends[some], begin[owner[some]], rank[owner[some]], window, 2 * window)
            bounds.append(np.where(length[some] > 0, window, bound))
        return np.concatenate(bounds)

    leads = np.flatnonzero(place % stride == 0)
    bound = search(leads)
    lead = np.searchsorted(leads, np.arange(len(ends)), side="right") - 1
    ahead = place % stride
    search(np.flatnonzero((ahead > 0) & (bound[lead] + ahead >= window)))
    longest = length > 0  # of runs that grow word by word only the last is an interval of its own
    longest[:-1] &= (length[1:] != length[:-1] + 1) | (owner[1:] != owner[:-1])
    own, length, end = owner[longest], length[longest], ends[longest]
    return own, end - length + 1 - begin[own], length


def searched(distinct: DataFrame) -> DataFrame:
    """name, first, whole, skip, length: of each distinct segment the words that go, as runs of windows: all of them
    (whole) from documents after its first one, intervals of matching statistics from the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        words, last = 0, None
        for batch in batches:  # sorted by key: a shard ends where a key does
            key = batch.column(0).to_numpy()
            size = pc.binary_length(batch.column(1)).to_numpy() // 4
            at = 0
            for cut in [*np.flatnonzero(np.diff(key, prepend=key[0] if last is None else last)).tolist(), len(key)]:
                if cut > at:
                    kept.append(batch.slice(at, cut - at))
                    words += int(size[at:cut].sum())
                    at = cut
                if words > SHARD_WORDS and cut < len(key):
                    yield from shard(kept)
                    kept, words = [], 0
            last = key[-1]
        yield from shard(kept)

    def shard(kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            return
        rows = pa.Table.from_batches(kept).combine_chunks()
        first, final = (rows.column(c).to_numpy() for c in ("first", "final"))
        words = rows.column("words").combine_chunks()
        # equal windows have one key: a segment alone with its key isn't indexed, one with the key's least document isn't searched
        _, key, alike = np.unique(rows.column("key").to_numpy(), return_inverse=True, return_counts=True)
        least = np.full(len(alike), np.iinfo(np.int64).max)
        np.minimum.at(least, key, first)
        held = np.flatnonzero(alike[key] > 1)
        own, skip, length = repeated_intervals(words.take(pa.array(held)), first[held], (first > least[key])[held]) if len(held) else (held, held, held)
        own = held[own]
        twice = np.flatnonzero(final > first)
        every = pc.add(pc.count_substring(words, " "), 1).to_numpy(zero_copy_only=False)[twice].astype(np.int64)
        at, whole = np.concatenate([own, twice]), np.arange(len(own) + len(twice)) >= len(own)
        columns = (first[at], whole, np.concatenate([skip, np.zeros(len(twice), np.int64)]), np.concatenate([length, every]) - WINDOW + 1)
        yield pa.RecordBatch.from_arrays([rows.column("name").combine_chunks().take(pa.array(at)), *(pa.array(x) for x in columns)], names=["name", "first", "whole", "skip", "length"])

    dealt = distinct.repartition(width(distinct.sparkSession), "key").sortWithinPartitions("key")
    return dealt.select("key", "words", name_of(F.col("words")), "first", "final").mapInArrow(run, "name binary, first long, whole boolean, skip long, length long")


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, spans array<struct<start, length>>: words to remove, as runs of windows (first window, windows)."""
    rows = texts(docs).where("doc_id IS NOT NULL")
    hits = written(repeated_keys(rows, minimisers), "repeated")
    found = written(segments(rows, hits), "segments")
    discard(hits)
    per_key = found.select("key", F.xxhash64("words").alias("a1")).groupBy("key", "a1").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n"))
    hot = written(per_key.where(F.col("n") > HOT).select("key", F.lit(True).alias("hot")), "hot")
    distinct = split_hot(found, hot).groupBy("key", "words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("final"))
    gone = written(searched(distinct), "gone")
    places = split_hot(found, hot).select("doc_id", "start", name_of(F.col("words")))
    removed = places.join(gone, "name").where((F.col("whole") & (F.col("doc_id") > F.col("first"))) | (~F.col("whole") & (F.col("doc_id") == F.col("first"))))
    removed = removed.select("doc_id", F.struct((F.col("start") + F.col("skip")).alias("start"), "length").alias("span"))
    spans = written(removed.groupBy("doc_id").agg(F.collect_set("span").alias("spans")), "spans")
    discard(found, hot, gone)
    return spans


def stripped(docs: DataFrame, keep_text: bool, *keep: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document, and the columns named; with keep_text also kept: the words
    left over, or the text as it is where none goes."""
    spans = removals(docs)
    rows = texts(docs, *keep).join(spans, "doc_id", "left").select("doc_id", "text", "spans", *keep)
    extra = [rows.schema[k] for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            out: list[list] = [[], [], [], []]
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = text.encode().split()
                n = len(words)
                if spans:
                    gone = np.zeros(n + 1, dtype=np.int64)
                    start = np.array([s["start"] for s in spans])
                    end = start + np.array([s["length"] for s in spans]) + WINDOW - 1
                    np.add.at(gone, start, 1)
                    np.add.at(gone, end, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                left = b" ".join(words)
                for to, value in zip(out, (n, n - len(words), hashlib.sha256(left).hexdigest(), (text if len(words) == n else left.decode()) if keep_text else None), strict=True):
                    to.append(value)
            made = [pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *made, *(part.column(3 + i) for i in range(len(keep)))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", *keep])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)
    return rows.mapInArrow(run, schema)


def dedup_documents(docs: DataFrame) -> DataFrame:
    return stripped(docs, False).drop("kept")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_fm_substrings": op10}
SQL: dict[str, str] = {}
