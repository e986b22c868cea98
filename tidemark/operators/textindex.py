"""A stored inverted index with positions, and ranked search that reads only its terms' buckets.

Postings are rows (bucket, term, block): the documents of one block of ids that hold a term, as gaps, with each one's
positions, as gaps too. Blocks bound a row's size whatever the term, so a word of every document is many rows and files
instead of one. The table is partitioned by bucket of the term's hash and sorted by term in its files: a search prunes to
its terms' folders and, within, to their row groups. Document lengths stand beside it.

Ranking is by cover density: each smallest stretch of a text that holds all terms counts 0.1 / (1 + words in it that are
none of the terms).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T

BUCKETS, BLOCK, SLICES = 64, 4096, 4
WEIGHT = 0.1


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def gaps(values: Column) -> Column:
    """An ascending array as its first value and the steps after it."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def from_gaps(steps: Column, kind: str) -> Column:
    """The running sum of an array."""
    zero = F.struct(F.lit(0).cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(steps, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out")), lambda acc: acc["out"])


def write_index(docs: DataFrame, id_: str, text: str, path: str, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """Index the texts of docs (whole ids) below path: `postings` by bucket, and `lengths`.

    A text's words are grouped where it is read, and the documents of a term and block there too; what is left is shuffled
    once, to the bucket's files.
    """
    words = docs.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("doc"), T.tokens(F.col(text)).alias("t"))
    entry = "struct<doc:bigint,p:array<int>>"
    parts = words.where(F.size("t") > 0).mapInArrow(lambda batches: partial(batches, block), f"term string, block bigint, e array<{entry}>")
    parts = parts.select(bucket_of(F.col("term"), buckets).alias("bucket"), F.pmod(F.col("block"), F.lit(SLICES)).alias("slice"), "term", "block", "e").repartition("bucket", "slice")
    rows = parts.groupBy("bucket", "slice", "term", "block").agg(F.sort_array(F.flatten(F.collect_list("e"))).alias("e"))
    steps = F.transform("e", lambda x, i: F.when(i == 0, x["doc"]).otherwise(x["doc"] - F.get("e", i - 1)["doc"]))  # of the column itself: an expression would be computed anew for each element
    rows = rows.select("bucket", "term", "block", steps.alias("docs"), F.transform("e", lambda x: x["p"]).alias("positions"))
    rows.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    words.select("doc", F.size("t").alias("length")).write.mode("overwrite").parquet(f"{path}/lengths")


def partial(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """term, block and e (doc, gaps of its positions; by doc) of the documents of a batch (doc, t)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("t").flatten().dictionary_encode()
        sizes = batch.column("t").value_lengths().to_numpy(zero_copy_only=False).astype("int64")
        ids = np.repeat(batch.column("doc").to_numpy(zero_copy_only=False), sizes)
        term = coded.indices.to_numpy(zero_copy_only=False)
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((pos, ids, term))
        term, ids, pos = term[order], ids[order], pos[order]
        held = ids // block
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (ids[1:] != ids[:-1])])  # of a term in a document
        steps = np.diff(pos, prepend=0)
        steps[first] = pos[first]
        t, h = term[first], held[first]
        head = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])])  # of a term in a block
        each = pa.ListArray.from_arrays(pa.array(np.r_[first, len(ids)], pa.int32()), pa.array(steps, pa.int32()))
        entries = pa.StructArray.from_arrays([pa.array(ids[first], pa.int64()), each], ["doc", "p"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[head, len(first)], pa.int32()), entries)
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(t[head])), pa.array(h[head], pa.int64()), lists], ["term", "block", "e"])


def postings(spark: SparkSession, path: str, terms: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """term, doc, positions of the named terms; only their buckets are read."""
    wanted = sorted(set(terms))
    known = spark.range(1).select(F.array(*[bucket_of(F.lit(t), buckets) for t in wanted]).alias("b")).first().b  # a pruned scan needs them as literals
    rows = spark.read.schema("term string, block long, docs array<long>, positions array<array<int>>, bucket int").parquet(f"{path}/postings")
    rows = rows.where(F.col("bucket").isin(sorted(set(known))) & F.col("term").isin(wanted))
    pairs = F.arrays_zip(from_gaps(F.col("docs"), "bigint").alias("doc"), F.col("positions").alias("p"))
    return rows.select("term", F.explode(pairs).alias("x")).select("term", F.col("x.doc").alias("doc"), from_gaps(F.col("x.p"), "int").alias("positions"))


def phrase_places(found: DataFrame, phrase: Sequence[str]) -> DataFrame:
    """doc, places: where a phrase of words begins, by intersecting its words' positions, each shifted to the phrase's start."""
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(phrase)])
    shifted = found.where(F.col("term").isin(*phrase)).select("doc", F.explode(F.filter(words, lambda x: x["w"] == F.col("term"))).alias("x"), "positions")
    shifted = shifted.select("doc", F.transform("positions", lambda p: p - F.col("x.i")).alias("s"))
    lists = shifted.groupBy("doc").agg(F.collect_list("s").alias("l")).where(F.size("l") == len(phrase))
    met = F.aggregate(F.slice("l", 2, len(phrase)), F.get("l", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return lists.select("doc", F.sort_array(met).alias("places")).where(F.size("places") > 0)


def cover_density(entries: Column, terms: int) -> Column:
    """The density of array<struct<pos, k>>, sorted by pos: k is the term's number from 0, positions differ.

    A fold holds the last entry of each term. Where all have one, the stretch from the earliest of them is a cover; it is
    a smallest one if its start is later than that of the cover before.
    """
    none = F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("i"))
    zero = F.struct(F.array_repeat(none, terms).alias("last"), F.lit(-1).alias("since"), F.lit(0).alias("i"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(x["pos"].alias("pos"), acc["i"].alias("i"))
        last = F.transform(acc["last"], lambda y, k: F.when(k == x["k"], here).otherwise(y))
        start = F.array_min(last)
        new = (start["pos"] >= 0) & (start["pos"] > acc["since"])
        noise = (x["pos"] - start["pos"]) - (acc["i"] - start["i"])
        return F.struct(last.alias("last"), F.when(new, start["pos"]).otherwise(acc["since"]).alias("since"), (acc["i"] + 1).alias("i"), (acc["sum"] + F.when(new, F.lit(WEIGHT) / (1 + noise)).otherwise(0.0)).alias("sum"))

    return F.aggregate(entries, zero, step, lambda acc: acc["sum"])


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """doc, density_millionths, rank of the densest (ties: doc)."""
    rows = rows.select("doc", F.floor(F.col("density") * 1e6 + 0.5).cast("long").alias("density_millionths"))
    order = (F.desc("density_millionths"), F.asc("doc"))
    return rows.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def _entries(found: DataFrame, terms: Sequence[str]) -> DataFrame:
    number = F.array_position(F.array(*map(F.lit, terms)), F.col("term")).cast("int") - 1
    each = found.select("doc", "term", F.transform("positions", lambda p: F.struct(p.alias("pos"), number.alias("k"))).alias("e"))
    lists = each.groupBy("doc").agg(F.count("*").alias("n"), F.sort_array(F.flatten(F.collect_list("e"))).alias("e"))
    return lists.where(F.col("n") == len(terms)).select("doc", "e")


def search(spark: SparkSession, path: str, terms: Sequence[str], phrases: Sequence[Sequence[str]] = (), most: int = 50, buckets: int = BUCKETS) -> DataFrame:
    """The densest documents that hold every term and phrase, from the index alone."""
    wanted = sorted({*terms, *(w for p in phrases for w in p)})
    found = postings(spark, path, wanted, buckets)
    rows = _entries(found, wanted)
    for p in phrases:
        rows = rows.join(phrase_places(found, p).select("doc"), "doc", "left_semi")
    return ranked(rows.select("doc", cover_density(F.col("e"), len(wanted)).alias("density")), most)


def scan(docs: DataFrame, id_: str, text: str, terms: Sequence[str], phrases: Sequence[Sequence[str]] = (), most: int = 50) -> DataFrame:
    """What search() gives, from the texts themselves."""
    wanted = sorted({*terms, *(w for p in phrases for w in p)})
    asked = F.array(*map(F.lit, wanted))
    rows = docs.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("doc"), T.tokens(F.col(text)).alias("t")).where(F.size(F.array_intersect("t", asked)) == len(wanted))
    for p in phrases:
        rows = rows.where(F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")).contains(f" {' '.join(p)} "))
    entries = F.filter(F.transform("t", lambda w, i: F.struct(i.alias("pos"), (F.array_position(asked, w).cast("int") - 1).alias("k"))), lambda x: x["k"] >= 0)
    return ranked(rows.select("doc", cover_density(entries, len(wanted)).alias("density")), most)
