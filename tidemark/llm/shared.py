"""What several operators share: shared-folder tables, word boundaries and hashes of Arrow text."""

from __future__ import annotations

import hashlib
import secrets
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20  # text handled at once by the vectorised helpers; a longer document stands alone
GATHER_BYTES = 64 << 20  # text whose packed keys one task gathers at once
WHITE = r"[\x20\x09-\x0D]"
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LONG_WORD = 64
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one of our own only in local mode where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = got.get() if got.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it again: lineage ends, lost executors cost nothing.

    Spark drops the shuffle files of the write when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of written() that no later plan reads."""
    for table in tables:
        if table is not None:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_ROWS) -> Iterator[None]:
    """Within, Python is handed at most `most` rows at once: whole texts stand in the JVM, in Arrow and in Python then.

    Holds for what is run within, not for what is only planned; the session's own setting is back afterwards.
    """
    now = spark.conf.get(BATCH)
    try:
        if int(now) <= 0 or int(now) > most:
            spark.conf.set(BATCH, str(most))
        yield
    finally:
        spark.conf.set(BATCH, now)


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session asks for them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(df: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns, whatever else the table holds."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `most` bytes of text."""
    column = batch.column(batch.schema.get_field_index(column))
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words (runs outside space and \\t..\\r) of an Arrow string column: bytes data[start:end], first[d]:first[d+1] of document d."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets - offsets[0]
        n = len(self.data)
        solid = np.zeros(n + 2, dtype=bool)
        solid[1:-1] = ~_SPACE[self.data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        self.start = np.flatnonzero(solid[1:] & (~solid[:-1] | cut))
        self.end = np.flatnonzero(solid[:-1] & (~solid[1:] | cut))
        self.first = np.searchsorted(self.start, self.offsets)

    def hashes(self, seed: int = 0, key: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes. Eight bytes at a time go through a bijective mixer, longer words than
        LONG_WORD bytes through blake2b; other seeds give independent hashes.

        Without a key the mixer's states are known, so words of over eight bytes can be made to collide. With a secret
        key (fresh_key) each state is unknown from the first eight bytes on, so no word can be steered to another's hash.
        """
        lanes = np.ndarray(len(self.data) + 1, "<u8", np.append(self.data, np.zeros(8, np.uint8)), strides=(1,))
        length = self.end - self.start
        secret = np.uint64(key or 0)
        h = mixed((length.astype(np.uint64) ^ secret) + np.uint64((seed + 1) * int(_MULT) & 0xFFFFFFFFFFFFFFFF))
        h = mixed(h ^ (lanes[self.start] & _LOW_BYTES[np.minimum(length, 8)]))
        for at in range(8, LONG_WORD, 8):
            live = np.flatnonzero(length > at)
            if not len(live):
                break
            h[live] = mixed((h[live] ^ (lanes[self.start[live] + at] & _LOW_BYTES[np.minimum(length[live] - at, 8)])) + secret)
        salt = seed.to_bytes(8, "little")
        own = b"" if key is None else key.to_bytes(8, "little")
        for i in np.flatnonzero(length > LONG_WORD).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8, salt=salt, key=own).digest(), "little")
        return h

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def fresh_key() -> int:
    """A secret for one run's hashes: all its tasks share it, no other run does."""
    return secrets.randbits(64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive words; the caller drops runs across documents."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x2545F4914F6CDD1D) + hashes[j : n + j]
    return mixed(out + np.uint64(k))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all the runs starts[i] .. starts[i] + lengths[i]."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def repeated_keys(docs: DataFrame, keys_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Which of each document's 64-bit keys are also keys of another document: doc_id, keys (binary, uint64).

    keys_of gives (place of the document in the column, key) pairs, documents ascending. A key that several documents of
    one slice hold is a hit for each of them at once and sent on only once, so a key of a third of all documents costs a
    task one entry (16 bytes) a slice. Entries meet by key; hits are dealt out by document and gathered there, so each
    document is one row. A partition is dealt into as many buckets as keep each at the keys of about GATHER_BYTES of
    text; rows come sorted by bucket and one bucket at a time is held.
    """
    spark = docs.sparkSession
    parts = width(spark)
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = parts * max(1, -(-size // (parts * GATHER_BYTES)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            doc, key = keys_of(part.column(1))
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(key, kind="stable")
            doc, key = doc[order], key[order]
            new_key = np.ones(len(key), dtype=bool)
            new_key[1:] = key[1:] != key[:-1]
            new = new_key.copy()
            new[1:] |= doc[1:] != doc[:-1]
            doc, key, new_key = doc[new], key[new], new_key[new]
            at = np.flatnonzero(new_key)
            held = np.diff(np.append(at, len(key)))
            many = np.repeat(held > 1, held)
            yield from dealt(key[at], ids[doc[at]], key[at], False)
            hit_doc = ids[doc[many]]
            yield from dealt(mixed(hit_doc.astype(np.uint64)), hit_doc, key[many], True)

    def dealt(by: np.ndarray, ids: np.ndarray, key: np.ndarray, hit: bool) -> Iterator[pa.RecordBatch]:
        to = (by % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to.astype(np.int16) if buckets < 32_768 else to, kind="stable")  # short integers are sorted by radix
        to, ids, key = to[order], ids[order], key[order]
        cut = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to)) if len(to) else np.zeros(1, np.int64)
        rows = [(b % parts, b // parts, ids[i:j].tobytes(), key[i:j].tobytes(), hit) for b, i, j in zip(to[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], names=["part", "bucket", "ids", "keys", "hit"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, key, hit in gathered(batches):
            hit_ids, hit_keys = ids[hit], key[hit]
            ids, key = ids[~hit], key[~hit]
            order = np.argsort(key, kind="stable")
            ids, key = ids[order], key[order]
            same = np.zeros(len(key) + 1, dtype=bool)
            same[1:-1] = key[1:] == key[:-1]
            found = same[1:] | same[:-1]
            ids, key = np.concatenate([hit_ids, ids[found]]), np.concatenate([hit_keys, key[found]])
            yield from dealt(mixed(ids.astype(np.uint64)), ids, key, True)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The arrays of each bucket."""
        ids, keys, hits, last = [], [], [], None
        for batch in batches:
            for bucket, one, key, hit in zip(*(batch.column(i) for i in (1, 2, 3, 4)), strict=True):
                if bucket.as_py() != last and ids:
                    yield np.concatenate(ids), np.concatenate(keys), np.concatenate(hits)
                    ids, keys, hits = [], [], []
                last = bucket.as_py()
                ids.append(np.frombuffer(one.as_py(), np.int64))
                keys.append(np.frombuffer(key.as_py(), np.uint64))
                hits.append(np.full(len(ids[-1]), hit.as_py()))
        if ids:
            yield np.concatenate(ids), np.concatenate(keys), np.concatenate(hits)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, key, _ in gathered(batches):
            order = np.argsort(ids, kind="stable")
            ids, key = ids[order], key[order]
            cut = np.append(np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)), len(ids))
            for at in range(0, len(cut) - 1, 5000):
                some = cut[at : at + 5001]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some[:-1]]), pa.array([key[a:b].tobytes() for a, b in zip(some[:-1].tolist(), some[1:].tolist())], pa.binary())], names=["doc_id", "keys"])

    packed = "part int, bucket int, ids binary, keys binary, hit boolean"
    by_bucket = lambda rows: rows.repartition(parts, "part").sortWithinPartitions("bucket")
    met = by_bucket(docs.mapInArrow(send, packed)).mapInArrow(meet, packed)
    return by_bucket(met).mapInArrow(tell, "doc_id long, keys binary")
