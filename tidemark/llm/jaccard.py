"""Operator 1, n-gram Jaccard join over prefix trees, exact at 100 * intersection >= 80 * union.

1. Any two linked documents share several of the least-hashed shingles of their extended prefixes; only documents with
   that many repeated prefix shingles go on (one shuffle of packed prefix keys, one of the text).
2. Documents with equal sets are one class, its smallest document stands for it.
3. Shingles of the representatives are ordered by document frequency (half powers of two), then hash. A pair that links meets at its first common
   prefix shingle, where the rest of both sets must still be long enough (position filter).
4. Candidates are probes against chunks of about CHUNK sets; each chunk stores its globally ordered sets in a radix
   trie, and a probe walks it, sharing partial overlaps and pruning subtrees by remaining-length bounds. Star rounds
   take one likely centre a document, then waves hold each document against one chunk of the largest component it
   meets, until a wave links few: large groups of near copies become one component by work in proportion to their
   size. What still meets another component is held against all its chunks that fit, so no link between components is
   lost and none is sought inside one. After each round components are contracted to points, so a round costs at most
   one edge for each pair of components that it joins. Tables with a row a document or shingle are joined by merging, never
by broadcast; a hot shingle's partition is then split by Spark's skew handling.

Result: one row per document with its set size and component; links aren't expanded into pairs.

Shingles are 64-bit hashes under a secret key that is drawn for each run, so no text can be made to collide with another;
classes are named by two sums under two keys (128 bits). In the global order 57 bits of a shared shingle's hash count: a
pair of sets of n and m shingles takes a different one for a common one with a chance of n * m / 2**57, and that matters only
if it stands within one shingle of the threshold. No two texts are compared word by word.

Cases: null or wordless texts have empty sets and link with nothing; texts of under five words are one shingle; a very
long text is one set like any other, handled by itself; repeated rows are one class; ties are decided by the smaller
doc_id; an empty table gives an empty result; rows without doc_id are alone; only doc_id and text are read, so other
columns may be named anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import Words, discard, fresh_key, grams, mixed, repeated_keys, slices, texts, written

SHINGLE = 5
CHUNK = 256
STARS = 2
WAVES = 16  # waves go on while one in so many probes links


def sets_of(column: pa.Array, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash (under a key) of each distinct shingle, sorted by both."""
    w = Words(column, lower=True)
    h, doc = w.hashes(key=key), w.doc()
    g = grams(h, SHINGLE)
    at = np.flatnonzero(doc[: len(g)] == doc[SHINGLE - 1 :]) if len(g) else np.zeros(0, np.int64)
    docs, keys = [doc[at]], [g[at]]
    count = np.diff(w.first)
    for k in range(1, SHINGLE):
        own = np.flatnonzero(count == k)
        if len(own):
            docs.append(own)
            keys.append(grams(h, k)[w.first[own]])
    doc, found = np.concatenate(docs), np.concatenate(keys)
    if len(docs) > 1:
        order = np.argsort(doc, kind="stable")
        doc, found = doc[order], found[order]
    cut = np.searchsorted(doc, np.arange(len(count) + 1)).tolist()
    for a, b in zip(cut, cut[1:]):
        found[a:b].sort()
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], found[new]


def set_sums(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """The sum of each document's mixed keys modulo 2**64."""
    total = np.concatenate([[0], np.cumsum(mixed(key))]).astype(np.uint64)
    cut = np.searchsorted(doc, np.arange(n + 1))
    return (total[cut[1:]] - total[cut[:-1]]).view(np.int64)


def extra(n: np.ndarray) -> np.ndarray:
    """Common prefix shingles asked of a set of n beyond the plain prefix filter's one."""
    return np.maximum(1, n // 20)


def prefix_keys(column: pa.Array, secret: int) -> tuple[np.ndarray, np.ndarray]:
    doc, key = sets_of(column, secret)
    n = np.bincount(doc, minlength=len(column))
    first = np.cumsum(n) - n
    keep = np.arange(len(doc)) - first[doc] < (n - (4 * n + 4) // 5 + extra(n))[doc]
    return doc[keep], key[keep]


def candidate_sets(docs: DataFrame, hits: DataFrame, secrets: tuple[int, int]) -> DataFrame:
    """doc_id, n of every document; set (and its two names) of those that may have a partner."""
    hits = hits.select("doc_id", F.expr("octet_length(keys) div 8").alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            doc, key = sets_of(part.column(1), secrets[0])
            n = np.bincount(doc, minlength=len(part))
            hits = np.nan_to_num(part.column(2).to_numpy(zero_copy_only=False).astype(float))
            likely = (n > 0) & (hits >= extra((4 * n + 4) // 5))
            at = np.flatnonzero(likely)
            ends = np.concatenate([[0], np.cumsum(np.where(likely, n, 0))])
            own = key[likely[doc]]
            # a null offset makes a null list
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~likely, False)), pa.array(own.view(np.int64)))
            s1, s2 = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            s1[at] = set_sums(doc, key, len(part))[at]
            s2[at] = set_sums(*sets_of(part.column(1).take(pa.array(at)), secrets[1]), len(at))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(s1, mask=~likely), pa.array(s2, mask=~likely), lists],
                names=["doc_id", "n", "s1", "s2", "keys"],
            )

    # hits grow with the documents, so they are never broadcast
    return docs.join(hits.hint("merge"), "doc_id", "left").select("doc_id", "text", "hits").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, keys array<long>")


def ordered_sets(reps: DataFrame, shared: DataFrame) -> DataFrame:
    """id, n, rare (shingles nobody shares), keys: the shared ones as numbers in the global order: six bits of document
    frequency (half powers of two), then 57 bits of the shingle, so rare ones come first."""
    each = reps.select("id", F.explode("keys").alias("key"))
    code = F.shiftleft(F.col("step").cast("long"), 57).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 57) - 1)))
    back = each.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(code)).alias("keys"))
    return reps.select("id", "n").join(back, "id").select("id", "n", (F.col("n") - F.size("keys")).alias("rare"), "keys")


def frequencies(reps: DataFrame) -> DataFrame:
    """key, step (of document frequency) of the shingles that several representatives hold."""
    counted = reps.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    return counted.select("key", F.least(F.lit(63), F.floor(2 * F.log2("df"))).cast("byte").alias("step"))


class Trie:
    """Radix trie of integer sequences (each in one global order); sizes are those of the whole sets."""

    def __init__(self, sequences: list[np.ndarray], sizes: list[int]):
        by_bytes = sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">i4").tobytes())
        self.parent, self.edge, self.depth, self.held = [-1], [np.zeros(0, np.int64)], [0], [[]]
        path, last = [0], np.zeros(0, np.int64)
        for i in by_bytes:
            s = sequences[i]
            m = min(len(s), len(last))
            differ = np.flatnonzero(s[:m] != last[:m])
            common = int(differ[0]) if len(differ) else m
            while self.depth[path[-1]] > common:
                node = path.pop()
                if self.depth[path[-1]] < common:  # the edge is cut where the sequences part
                    cut = common - self.depth[path[-1]]
                    path.append(self.add(path[-1], self.edge[node][:cut]))
                    self.parent[node], self.edge[node] = path[-1], self.edge[node][cut:]
            if len(s) > common:
                path.append(self.add(path[-1], s[common:]))
            self.held[path[-1]].append(i)
            last = s
        self.sizes, self.lengths = sizes, [len(s) for s in sequences]
        n = len(self.parent)
        self.children: list[list[int]] = [[] for _ in range(n)]
        self.reach, self.least = [-(1 << 60)] * n, [1 << 60] * n  # largest 9 * length - 4 * size, smallest size below
        for node in sorted(range(n), key=lambda k: (self.depth[k], -len(self.edge[k])), reverse=True):
            for i in self.held[node]:
                self.reach[node] = max(self.reach[node], 9 * self.lengths[i] - 4 * sizes[i])
                self.least[node] = min(self.least[node], sizes[i])
            if (p := self.parent[node]) >= 0:
                self.children[p].append(node)
                self.reach[p], self.least[p] = max(self.reach[p], self.reach[node]), min(self.least[p], self.least[node])
        self.pool = np.concatenate(self.edge).astype(np.int64)
        self.ends = np.cumsum([len(e) for e in self.edge]).tolist()

    def add(self, parent: int, edge: np.ndarray) -> int:
        self.parent.append(parent)
        self.edge.append(edge)
        self.depth.append(self.depth[parent] + len(edge))
        self.held.append([])
        return len(self.parent) - 1

    def probe(self, mask: np.ndarray, size: int, length: int) -> list[int]:
        """Sequences that link with a set of `size` of which mask marks the `length` numbers that sequences may share."""
        total = np.concatenate([[0], np.cumsum(mask[self.pool])]).tolist()
        out, todo = [], [(0, 0)]
        while todo:
            node, overlap = todo.pop()
            end = self.ends[node]
            overlap += total[end] - total[end - len(self.edge[node])]
            if 9 * (overlap - self.depth[node]) + self.reach[node] < 4 * size or 9 * length < 4 * (self.least[node] + size):
                continue
            out += [i for i in self.held[node] if 9 * overlap >= 4 * (self.sizes[i] + size)]
            todo += [(c, overlap) for c in self.children[node]]
        return out


class Chunk:
    """Members of a chunk in a trie over local numbers of their shingles."""

    def __init__(self, ids: list[int], sizes: list[int], keys: list[np.ndarray]):
        self.ids = ids
        self.known, back = np.unique(np.concatenate(keys), return_inverse=True)
        # most frequent first: near copies then share long paths
        self.trie = Trie([x[::-1] for x in np.split(back, np.cumsum([len(k) for k in keys])[:-1])], sizes)

    def linked(self, probe: int, n: int, keys: np.ndarray) -> list[int]:
        """Members that link with a set."""
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        at = at[self.known[at] == keys]
        mask = np.zeros(len(self.known), dtype=np.int64)
        mask[at] = 1
        return sorted(self.ids[i] for i in self.trie.probe(mask, n, len(at)) if self.ids[i] != probe)


def walked(batches: Iterator[pa.RecordBatch], one: bool) -> Iterator[pa.RecordBatch]:
    """Links of each chunk's probes with its members. Rows are sorted by chunk, members first, so only one chunk's
    members are held; one: at most one link a probe, as members are one component."""
    last, chunk, held = None, None, ([], [], [])
    for batch in batches:
        names = [batch.column(i).to_pylist() for i in range(5)]
        lists = batch.column(5)
        cut, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        a, b = [], []
        for i, (key, share, probe, doc, n) in enumerate(zip(*names)):
            keys = values[cut[i] : cut[i + 1]]
            if (key, share) != last:
                last, chunk, held = (key, share), None, ([], [], [])
            if not probe:
                for to, x in zip(held, (doc, n, keys.copy())):
                    to.append(x)
            elif held[0]:
                chunk = chunk or Chunk(*held)
                found = chunk.linked(doc, n, keys)
                found = found[:1] if one else found
                a += [doc] * len(found)
                b += found
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified(members: DataFrame, probes: DataFrame, sets: DataFrame, one: bool) -> DataFrame:
    """Links a, b among members(chunk, id) and probes(chunk, id). Chunks with many probes are dealt out with copies of the chunk."""
    load = probes.groupBy("chunk").agg(F.ceil(F.count("*") / (4 * CHUNK)).cast("int").alias("shares"))
    own = members.join(load, "chunk").select("chunk", "id", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(False).alias("probe"))
    asked = probes.join(load, "chunk").select("chunk", "id", F.pmod(F.xxhash64("id"), "shares").cast("int").alias("share"), F.lit(True).alias("probe"))
    rows = own.union(asked).join(sets.select("id", "n", "keys"), "id").select("chunk", "share", "probe", "id", "n", "keys")
    dealt = rows.repartition("chunk", "share").sortWithinPartitions("chunk", "share", "probe", "id")
    return dealt.mapInArrow(lambda batches: walked(batches, one), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of all ids in links(a, b): hook to the least neighbour, then jump, until nothing changes."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        hooked = written(labels.join(near, labels.id == near.a).select("id", F.least("component", "near").alias("component"), F.col("component").alias("was")), "hooked")
        root = hooked.select(F.col("id").alias("root"), F.col("component").alias("top"))
        jumped = written(hooked.join(root, hooked.component == root.root).select("id", F.least("component", "top").alias("component"), "was"), "labels")
        discard(labels, hooked)
        labels = jumped
        if jumped.where("component <> was").isEmpty():
            discard(edges)
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels(id, component) after links(a, b) as well, whose ends are contracted to components before they are followed."""
    ends = links.select(F.col("a").alias("id"), "b")
    ends = labelled(ends, labels).select(F.col("component").alias("a"), F.col("b").alias("id"))
    points = written(labelled(ends, labels).select("a", F.col("component").alias("b")).where("a <> b").distinct(), "points")
    top = components(points)
    discard(points)
    if labels is None:
        return top
    known = labels.select("id", "component").union(top.select("id", F.col("id").alias("component"))).distinct()
    up = top.select(F.col("id").alias("was"), F.col("component").alias("top"))
    out = written(known.join(up, known.component == up.was, "left").select("id", F.coalesce("top", "component").alias("component")), "components")
    discard(labels, top)
    return out


def labelled(frame: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Add component: the id itself where labels has none."""
    if labels is None:
        return frame.withColumn("component", F.col("id"))
    return frame.join(labels.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def star_pairs(entries: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """For each set the centre that most of its prefix shingles name: id, centre, in another component."""
    rows = labelled(entries, labels).withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25))))
    centre = rows.groupBy("key", "band").agg(F.min(F.struct(F.xxhash64(F.col("component"), F.lit(turn)).alias("h"), F.col("id").alias("centre"), F.col("component").alias("c"))).alias("m"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    named = rows.join(centre.select("key", "band", "m.centre", "m.c").hint("merge"), ["key", "band"]).where("component <> c")
    votes = named.groupBy("id", "centre").agg(F.count("*").alias("votes"))
    return votes.groupBy("id").agg(F.max(F.struct("votes", (-F.col("centre")).alias("c"))).alias("m")).select("id", (-F.col("m.c")).alias("centre"))


def chunk_of(component: str, size: str, by: Column) -> Column:
    return F.xxhash64(component, F.pmod(by, F.ceil(F.col(size) / CHUNK)))


def placed(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """id, component, size of the component, chunk of each set."""
    ids = labelled(entries.select("id").distinct(), labels)
    sizes = ids.groupBy("component").agg(F.count("*").alias("size"))
    return ids.join(sizes, "component").select("id", "component", "size", chunk_of("component", "size", F.xxhash64("id")).alias("chunk"))


def unsettled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries whose shingle still meets several components; components only grow, so the others are done with."""
    rows = labelled(entries, labels)
    several = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    out = written(entries.join(several.hint("merge"), "key", "left_semi"), "entries")
    discard(entries)
    return out


def wave_pairs(entries: DataFrame, members: DataFrame, turn: int) -> DataFrame:
    """probes(chunk, id): for each set one chunk of the component that most of its prefix shingles point to, which is
    the largest one that a shingle meets. One row a set."""
    rows = entries.join(members.select("id", "component", "size"), "id")
    top = rows.groupBy("key").agg(F.max(F.struct("size", F.xxhash64("component", F.lit(turn)).alias("h"), "component")).alias("m"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    named = rows.join(top.select("key", F.col("m.component").alias("to"), F.col("m.size").alias("to_size")).hint("merge"), "key").where("component <> to")
    votes = named.groupBy("id", "to", "to_size").agg(F.count("*").alias("votes"))
    best = votes.groupBy("id").agg(F.max(F.struct("votes", "to_size", "to")).alias("m")).select("id", "m.to", "m.to_size")
    return best.select(chunk_of("to", "to_size", F.xxhash64("id", F.lit(turn))).alias("chunk"), "id")


def cross_pairs(entries: DataFrame, members: DataFrame) -> DataFrame:
    """probes(chunk, id): sets that meet a chunk of another component, whatever its size."""
    rows = entries.join(members, "id")
    mixed_keys = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max(F.struct("size", "component")).alias("top")).where("x < y").select("key", F.col("top.component").alias("top"))
    rows = written(rows.join(mixed_keys.hint("merge"), "key"), "meeting")
    held = rows.groupBy("key", "chunk", "component", "size").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("place")).alias("rest"))
    held = held.select("key", *[F.col(c).alias(f"c_{c}") for c in ("chunk", "component", "size", "low", "high", "rest")])
    turned = (F.col("size") < F.col("c_size")) | ((F.col("size") == F.col("c_size")) & (F.col("component") < F.col("c_component")))
    fits = (4 * F.col("n") <= 5 * F.col("c_high")) & (4 * F.col("c_low") <= 5 * F.col("n"))
    enough = 9 * F.least(F.col("n") - F.col("place"), F.col("c_rest")) >= 4 * (F.col("n") + F.greatest(F.col("c_low"), F.ceil(0.8 * F.col("n"))))
    # sets of a shingle's largest component ask nobody there
    pairs = rows.where("component <> top").join(held, "key").where(turned & fits & enough)
    out = written(pairs.select(F.col("c_chunk").alias("chunk"), "id").distinct(), "probes")
    discard(rows)
    return out


def linked(sets: DataFrame, stars: int = STARS) -> DataFrame | None:
    """Components of the representatives; None if there are no links."""
    prefix = F.slice("keys", 1, F.greatest(F.lit(0), F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1 - F.col("rare")).cast("int"))
    entries = written(sets.select("id", "n", "rare", F.posexplode(prefix).alias("i", "key")).select("id", "n", "key", (F.col("rare") + F.col("i")).alias("place")), "entries")
    labels = None
    for turn in range(stars):
        pairs = written(star_pairs(entries, labels, turn), "stars")
        votes = pairs.groupBy("centre").agg(F.count("*").alias("size"))
        dealt = pairs.join(votes, "centre").select("id", "centre", chunk_of("centre", "size", F.xxhash64("id")).alias("chunk"))
        found = written(verified(dealt.select("chunk", "id"), dealt.select("chunk", F.col("centre").alias("id")).distinct(), sets, False), "links")
        if not found.isEmpty():
            labels = merged(labels, found)
            entries = unsettled(entries, labels)
        discard(pairs, found)
    members, turn, more = written(placed(entries, labels), "members"), stars, True
    while more:
        probes = written(wave_pairs(entries, members, turn), "waves")
        found = written(verified(members, probes, sets, True), "links")
        n = found.count()
        more = n * WAVES > probes.count()
        if n:
            labels = merged(labels, found)
        discard(probes, found)
        if more:
            discard(members)
            members, turn = written(placed(entries, labels), "members"), turn + 1
    probes = cross_pairs(entries, members)  # components that the last wave joined may meet again; that joins nothing new
    found = written(verified(members, probes, sets, True), "links")
    if not found.isEmpty():
        labels = merged(labels, found)
    discard(entries, members, probes, found)
    return labels


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows, secrets = texts(docs), (fresh_key(), fresh_key())
    hits = written(repeated_keys(rows, lambda column: prefix_keys(column, secrets[0])), "prefixes")
    sets = written(candidate_sets(rows, hits, secrets), "sets")
    discard(hits)
    likely = sets.where("keys IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(likely.groupBy("s1", "s2").agg(F.min("doc_id").alias("id")), "classes")
    reps = likely.join(classes.select("id", F.col("s1").alias("c1"), F.col("s2").alias("c2")), (F.col("doc_id") == F.col("id")) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")))
    reps = written(reps.groupBy("id").agg(F.max_by(F.struct("n", "keys"), "n").alias("x")).select("id", "x.n", "x.keys"), "class-sets")
    small = written(sets.select("doc_id", "n", "s1", "s2"), "sizes")
    discard(sets)
    shared = written(frequencies(reps), "frequencies")
    ordered = written(ordered_sets(reps, shared), "ordered")
    discard(reps, shared)
    labels = linked(ordered)
    discard(ordered)
    named = written(labelled(classes, labels).select("s1", "s2", "component"), "named")
    discard(classes, labels)
    # most documents have no likely partner: their null names stay out of the join
    paired = small.where("s1 IS NOT NULL").join(named, ["s1", "s2"], "left").select("doc_id", "n", "component")
    out = paired.union(small.where("s1 IS NULL").select("doc_id", "n", F.lit(None).cast("long")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_ngram_jaccard": op1}
SQL: dict[str, str] = {}
