"""Provenance of alerts and stored runs: graphs by kind, Merkle hashes, replay from archived payloads.

A graph is nodes (run_id, node_id, kind, label, attributes map<string,string>) and edges (run_id, source_id, target_id,
relation) that never lead to an earlier kind. A node's Merkle hash covers its kind, label and attributes and the hashes of
what it derives from, not its id or time: equal subgraphs of different runs share one hash, and a change shows in exactly
the nodes that derive from it. Small runs are hashed, and their order of replay found, as one row each. Of large ones levels
are worked through in turn, each one join on (run, node); predecessors are hashed in groups first, so a node of very many
inputs is many small rows. Replay recomputes values in the same way from archived
bytes that still have their recorded hash, and names the first node whose value isn't the recorded one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.records import DATASET_OF
from tidemark.functions.alerts import looked_up
from tidemark.sources.store import dropped, stored

# fixed values: kinds in the order of the chain, what a kind's attributes must have, and the formula behind alerts
KINDS = ("dataset", "raw_payload", "agent", "formula", "output")
SMALL, TASK_ROWS = 5_000, 400_000  # nodes and edges of a run that is hashed as one row; of all runs of a task
REQUIRED = {"raw_payload": ("sha256",), "formula": ("formula_id", "formula_version")}
ALERT_FORMULA, ALERT_VERSION = "tidemark.alerts.trigger_evaluation", "1.0.0"
NODE = "struct<node_id:string,kind:string,label:string,attributes:map<string,string>>"


def alert_graphs(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the chain behind each rule's result: dataset, payload (if one was read), agent, formula, output.

    results: run_id, user_id, rule, outcome, observed, threshold, threshold_source (strings), payload_sha256 (or null).
    No payload is made up where a rule read none.
    """
    dataset = looked_up(DATASET_OF, F.col("rule"))
    attributes = lambda **kv: F.map_from_arrays(F.array(*map(F.lit, kv)), F.array(*[v.cast("string") for v in kv.values()]))
    node = lambda id_, kind, label, **kv: F.struct(id_.alias("node_id"), F.lit(kind).alias("kind"), label.alias("label"), attributes(**kv).alias("attributes"))
    sha = F.col("payload_sha256")
    payload = node(F.concat(F.lit("payload:"), F.substring(sha, 1, 16)), "raw_payload", F.lit("archived upstream payload"), sha256=sha)
    chain = F.filter(
        F.array(
            node(F.concat(F.lit("dataset:"), dataset), "dataset", dataset, dataset_id=dataset, threshold_source=F.col("threshold_source")),
            F.when(sha.isNotNull(), payload),
            node(F.lit("agent:alert_scheduler"), "agent", F.lit("alert scheduler"), user_id=F.col("user_id")),
            node(F.concat(F.lit("formula:"), "rule"), "formula", F.col("rule"), formula_id=F.lit(ALERT_FORMULA), formula_version=F.lit(ALERT_VERSION), rule=F.col("rule"), threshold=F.col("threshold"), threshold_source=F.col("threshold_source")),
            node(F.concat(F.lit("out:"), "rule"), "output", F.concat("rule", F.lit(" outcome")), outcome=F.col("outcome"), observed=F.col("observed")),
        ),
        lambda x: x.isNotNull(),
    )
    rows = results.select("run_id", chain.alias("c"))
    nodes = rows.select("run_id", F.explode("c").alias("n")).select("run_id", "n.*")
    steps = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.get("c", i - 1)["node_id"].alias("source_id"), F.get("c", i)["node_id"].alias("target_id")))
    edges = rows.select("run_id", F.explode(steps).alias("e")).select("run_id", "e.*", F.lit("derives").alias("relation"))
    return nodes, edges


def order_of(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")


def node_issues(nodes: DataFrame) -> DataFrame:
    """run_id, node_id, issue of nodes that may not be recorded: no id or label, an unknown kind, a missing attribute, or
    an id that stands twice in its run."""
    has = lambda name: F.coalesce(F.array_contains(F.map_keys("attributes"), name), F.lit(False))
    lacking = [F.when((F.col("kind") == kind) & ~has(name), F.lit(f"{kind} lacks {name}")) for kind, names in REQUIRED.items() for name in names]
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    found = F.array(F.when(blank("node_id"), "no id"), F.when(blank("label"), "no label"), F.when(F.coalesce(order_of(F.col("kind")), F.lit(0)) == 0, "unknown kind"), *lacking)
    own = nodes.select("run_id", "node_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))
    twice = nodes.groupBy("run_id", "node_id").agg(F.count("*").alias("n")).where("n > 1").select("run_id", "node_id", F.lit("id stands twice").alias("issue"))
    return own.union(twice)


def content(attributes: Column) -> Column:
    """Attributes as text that depends on neither their order nor on separators in them: sizes stand before texts."""
    sized = lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    pairs = F.array_sort(F.transform(F.map_entries(F.coalesce(attributes, F.create_map().cast("map<string,string>"))), lambda e: F.concat(sized(e["key"]), sized(e["value"]))))
    return F.concat(F.size(pairs).cast("string"), F.lit(";"), F.array_join(pairs, ""))


def by_levels(nodes: DataFrame, edges: DataFrame, first: Column, step: Callable[[DataFrame], DataFrame], made: str) -> DataFrame:
    """Work through a graph: nodes without predecessors get `first`; then, level after level, nodes whose predecessors
    all have a value get what `step` makes of rows (the node's columns, and value and relation of each predecessor).

    step returns run_id, node_id and `made`. The result has level and `made`; a cycle is an error.
    """
    need = edges.groupBy("run_id", F.col("target_id").alias("node_id")).agg(F.count("*").alias("_need"))
    every = nodes.join(need, ["run_id", "node_id"], "left")
    done = stored(every.where("_need IS NULL").drop("_need").withColumn(made, first).withColumn("level", F.lit(0)), "level")
    rest = stored(every.where("_need IS NOT NULL"), "rest")
    parts, level, fresh = [done], 0, done
    arrived = None
    while not rest.isEmpty():
        level += 1
        sent = fresh.select("run_id", F.col("node_id").alias("source_id"), F.col(made).alias("_v"))
        now = edges.join(sent, ["run_id", "source_id"]).select("run_id", F.col("target_id").alias("node_id"), "relation", "_v")
        known = stored(now if arrived is None else arrived.union(now), "arrived")
        dropped(arrived)
        counts = known.groupBy("run_id", "node_id").agg(F.count("*").alias("_have"))
        ready = rest.join(counts, ["run_id", "node_id"]).where("_have = _need").drop("_need", "_have")
        values = step(ready.join(known, ["run_id", "node_id"]))
        fresh = stored(ready.join(values, ["run_id", "node_id"]).withColumn("level", F.lit(level)), "level")
        if fresh.isEmpty():
            raise ValueError("the graph has a cycle, or an edge from a node that isn't there")
        parts.append(fresh)
        after = stored(rest.join(fresh.select("run_id", "node_id"), ["run_id", "node_id"], "left_anti"), "rest")
        dropped(rest)
        rest, arrived = after, stored(known.join(fresh.select("run_id", "node_id"), ["run_id", "node_id"], "left_anti"), "arrived")
        dropped(known)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def parts_of(spark: SparkSession, total: int) -> int:
    """Partitions for runs that have so many nodes and edges in all."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS)


def _large(nodes: DataFrame, edges: DataFrame) -> tuple[int, DataFrame | None]:
    """Nodes and edges of all runs; run_id of runs of more than SMALL, if there are any."""
    sizes = nodes.select("run_id").union(edges.select("run_id")).groupBy("run_id").agg(F.count("*").alias("n"))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    return total or 0, stored(sizes.where(F.col("n") > SMALL).select("run_id"), "large") if (most or 0) > SMALL else None


def merkle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, node_id, kind, level, hash.

    A run is brought together once and hashed as a whole; runs of more than SMALL nodes and edges are worked by levels.
    """
    own = F.sha2(F.concat_ws("|", "kind", F.length("label").cast("string"), "label", content(F.col("attributes"))), 256)
    rows = nodes.select("run_id", "node_id", "kind", own.alias("own"))

    def step(met: DataFrame) -> DataFrame:
        one = F.concat(F.col("_v"), F.lit(":"), F.coalesce("relation", F.lit("")))
        groups = met.groupBy("run_id", "node_id", "own", F.substring("_v", 1, 2).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), ","), 256).alias("h"))
        return groups.groupBy("run_id", "node_id", "own").agg(F.array_sort(F.collect_list(F.concat("g", "h"))).alias("l")).select("run_id", "node_id", F.sha2(F.concat("own", F.lit("<"), F.array_join("l", ",")), 256).alias("hash"))

    total, big = _large(nodes, edges)
    small, links, large = rows, edges, None
    if big is not None:
        small, links = (x.join(big, "run_id", "left_anti") for x in (rows, edges))
        large = by_levels(*(x.join(big, "run_id", "left_semi") for x in (rows, edges)), F.col("own"), step, "hash")
    found = stored(_hashed(small, links, total), "hashes")
    if not found.where("level < 0").isEmpty():
        raise ValueError("the graph has a cycle, or an edge from a node that isn't there")
    return found if large is None else found.union(large.select(found.columns))


def _hashed(rows: DataFrame, edges: DataFrame, total: int) -> DataFrame:
    """merkle() of runs that fit in a row; level -1 where a node's value can't be had. total: rows of both."""
    node, edge = "struct<node_id:string,kind:string,own:string>", "struct<source_id:string,target_id:string,relation:string>"
    tagged = rows.select("run_id", F.struct("node_id", "kind", "own").cast(node).alias("n"), F.lit(None).cast(edge).alias("e"))
    tagged = tagged.union(edges.select("run_id", F.lit(None).cast(node), F.struct("source_id", "target_id", "relation").cast(edge)))
    packed = tagged.repartition(parts_of(rows.sparkSession, total), "run_id").groupBy("run_id").agg(F.collect_list("n").alias("n"), F.collect_list("e").alias("e"))
    lists = packed.select("run_id", "n.node_id", "n.kind", "n.own", "e.source_id", "e.target_id", "e.relation")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, owns, *links = (batch.column(i).flatten().to_pylist() for i in (1, 3, 4, 5, 6))
            ends, last = (np.concatenate([[0], np.cumsum(batch.column(i).value_lengths().to_numpy(zero_copy_only=False))]).tolist() for i in (1, 4))
            levels, hashes = [], []
            for k in range(batch.num_rows):
                made = run_hashes(ids[ends[k] : ends[k + 1]], owns[ends[k] : ends[k + 1]], *(x[last[k] : last[k + 1]] for x in links))
                levels += made[0]
                hashes += made[1]
            whose = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(whose), batch.column(1).flatten(), batch.column(2).flatten(), pa.array(levels, pa.int32()), pa.array(hashes, pa.string())], ["run_id", "node_id", "kind", "level", "hash"])

    return lists.mapInArrow(run, f"run_id {dict(rows.dtypes)['run_id']}, node_id string, kind string, level int, hash string")


def run_levels(ids: list, sources: list, targets: list) -> tuple[list[int], list[int], list[list[tuple[int, int]]]]:
    """Of a run: each node's level (-1 on a cycle, and behind one or a missing node), the nodes that have one by level, and
    what each node derives from as (node, edge)."""
    at: dict[str, list[int]] = {}
    for i, name in enumerate(ids):
        if name is not None:
            at.setdefault(name, []).append(i)
    before: list[list[tuple[int, int]]] = [[] for _ in ids]
    after: list[list[int]] = [[] for _ in ids]
    lack = [0] * len(ids)
    for k, (source, target) in enumerate(zip(sources, targets)):
        for t in at.get(target, ()):
            lack[t] += 1
            found = at.get(source, ())
            if len(found) == 1:
                before[t].append((found[0], k))
                after[found[0]].append(t)
    levels, order, level = [-1] * len(ids), [], 0
    ready = [i for i, n in enumerate(lack) if n == 0]
    while ready:
        following = []
        for i in ready:
            levels[i] = level
            for t in after[i]:
                lack[t] -= 1
                if lack[t] == 0:
                    following.append(t)
        order += ready
        ready, level = following, level + 1
    return levels, order, before


def run_hashes(ids: list, owns: list, sources: list, targets: list, relations: list) -> tuple[list[int], list[str | None]]:
    """Level and Merkle hash of each node of a run; -1 and none on a cycle and behind one or a missing node."""
    levels, order, before = run_levels(ids, sources, targets)
    hashes = [None] * len(ids)
    for i in order:
        hashes[i] = owns[i]
        if before[i]:
            groups: dict[str, list[str]] = {}
            for j, k in before[i]:
                groups.setdefault(hashes[j][:2], []).append(f"{hashes[j]}:{relations[k] or ''}")
            met = sorted(g + hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for g, x in groups.items())
            hashes[i] = hashlib.sha256(f"{owns[i]}<{','.join(met)}".encode()).hexdigest()
    return levels, hashes


def fingerprints(hashes: DataFrame) -> DataFrame:
    """run_id, nodes, fingerprint of each run: over its nodes' ids and hashes, grouped, so times and order don't count."""
    one = F.concat("node_id", F.lit("="), "hash")
    groups = hashes.groupBy("run_id", F.substring("hash", 1, 2).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), ","), 256).alias("h"), F.count("*").alias("n"))
    return groups.groupBy("run_id").agg(F.sum("n").alias("nodes"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("g", "h"))), ","), 256).alias("fingerprint"))


def shared_subgraphs(hashes: DataFrame) -> DataFrame:
    """hash, kind, runs: subgraphs that several runs have in common."""
    rows = hashes.groupBy(F.unhex("hash").alias("h"), "kind").agg(F.countDistinct("run_id").alias("runs")).where("runs > 1")  # half the bytes in the shuffle
    return rows.select(F.lower(F.hex("h")).alias("hash"), "kind", "runs")


# --- replay --------------------------------------------------------------------------------------------------------


GONE, ALTERED = 1, 2  # evidence of a payload that isn't there or isn't what was recorded; 0: present
OPEN = {"i": pa.int32(), "node_id": pa.string(), "level": pa.int32(), "depth": pa.int32(), "formula": pa.string(), "was": pa.float64(), "known": pa.list_(pa.float64()), "open": pa.list_(pa.int32())}
FIRST = {"level": pa.int32(), "node_id": pa.string(), "was": pa.float64(), "now": pa.float64()}
SETTLED = (pa.int64(), pa.string(), pa.struct(list(FIRST.items())), pa.list_(pa.struct(list(OPEN.items()))))


def _key(sha256: Column) -> Column:
    """A hash as its 32 bytes, which are half of its text; any other text as more than 32 bytes."""
    return F.when(sha256.rlike("^[0-9a-f]{64}$"), F.unhex(sha256)).otherwise(F.concat(sha256.cast("binary"), F.lit(bytes(33))))


def verified(nodes: DataFrame, archive: DataFrame, read: Column) -> DataFrame:
    """run_id, node_id, was, evidence (0, GONE or ALTERED), read of each payload node. archive(sha256, content).

    Contents are hashed and read where they lie; of several under one hash that one counts which still has it.
    """
    whole = F.sha2("content", 256) == F.col("sha256")
    held = archive.where("content IS NOT NULL").select(_key(F.col("sha256")).alias("_s"), whole.alias("whole"), F.when(whole, read.cast("double")).alias("read"))
    held = held.groupBy("_s").agg(F.bool_or("whole").alias("whole"), F.max("read").alias("read"))
    was = F.try_element_at("attributes", F.lit("value")).cast("double")
    recorded = nodes.where("kind = 'raw_payload'").select("run_id", "node_id", was.alias("was"), _key(F.try_element_at("attributes", F.lit("sha256"))).alias("_k"))
    evidence = F.when(F.col("_s").isNull(), GONE).when(F.col("whole"), 0).otherwise(ALTERED).cast("byte")
    return recorded.join(held, F.col("_k") == F.col("_s"), "left").select("run_id", "node_id", "was", evidence.alias("evidence"), "read")


def replay(nodes: DataFrame, edges: DataFrame, archive: DataFrame, read: Column, formulas: dict[str, Column], versions: dict[str, str]) -> DataFrame:
    """One row a run: run_id, outcome, verified (payloads), node (the first whose value differs; its level, was, now).

    Values are doubles in the attribute `value`; payloads give `read` of their content. formulas are aggregates over
    _v, the values of what a node derives from, by the node's formula_id; a node without one hands on the only or, of
    several, the sum of its predecessors' values. Runs whose evidence is gone or altered, or whose formulas have another
    version by now, aren't recomputed: a difference would say nothing.

    A run is brought together once, as in merkle(), where its payloads' values become those of what derives from them; only
    values that formulas make go on, a level of formulas at a time. Nodes and edges that are dealt out by run_id to
    parts_of() partitions already stay where they are. Runs of more than SMALL nodes and edges are worked by levels.
    """
    total, big = _large(nodes, edges)
    if big is None:
        return _replayed(nodes, edges, verified(nodes, archive, read), formulas, versions, total)
    few, many = (tuple(x.join(big, "run_id", how) for x in (nodes, edges)) for how in ("left_anti", "left_semi"))
    small = _replayed(*few, verified(few[0], archive, read), formulas, versions, total)
    return small.union(_replayed_by_levels(*many, verified(many[0], archive, read), formulas, versions))


def _formula(versions: dict[str, str]) -> tuple[Column, Column]:
    """A node's formula, and whether it has another version by now."""
    now = F.create_map(*[F.lit(x) for kv in sorted(versions.items()) for x in kv]) if versions else F.create_map().cast("map<string,string>")
    formula, version = F.try_element_at("attributes", F.lit("formula_id")), F.try_element_at("attributes", F.lit("formula_version"))
    return formula, F.coalesce(F.col("kind") == "formula", F.lit(False)) & ~version.eqNullSafe(F.try_element_at(now, formula))


def _made(met: DataFrame, keys: list[str], formulas: dict[str, Column]) -> tuple[DataFrame, Column]:
    """Rows grouped by keys (formula is one), and what the formula makes of their _v."""
    value = F.col("_sum")
    for i, name in enumerate(formulas):
        value = F.when(F.col("formula") == name, F.col(f"_f_{i}")).otherwise(value)
    return met.groupBy(*keys).agg(F.sum("_v").alias("_sum"), *[x.alias(f"_f_{i}") for i, x in enumerate(formulas.values())]), value


def _outcome(runs: DataFrame, first: DataFrame) -> DataFrame:
    """runs: run_id, verified, reason; first: run_id, d."""
    outcome = F.coalesce("reason", F.when(F.col("d").isNotNull(), "output_differs").otherwise("identical"))
    seen = F.when(F.col("reason").isNull() | (F.col("reason") == "formula_changed"), F.col("verified")).otherwise(0)
    return runs.join(first, "run_id", "left").select("run_id", outcome.alias("outcome"), seen.alias("verified"), F.col("d.node_id").alias("node"), F.col("d.was").alias("was"), F.col("d.now").alias("now"))


def _replayed(nodes: DataFrame, edges: DataFrame, proof: DataFrame, formulas: dict[str, Column], versions: dict[str, str], total: int) -> DataFrame:
    """replay() of runs that fit in a row. total: nodes and edges."""
    formula, changed = _formula(versions)
    was = F.try_element_at("attributes", F.lit("value")).cast("double")
    node, edge = "struct<node_id:string,formula:string,was:double,evidence:tinyint,read:double,changed:boolean>", "struct<source_id:string,target_id:string>"
    none = lambda kind: F.lit(None).cast(kind)
    parts = parts_of(nodes.sparkSession, total)
    dealt = [
        nodes.where("NOT kind <=> 'raw_payload'").repartition(parts, "run_id").select("run_id", F.struct("node_id", formula, was, none("byte"), none("double"), changed).cast(node).alias("n"), none(edge).alias("e")),
        proof.repartition(parts, "run_id").select("run_id", F.struct("node_id", none("string"), "was", "evidence", "read", F.lit(False)).cast(node), none(edge)),
        edges.repartition(parts, "run_id").select("run_id", none(node), F.struct("source_id", "target_id").cast(edge)),
    ]
    packed = dealt[0].union(dealt[1]).union(dealt[2]).groupBy("run_id").agg(F.collect_list("n").alias("n"), F.collect_list("e").alias("e"))
    lists = packed.select("run_id", "n.node_id", "n.formula", "n.was", "n.evidence", "n.read", "n.changed", "e.source_id", "e.target_id")
    opened = "i int, node_id string, level int, depth int, formula string, was double, known array<double>, open array<int>"
    out = f"run_id {dict(nodes.dtypes)['run_id']}, verified long, reason string, d struct<level:int,node_id:string,was:double,now:double>, opened array<struct<{opened}>>"
    names = ["run_id", "verified", "reason", "d", "opened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).flatten().to_pylist() for i in range(1, 9)]
            ends, last = (np.concatenate([[0], np.cumsum(batch.column(i).value_lengths().to_numpy(zero_copy_only=False))]).tolist() for i in (1, 7))
            made = [settled(*(x[ends[k] : ends[k + 1]] for x in columns[:6]), *(x[last[k] : last[k + 1]] for x in columns[6:])) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in made], kind) for i, kind in enumerate(SETTLED))], names)

    runs = stored(lists.mapInArrow(run, out), "replayed")
    if not runs.where("reason = 'cycle'").isEmpty():
        raise ValueError("the graph has a cycle, or an edge from a node that isn't there")
    work = runs.select("run_id", F.explode("opened").alias("o")).select("run_id", "o.*")
    values: list[DataFrame] = []
    keys = ["run_id", "i", "node_id", "level", "formula", "was"]
    for depth in range(1, (work.agg(F.max("depth")).first()[0] or 0) + 1):
        rows = work.where(F.col("depth") == depth)
        met = rows.select(*keys, F.explode("known").alias("_v"))
        for sent in values:
            before = sent.select("run_id", F.col("i").alias("_j"), F.col("now").alias("_v"))
            met = met.union(rows.select(*keys, F.explode("open").alias("_j")).join(before, ["run_id", "_j"]).select(*keys, "_v"))
        grouped, value = _made(met, keys, formulas)
        differs = F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("now"))
        values.append(stored(grouped.withColumn("now", value).select("run_id", "i", "now", F.when(differs, F.struct("level", "node_id", "was", "now")).alias("d")), "values"))
    differ = runs.select("run_id", "d")
    for made in values:
        differ = differ.union(made.select("run_id", "d"))
    return _outcome(runs.select("run_id", "verified", "reason"), differ.where("d IS NOT NULL").groupBy("run_id").agg(F.min("d").alias("d")))


def settled(ids: list, formulas: list, was: list, evidence: list, read: list, changed: list, sources: list, targets: list) -> tuple[int, str | None, tuple | None, list[tuple]]:
    """Of a run: its payloads, why it isn't recomputed, the first node that differs of those whose value is known, and the
    nodes that formulas or sums make (OPEN): with the known values that they derive from, and the other nodes."""
    payloads = [x for x in evidence if x is not None]
    reason = "evidence_unavailable" if GONE in payloads else "evidence_tampered" if ALTERED in payloads else "formula_changed" if any(changed) else None
    if reason:
        return len(payloads), reason, None, []
    levels, order, before = run_levels(ids, sources, targets)
    if len(order) < len(ids):
        return len(payloads), "cycle", None, []
    depths, first, opened = [0] * len(ids), None, []
    for i in order:
        if evidence[i] is None and before[i]:
            depths[i] = 1 + max(depths[j] for j, _ in before[i])
            opened.append((i, ids[i], levels[i], depths[i], formulas[i], was[i], [read[j] for j, _ in before[i] if not depths[j]], [j for j, _ in before[i] if depths[j]]))
        elif was[i] is not None and was[i] != read[i] and not (was[i] != was[i] and read[i] is not None and read[i] != read[i]):
            if first is None or (levels[i], ids[i]) < first[:2]:
                first = (levels[i], ids[i], was[i], read[i])
    return len(payloads), None, first, opened


def _replayed_by_levels(nodes: DataFrame, edges: DataFrame, proof: DataFrame, formulas: dict[str, Column], versions: dict[str, str]) -> DataFrame:
    """replay() of runs of any size."""
    proof = stored(proof, "evidence")
    state = proof.groupBy("run_id").agg(F.count("*").alias("payloads"), F.count_if(F.col("evidence") == GONE).alias("gone"), F.count_if(F.col("evidence") == ALTERED).alias("bad"))
    formula, changed = _formula(versions)
    changes = nodes.groupBy("run_id").agg(F.count_if(changed).alias("changed"))
    runs = changes.join(state, "run_id", "left").fillna(0, ["payloads", "gone", "bad"])
    reason = F.when(F.col("gone") > 0, "evidence_unavailable").when(F.col("bad") > 0, "evidence_tampered").when(F.col("changed") > 0, "formula_changed")
    runs = stored(runs.select("run_id", F.col("payloads").alias("verified"), reason.alias("reason")), "runs")

    able = runs.where("reason IS NULL").select("run_id")
    was = F.try_element_at("attributes", F.lit("value")).cast("double")
    rows = nodes.join(able, "run_id", "left_semi").select("run_id", "node_id", formula.alias("formula"), was.alias("was"))
    rows = rows.join(proof.select("run_id", "node_id", F.col("read").alias("_read"), F.lit(True).alias("_payload")), ["run_id", "node_id"], "left")

    def step(met: DataFrame) -> DataFrame:
        made, value = _made(met, ["run_id", "node_id", "formula", "_read", "_payload"], formulas)
        return made.select("run_id", "node_id", F.when(F.col("_payload"), F.col("_read")).otherwise(value).alias("now"))

    values = by_levels(rows, edges.join(able, "run_id", "left_semi"), F.when(F.col("_payload"), F.col("_read")), step, "now")
    differ = values.where(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("now")))
    return _outcome(runs, differ.groupBy("run_id").agg(F.min(F.struct("level", "node_id", "was", "now")).alias("d")))
