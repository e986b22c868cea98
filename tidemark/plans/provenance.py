"""Queries over provenance of alerts and replays, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import provenance
from tidemark.operators.records import DATASET_OF
from tidemark.plans.catalogue import SQL, query, vessel_rules
from tidemark.sources.views import view

_SHA = "CASE WHEN rule <> 'lightning' THEN sha256(rule || '-' || (vessel_id % 50)) END"


def _alert_results(spark: SparkSession, d: str) -> DataFrame:
    """The rules of all vessels; lightning reads no payload."""
    v = vessel_rules(spark, d)
    text = lambda c: F.col(c).cast("string")
    sha = F.when(F.col("rule") != "lightning", F.sha2(F.concat("rule", F.lit("-"), (F.col("vessel_id") % 50).cast("string")), 256))
    return v.select(F.concat_ws(":", F.lit("run"), text("vessel_id"), "rule").alias("run_id"), F.concat(F.lit("u"), (F.col("vessel_id") % 200).cast("string")).alias("user_id"), "rule", "outcome", text("severity").alias("observed"), F.lit("t1").alias("threshold"), F.lit("classes").alias("threshold_source"), sha.alias("payload_sha256"))


def _merkle_sql() -> str:
    pairs = lambda kv: f"'{len(kv)};' || array_to_string(list_sort([" + ", ".join(f"'{len(k)}:{k}' || length({v}) || ':' || {v}" for k, v in kv.items()) + "]), '')"
    own = lambda kind, label, kv: f"sha256('{kind}|' || length({label}) || '|' || {label} || '|' || {pairs(kv)})"
    on = lambda own_, before: f"sha256({own_} || '<' || substr({before}, 1, 2) || sha256({before} || ':derives'))"
    dataset = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DATASET_OF.items()) + " END"
    return f"""WITH v AS ({SQL['vessel_rules']}), r AS (SELECT 'run:' || vessel_id || ':' || rule AS run_id, 'u' || (vessel_id % 200) AS user_id, rule, outcome, severity, {dataset} AS ds, {_SHA} AS sha FROM v),
 a AS (SELECT *, {own('dataset', 'ds', {'dataset_id': 'ds', 'threshold_source': "'classes'"})} AS h0 FROM r),
 b AS (SELECT *, CASE WHEN sha IS NOT NULL THEN {on(own('raw_payload', "'archived upstream payload'", {'sha256': 'sha'}), 'h0')} END AS h1 FROM a),
 c AS (SELECT *, {on(own('agent', "'alert scheduler'", {'user_id': 'user_id'}), 'coalesce(h1, h0)')} AS h2 FROM b),
 e AS (SELECT *, {on(own('formula', 'rule', {'formula_id': f"'{provenance.ALERT_FORMULA}'", 'formula_version': f"'{provenance.ALERT_VERSION}'", 'rule': 'rule', 'threshold': "'t1'", 'threshold_source': "'classes'"}), 'h2')} AS h3 FROM c),
 f AS (SELECT *, {on(own('output', "rule || ' outcome'", {'outcome': 'outcome', 'observed': 'severity'}), 'h3')} AS h4 FROM e),
 h AS (SELECT run_id, unnest(['dataset', 'raw_payload', 'agent', 'formula', 'output']) AS kind, unnest([h0, h1, h2, h3, h4]) AS hash FROM f)"""


def _graphs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return provenance.alert_graphs(_alert_results(spark, d))


@query("alert_provenance", _merkle_sql() + " SELECT run_id, kind, hash FROM h WHERE hash IS NOT NULL")
def alert_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The chain behind every result, each node with its Merkle hash."""
    return provenance.merkle(*_graphs(spark, d)).select("run_id", "kind", "hash")


@query("shared_provenance", _merkle_sql() + ", s AS (SELECT kind, hash, count(DISTINCT run_id) AS runs FROM h WHERE hash IS NOT NULL GROUP BY ALL HAVING count(DISTINCT run_id) > 1) SELECT kind, count(*) AS subgraphs, CAST(sum(runs) AS BIGINT) AS runs FROM s GROUP BY kind")
def shared_provenance(spark: SparkSession, d: str) -> DataFrame:
    """How many subgraphs several runs share, by the kind that they end in."""
    shared = provenance.shared_subgraphs(provenance.merkle(*_graphs(spark, d)))
    return shared.groupBy("kind").agg(F.count("*").alias("subgraphs"), F.sum("runs").alias("runs"))


# --- replay: a run an order, its payloads the order's lines ------------------------------------------------------------


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and archive. Payloads say what a line weighs; formulas take their sum and their maximum, the output is
    the one less the other. Of some orders payloads are gone or altered, formulas old, or recorded values wrong."""
    lines = view(spark, d, "lineitem")
    parts = provenance.parts_of(spark, 5 * lines.count())  # about five nodes and edges a line
    lines = lines.select(F.col("l_orderkey").alias("run_id"), "l_linenumber", (F.col("l_partkey") % 97 + 1).cast("long").alias("w")).repartition(parts, "run_id").distinct()
    body = F.format_string('{"order":%d,"line":%d,"weight":%d}', "run_id", "l_linenumber", "w")
    lines = lines.select("run_id", body.alias("body"), F.col("w").cast("double").alias("w")).withColumn("sha", F.sha2("body", 256))
    total = lines.groupBy("run_id").agg(F.sum("w").alias("s"), F.max("w").alias("m"))
    r = F.col("run_id")
    attributes = lambda **kv: F.map_from_arrays(F.array(*map(F.lit, kv)), F.array(*[v.cast("string") for v in kv.values()])).alias("attributes")
    node = lambda id_, kind, a: F.struct(id_.alias("node_id"), F.lit(kind).alias("kind"), F.lit(kind).alias("label"), a)
    version = F.when(r % 43 == 0, "0.9").otherwise("1.0")
    fixed = F.array(
        node(F.lit("dataset"), "dataset", attributes(dataset_id=F.lit("lines"))),
        node(F.lit("formula:peak"), "formula", attributes(formula_id=F.lit("peak"), formula_version=version, value=F.col("m") + F.when(r % 53 == 0, 1.0).otherwise(0.0))),
        node(F.lit("formula:sum"), "formula", attributes(formula_id=F.lit("sum"), formula_version=version, value=F.col("s"))),
        node(F.lit("out"), "output", attributes(formula_id=F.lit("rest"), value=F.col("s") - F.col("m") + F.when(r % 47 == 0, 1.0).otherwise(0.0))),
    )
    payload = node(F.concat(F.lit("payload:"), F.substring("sha", 1, 16)), "raw_payload", attributes(sha256=F.col("sha")))
    nodes = total.select("run_id", F.explode(fixed).alias("n")).union(lines.select("run_id", payload.alias("n"))).select("run_id", "n.*")
    edge = lambda a, b: F.struct(a.alias("source_id"), b.alias("target_id"))
    p = F.concat(F.lit("payload:"), F.substring("sha", 1, 16))
    edges = lines.select("run_id", F.explode(F.array(edge(F.lit("dataset"), p), edge(p, F.lit("formula:sum")), edge(p, F.lit("formula:peak")))).alias("e"))
    edges = edges.union(total.select("run_id", F.explode(F.array(edge(F.lit("formula:sum"), F.lit("out")), edge(F.lit("formula:peak"), F.lit("out")))).alias("e"))).select("run_id", "e.*", F.lit("derives").alias("relation"))
    archive = lines.where(r % 37 != 0).select(F.col("sha").alias("sha256"), F.when(r % 41 == 0, F.concat("body", F.lit(" "))).otherwise(F.col("body")).cast("binary").alias("content"))
    return nodes, edges, archive


@query("replay_runs", """WITH l AS (SELECT DISTINCT l_orderkey AS r, l_linenumber, l_partkey % 97 + 1 AS w FROM lineitem), t AS (SELECT r, count(*) AS n, sum(w) AS s, max(w) AS m FROM l GROUP BY r)
 SELECT r AS run_id, CASE WHEN r % 37 = 0 THEN 'evidence_unavailable' WHEN r % 41 = 0 THEN 'evidence_tampered' WHEN r % 43 = 0 THEN 'formula_changed' WHEN r % 53 = 0 OR r % 47 = 0 THEN 'output_differs' ELSE 'identical' END AS outcome,
 CASE WHEN r % 37 = 0 OR r % 41 = 0 THEN 0 ELSE n END AS verified, CASE WHEN r % 37 = 0 OR r % 41 = 0 OR r % 43 = 0 THEN NULL WHEN r % 53 = 0 THEN 'formula:peak' WHEN r % 47 = 0 THEN 'out' END AS node FROM t""")  # fmt: skip
def replay_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every order's run computed again from its archived lines, and where it first differs."""
    nodes, edges, archive = _runs(spark, d)
    v = F.col("_v")
    made = {"sum": F.sum(v), "peak": F.max(v), "rest": F.max(v) - F.when(F.count(v) > 1, F.min(v)).otherwise(0.0)}
    weight = F.get_json_object(F.decode("content", "UTF-8"), "$.weight")
    return provenance.replay(nodes, edges, archive, weight, made, {"sum": "1.0", "peak": "1.0"}).select("run_id", "outcome", "verified", "node")
