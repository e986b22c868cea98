"""Evidence checks, conflict resolution, verdicts, provenance graphs and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.timeq import age_seconds, in_box

MAX_AGE_HOURS, MIN_EVIDENCE, IRRECONCILABLE = 12.0, 2, 4.0


def check_row(name: str, severity: str, passed: Column, observed: Column) -> list[Column]:
    return [F.lit(name).alias("check"), F.lit(severity).alias("severity"), passed.alias("passed"), observed.cast("long").alias("observed")]


def freshness(items: DataFrame, by: str, now: Column, cadence_hours: Column | None = None) -> DataFrame:
    """Every item within min(its cadence, 12 h); no items at all blocks."""
    limit = F.least(F.coalesce(cadence_hours, F.lit(MAX_AGE_HOURS)), F.lit(MAX_AGE_HOURS)) * 3600 if cadence_hours is not None else F.lit(MAX_AGE_HOURS * 3600)
    stale = (age_seconds(F.col("issued_time"), now) > limit).cast("long")
    n = items.groupBy(by).agg(F.count("*").alias("n"), F.sum(stale).alias("bad"))
    return n.select(by, *check_row("freshness", "blocking", (F.col("n") > 0) & (F.col("bad") == 0), F.col("bad")))


def missing_data(items: DataFrame, by: str, required: list[str]) -> DataFrame:
    """Required variables without any value."""
    wanted = F.array(*map(F.lit, sorted(required)))
    there = items.groupBy(by).agg(F.collect_set(F.when(F.col("value").isNotNull(), F.col("variable"))).alias("got"))
    gone = F.size(F.array_except(wanted, "got"))
    return there.select(by, *check_row("missing_data", "blocking", gone == 0, gone))


def sufficiency(items: DataFrame, by: str, least: int = MIN_EVIDENCE) -> DataFrame:
    n = items.groupBy(by).agg(F.count("*").alias("n"))
    return n.select(by, *check_row("sufficiency", "blocking", F.col("n") >= least, F.col("n")))


def source_validity(items: DataFrame, by: str, known: list[str]) -> DataFrame:
    """Items of sources outside the allow-list."""
    bad = F.sum((~F.col("source").isin(known)).cast("long"))
    n = items.groupBy(by).agg(bad.alias("bad"))
    return n.select(by, *check_row("source_validity", "blocking", F.col("bad") == 0, F.col("bad")))


def spatial_consistency(items: DataFrame, by: str, box: tuple[float, float, float, float], tolerance: float = 1.0) -> DataFrame:
    """Located items outside the box and its margin: a warning; nothing located passes."""
    out = (F.col("lat").isNotNull() & ~in_box(F.col("lat"), F.col("lon"), *box, tolerance)).cast("long")
    n = items.groupBy(by).agg(F.sum(out).alias("bad"))
    return n.select(by, *check_row("spatial", "warning", F.col("bad") == 0, F.col("bad")))


def resolve_conflicts(readings: DataFrame, by: list[str], threshold: Column) -> DataFrame:
    """Per group the most reliable reading (ties: source), the interval of all, and whether they can be reconciled. Never an average."""
    best = F.min_by(F.struct("source", "value"), F.struct((-F.col("reliability")).alias("r"), F.col("source").alias("s")))
    rows = readings.groupBy(*by).agg(best.alias("b"), F.min("value").alias("lower"), F.max("value").alias("upper"), F.count("*").alias("n"), F.first(threshold).alias("threshold"))
    spread = F.col("upper") - F.col("lower")
    return rows.select(*by, F.col("b.source").alias("chosen_source"), F.col("b.value").alias("chosen_value"), "lower", "upper", "n", ((F.col("n") > 1) & (spread > F.col("threshold"))).alias("conflict"), ((F.col("n") > 1) & (spread > IRRECONCILABLE * F.col("threshold"))).alias("irreconcilable"))


def disagreement(resolved: DataFrame, by: str) -> DataFrame:
    bad = resolved.groupBy(by).agg(F.sum(F.col("conflict").cast("long")).alias("c"), F.max("irreconcilable").alias("i"))
    return bad.select(by, F.lit("disagreement").alias("check"), F.when(F.col("i"), "blocking").otherwise("warning").alias("severity"), (F.col("c") == 0).alias("passed"), F.col("c").alias("observed"))


def verdict(checks: DataFrame, by: str) -> DataFrame:
    """A failed blocking check abstains, a failed warning makes caveats, else answer."""
    failed = checks.groupBy(by).agg(
        F.coalesce(F.bool_or(~F.col("passed") & (F.col("severity") == "blocking")), F.lit(False)).alias("blocks"),
        F.sum((~F.col("passed") & (F.col("severity") == "warning")).cast("long")).alias("caveats"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed") & (F.col("severity") == "blocking"), F.col("check")))), ",").alias("reasons"),
    )
    status = F.when(F.col("blocks"), "abstain").when(F.col("caveats") > 0, "caveated").otherwise("answer")
    return failed.select(by, status.alias("status"), "caveats", "reasons")


def bad_edges(nodes: DataFrame, edges: DataFrame, order: Column) -> DataFrame:
    """Edges that dangle, or lead to an earlier kind."""
    n = nodes.select("run_id", "node_id", order.alias("at"))
    a = n.select("run_id", F.col("node_id").alias("source_id"), F.col("at").alias("from_at"))
    b = n.select("run_id", F.col("node_id").alias("target_id"), F.col("at").alias("to_at"))
    joined = edges.join(a, ["run_id", "source_id"], "left").join(b, ["run_id", "target_id"], "left")
    return joined.where("from_at IS NULL OR to_at IS NULL OR to_at < from_at")


def graph_fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, fingerprint: order-free and time-free."""
    a = nodes.select("run_id", F.concat_ws("|", F.lit("n"), "node_id", "kind", "label").alias("x"))
    b = edges.select("run_id", F.concat_ws("|", F.lit("e"), "source_id", "target_id", "relation").alias("x"))
    return a.union(b).groupBy("run_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256).alias("fingerprint"))


def runs_using(nodes: DataFrame, path: str, value: str) -> DataFrame:
    """Distinct runs with a node whose JSON attribute equals a value."""
    return nodes.where(F.get_json_object("attributes", path) == value).select("run_id").distinct()


def output_diff(original: DataFrame, replayed: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of either side whose values differ; null equals null."""
    a, b = original.select(F.col(key).alias("a"), F.col(value).alias("was")), replayed.select(F.col(key).alias("b"), F.col(value).alias("now"))
    return a.join(b, F.col("a") == F.col("b"), "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select(F.coalesce("a", "b").alias(key), "was", "now")


def replay_outcome(payloads: DataFrame, archive: DataFrame, changed_formulas: int, differing: int) -> DataFrame:
    """One row: evidence_unavailable, evidence_tampered, formula_changed, output_differs or identical."""
    held = payloads.select("sha256").join(archive.select(F.col("sha256").alias("id"), F.sha2("content", 256).alias("real")), F.col("sha256") == F.col("id"), "left")
    n = held.agg(F.count_if(F.col("id").isNull()).alias("gone"), F.count_if(F.col("real") != F.col("sha256")).alias("bad"))
    return n.select(F.when(F.col("gone") > 0, "evidence_unavailable").when(F.col("bad") > 0, "evidence_tampered").when(F.lit(changed_formulas > 0), "formula_changed").when(F.lit(differing > 0), "output_differs").otherwise("identical").alias("outcome"))


def running_budget(entries: DataFrame, by: str, order: list[str], calls: Column, tokens: Column, seconds: Column, most: tuple[float, float, float]) -> DataFrame:
    """Running sums and the first dimension over its ceiling (asked in the order calls, tokens, seconds; strictly over)."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = entries.withColumn("calls", F.sum(calls).over(w)).withColumn("tokens", F.sum(tokens).over(w)).withColumn("seconds", F.sum(seconds).over(w))
    return rows.withColumn("exhausted", F.when(F.col("calls") > most[0], "api_calls").when(F.col("tokens") > most[1], "tokens").when(F.col("seconds") > most[2], "wall_clock"))
