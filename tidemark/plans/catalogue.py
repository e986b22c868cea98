"""The engine's own queries and their SQL, by name. Views are those of sources/views.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import alerts as A
from tidemark.functions import geo, kernels
from tidemark.functions import text as T
from tidemark.functions.timeq import in_season
from tidemark.operators import asof, catalog, retrieve, route, sessions, spatial, trust, zones
from tidemark.sources import dimensions as dim
from tidemark.sources.store import new_path, remove
from tidemark.sources.views import cte, view
from tidemark.streaming import alerts as machine
from tidemark.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2024-01-20 00:00:00"
BOX = (5.0, 9.0, 77.0, 80.0)
OBS = ["variable", "source", "valid_time", "issued_time", "lat", "lon", "value", "event_id"]


def ntz(text: str = NOW) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from tidemark.plans import advice, archives, indexes, lifecycle, messages, places, provenance, records, watch  # noqa: F401  register their queries here

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return SQL


# --- bitemporal observations ---------------------------------------------------------------------------------------

_AS_OF = cte("obs") + f", k AS (SELECT *, coalesce(depth_m, -1.0) AS depth_key FROM obs WHERE issued_time <= TIMESTAMP '{NOW}'"


@query("asof_events", _AS_OF + ") SELECT DISTINCT ON (source, variable, valid_time, lat, lon, depth_key) variable, source, valid_time, issued_time, lat, lon, value, event_id FROM k ORDER BY source, variable, valid_time, lat, lon, depth_key, issued_time DESC, event_id DESC")
def asof_events(spark: SparkSession, d: str) -> DataFrame:
    return asof.as_of(view(spark, d, "obs"), ntz()).select(*OBS)


@query("as_of_latest", _AS_OF + ") SELECT DISTINCT ON (variable, source, valid_time) variable, source, valid_time, issued_time, lat, lon, value, event_id FROM k ORDER BY variable, source, valid_time, issued_time DESC, event_id DESC")
def as_of_latest(spark: SparkSession, d: str) -> DataFrame:
    return asof.as_of(view(spark, d, "obs"), ntz(), key=("variable", "source", "valid_time")).select(*OBS)


@query("as_of_by_source", _AS_OF + " AND source = 'src1') SELECT DISTINCT ON (variable, source, valid_time) variable, source, valid_time, issued_time, lat, lon, value, event_id FROM k ORDER BY variable, source, valid_time, issued_time DESC, event_id DESC")
def as_of_by_source(spark: SparkSession, d: str) -> DataFrame:
    return asof.as_of(view(spark, d, "obs"), ntz(), key=("variable", "source", "valid_time"), source="src1").select(*OBS)


@query("latest_issue", cte("obs") + f" SELECT variable, source, max(issued_time) AS latest, count(*) AS n FROM obs WHERE issued_time <= TIMESTAMP '{NOW}' GROUP BY ALL")
def latest_issue(spark: SparkSession, d: str) -> DataFrame:
    return asof.latest_issue(view(spark, d, "obs"), ntz())


@query("obs_bbox_window", cte("obs") + " SELECT variable, source, valid_time, issued_time, lat, lon, value, event_id FROM obs WHERE variable IN ('click', 'view') AND valid_time >= TIMESTAMP '2024-01-05' AND valid_time < TIMESTAMP '2024-01-12' AND lat BETWEEN 5.0 AND 9.0 AND lon BETWEEN 77.0 AND 80.0")
def obs_bbox_window(spark: SparkSession, d: str) -> DataFrame:
    return asof.scan(view(spark, d, "obs"), asof.ScanSpec(BOX, "2024-01-05", "2024-01-12", frozenset({"click", "view"}))).select(*OBS)


_LIMIT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(dim.CADENCE_HOURS.items())) + " END"
_STALE = f"coalesce(epoch_us(TIMESTAMP '{NOW}') - epoch_us(issued_time) > {_LIMIT} * 3600000000, false)"


@query("stale_split", cte("obs") + f" SELECT source, variable, {_STALE} AS stale, count(*) AS n FROM obs GROUP BY ALL")
def stale_split(spark: SparkSession, d: str) -> DataFrame:
    return asof.with_staleness(view(spark, d, "obs"), dim.CADENCE_HOURS, ntz()).groupBy("source", "variable", "stale").agg(F.count("*").alias("n"))


RANKS = {"src0": 1, "src1": 2, "src2": 3, "src3": 1, "src4": 4}
_RANK = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(RANKS.items())) + " ELSE 5 END"


@query("fallback_resolve", cte("obs") + f", f AS (SELECT *, dense_rank() OVER (PARTITION BY variable ORDER BY {_RANK}, source) AS r FROM obs WHERE NOT {_STALE}) SELECT variable, source, event_id, value FROM f WHERE r = 1")
def fallback_resolve(spark: SparkSession, d: str) -> DataFrame:
    return asof.fallback(view(spark, d, "obs"), RANKS, dim.CADENCE_HOURS, ntz()).select("variable", "source", "event_id", "value")


@query("source_attempts", cte("obs") + f" SELECT source, count(*) AS n_rows, CAST(sum(CASE WHEN {_STALE} THEN 1 ELSE 0 END) AS BIGINT) AS n_stale, max(issued_time) AS newest, CASE WHEN bool_and({_STALE}) THEN 'stale' ELSE 'success' END AS outcome FROM obs GROUP BY source")
def source_attempts(spark: SparkSession, d: str) -> DataFrame:
    return asof.attempts(view(spark, d, "obs"), dim.CADENCE_HOURS, ntz())


@query("quarantine_counts", cte("obs") + " SELECT variable, CASE WHEN quality = 'missing' AND value IS NOT NULL THEN 'missing_with_value' WHEN quality <> 'missing' AND value IS NULL THEN 'value_without_missing' ELSE 'valid' END AS reason, count(*) AS n FROM obs GROUP BY ALL")
def quarantine_counts(spark: SparkSession, d: str) -> DataFrame:
    good, bad = asof.split_expectation(view(spark, d, "obs"), asof.quarantine_reason())
    return good.withColumn("reason", F.lit("valid")).unionByName(bad).groupBy("variable", "reason").agg(F.count("*").alias("n"))


_MERGE_KEY = ("variable", "source", "valid_time")


@query("upsert_merge", cte("obs") + """, s AS (SELECT *, CAST(event_id % 2 AS INTEGER) AS fresh FROM obs),
 r AS (SELECT *, row_number() OVER (PARTITION BY variable, source, valid_time ORDER BY fresh DESC, event_id DESC) AS n, first_value(dataset_id) OVER (PARTITION BY variable, source, valid_time ORDER BY fresh, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_dataset FROM s)
 SELECT variable, source, valid_time, event_id, value, first_dataset AS dataset_id FROM r WHERE n = 1""")  # fmt: skip
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    obs = view(spark, d, "obs").select("variable", "source", "valid_time", "event_id", "value", "dataset_id")
    return asof.upsert(obs.where("event_id % 2 = 0"), obs.where("event_id % 2 = 1"), _MERGE_KEY, "event_id", keep_first=("dataset_id",))


@query("as_of_join_orders", "SELECT l.event_id, r.event_id AS last_purchase FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') l ASOF LEFT JOIN (SELECT max(event_id) AS event_id, user_id, ts FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) r ON l.user_id = r.user_id AND l.ts >= r.ts")
def as_of_join_orders(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return asof.as_of_join(e.where("event_type = 'view'").drop("event_type"), right, ["user_id"], "ts", "ts", ["event_id"]).select("event_id", F.col("_r_event_id").alias("last_purchase"))


@query("chunk_replace", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS version FROM documents")
def chunk_replace(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "documents").select("doc_id")
    return asof.replace_by_key(docs.withColumn("version", F.lit(0)), docs.where("doc_id % 3 = 0").withColumn("version", F.lit(1)), "doc_id")


# --- dataset registry, seasons -------------------------------------------------------------------------------------

_REGISTRY = f"""{cte('registry')}, j AS (SELECT *, CASE WHEN NOT list_contains(variables, 'click') THEN 'variable_not_served' WHEN NOT (south <= 9.0 AND north >= 5.0 AND west <= 80.0 AND east >= 77.0) THEN 'outside_coverage'
 WHEN NOT ((starts IS NULL OR CAST(starts AS DATE) <= DATE '2024-01-20') AND (ends IS NULL OR DATE '2024-01-20' <= CAST(ends AS DATE))) THEN 'outside_temporal_coverage' WHEN cost > 5.0 THEN 'over_budget' WHEN requires_auth THEN 'requires_auth' END AS reason FROM registry)"""  # fmt: skip


def _registry(spark: SparkSession, d: str) -> tuple:
    return view(spark, d, "registry"), "click", BOX, F.lit("2024-01-20").cast("date"), 5.0


@query("registry_select", _REGISTRY + " SELECT row_number() OVER (ORDER BY authority_rank, reliability_prior DESC, cost, dataset_id) AS place, dataset_id, source_id FROM j WHERE reason IS NULL")
def registry_select(spark: SparkSession, d: str) -> DataFrame:
    order = W.orderBy("authority_rank", F.desc("reliability_prior"), "cost", "dataset_id")
    return catalog.select(*_registry(spark, d)).select(F.row_number().over(order).cast("long").alias("place"), "dataset_id", "source_id")


@query("registry_rejections", _REGISTRY + " SELECT dataset_id, reason FROM j WHERE reason IS NOT NULL")
def registry_rejections(spark: SparkSession, d: str) -> DataFrame:
    return catalog.judged(*_registry(spark, d)).where("reason IS NOT NULL").select("dataset_id", "reason")


_BANS = "b(ban_id, jurisdiction, m1, d1, m2, d2, severity) AS (VALUES " + ", ".join(map(str, dim.BANS)) + ")"


@query("seasonal_bans", f"WITH {_BANS} SELECT ban_id, o_orderpriority AS priority, count(*) AS n FROM orders JOIN b ON concat('J', CAST(o_custkey % 4 AS VARCHAR)) = jurisdiction WHERE CASE WHEN m1 * 100 + d1 <= m2 * 100 + d2 THEN month(o_orderdate) * 100 + day(o_orderdate) BETWEEN m1 * 100 + d1 AND m2 * 100 + d2 ELSE month(o_orderdate) * 100 + day(o_orderdate) >= m1 * 100 + d1 OR month(o_orderdate) * 100 + day(o_orderdate) <= m2 * 100 + d2 END GROUP BY ALL")
def seasonal_bans(spark: SparkSession, d: str) -> DataFrame:
    orders = view(spark, d, "orders").select(F.concat(F.lit("J"), (F.col("o_custkey") % 4).cast("string")).alias("jurisdiction"), "o_orderdate", F.col("o_orderpriority").alias("priority"))
    hit = orders.join(F.broadcast(dim.bans(spark)), "jurisdiction").where(in_season(F.col("o_orderdate"), F.col("m1"), F.col("d1"), F.col("m2"), F.col("d2")))
    return hit.groupBy("ban_id", "priority").agg(F.count("*").alias("n"))


# --- evidence checks and trust -------------------------------------------------------------------------------------


def _items(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "obs").withColumn("request", F.concat_ws("|", F.col("variable"), F.col("valid_time").cast("date").cast("string")))


_ITEMS = cte("obs") + ", i AS (SELECT *, concat_ws('|', variable, CAST(CAST(valid_time AS DATE) AS VARCHAR)) AS request FROM obs)"


def _check_sql(name: str, severity: str, passed: str, observed: str) -> str:
    return f"{_ITEMS} SELECT request, '{name}' AS \"check\", '{severity}' AS severity, {passed} AS passed, CAST({observed} AS BIGINT) AS observed FROM i GROUP BY request"


_OLD = f"sum(CASE WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(issued_time) > 43200000000 THEN 1 ELSE 0 END)"
_OUTSIDE = "sum(CASE WHEN NOT (lat BETWEEN 4.0 AND 10.0 AND lon BETWEEN 76.0 AND 81.0) THEN 1 ELSE 0 END)"


@query("freshness_check", _check_sql("freshness", "blocking", f"{_OLD} = 0", _OLD))
def freshness_check(spark: SparkSession, d: str) -> DataFrame:
    return trust.freshness(_items(spark, d), "request", ntz())


@query("missing_check", f"{cte('obs')} SELECT source, 'missing_data' AS \"check\", 'blocking' AS severity, count(DISTINCT variable) FILTER (value IS NOT NULL AND variable IN ('click', 'purchase', 'storm')) = 3 AS passed, 3 - count(DISTINCT variable) FILTER (value IS NOT NULL AND variable IN ('click', 'purchase', 'storm')) AS observed FROM obs GROUP BY source")
def missing_check(spark: SparkSession, d: str) -> DataFrame:
    return trust.missing_data(view(spark, d, "obs"), "source", ["click", "purchase", "storm"])


@query("sufficiency_check", _check_sql("sufficiency", "blocking", "count(*) >= 2", "count(*)"))
def sufficiency_check(spark: SparkSession, d: str) -> DataFrame:
    return trust.sufficiency(_items(spark, d), "request")


_UNKNOWN = "sum(CASE WHEN source NOT IN ('src0', 'src1', 'src2') THEN 1 ELSE 0 END)"


@query("source_check", _check_sql("source_validity", "blocking", f"{_UNKNOWN} = 0", _UNKNOWN))
def source_check(spark: SparkSession, d: str) -> DataFrame:
    return trust.source_validity(_items(spark, d), "request", ["src0", "src1", "src2"])


@query("spatial_check", _check_sql("spatial", "warning", f"{_OUTSIDE} = 0", _OUTSIDE))
def spatial_check(spark: SparkSession, d: str) -> DataFrame:
    return trust.spatial_consistency(_items(spark, d), "request", BOX)


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """Latest value per variable, day and source."""
    rows = asof.as_of(view(spark, d, "obs").where("value IS NOT NULL"), ntz(), key=("variable", "valid_time", "source"))
    return rows.select("variable", "valid_time", "source", "value", ((F.lit(10) - F.col("user_id") % 5) / F.lit(16.0)).alias("reliability"))


_READINGS = cte("obs") + f", readings AS (SELECT DISTINCT ON (variable, valid_time, source) variable, valid_time, source, value, (10 - user_id % 5) / 16.0 AS reliability FROM obs WHERE value IS NOT NULL AND issued_time <= TIMESTAMP '{NOW}' ORDER BY variable, valid_time, source, issued_time DESC, event_id DESC)"
_CONFLICT = f"""{_READINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY variable, valid_time ORDER BY reliability DESC, source) AS k FROM readings),
 c AS (SELECT variable, valid_time, max(source) FILTER (k = 1) AS chosen_source, max(value) FILTER (k = 1) AS chosen_value, min(value) AS lower, max(value) AS upper, count(*) AS n FROM r GROUP BY ALL)"""
_CONFLICTS = _CONFLICT + " SELECT *, n > 1 AND upper - lower > 20.0 AS conflict, n > 1 AND upper - lower > 80.0 AS irreconcilable FROM c"


@query("conflict_resolve", _CONFLICTS)
def conflict_resolve(spark: SparkSession, d: str) -> DataFrame:
    return trust.resolve_conflicts(_readings(spark, d), ["variable", "valid_time"], F.lit(20.0))


@query("disagreement_check", _CONFLICT + " SELECT variable, 'disagreement' AS \"check\", CASE WHEN bool_or(n > 1 AND upper - lower > 80.0) THEN 'blocking' ELSE 'warning' END AS severity, count(*) FILTER (n > 1 AND upper - lower > 20.0) = 0 AS passed, count(*) FILTER (n > 1 AND upper - lower > 20.0) AS observed FROM c GROUP BY variable")
def disagreement_check(spark: SparkSession, d: str) -> DataFrame:
    return trust.disagreement(conflict_resolve(spark, d), "variable")


@query("verdict_rollup", f"""{_ITEMS}, c AS (SELECT request, {_OLD} > 0 AS stale, count(*) < 2 AS few, {_UNKNOWN} > 0 AS unknown, {_OUTSIDE} > 0 AS outside FROM i GROUP BY request)
 SELECT request, CASE WHEN stale OR few OR unknown THEN 'abstain' WHEN outside THEN 'caveated' ELSE 'answer' END AS status, CAST(CASE WHEN outside THEN 1 ELSE 0 END AS BIGINT) AS caveats,
 concat_ws(',', CASE WHEN stale THEN 'freshness' END, CASE WHEN unknown THEN 'source_validity' END, CASE WHEN few THEN 'sufficiency' END) AS reasons FROM c""")  # fmt: skip
def verdict_rollup(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    every = [trust.freshness(items, "request", ntz()), trust.sufficiency(items, "request"), trust.source_validity(items, "request", ["src0", "src1", "src2"]), trust.spatial_consistency(items, "request", BOX)]
    checks = every[0]
    for c in every[1:]:
        checks = checks.unionByName(c)
    return trust.verdict(checks, "request")


@query("replay_diff", "SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderstatus AS was, b.o_orderstatus AS now FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0) b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus")
def replay_diff(spark: SparkSession, d: str) -> DataFrame:
    orders = view(spark, d, "orders")
    again = orders.where("o_orderkey % 4 <> 0").withColumn("o_orderstatus", F.when(F.col("o_custkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return trust.output_diff(orders.where("o_orderkey % 3 <> 0"), again, "o_orderkey", "o_orderstatus")


@query("runs_using_payload", "SELECT DISTINCT user_id AS run_id FROM events WHERE CAST(props ->> '$.k' AS VARCHAR) = '7'")
def runs_using_payload(spark: SparkSession, d: str) -> DataFrame:
    return trust.runs_using(view(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("props").alias("attributes")), "$.k", "7")


@query("content_hash_dupes", "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_hash_dupes(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "documents").where("text IS NOT NULL")
    return docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


_BUDGET = "sum(l_linenumber) OVER w AS calls, CAST(sum(l_partkey) OVER w AS BIGINT) AS tokens, CAST(sum(l_suppkey) OVER w AS BIGINT) AS seconds"


@query("budget_running", f"WITH b AS (SELECT l_orderkey, l_linenumber, {_BUDGET} FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)) SELECT l_orderkey, l_linenumber, CAST(calls AS BIGINT) AS calls, tokens, seconds, CASE WHEN calls > 10 THEN 'api_calls' WHEN tokens > 2000 THEN 'tokens' WHEN seconds > 200 THEN 'wall_clock' END AS exhausted FROM b")
def budget_running(spark: SparkSession, d: str) -> DataFrame:
    rows = trust.running_budget(view(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_linenumber").cast("long"), F.col("l_partkey"), F.col("l_suppkey"), (10, 2000, 200))
    return rows.select("l_orderkey", "l_linenumber", "calls", "tokens", "seconds", "exhausted")


# --- kernels -------------------------------------------------------------------------------------------------------

_CLASSES = "k(vessel_class, caution_wave, avoid_wave, caution_wind, avoid_wind, min_period) AS (VALUES " + ", ".join("('{}', {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE)".format(*r) for r in dim.VESSEL_CLASSES) + ")"


def _clamp(x: str, a: str = "0.0::DOUBLE", b: str = "1.0::DOUBLE") -> str:
    return f"greatest({a}, least({b}, {x}))"


_SAFETY = f"""{cte('vessels')}, {_CLASSES}, j AS (SELECT v.*, k.* EXCLUDE (vessel_class), {_clamp('freeboard_m / (length_overall_m * 0.08::DOUBLE)', '0.9::DOUBLE', '1.1::DOUBLE')} AS m FROM vessels v JOIN k USING (vessel_class)),
 h AS (SELECT *, CASE WHEN engine_power_hp > 0 THEN m ELSE least(m, 1.0::DOUBLE) END AS margin,
  0.45::DOUBLE * {_clamp('(wave_height_m - caution_wave) / (avoid_wave - caution_wave)')} + 0.3::DOUBLE * {_clamp('(wind_speed_ms - caution_wind) / (avoid_wind - caution_wind)')}
  + CASE WHEN swell_period_s IS NOT NULL THEN 0.15::DOUBLE * {_clamp('(min_period - swell_period_s) / (min_period - min_period / 2.0::DOUBLE)')} ELSE 0.0::DOUBLE END
  + CASE WHEN squall_risk IS NOT NULL THEN 0.1::DOUBLE * {_clamp('squall_risk')} ELSE 0.0::DOUBLE END AS total,
  0.75::DOUBLE + CASE WHEN swell_period_s IS NOT NULL THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN squall_risk IS NOT NULL THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM j),
 s AS (SELECT *, (1.0::DOUBLE - {_clamp('total / weight / margin')}) * 100.0::DOUBLE AS raw, CASE WHEN wave_height_m IS NULL THEN 'missing_input' WHEN reliability < 0.25 THEN 'insufficient_evidence' END AS abstain_reason FROM h),
 t AS (SELECT *, CASE WHEN abstain_reason IS NULL THEN CAST(floor(raw * 10.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) END AS score_tenths,
  3.0::DOUBLE + (1.0::DOUBLE - reliability) * 25.0::DOUBLE + (1.0::DOUBLE - weight) * 20.0::DOUBLE + CASE WHEN can_call THEN 0.0::DOUBLE ELSE 5.0::DOUBLE END AS spread FROM s)
SELECT vessel_id, score_tenths, CASE WHEN score_tenths >= 700 THEN 'safe' WHEN score_tenths >= 400 THEN 'caution' WHEN score_tenths IS NOT NULL THEN 'avoid' END AS band, abstain_reason,
 CASE WHEN abstain_reason IS NULL THEN CAST(floor({_clamp('raw - spread', '0.0::DOUBLE', '100.0::DOUBLE')} * 10.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) END AS lower_tenths FROM t"""  # fmt: skip


@query("safety_score", _SAFETY)
def safety_score(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vessels").join(F.broadcast(dim.vessel_classes(spark)), "vessel_class")
    margin = kernels.margin_factor(F.col("freeboard_m"), F.col("length_overall_m"), F.col("engine_power_hp"))
    score, weight = kernels.safety_value(F.col("wave_height_m"), F.col("wind_speed_ms"), F.col("swell_period_s"), F.col("squall_risk"), margin, F.col)
    reason = F.when(F.col("wave_height_m").isNull(), "missing_input").when(F.col("reliability") < kernels.MIN_RELIABILITY, "insufficient_evidence")
    low = kernels.clamp(score - kernels.confidence_spread(F.col("reliability"), weight, F.col("can_call")), 0.0, 100.0)
    rows = v.select("vessel_id", reason.alias("abstain_reason"), F.when(reason.isNull(), kernels.tenths(score)).alias("score_tenths"), F.when(reason.isNull(), kernels.tenths(low)).alias("lower_tenths"))
    band = F.when(F.col("score_tenths").isNotNull(), kernels.safety_band(F.col("score_tenths") / 10.0))
    return rows.select("vessel_id", "score_tenths", band.alias("band"), "abstain_reason", "lower_tenths")


_DOMINATED = "EXISTS (SELECT 1 FROM c b WHERE b.zone_id <> a.zone_id AND b.catch_signal >= a.catch_signal AND b.safety_score >= a.safety_score AND b.distance_nm <= a.distance_nm AND b.fuel_cost_litres <= a.fuel_cost_litres AND (b.catch_signal > a.catch_signal OR b.safety_score > a.safety_score OR b.distance_nm < a.distance_nm OR b.fuel_cost_litres < a.fuel_cost_litres))"
_FRONT = f"{cte('zones')}, c AS (SELECT * FROM zones WHERE compliant), f AS (SELECT a.* FROM c a WHERE NOT {_DOMINATED})"


@query("pareto_frontier", _FRONT + " SELECT zone_id, catch_signal, safety_score, distance_nm, fuel_cost_litres FROM f")
def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "zones").where("compliant").select("zone_id", "catch_signal", "safety_score", "distance_nm", "fuel_cost_litres")
    return zones.frontier(rows, "zone_id", ["catch_signal", "safety_score"], ["distance_nm", "fuel_cost_litres"])


@query("pareto_spread", _FRONT + """, r AS (SELECT *, row_number() OVER (ORDER BY catch_signal DESC, zone_id) AS c, row_number() OVER (ORDER BY safety_score DESC, catch_signal DESC, zone_id) AS s, row_number() OVER (ORDER BY fuel_cost_litres, catch_signal DESC, zone_id) AS k FROM f)
 SELECT zone_id, catch_signal, safety_score, distance_nm, fuel_cost_litres FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN c = 1 THEN 0 WHEN s = 1 THEN 1 WHEN k = 1 THEN 2 ELSE 2 + c END) AS t FROM r) WHERE t <= 3""")  # fmt: skip
def pareto_spread(spark: SparkSession, d: str) -> DataFrame:
    return zones.spread(pareto_frontier(spark, d), "zone_id", "catch_signal", "safety_score", "fuel_cost_litres")


_DAILY = cte("obs") + ", d AS (SELECT variable, source, valid_time, max(value) AS top FROM obs GROUP BY ALL), h AS (SELECT *, coalesce(top > 60.0, false) AS hot FROM d)"


@query("heatwave_runs", _DAILY + """, i AS (SELECT *, row_number() OVER w - sum(CASE WHEN hot THEN 1 ELSE 0 END) OVER w AS g FROM h WINDOW w AS (PARTITION BY variable, source ORDER BY valid_time)),
 r AS (SELECT variable, source, g, count(*) FILTER (hot) AS n FROM i GROUP BY ALL), b AS (SELECT variable, source, max(n) AS longest FROM r GROUP BY ALL)
 SELECT variable, source, longest, CASE WHEN longest >= 10 THEN 'high' WHEN longest >= 5 THEN 'medium' END AS flag FROM b""")  # fmt: skip
def heatwave_runs(spark: SparkSession, d: str) -> DataFrame:
    daily = view(spark, d, "obs").groupBy("variable", "source", "valid_time").agg(F.max("value").alias("top"))
    return zones.longest_runs(daily, ["variable", "source"], "valid_time", F.col("top") > 60.0)


@query("bloom_flags", cte("obs") + """, v AS (SELECT event_id, value / 16.0 AS x, (event_id % 9) * 0.25 AS b FROM obs)
 SELECT event_id, CASE WHEN b > 0 AND x / nullif(b, 0) >= 3.0 AND x >= 1.0 THEN CASE WHEN x / nullif(b, 0) >= 5.0 THEN 'high' ELSE 'medium' END END AS bloom, CASE WHEN x <= 0.05 AND x < 0.2 * b THEN 'low' END AS slick FROM v""")  # fmt: skip
def bloom_flags(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "obs").select("event_id", (F.col("value") / 16.0).alias("x"), ((F.col("event_id") % 9) * 0.25).alias("b"))
    return v.select("event_id", kernels.bloom_flag(F.col("x"), F.col("b")).alias("bloom"), kernels.slick_flag(F.col("x"), F.col("b")).alias("slick"))


# --- geography -----------------------------------------------------------------------------------------------------

_EDGES = "ring(area_id, lat1, lon1, lat2, lon2) AS (VALUES " + ", ".join(f"('{i}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for i, r in dim.AREAS for a, b in zip(r, r[1:] + r[:1])) + ")"
_INSIDE = f"""{cte('obs')}, {_EDGES}, x AS (SELECT o.event_id, area_id, lon, (lon2 - lon1) * (lat - lat1) / nullif(lat2 - lat1, 0) + lon1 AS cx FROM obs o, ring WHERE (lat1 > lat) <> (lat2 > lat)),
 p AS (SELECT event_id, area_id FROM x GROUP BY ALL HAVING (count(*) FILTER (lon < cx)) % 2 = 1 OR (count(*) FILTER (lon = cx)) > 0)"""


@query("area_containment", _INSIDE + " SELECT event_id, area_id FROM p")
def area_containment(spark: SparkSession, d: str) -> DataFrame:
    return spatial.containing(view(spark, d, "obs").select("event_id", "lat", "lon"), dim.areas(spark)).select("event_id", "area_id")


@query("ring_max", _INSIDE + " SELECT o.event_id, CAST(max(CASE area_id WHEN 'a1' THEN 34 WHEN 'a2' THEN 50 WHEN 'a3' THEN 28 WHEN 'a4' THEN 64 WHEN 'a5' THEN 40 END) AS INTEGER) AS knots FROM obs o LEFT JOIN p USING (event_id) GROUP BY o.event_id")
def ring_max(spark: SparkSession, d: str) -> DataFrame:
    rings = dim.areas(spark).withColumn("knots", A.looked_up({"a1": 34, "a2": 50, "a3": 28, "a4": 64, "a5": 40}, F.col("area_id")))
    return spatial.strongest(view(spark, d, "obs").select("event_id", "lat", "lon"), rings, "event_id")


_EAST = "((s.lon - v.lon) * 111.32::DOUBLE * cos(radians((v.lat + s.lat) / 2)))"
_NORTH = "((s.lat - v.lat) * 110.57::DOUBLE)"


@query("nearest_shelter", cte("vessels", "shelters") + f", n AS (SELECT v.vessel_id, s.shelter_id, row_number() OVER (PARTITION BY v.vessel_id ORDER BY {_NORTH} * {_NORTH} + {_EAST} * {_EAST}, s.shelter_id) AS r FROM vessels v, shelters s) SELECT vessel_id, shelter_id FROM n WHERE r = 1")
def nearest_shelter(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest(view(spark, d, "vessels").select("vessel_id", "lat", "lon"), view(spark, d, "shelters"), "vessel_id", "shelter_id").select("vessel_id", "shelter_id")


_SEGMENTS = "seg(i, y1, x1, dy, dx) AS (VALUES " + ", ".join(f"({i}, {a[1]!r}::DOUBLE, {a[2]!r}::DOUBLE, {b[1] - a[1]!r}::DOUBLE, {b[2] - a[2]!r}::DOUBLE)" for i, (a, b) in enumerate(zip(dim.BOUNDARY, dim.BOUNDARY[1:]))) + ")"
LINE = [(lat, lon) for _, lat, lon in dim.BOUNDARY]


@query("boundary_side", f"""{cte('vessels')}, {_SEGMENTS}, t AS (SELECT vessel_id, lat, lon, seg.*, {_clamp('((lon - x1) * dx + (lat - y1) * dy) / (dx * dx + dy * dy)')} AS t FROM vessels, seg),
 q AS (SELECT *, (lat - (y1 + t * dy)) * (lat - (y1 + t * dy)) + (lon - (x1 + t * dx)) * (lon - (x1 + t * dx)) AS d2 FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY d2, i) AS k FROM q)
 SELECT vessel_id, CAST(i AS INTEGER) AS segment, CASE WHEN dx * (lat - y1) - dy * (lon - x1) > 0 THEN 'sri_lanka' ELSE 'india' END AS side FROM r WHERE k = 1""")  # fmt: skip
def boundary_side(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vessels").select("vessel_id", geo.nearest_segment(LINE, F.col("lat"), F.col("lon")).alias("n"))
    return v.select("vessel_id", F.col("n.i").alias("segment"), geo.side(F.col("n")).alias("side"))


@query("boundary_band")
def boundary_band(spark: SparkSession, d: str) -> DataFrame:
    rows = spatial.boundary(view(spark, d, "vessels").select("vessel_id", "lat", "lon"), LINE, home_side="india")
    return rows.select("vessel_id", F.floor(F.col("metres")).alias("metres"), "side", "band")


@query("drift_crossings")
def drift_crossings(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vessels").select(F.col("vessel_id").alias("id"), "lat", "lon", ((F.col("vessel_id") % 8) * 45.0).alias("heading_deg"), F.lit(9.0).alias("speed_ms"), F.lit(0.5).alias("current_east_ms"), F.lit(0.0).alias("current_north_ms"))
    return spatial.drift(v, LINE)


# --- graphs and routes ---------------------------------------------------------------------------------------------


@query("topo_levels", cte("edges").replace("WITH ", "WITH RECURSIVE ", 1) + ", walk(node, level) AS (SELECT DISTINCT source_id, 0 FROM edges WHERE source_id NOT IN (SELECT target_id FROM edges) UNION ALL SELECT e.target_id, w.level + 1 FROM walk w JOIN edges e ON e.source_id = w.node WHERE w.level < 49) SELECT node, CAST(max(level) AS BIGINT) AS level FROM walk GROUP BY node")
def topo_levels(spark: SparkSession, d: str) -> DataFrame:
    return route.levels(spark, view(spark, d, "edges"))


@query("provenance_closure", cte("edges").replace("WITH ", "WITH RECURSIVE ", 1) + ", up(target, ancestor, depth) AS (SELECT target_id, source_id, 1 FROM edges UNION ALL SELECT u.target, e.source_id, u.depth + 1 FROM up u JOIN edges e ON e.target_id = u.ancestor WHERE u.depth < 19) SELECT DISTINCT target, ancestor FROM up")
def provenance_closure(spark: SparkSession, d: str) -> DataFrame:
    return route.closure(spark, view(spark, d, "edges"))


@query("route_cost")
def route_cost(spark: SparkSession, d: str) -> DataFrame:
    cells = route.navigable(route.grid_of(view(spark, d, "events")), 2.0)
    return route.relax(spark, cells, (5, 0)).select("row", "col", kernels.tenths(F.col("cost") * 100.0).alias("cost_milli"))


# --- retrieval and text --------------------------------------------------------------------------------------------

WORDS = ("the", "and", "thing", "que", "die", "nature")
_ASKED = "[" + ", ".join(f"'{w}'" for w in sorted(WORDS)) + "]"
_TOKENS = "regexp_extract_all(lower(text), '\\p{L}+')"
_LEX = f"t AS (SELECT doc_id, {_TOKENS} AS t FROM {{table}}), l AS (SELECT doc_id, len(list_intersect(list_distinct(t), {_ASKED})) AS matched, len(list_filter(t, lambda w: list_contains({_ASKED}, w))) AS total FROM t), lex AS (SELECT doc_id, CAST(matched AS INTEGER) AS matched, CAST(total AS INTEGER) AS total, row_number() OVER (ORDER BY matched DESC, total DESC, doc_id) AS rank FROM l WHERE matched > 0 QUALIFY rank <= 50)"


@query("lexical_topk", "WITH " + _LEX.replace("{table}", "documents") + " SELECT * FROM lex")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.lexical(view(spark, d, "documents"), "doc_id", WORDS)


_GATE = f"g AS (SELECT * FROM docs WHERE issued_time <= TIMESTAMP '{NOW}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{NOW}') AND kind IN ('k1', 'k2', 'k3') AND (region IS NULL OR region IN ('R1', 'R2')))"


def _gate() -> retrieve.Gate:
    return retrieve.Gate(ntz(), None, frozenset({"k1", "k2", "k3"}), frozenset({"R1", "R2"}))


@query("gated_retrieval", f"{cte('docs')}, {_GATE}, {_LEX.replace("{table}", "g")} SELECT * FROM lex")
def gated_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.lexical(view(spark, d, "docs").where(_gate().predicate()), "doc_id", WORDS)


@query("gate_counts", f"{cte('docs')}, {_GATE} SELECT kind, region, count(*) AS n FROM g GROUP BY ALL")
def gate_counts(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "docs").where(_gate().predicate()).groupBy("kind", "region").agg(F.count("*").alias("n"))


_PROBE = [0.125 if i % 3 == 0 else -0.0625 for i in range(64)]
_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST([" + ", ".join(map(str, _PROBE)) + "][i] AS DOUBLE)))"


@query("vector_topk", f"WITH s AS (SELECT vec_id, {_DOT} AS score FROM embeddings) SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 50")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.nearest_vectors(view(spark, d, "embeddings"), "vec_id", "embedding", _PROBE).select("vec_id", "rank")


@query("rrf_fusion", f"WITH {_LEX.replace("{table}", "documents")}, s AS (SELECT vec_id, {_DOT} AS score FROM embeddings), v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 50), u AS (SELECT doc_id, rank, 'lexical' AS list FROM lex UNION ALL SELECT doc_id, rank, 'vector' FROM v), f AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, CASE WHEN count(*) > 1 THEN 'hybrid' ELSE min(list) END AS mode FROM u GROUP BY doc_id) SELECT doc_id, mode FROM f ORDER BY score DESC, doc_id LIMIT 8")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    vectors = retrieve.nearest_vectors(view(spark, d, "embeddings"), "vec_id", "embedding", _PROBE).select(F.col("vec_id").alias("doc_id"), "rank")
    return retrieve.fuse({"lexical": lexical_topk(spark, d), "vector": vectors}, "doc_id").select("doc_id", "mode")


@query("chunk_documents")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    parts = view(spark, d, "documents").select("doc_id", F.posexplode(T.chunks("text")).alias("ordinal", "text"))
    return parts.select(F.format_string("%d#%04d", "doc_id", "ordinal").alias("chunk_id"), "doc_id", "ordinal", F.sha2("text", 256).alias("sha256"), T.token_estimate(F.col("text")).alias("token_count"))


@query("hash_embed_norm", f"WITH w AS (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents), b AS (SELECT doc_id, CAST(concat('0x', substr(sha256(w), 1, 8)) AS BIGINT) % 1024 AS bucket, CASE WHEN CAST(concat('0x', substr(sha256(w), 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM w), s AS (SELECT doc_id, bucket, CAST(sum(sign) AS BIGINT) AS v FROM b GROUP BY ALL) SELECT doc_id, count(*) AS buckets, CAST(sum(v * v) AS BIGINT) AS norm2 FROM s GROUP BY doc_id")
def hash_embed_norm(spark: SparkSession, d: str) -> DataFrame:
    words = view(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    bucket, sign = T.bucket(F.col("w"))
    cells = words.groupBy("doc_id", bucket.alias("bucket")).agg(F.sum(sign * F.col("n")).alias("v"))
    return cells.groupBy("doc_id").agg(F.count("*").alias("buckets"), F.sum(F.col("v") * F.col("v")).alias("norm2"))


@query("number_tokens", "SELECT doc_id, len(regexp_extract_all(text, '(?:^|[^0-9.])(-?[0-9]+(?:\\.[0-9]+)?)', 1)) AS n, array_to_string(regexp_extract_all(text, '(?:^|[^0-9.])(-?[0-9]+(?:\\.[0-9]+)?)', 1), ',') AS numbers FROM documents")
def number_tokens(spark: SparkSession, d: str) -> DataFrame:
    n = T.numbers(F.col("text"))
    return view(spark, d, "documents").select("doc_id", F.size(n).cast("long").alias("n"), F.array_join(n, ",").alias("numbers"))


@query("script_share", "SELECT lang, CAST(sum(length(regexp_replace(text, '[^\\p{L}]', '', 'g'))) AS BIGINT) AS letters, CAST(sum(length(regexp_replace(text, '[^\\p{Tamil}]', '', 'g'))) AS BIGINT) AS tamil, CAST(sum(length(regexp_replace(text, '[^\\p{Devanagari}]', '', 'g'))) AS BIGINT) AS devanagari FROM documents GROUP BY lang")
def script_share(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "documents")
    return docs.groupBy("lang").agg(F.sum(T.letters_of(F.col("text"))).alias("letters"), F.sum(T.letters_of(F.col("text"), "TAMIL")).alias("tamil"), F.sum(T.letters_of(F.col("text"), "DEVANAGARI")).alias("devanagari"))


MARKERS = {"ta": ["of", "inherent", "que"], "hi": ["der", "la", "que"]}


_LETTERS = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"
_OF = lambda script: f"length(regexp_replace(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), '[^\\p{{{script.title()}}}]', '', 'g'))"
_SCRIPTS = "[" + ", ".join(f"{{'n': {_OF(x)}, 'code': '{c}'}}" for x, c in T.SCRIPTS.items()) + "]"
_MARKED = "[" + ", ".join(f"{{'n': len(list_intersect(list_distinct({_TOKENS}), [{', '.join(repr(w) for w in ws)}])), 'code': '{c}'}}" for c, ws in MARKERS.items()) + "]"


@query("language_detect", f"""WITH a AS (SELECT {_LETTERS} AS n, {_SCRIPTS} AS ss, {_MARKED} AS ms FROM documents),
 b AS (SELECT n, list_sort(ss, 'DESC')[1] AS top, list_sort(ms, 'DESC')[1] AS hit, CAST(list_sum(list_transform(ss, lambda x: x.n)) AS BIGINT) AS indic, len(list_filter(ms, lambda x: x.n = list_max(list_transform(ms, lambda y: y.n)))) > 1 AS tied FROM a),
 c AS (SELECT *, n > 0 AND top.n >= {T.DOMINANT} * n AS script, n = 0 OR (hit.n = 0 AND n < {T.FEW_LETTERS}) AS nothing FROM b),
 d AS (SELECT CASE WHEN script THEN top.code WHEN nothing OR hit.n = 0 OR tied THEN 'en' ELSE hit.code END AS language, CASE WHEN script THEN 'script' WHEN nothing THEN 'default' WHEN hit.n = 0 THEN 'romanized_lexicon' WHEN tied THEN 'default' ELSE 'romanized_lexicon' END AS method,
 CASE WHEN script THEN n - indic >= {T.MIXED} * n ELSE NOT nothing AND hit.n > 0 END AS code_mixed FROM c) SELECT language, method, code_mixed, count(*) AS n FROM d GROUP BY ALL""")  # fmt: skip
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieve.detect_language(view(spark, d, "documents"), "text", MARKERS)
    return rows.groupBy("language", "method", "code_mixed").agg(F.count("*").alias("n"))


_PLACES = "p AS (SELECT s_suppkey AS place_id, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS name FROM supplier), q AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN concat('suppliar', lpad(CAST(c_custkey % 70 AS VARCHAR), 9, '0')) ELSE concat('supplier', lpad(CAST(c_custkey % 70 AS VARCHAR), 9, '0')) END AS query FROM customer)"


@query("place_resolve", f"""WITH {_PLACES}, e AS (SELECT query, count(*) AS n, min(place_id) AS place_id, 0 AS distance FROM q JOIN p ON query = name GROUP BY query),
 f AS (SELECT query, place_id, levenshtein(query, name) AS distance FROM q JOIN p ON levenshtein(query, name) <= 2 WHERE query NOT IN (SELECT query FROM e)), m AS (SELECT query, min(distance) AS d FROM f GROUP BY query),
 z AS (SELECT query, count(*) AS n, min(place_id) AS place_id, d AS distance FROM f JOIN m USING (query) WHERE distance = d GROUP BY query, d), a AS (SELECT * FROM e UNION ALL SELECT * FROM z)
 SELECT q.query, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN n = 1 THEN place_id END AS place_id, CAST(distance AS BIGINT) AS distance FROM q LEFT JOIN a USING (query)""")  # fmt: skip
def place_resolve(spark: SparkSession, d: str) -> DataFrame:
    places = view(spark, d, "supplier").select(F.col("s_suppkey").alias("place_id"), F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", "")).alias("name"))
    number = F.lpad((F.col("c_custkey") % 70).cast("string"), 9, "0")
    asked = view(spark, d, "customer").select(F.concat(F.when(F.col("c_custkey") % 3 == 0, "suppliar").otherwise("supplier"), number).alias("query")).distinct()
    return retrieve.resolve_places(asked, places)


# --- sessions, alerts, windows -------------------------------------------------------------------------------------

_CARRY = "last_value({0} IGNORE NULLS) OVER w"
_ORIGIN = "CASE WHEN {0} IS NOT NULL THEN 'turn' WHEN last_value({0} IGNORE NULLS) OVER w IS NOT NULL THEN 'carried' END"


@query("session_carry", cte("turns") + f" SELECT conv_id, turn, {_CARRY.format('intent')} AS intent, {_CARRY.format('place')} AS place, time_window, {_ORIGIN.format('intent')} AS origin_intent, {_ORIGIN.format('place')} AS origin_place, CASE WHEN time_window IS NOT NULL THEN 'turn' END AS origin_time_window FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def session_carry(spark: SparkSession, d: str) -> DataFrame:
    turns = view(spark, d, "turns").select("conv_id", "turn", "intent", "place", "time_window")
    return sessions.carry_over(turns, "conv_id", "turn", ["intent", "place", "time_window"], never=["time_window"])


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Alert results: one rule outcome an event."""
    e = view(spark, d, "events")
    outcome = F.element_at(F.array(*map(F.lit, ("clear", "watch", "warning", "emergency", "unevaluated"))), (F.col("event_id") % 5 + 1).cast("int"))
    rule = F.when(F.col("event_type") == "click", "geofence_drift").otherwise(F.col("event_type"))
    rows = e.select("user_id", rule.alias("rule"), F.lit("h").alias("hazard"), F.col("ts").cast("timestamp").alias("at"), outcome.alias("outcome"))
    return rows.withColumn("severity", A.severity(F.col("outcome"))).withColumn("minutes", F.lit(None).cast("double"))


_WINDOWS = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v * 60_000_000}" for k, v in machine.WINDOW_MINUTES.items()) + " END"
_AGE = "epoch_us(t) - epoch_us(s_at)"
_DEDUP = f"""WITH RECURSIVE o AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'geofence_drift' ELSE event_type END AS rule, ts AS t, ['clear', 'watch', 'warning', 'emergency', 'unevaluated'][event_id % 5 + 1] AS outcome FROM events),
 r AS (SELECT *, CASE outcome WHEN 'emergency' THEN 3 WHEN 'warning' THEN 2 WHEN 'watch' THEN 1 WHEN 'clear' THEN 0 ELSE -1 END AS rank, CASE outcome WHEN 'emergency' THEN 'Extreme' WHEN 'warning' THEN 'Severe' WHEN 'watch' THEN 'Moderate' WHEN 'clear' THEN 'Minor' ELSE 'Unknown' END AS severity, row_number() OVER (PARTITION BY user_id, rule ORDER BY t, outcome) AS n FROM o),
 f AS (SELECT DISTINCT user_id, rule, CAST(0 AS BIGINT) AS n, NULL::TIMESTAMP AS t, '' AS outcome, '' AS decision, NULL::TIMESTAMP AS s_at, 0 AS s_rank, '' AS s_severity, CAST(0 AS BIGINT) AS sends FROM r
  UNION ALL SELECT user_id, rule, n, t, outcome, decision, CASE WHEN sent THEN t WHEN decision <> 'send_cancel' AND live THEN s_at END, CASE WHEN sent THEN rank ELSE s_rank END, CASE WHEN sent THEN severity ELSE s_severity END, CASE WHEN sent THEN 1 + CASE WHEN live THEN sends ELSE 0 END WHEN decision <> 'send_cancel' AND live THEN sends ELSE 0 END FROM (
   SELECT *, decision IN ('send_new', 'send_escalation', 'send_update') AS sent FROM (
    SELECT *, CASE WHEN rank < 1 THEN CASE WHEN live AND s_severity IN ('Extreme', 'Severe') THEN 'send_cancel' ELSE 'nothing_to_do' END WHEN NOT live THEN 'send_new' WHEN rank > s_rank THEN 'send_escalation' WHEN {_AGE} < {_WINDOWS} THEN 'suppress_duplicate' ELSE 'send_update' END AS decision FROM (
     SELECT r.*, s_at, s_rank, s_severity, sends, coalesce({_AGE.replace('(t)', '(r.t)')} <= {machine.PRUNE_HOURS * 3_600_000_000}, false) AS live FROM f JOIN r ON r.user_id = f.user_id AND r.rule = f.rule AND r.n = f.n + 1)))),
 d AS (SELECT user_id, rule, 'h' AS hazard, t AS "at", outcome, decision, sends AS send_count FROM f WHERE n > 0)"""


def _plain_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("alert_dedup_batch", _DEDUP + " SELECT * FROM d")
def alert_dedup_batch(spark: SparkSession, d: str) -> DataFrame:
    return _plain_time(machine.decide_batch(_results(spark, d)))


@query("tick_summary", _DEDUP + " SELECT decision, count(*) AS n, count(DISTINCT user_id) AS users FROM d GROUP BY decision")
def tick_summary(spark: SparkSession, d: str) -> DataFrame:
    return machine.tick_summary(machine.decide_batch(_results(spark, d)))


@query("alert_dedup_stream", _DEDUP + " SELECT * FROM d")
def alert_dedup_stream(spark: SparkSession, d: str) -> DataFrame:
    """The stateful stream run to its end over the events; its checkpoint is deleted when it is done."""
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")  # a glob may be a file or a folder
    outcome = F.element_at(F.array(*map(F.lit, ("clear", "watch", "warning", "emergency", "unevaluated"))), (F.col("event_id") % 5 + 1).cast("int"))
    rule = F.when(F.col("event_type") == "click", "geofence_drift").otherwise(F.col("event_type"))
    rows = stream.select("user_id", rule.alias("rule"), F.lit("h").alias("hazard"), F.col("ts").cast("timestamp").alias("at"), outcome.alias("outcome"))
    rows = rows.withColumn("severity", A.severity(F.col("outcome"))).withColumn("minutes", F.lit(None).cast("double")).withWatermark("at", "12 hours")
    out, state = new_path(spark, "alerts"), new_path(spark, "alert-state")
    q = machine.decide_stream(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    remove(spark, state)
    return _plain_time(spark.read.schema(machine.OUT).parquet(out))


_SKIP = "CASE WHEN no_position THEN 'no_position' WHEN NOT at_sea THEN 'ashore' WHEN position_age_min > 30 THEN 'stale' WHEN endpoints = 0 THEN 'unreachable' ELSE 'evaluable' END"


@query("skip_reasons", cte("vessels") + f" SELECT {_SKIP} AS reason, count(*) AS n FROM vessels GROUP BY 1")
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    reason = A.skip_reason(~F.col("no_position"), F.col("at_sea"), F.col("position_age_min") * 60, F.col("endpoints"))
    return view(spark, d, "vessels").groupBy(F.coalesce(reason, F.lit("evaluable")).alias("reason")).agg(F.count("*").alias("n"))


@query("broadcast_recipients", cte("vessels") + " SELECT vessel_id FROM vessels WHERE no_position OR (lat BETWEEN 8.5 AND 10.0 AND lon BETWEEN 79.0 AND 81.0)")
def broadcast_recipients(spark: SparkSession, d: str) -> DataFrame:
    inside = F.col("lat").between(8.5, 10.0) & F.col("lon").between(79.0, 81.0)
    return view(spark, d, "vessels").where(A.broadcast_reaches(F.lit(False), False, ~F.col("no_position"), inside, True)).select("vessel_id")


@query("vessel_rules", f"""{cte('vessels')}, {_CLASSES}, j AS (SELECT * FROM vessels JOIN k USING (vessel_class)),
 u AS (SELECT vessel_id, 'wave_height' AS rule, CASE WHEN wave_height_m IS NULL OR position_age_min * 360 > 10800 THEN 'unevaluated' WHEN wave_height_m >= avoid_wave THEN 'warning' WHEN wave_height_m >= caution_wave THEN 'watch' ELSE 'clear' END AS outcome FROM j
 UNION ALL SELECT vessel_id, 'wind_speed', CASE WHEN wind_speed_ms IS NULL OR position_age_min * 360 > 10800 THEN 'unevaluated' WHEN wind_speed_ms >= avoid_wind THEN 'warning' WHEN wind_speed_ms >= caution_wind THEN 'watch' ELSE 'clear' END FROM j
 UNION ALL SELECT vessel_id, 'lightning', CASE WHEN vessel_id % 13 >= 10 THEN CASE WHEN freeboard_m < 1.2 THEN 'emergency' ELSE 'warning' END WHEN vessel_id % 13 >= 3 THEN 'watch' ELSE 'clear' END FROM j
 UNION ALL SELECT vessel_id, 'squall', CASE WHEN squall_risk IS NULL THEN 'unevaluated' WHEN squall_risk >= 0.5 THEN 'warning' WHEN squall_risk >= 0.3 THEN 'watch' ELSE 'clear' END FROM j)
 SELECT vessel_id, rule, outcome, CASE outcome WHEN 'emergency' THEN 'Extreme' WHEN 'warning' THEN 'Severe' WHEN 'watch' THEN 'Moderate' WHEN 'clear' THEN 'Minor' ELSE 'Unknown' END AS severity FROM u""")  # fmt: skip
def vessel_rules(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vessels").join(F.broadcast(dim.vessel_classes(spark)), "vessel_class")
    age = F.col("position_age_min") * 360
    rules = {
        "wave_height": A.threshold_rule(F.col("wave_height_m"), F.col("caution_wave"), F.col("avoid_wave"), age),
        "wind_speed": A.threshold_rule(F.col("wind_speed_ms"), F.col("caution_wind"), F.col("avoid_wind"), age),
        "lightning": A.lightning_rule(F.col("vessel_id") % 13, F.col("freeboard_m")),
        "squall": A.squall_rule(F.col("squall_risk")),
    }
    rows = v.select("vessel_id", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), x.alias("outcome")) for k, x in rules.items()])).alias("r"))
    return rows.select("vessel_id", "r.rule", "r.outcome", A.severity(F.col("r.outcome")).alias("severity"))


_CAP = f"""v AS ({SQL['vessel_rules']}) SELECT vessel_id, rule, 'tm-' || substr(sha256(vessel_id || '|' || rule || '|{NOW}|'), 1, 16) AS identifier,
 '<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>tm-' || substr(sha256(vessel_id || '|' || rule || '|{NOW}|'), 1, 16) || '</identifier><sender>tidemark</sender><sent>{NOW.replace(' ', 'T')}+00:00</sent><status>Actual</status><msgType>Alert</msgType><scope>Public</scope><info><category>Met</category><event>' || rule
 || '</event><urgency>' || CASE outcome WHEN 'emergency' THEN 'Immediate' ELSE 'Expected' END || '</urgency><severity>' || severity || '</severity><certainty>Likely</certainty><headline>' || rule || ' ' || outcome || '</headline></info></alert>' AS cap FROM v WHERE outcome IN ('warning', 'emergency')"""


@query("cap_alerts", f"WITH {_CAP}")
def cap_alerts(spark: SparkSession, d: str) -> DataFrame:
    rows = vessel_rules(spark, d).where("outcome IN ('warning', 'emergency')")
    sent = F.lit(NOW).cast("timestamp_ntz")
    name = A.identifier(F.col("vessel_id").cast("string"), F.col("rule"), sent)
    xml = A.cap_xml(name, "tidemark", sent, F.lit("Alert"), F.col("rule"), A.urgency(F.col("rule"), F.col("outcome"), F.lit(None).cast("double")), F.col("severity"), F.lit("Likely"), F.concat_ws(" ", F.col("rule"), F.col("outcome")))
    return rows.select("vessel_id", "rule", name.alias("identifier"), xml.alias("cap"))


@query("tumbling_hours", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) * 100 AS BIGINT) AS total_cents FROM events GROUP BY ALL")
def tumbling_hours(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(view(spark, d, "events"), "ts", "1 hour", ["event_type"])


@query("sliding_hours", "WITH s AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, event_type, value FROM events, (VALUES (0), (1)) v(k)) SELECT start, start + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) * 100 AS BIGINT) AS total_cents FROM s GROUP BY ALL")
def sliding_hours(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(view(spark, d, "events"), "ts", "1 hour", ["event_type"], "30 minutes")


@query("user_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(view(spark, d, "events"), "ts", "6 hours", "user_id")
