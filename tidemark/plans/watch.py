"""Queries over hazards, closures, inputs and evidence, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import alerts as A
from tidemark.functions import kernels
from tidemark.operators import asof, spatial, watch
from tidemark.plans.catalogue import _AS_OF, _INSIDE, _SKIP, LINE, SQL, ntz, query, vessel_rules
from tidemark.sources import dimensions as dim
from tidemark.sources.views import cte, view

# systems: centre, time of the bulletin, with a cone or not; rings are squares of these half sides in degrees
SYSTEMS = [("alpha", 9.03, 79.03, "2024-01-19 23:00:00", True), ("beta", 8.53, 81.03, "2024-01-19 18:00:00", False), ("gamma", 9.53, 80.03, "2024-01-19 17:59:59", True)]
HALF_SIDES, CONE = {27: 2.0, 34: 1.0, 50: 0.5, 64: 0.2}, 3.0
SEASONS = [("a1", "hard", None, None, None, None), ("a2", "soft", 1, 10, 2, 10), ("a3", "hard", 12, 1, 1, 25), ("a4", "hard", 6, 1, 7, 31), ("a5", "soft", 4, 1, 4, 30), ("a5", "soft", 1, 1, 1, 31)]
APPROVED = ["f0", "f1", "f2"]


def square(lat: float, lon: float, half: float) -> list[dict]:
    return [{"lat": lat + a * half, "lon": lon + b * half} for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def _cyclones(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    ring = "ring array<struct<lat:double,lon:double>>"
    systems = spark.createDataFrame([(n, t) for n, _, _, t, _ in SYSTEMS], "system string, t string").select("system", F.col("t").cast("timestamp_ntz").alias("issued_time"))
    rings = spark.createDataFrame([(n, k, square(a, b, h)) for n, a, b, _, _ in SYSTEMS for k, h in HALF_SIDES.items()], f"system string, knots int, {ring}")
    cones = spark.createDataFrame([(n, square(a, b, CONE)) for n, a, b, _, c in SYSTEMS if c], f"system string, {ring}")
    return systems, rings, cones


_SYSTEMS = "s(hazard, a, b, t, has_cone) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, TIMESTAMP '{t}', {c})" for n, a, b, t, c in SYSTEMS) + "), on_ AS (SELECT * FROM s WHERE TIMESTAMP '2024-01-20 00:00:00' - t <= INTERVAL 6 HOUR)"
_WITHIN = lambda h: f"(abs(lat - a) < {h} AND abs(lon - b) < {h})"
_KNOTS = "CASE " + " ".join(f"WHEN {_WITHIN(h)} THEN {k}" for k, h in sorted(HALF_SIDES.items(), reverse=True)) + " END"
_CYCLONES = f"""{_SYSTEMS}, k AS (SELECT vessel_id, hazard, CAST({_KNOTS} AS INTEGER) AS knots, has_cone, {_WITHIN(CONE)} AS inside FROM vessels, on_),
 cy AS (SELECT vessel_id, hazard, 'cyclone_wind' AS rule, CASE WHEN knots IS NULL THEN 'clear' WHEN knots >= 50 THEN 'emergency' WHEN knots >= 34 THEN 'warning' ELSE 'watch' END AS outcome, knots FROM k
 UNION ALL SELECT vessel_id, hazard, 'cyclone_cone', CASE WHEN NOT has_cone THEN 'unevaluated' WHEN inside THEN 'watch' ELSE 'clear' END, knots FROM k)"""


@query("active_cyclones", f"{cte('bulletins')} SELECT system FROM bulletins WHERE TIMESTAMP '2024-01-20 00:00:00' - issued_time <= INTERVAL 6 HOUR")
def active_cyclones(spark: SparkSession, d: str) -> DataFrame:
    return watch.active_cyclones(view(spark, d, "bulletins"), ntz()).select("system")


@query("cyclone_rules", f"{cte('vessels')}, {_CYCLONES} SELECT * FROM cy")
def cyclone_rules(spark: SparkSession, d: str) -> DataFrame:
    return watch.evaluate_cyclones(view(spark, d, "vessels"), *_cyclones(spark), "vessel_id", ntz())


def _tick_results(spark: SparkSession, d: str) -> DataFrame:
    return vessel_rules(spark, d).select("vessel_id", F.lit("").alias("hazard"), "rule", "outcome").union(cyclone_rules(spark, d).select("vessel_id", "hazard", "rule", "outcome"))


def _skips(spark: SparkSession, d: str) -> DataFrame:
    reason = A.skip_reason(~F.col("no_position"), F.col("at_sea"), F.col("position_age_min") * 60, F.col("endpoints"))
    return view(spark, d, "vessels").select("vessel_id", reason.alias("skip"))


_RANK = "CASE outcome WHEN 'emergency' THEN 3 WHEN 'warning' THEN 2 WHEN 'watch' THEN 1 WHEN 'clear' THEN 0 ELSE -1 END"
_TICK = f"""{cte('vessels')}, {_CYCLONES}, vr AS ({SQL['vessel_rules']}), res AS (SELECT vessel_id, '' AS hazard, rule, outcome FROM vr UNION ALL SELECT vessel_id, hazard, rule, outcome FROM cy),
 sk AS (SELECT vessel_id, nullif({_SKIP}, 'evaluable') AS skip FROM vessels)"""
_CERTAINTY = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in watch.CERTAINTY.items()) + " END"


@query("alert_tick", f"""{_TICK}, w AS (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY {_RANK} DESC, rule, hazard) AS n FROM res JOIN sk USING (vessel_id) WHERE skip IS NULL AND {_RANK} >= 1)
 SELECT vessel_id, rule, hazard, outcome, CASE outcome WHEN 'emergency' THEN 'Extreme' WHEN 'warning' THEN 'Severe' ELSE 'Moderate' END AS severity, {_CERTAINTY} AS certainty FROM w WHERE n = 1""")  # fmt: skip
def alert_tick(spark: SparkSession, d: str) -> DataFrame:
    evaluable = _skips(spark, d).where("skip IS NULL").select("vessel_id")
    return watch.tick(_tick_results(spark, d).join(evaluable, "vessel_id", "left_semi"), "vessel_id")


def _under_way(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("vessel_id")
    return view(spark, d, "vessels").where("NOT no_position").select("vessel_id", "lat", "lon", ((n % 8) * 45.0).alias("heading_deg"), F.lit(9.0).alias("speed_ms"), F.lit(0.5).alias("current_east_ms"), F.lit(0.0).alias("current_north_ms"))


@query("full_tick")
def full_tick(spark: SparkSession, d: str) -> DataFrame:
    """The tick over all rules: cyclones, conditions, the boundary's nearness and the drift over it."""
    boundary = watch.boundary_results(_under_way(spark, d), LINE, "vessel_id")
    every = _tick_results(spark, d).union(boundary.select("vessel_id", "hazard", "rule", "outcome"))
    evaluable = _skips(spark, d).where("skip IS NULL").select("vessel_id")
    return watch.tick(every.join(evaluable, "vessel_id", "left_semi"), "vessel_id")


@query("audit_rows", f"""{_TICK}, c AS (SELECT vessel_id, count(*) AS evaluated, count(*) FILTER ({_RANK} >= 1) AS fired, count(*) FILTER (outcome = 'unevaluated') AS unevaluated FROM res GROUP BY vessel_id)
 SELECT vessel_id, skip, CASE WHEN skip IS NULL THEN evaluated ELSE 0 END AS evaluated, CASE WHEN skip IS NULL THEN fired ELSE 0 END AS fired, CASE WHEN skip IS NULL THEN unevaluated ELSE 0 END AS unevaluated FROM sk JOIN c USING (vessel_id)""")  # fmt: skip
def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    return watch.audit(_skips(spark, d), _tick_results(spark, d), "vessel_id")


_SEASONS = "z(area_id, severity, x, y) AS (VALUES " + ", ".join(f"('{i}', '{s}', {'NULL::INTEGER' if a is None else a * 100 + b}, {'NULL::INTEGER' if a is None else c * 100 + e})" for i, s, a, b, c, e in SEASONS) + ")"


@query("area_closures", f"{_INSIDE}, {_SEASONS}, shut AS (SELECT DISTINCT area_id, severity FROM z WHERE x IS NULL OR (x <= y AND 120 BETWEEN x AND y) OR (x > y AND (120 >= x OR 120 <= y))) SELECT event_id, area_id, severity, severity = 'hard' AS blocks FROM p JOIN shut USING (area_id)")
def area_closures(spark: SparkSession, d: str) -> DataFrame:
    inside = spatial.containing(view(spark, d, "obs").select("event_id", "lat", "lon"), dim.areas(spark)).select("event_id", "area_id")
    seasons = spark.createDataFrame(SEASONS, "area_id string, severity string, m1 int, d1 int, m2 int, d2 int")
    return watch.closed_areas(inside, seasons, ntz()).select("event_id", "area_id", "severity", "blocks")


@query("evidence_rows", _AS_OF + """), l AS (SELECT DISTINCT ON (source, variable, valid_time, lat, lon, depth_key) * FROM k ORDER BY source, variable, valid_time, lat, lon, depth_key, issued_time DESC, event_id DESC)
 SELECT event_id, CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 2 WHEN 'src2' THEN 3 ELSE 5 END AS authority_rank, concat_ws(':', source, variable, strftime(valid_time, '%Y-%m-%dT%H:%M:%S'), printf('%.4f,%.4f', lat, lon)) AS provenance_id, 'tidemark://observation/' || source || '/' || coalesce(dataset_id, 'default') AS url FROM l""")  # fmt: skip
def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    ranks = spark.createDataFrame([("src0", 1), ("src1", 2), ("src2", 3)], "source string, authority_rank int")
    return watch.evidence_rows(asof.as_of(view(spark, d, "obs"), ntz()), ranks).select("event_id", "authority_rank", "provenance_id", "url")


@query("source_candidates", f"{cte('registry')} SELECT CAST(row_number() OVER (ORDER BY authority_rank, source_id, dataset_id) AS INTEGER) AS place, dataset_id FROM registry WHERE south <= 6.5 AND north >= 8.0 AND west <= 77.0 AND east >= 80.0 AND list_has_any(variables, ['click', 'error'])")
def source_candidates(spark: SparkSession, d: str) -> DataFrame:
    return watch.candidates(view(spark, d, "registry"), (6.5, 8.0, 77.0, 80.0), ["click", "error"]).select("place", "dataset_id")


@query("formula_check", "WITH o AS (SELECT o_custkey % 50 AS run_id, list_sort(list_distinct(list('f' || (o_orderkey % 5)))) AS f FROM orders GROUP BY 1) SELECT run_id, array_to_string(list_filter(f, lambda x: x NOT IN ('f0', 'f1', 'f2')), ',') AS unapproved, len(list_filter(f, lambda x: x NOT IN ('f0', 'f1', 'f2'))) = 0 AS passed FROM o")
def formula_check(spark: SparkSession, d: str) -> DataFrame:
    runs = view(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("run_id")).agg(F.collect_set(F.concat(F.lit("f"), F.col("o_orderkey") % 5)).alias("f"))
    bad = watch.unapproved(F.col("f"), APPROVED)
    return runs.select("run_id", F.array_join(bad, ",").alias("unapproved"), (F.size(bad) == 0).alias("passed"))


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    """Three kernel inputs a vessel."""
    v = view(spark, d, "vessels")
    one = lambda name, value, age, limit, required: F.struct(F.lit(name).alias("name"), value.alias("value"), age.alias("age"), F.coalesce(age > limit, F.lit(False)).alias("stale"), F.lit(required).alias("required"))
    n = F.col("vessel_id")
    age = lambda k, m: F.when(n % m != 0, (n * k) % 50)
    value = lambda m: F.when(n % m != 0, n % 23)
    return v.select("vessel_id", F.array(one("wave", value(11), age(3, 10), 40, True), one("wind", value(7), age(7, 9), 45, True), one("swell", value(5), age(11, 8), 30, False)).alias("inputs"))


_AGE = lambda k, m: f"CASE WHEN n % {m} <> 0 THEN (n * {k}) % 50 END"
_INPUTS = f"""WITH v AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 23 END AS wave, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 23 END AS wind, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 23 END AS swell FROM customer),
 g AS (SELECT *, {_AGE(3, 10)} AS a, {_AGE(7, 9)} AS b, {_AGE(11, 8)} AS c FROM v), s AS (SELECT *, coalesce(a > 40, false) AS sa, coalesce(b > 45, false) AS sb, coalesce(c > 30, false) AS sc FROM g)"""


@query("input_states", _INPUTS + """ SELECT n AS vessel_id, coalesce(greatest(a, b, c), 0) AS max_age, concat_ws(',', CASE WHEN sc THEN 'swell' END, CASE WHEN sa THEN 'wave' END, CASE WHEN sb THEN 'wind' END) AS stale,
 CASE WHEN sa OR sb THEN 'stale_input' WHEN wave IS NULL OR wind IS NULL THEN 'missing_required_input' END AS reason,
 CASE WHEN sa AND (NOT sb OR a >= b) THEN 'wave' WHEN sb THEN 'wind' WHEN wave IS NULL OR wind IS NULL THEN concat_ws(',', CASE WHEN wave IS NULL THEN 'wave' END, CASE WHEN wind IS NULL THEN 'wind' END) END AS blamed FROM s""")  # fmt: skip
def input_states(spark: SparkSession, d: str) -> DataFrame:
    return _inputs(spark, d).select("vessel_id", watch.input_state(F.col("inputs")).alias("s")).select("vessel_id", "s.*")


@query("input_fingerprints", _INPUTS + " SELECT n AS vessel_id, sha256('4:wave=' || coalesce(length(wave::VARCHAR) || ':' || wave, '-') || ';4:wind=' || coalesce(length(wind::VARCHAR) || ':' || wind, '-') || ';5:swell=' || coalesce(length(swell::VARCHAR) || ':' || swell, '-')) AS fingerprint FROM s")
def input_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return _inputs(spark, d).select("vessel_id", watch.input_fingerprint(F.col("inputs")).alias("fingerprint"))


@query("anomaly_rollup", cte("obs") + """, v AS (SELECT event_id, value / 16.0 AS x, CASE WHEN event_id % 5 <> 0 THEN (event_id % 9) * 0.25 END AS b, event_id % 4 <> 0 AS sst, event_id % 12 = 1 AS hot FROM obs),
 f AS (SELECT event_id, sst, sst AND hot AS h, x IS NOT NULL AND b IS NOT NULL AS c, coalesce(b > 0 AND x / nullif(b, 0) >= 3.0 AND x >= 1.0, false) AS bloom, coalesce(x <= 0.05 AND x < 0.2 * b, false) AS slick FROM v)
 SELECT event_id, CASE WHEN c OR sst THEN CASE WHEN c THEN bloom::INTEGER + slick::INTEGER ELSE 0 END + h::INTEGER END AS flags, NOT (c OR sst) AS abstains FROM f""")  # fmt: skip
def anomaly_rollup(spark: SparkSession, d: str) -> DataFrame:
    n, x = F.col("event_id"), F.col("value") / 16.0
    b = F.when(n % 5 != 0, (n % 9) * 0.25)
    made = watch.anomaly_rollup(x, b, kernels.bloom_flag(x, b), kernels.slick_flag(x, b), n % 4 != 0, F.when(n % 12 == 1, "medium"))
    return view(spark, d, "obs").select("event_id", made.alias("r")).select("event_id", "r.*")


_TOOLS = ("vhf_radio", "flares", "epirb", "liferaft", "navic_gemini", "mirror", "whistle")


@query("call_for_help", f"SELECT c_custkey AS vessel_id, list_has_any([{', '.join(repr(t) for t in _TOOLS)}][1 + c_custkey % 7 : 1 + c_custkey % 7 + c_custkey % 2], ['vhf_radio', 'epirb', 'navic_gemini']) AS can_call FROM customer")
def call_for_help(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey")
    held = F.slice(F.array(*map(F.lit, _TOOLS)), (1 + n % 7).cast("int"), (1 + n % 2).cast("int"))
    return view(spark, d, "customer").select(n.alias("vessel_id"), watch.can_call(held).alias("can_call"))


@query("fleet_members", "SELECT c_custkey AS user_id, 'f' || (c_custkey % 3) AS fleet FROM customer WHERE list_contains([3, 5, 8, 13, 21, 34], c_custkey % 40) OR c_custkey % 3 = c_custkey % 4")
def fleet_members(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey")
    fleet = F.concat(F.lit("f"), n % 3)
    own = watch.in_fleet(n % 40, F.array(*[F.lit(x).cast("bigint") for x in (3, 5, 8, 13, 21, 34)]), fleet, F.array(F.concat(F.lit("f"), n % 4)))
    return view(spark, d, "customer").where(own).select(n.alias("user_id"), fleet.alias("fleet"))


_TURNS = "WITH t AS (SELECT conv_id, turn, 'l' || ((conv_id + turn) % 3) AS language, (conv_id * 3 + turn * 5) % 10 AS c, CASE (conv_id + 2 * turn) % 3 WHEN 0 THEN 'script' WHEN 1 THEN 'provider' ELSE 'lexicon' END AS method FROM conversations)"


@query("pinned_languages", _TURNS + """, o AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR (c >= 8 AND method <> 'lexicon') THEN language END AS offered FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 p AS (SELECT *, last_value(offered IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS pinned FROM o)
 SELECT conv_id, turn, pinned, NOT coalesce(pinned = lag(pinned) OVER (PARTITION BY conv_id ORDER BY turn), false) AS changed FROM p""")  # fmt: skip
def pinned_languages(spark: SparkSession, d: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    method = F.element_at(F.array(F.lit("script"), F.lit("provider"), F.lit("lexicon")), ((c + 2 * t) % 3 + 1).cast("int"))
    turns = view(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("l"), (c + t) % 3).alias("language"), (((c * 3 + t * 5) % 10) / 10).alias("confidence"), method.alias("method"))
    return watch.pinned_language(turns, "conv_id", "turn").select("conv_id", "turn", "pinned", "changed")


@query("abstentions_since", "SELECT event_id FROM events WHERE event_id % 7 = 3 AND ts >= TIMESTAMP '2024-01-20 00:00:00'")
def abstentions_since(spark: SparkSession, d: str) -> DataFrame:
    runs = view(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 3, "abstain").otherwise("ok").alias("status"), F.col("ts").alias("recorded_at"))
    return watch.abstentions_since(runs, ntz()).select("event_id")
