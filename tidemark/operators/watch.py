"""Hazards, closures, input checks and evidence rows that an alert tick and a decision are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import alerts as A
from tidemark.functions.timeq import age_seconds, in_season
from tidemark.operators import spatial

MOST_SYSTEMS = 1000  # cyclones in force at once; more are an error
DEFAULT_RANK = 5
# fixed values: how certain each rule's evidence is, and equipment that can raise an alarm
CERTAINTY = {"cyclone_wind": "Observed", "cyclone_cone": "Possible", "wave_height": "Likely", "wind_speed": "Likely", "lightning": "Observed", "squall": "Possible", "geofence_proximity": "Observed", "geofence_drift": "Likely"}
CALLS = ("vhf_radio", "epirb", "navic_gemini")


def active_cyclones(cyclones: DataFrame, now: Column, max_age_s: int = A.CYCLONE_AGE_S) -> DataFrame:
    """Systems whose bulletin is at most max_age_s old."""
    return cyclones.where(age_seconds(F.col("issued_time"), now) <= max_age_s)


def evaluate_cyclones(points: DataFrame, cyclones: DataFrame, rings: DataFrame, cones: DataFrame, id_: str, now: Column) -> DataFrame:
    """Both cyclone rules for each point and active system: id, hazard, rule, outcome, knots.

    cyclones(system, issued_time), rings(system, knots, ring), cones(system, ring). The result has a row for each point and
    system, so the systems' names (at most MOST_SYSTEMS) are dealt out as an array, and which of them have a cone is a list;
    rings and cones of these systems go to the points and meet them by grid cells, so no task has all points of a system.
    """
    names = [r.system for r in active_cyclones(cyclones, now).select("system").distinct().orderBy("system").limit(MOST_SYSTEMS + 1).collect()]
    if len(names) > MOST_SYSTEMS:
        raise ValueError("more active systems than MOST_SYSTEMS")
    listed = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    every = points.select(id_, F.explode(listed).alias("hazard"))
    rings, cones = (x.where(F.col("system").isin(names)) for x in (rings, cones))
    with_cone = [r.system for r in cones.select("system").distinct().collect()]
    at = points.select(id_, "lat", "lon")
    wind = spatial.containing(at, rings, few=True).groupBy(id_, F.col("system").alias("hazard")).agg(F.max("knots").alias("knots"))
    cone = spatial.containing(at, cones, few=True).select(id_, F.col("system").alias("hazard"), F.lit(True).alias("inside")).distinct()
    rows = every.join(wind, [id_, "hazard"], "left").join(cone, [id_, "hazard"], "left")
    inside, has_cone = F.coalesce("inside", F.lit(False)), F.col("hazard").isin(with_cone)
    rules = F.array(F.struct(F.lit("cyclone_wind").alias("rule"), A.cyclone_rule(F.col("knots")).alias("outcome")), F.struct(F.lit("cyclone_cone").alias("rule"), A.cone_rule(has_cone, inside).alias("outcome")))
    return rows.select(id_, "hazard", "knots", F.explode(rules).alias("r")).select(id_, "hazard", "r.rule", "r.outcome", "knots")


def hazard_ref(observed: Column) -> Column:
    """The hazard that a result is about: its system, or nothing."""
    return F.coalesce(observed["system"], F.lit(""))


def certainty(rule: Column) -> Column:
    return A.looked_up(CERTAINTY, rule)


def tick(results: DataFrame, id_: str) -> DataFrame:
    """The worst fired result of each subscriber (ties: rule, then hazard) with its CAP severity and certainty."""
    order = F.struct((-A.rank(F.col("outcome"))).alias("r"), "rule", "hazard", "outcome")
    worst = results.where(A.rank(F.col("outcome")) >= A.RANKS["watch"]).groupBy(id_).agg(F.min(order).alias("w")).select(id_, "w.rule", "w.hazard", "w.outcome")
    return worst.withColumn("severity", A.severity(F.col("outcome"))).withColumn("certainty", certainty(F.col("rule")))


def boundary_results(vessels: DataFrame, line: list[tuple[float, float]], id_: str, home_side: str | None = None, horizon_s: int = 3600) -> DataFrame:
    """Both boundary rules of each vessel: id, hazard, rule, outcome, distance_km, minutes. vessels(id, lat, lon,
    heading_deg, speed_ms, current_east_ms, current_north_ms); vessels without a position have no part.

    Proximity goes by the warning band and, if home_side is named, by having crossed; it says where a boat is, so it has no
    minutes. Drift goes by the minutes until the course over ground, current included, first stands on the other side.
    """
    at = vessels.where("lat IS NOT NULL AND lon IS NOT NULL")
    none = F.lit(None).cast("double")
    near = spatial.boundary(at.select(id_, "lat", "lon"), line, home_side)
    close = near.select(id_, F.lit("").alias("hazard"), F.lit("geofence_proximity").alias("rule"), A.band_rule(F.col("band")).alias("outcome"), (F.col("metres") / 1000).alias("distance_km"), none.alias("minutes"))
    motion = at.select(F.col(id_).alias("id"), "lat", "lon", "heading_deg", "speed_ms", "current_east_ms", "current_north_ms")
    way = spatial.drift(motion, line, horizon_s).select(F.col("id").alias(id_), (F.col("closest_m") / 1000).alias("distance_km"), (F.col("crossing_s") / 60).alias("minutes"))
    return close.union(way.select(id_, F.lit("").alias("hazard"), F.lit("geofence_drift").alias("rule"), A.drift_rule(F.col("minutes")).alias("outcome"), "distance_km", "minutes"))


def audit(subscribers: DataFrame, results: DataFrame, id_: str) -> DataFrame:
    """One row a subscriber: why it was skipped, or how its rules came out. subscribers(id, skip)."""
    fired = A.rank(F.col("outcome")) >= A.RANKS["watch"]
    counts = results.groupBy(id_).agg(F.count("*").alias("evaluated"), F.count_if(fired).alias("fired"), F.count_if(F.col("outcome") == "unevaluated").alias("unevaluated"))
    zero = lambda c: F.when(F.col("skip").isNull(), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long").alias(c)
    return subscribers.join(counts, id_, "left").select(id_, "skip", zero("evaluated"), zero("fired"), zero("unevaluated"))


def closed_areas(inside: DataFrame, seasons: DataFrame, day: Column) -> DataFrame:
    """Of inside(id, area_id) the areas closed on a day. seasons(area_id, severity, m1, d1, m2, d2) has a row for each
    season; an area whose months are null has none and is always closed."""
    shut = seasons.where(F.col("m1").isNull() | in_season(day, F.col("m1"), F.col("d1"), F.col("m2"), F.col("d2"))).select("area_id", "severity").distinct()
    return inside.join(shut, "area_id").withColumn("blocks", F.col("severity") == "hard")


def evidence_rows(records: DataFrame, ranks: DataFrame) -> DataFrame:
    """Observations with their source's authority rank (DEFAULT_RANK if it has none) and a provenance id made of the key
    (coordinates to four places, no depth)."""
    when = F.date_format("valid_time", "yyyy-MM-dd'T'HH:mm:ss")
    place = F.concat_ws(",", F.format_string("%.4f", "lat"), F.format_string("%.4f", "lon"))
    name = F.concat_ws(":", "source", "variable", when, place)
    url = F.concat(F.lit("tidemark://observation/"), F.col("source"), F.lit("/"), F.coalesce("dataset_id", F.lit("default")))
    return records.join(ranks, "source", "left").withColumn("authority_rank", F.coalesce("authority_rank", F.lit(DEFAULT_RANK))).withColumn("provenance_id", name).withColumn("url", url)


def candidates(sources: DataFrame, box: tuple[float, float, float, float], variables: list[str]) -> DataFrame:
    """Sources that cover the box and serve a variable, with their place in the order of authority and name."""
    s, n, w, e = box
    fit = (F.col("south") <= s) & (F.col("north") >= n) & (F.col("west") <= w) & (F.col("east") >= e) & F.arrays_overlap("variables", F.array(*map(F.lit, variables)))
    return sources.where(fit).withColumn("place", F.row_number().over(W.orderBy("authority_rank", "source_id", "dataset_id")))  # a registry, not data


def unapproved(formulas: Column, approved: list[str]) -> Column:
    """Formula ids that aren't approved, in order; none: the check passes, any: it blocks."""
    return F.array_sort(F.array_except(formulas, F.array(*map(F.lit, approved))))


def input_state(inputs: Column) -> Column:
    """struct(max_age, stale, reason, blamed) of array<struct<name, value, age, stale, required>>.

    A stale required input makes a kernel abstain (the oldest is blamed, of equals the first), else a missing one (all
    are named); the largest age is 0 if there is none.
    """
    names = lambda rows: F.array_sort(F.transform(rows, lambda i: i["name"]))
    stale = F.filter(inputs, lambda i: i["required"] & i["stale"])
    missing = F.filter(inputs, lambda i: i["required"] & i["value"].isNull())
    oldest = F.array_max(F.transform(stale, lambda i, k: F.struct(F.coalesce(i["age"], F.lit(0)).alias("age"), (-k).alias("k"), i["name"].alias("name"))))["name"]
    reason = F.when(F.size(stale) > 0, "stale_input").when(F.size(missing) > 0, "missing_required_input")
    blamed = F.when(F.size(stale) > 0, oldest).when(F.size(missing) > 0, F.array_join(names(missing), ","))
    top = F.coalesce(F.array_max(F.transform(inputs, lambda i: i["age"])), F.lit(0))
    return F.struct(top.alias("max_age"), F.array_join(names(F.filter(inputs, lambda i: i["stale"])), ",").alias("stale"), reason.alias("reason"), blamed.alias("blamed"))


def input_fingerprint(inputs: Column) -> Column:
    """SHA-256 over the inputs in order of their names. Sizes stand before names and values, so no separator in them can
    make two different inputs alike; a null value is a dash."""
    sized = lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    pairs = F.array_sort(F.transform(inputs, lambda i: F.concat(sized(i["name"]), F.lit("="), sized(i["value"].cast("string")))))
    return F.sha2(F.array_join(pairs, ";"), 256)


def conditions_for(subscribers: DataFrame, conditions: DataFrame, by: str) -> DataFrame:
    """Each subscriber with the conditions that were fetched for them; nulls where none were."""
    return subscribers.join(conditions, by, "left")


def active_endpoints(endpoints: Column) -> Column:
    """Of array<struct<channel, active>> the ways that reach a subscriber now; none for null."""
    return F.coalesce(F.filter(endpoints, lambda e: F.coalesce(e["active"], F.lit(False))), F.slice(endpoints, 1, 0), F.array().cast("array<struct<channel:string,active:boolean>>"))


def anomaly_rollup(chlorophyll: Column, baseline: Column, bloom: Column, slick: Column, has_sst: Column, heatwave: Column) -> Column:
    """struct(flags, abstains): flags raised by the detectors that have inputs; null and true if none has any."""
    colour = chlorophyll.isNotNull() & baseline.isNotNull()
    n = F.when(colour, bloom.isNotNull().cast("int") + slick.isNotNull().cast("int")).otherwise(0) + F.when(has_sst, heatwave.isNotNull().cast("int")).otherwise(0)
    return F.struct(F.when(colour | has_sst, n).alias("flags"), (~(colour | has_sst)).alias("abstains"))


def can_call(equipment: Column) -> Column:
    return F.arrays_overlap(equipment, F.array(*map(F.lit, CALLS)))


def in_fleet(user: Column, members: Column, fleet: Column, fleets: Column) -> Column:
    """Membership from either side."""
    return F.array_contains(members, user) | F.array_contains(fleets, fleet)


def pinned_language(turns: DataFrame, key: str, order: str, threshold: float = 0.8) -> DataFrame:
    """turns(key, order, language, confidence, method) with the conversation's pinned language and whether it changed:
    the first detection pins; later ones change it only if sure enough and by script or provider."""
    w = W.partitionBy(key).orderBy(order)
    sure = (F.col("confidence") >= threshold) & F.col("method").isin("script", "provider")
    offered = F.when((F.row_number().over(w) == 1) | sure, F.col("language"))
    rows = turns.withColumn("_offered", offered).withColumn("pinned", F.last("_offered", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("changed", ~F.coalesce(F.col("pinned") == F.lag("pinned").over(w), F.lit(False))).drop("_offered")


def abstentions_since(runs: DataFrame, moment: Column) -> DataFrame:
    return runs.where((F.col("status") == "abstain") & (F.col("recorded_at") >= moment)).orderBy(F.desc("recorded_at"))
