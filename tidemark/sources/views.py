"""Projections of the driver's tables to the engine's shapes: the same SQL text for Spark and for the oracle.

`{div}` is integer division, `{hours}`/`{days}` make intervals, `{ntz}` the zoneless timestamp type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "obs": (("events",), """SELECT event_id, event_type AS variable, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
  4.0E0 + (event_id % 64) * 0.125E0 AS lat, 76.0E0 + ((event_id * 7) % 64) * 0.125E0 AS lon,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 10.0E0 END AS depth_m, CAST(CAST(ts AS DATE) AS {ntz}) AS valid_time, ts AS issued_time,
  concat('src', CAST(user_id % 5 AS STRING)) AS source, CASE WHEN event_id % 17 = 0 THEN 'missing' ELSE 'observed' END AS quality,
  user_id, concat('ds', CAST(event_id % 3 AS STRING)) AS dataset_id FROM events"""),
    "docs": (("documents",), """SELECT doc_id, text, lang, concat('k', CAST(doc_id % 8 AS STRING)) AS kind, source, CAST('2024-01-01' AS {ntz}) + {hours(doc_id)} AS issued_time,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST('2024-01-11' AS {ntz}) + {hours(doc_id)} END AS valid_until, 1 + doc_id % 5 AS authority_rank,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('R', CAST(doc_id % 4 AS STRING)) END AS region FROM documents"""),
    "zones": (("part",), """SELECT p_partkey AS zone_id, CAST(p_size AS DOUBLE) AS distance_nm, CAST((p_partkey * 13) % 50 AS DOUBLE) AS fuel_cost_litres,
  CAST((p_partkey * 29) % 101 AS DOUBLE) AS safety_score, CAST((p_partkey * 17) % 64 AS DOUBLE) * 0.125E0 AS catch_signal, p_partkey % 7 <> 0 AS compliant FROM part"""),
    "vessels": (("customer",), """SELECT c_custkey AS vessel_id, CASE c_custkey % 4 WHEN 0 THEN 'catamaran' WHEN 1 THEN 'frp_vallam' WHEN 2 THEN 'gillnetter' ELSE 'mechanized_trawler' END AS vessel_class,
  6.0E0 + (c_custkey % 16) AS length_overall_m, CAST(c_custkey % 3 AS DOUBLE) * 40.0E0 AS engine_power_hp, 0.5E0 + (c_custkey % 8) * 0.125E0 AS freeboard_m,
  c_custkey % 5 = 0 AS can_call, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey % 40) * 0.125E0 END AS wave_height_m, CAST((c_custkey * 7) % 20 AS DOUBLE) AS wind_speed_ms,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 2.0E0 + (c_custkey % 8) END AS swell_period_s, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey % 9) * 0.125E0 END AS squall_risk,
  (c_custkey % 17) / 16.0E0 AS reliability, 8.0E0 + (c_custkey % 24) * 0.125E0 AS lat, 78.0E0 + ((c_custkey * 5) % 32) * 0.125E0 AS lon, c_custkey % 4 <> 0 AS at_sea,
  CAST(c_custkey % 61 AS INT) AS position_age_min, c_custkey % 9 = 0 AS no_position, CAST(c_custkey % 4 AS INT) AS endpoints FROM customer"""),
    "shelters": (("supplier",), """SELECT s_suppkey AS shelter_id, s_name AS name, 8.0E0 + ((s_suppkey * 3) % 25) * 0.125E0 AS lat, 78.0E0 + ((s_suppkey * 11) % 33) * 0.125E0 AS lon FROM supplier"""),
    "grid": (("events",), """SELECT CAST(event_id % 12 AS INT) AS row, CAST((event_id {div} 12) % 12 AS INT) AS col, ((event_id * 5) % 32) * 0.125E0 AS wave_height_m,
  CAST(event_id % 9 AS DOUBLE) AS wind_speed_ms, event_id % 13 = 0 AS blocked, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 20 AS DOUBLE) END AS depth_m FROM events WHERE event_id < 144"""),
    "edges": (("nation",), """SELECT concat('r', CAST(n_regionkey AS STRING)) AS source_id, concat('n', CAST(n_nationkey AS STRING)) AS target_id FROM nation
  UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('n', CAST(n_nationkey + 7 AS STRING)) FROM nation WHERE n_nationkey + 7 < 25"""),
    "registry": (("part",), """SELECT concat('d', CAST(p_partkey AS STRING)) AS dataset_id, concat('src', CAST(p_partkey % 5 AS STRING)) AS source_id,
  split(CASE p_size % 4 WHEN 0 THEN 'click,view' WHEN 1 THEN 'view' WHEN 2 THEN 'click,error' ELSE 'click' END, ',') AS variables,
  CAST(p_partkey % 13 AS DOUBLE) - 6.0E0 AS south, CAST(p_partkey % 13 AS DOUBLE) + 4.0E0 + (p_partkey % 7) AS north, 60.0E0 + (p_partkey % 19) AS west, 74.0E0 + (p_partkey % 17) AS east,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat(CAST(2018 + p_partkey % 8 AS STRING), '-01-01') END AS starts, CASE WHEN p_partkey % 4 <> 0 THEN NULL ELSE concat(CAST(2022 + p_partkey % 5 AS STRING), '-12-31') END AS ends,
  CAST(1 + p_partkey % 5 AS INT) AS authority_rank, CAST(p_partkey % 17 AS DOUBLE) * 0.0625E0 AS reliability_prior, CAST(p_partkey % 11 AS DOUBLE) AS cost, p_partkey % 6 = 0 AS requires_auth FROM part"""),
    "bulletins": (("events",), """SELECT concat('c', CAST(user_id AS STRING)) AS system, max(ts) AS issued_time FROM events WHERE ts <= CAST('2024-01-20' AS {ntz}) GROUP BY user_id"""),
    "turns": (("conversations",), """SELECT conv_id, turn, role, text, CASE WHEN (conv_id + turn) % 3 = 0 THEN concat('intent', CAST((conv_id + turn) % 5 AS STRING)) END AS intent,
  CASE WHEN (conv_id * 2 + turn) % 4 = 0 THEN concat('place', CAST(turn % 7 AS STRING)) END AS place, CASE WHEN (conv_id + 3 * turn) % 5 = 0 THEN concat('window', CAST(turn AS STRING)) END AS time_window FROM conversations"""),
}


def _fill(sql: str, spark: bool) -> str:
    for unit in ("hours",):
        while f"{{{unit}(" in sql:
            a = sql.index(f"{{{unit}(")
            b = sql.index(")}", a)
            inner = sql[a + len(unit) + 2 : b]
            made = f"make_dt_interval(0, CAST({inner} AS INT), 0, 0)" if spark else f"to_hours(CAST({inner} AS BIGINT))"
            sql = sql[:a] + made + sql[b + 2 :]
    return sql.replace("{div}", "div" if spark else "//").replace("{ntz}", "TIMESTAMP_NTZ" if spark else "TIMESTAMP")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection view, or a driver table as it is."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables, sql = VIEWS[name]
    sql = _fill(sql, True)
    (table,) = tables
    return spark.sql(sql.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def cte(*names: str) -> str:
    """WITH list of the views, for the oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({_fill(VIEWS[n][1], False)})" for n in names)
