"""Small fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: canonical unit, and the spread beyond which sources disagree, of each variable
VARIABLES = [
    ("significant_wave_height", "m", 0.5),
    ("swell_height", "m", 0.5),
    ("peak_wave_period", "s", 2.0),
    ("mean_wave_direction", "degree", 45.0),
    ("wind_speed", "m s-1", 3.0),
    ("wind_direction", "degree", 45.0),
    ("sea_surface_temperature", "degC", 1.5),
    ("chlorophyll", "mg m-3", 1.0),
    ("current_speed", "m s-1", 0.5),
    ("current_direction", "degree", 45.0),
    ("sea_surface_salinity", "1", 1.0),
    ("mixed_layer_depth", "m", 20.0),
    ("depth_of_20c_isotherm", "m", 20.0),
    ("sea_level", "m", 0.3),
]

# fixed values: caution and avoid wave height (m), caution and avoid wind speed (m/s), least comfortable swell period (s)
VESSEL_CLASSES = [
    ("catamaran", 1.0, 1.5, 7.0, 10.0, 7.0),
    ("frp_vallam", 1.5, 2.0, 8.0, 12.0, 6.0),
    ("gillnetter", 2.0, 3.0, 10.0, 15.0, 5.0),
    ("mechanized_trawler", 2.5, 4.0, 13.0, 18.0, 4.0),
]

# fixed values: the treaty positions of the boundary, north-east to south-west: degrees, minutes of latitude, of longitude
BOUNDARY_POSITIONS = [
    ("6b", 11, 26.6, 83, 22.0),
    ("5b", 11, 16.0, 82, 24.4),
    ("4b", 11, 2.7, 81, 56.0),
    ("3b", 10, 41.7, 81, 2.5),
    ("2b", 10, 33.0, 80, 46.0),
    ("1bb", 10, 8.4, 80, 9.5),
    ("1ba", 10, 5.8, 80, 5.0),
    ("1b", 10, 5.0, 80, 3.0),
    ("2", 9, 57.0, 79, 35.0),
    ("3", 9, 40.15, 79, 22.60),
    ("4", 9, 21.80, 79, 30.70),
    ("5", 9, 13.0, 79, 32.0),
    ("6", 9, 6.0, 79, 32.0),
    ("2m", 9, 0.0, 79, 31.3),
    ("3m", 8, 53.8, 79, 29.3),
    ("4m", 8, 40.0, 79, 18.2),
    ("5m", 8, 37.2, 79, 13.0),
    ("6m", 8, 31.2, 79, 4.7),
    ("7m", 8, 22.2, 78, 55.4),
    ("8m", 8, 12.2, 78, 53.7),
    ("9m", 7, 35.3, 78, 45.7),
    ("10m", 7, 21.0, 78, 38.8),
    ("11m", 6, 30.8, 78, 12.2),
    ("12m", 5, 53.9, 77, 50.7),
    ("13m", 5, 0.0, 77, 10.6),
    ("T", 4, 47.04, 77, 1.40),
]
BOUNDARY = [(label, a + b / 60.0, c + d / 60.0) for label, a, b, c, d in BOUNDARY_POSITIONS]

# closed areas for the spatial queries: (id, ring of (lat, lon))
AREAS = [
    ("a1", [(5.03, 77.03), (7.03, 77.03), (7.03, 79.03), (5.03, 79.03)]),
    ("a2", [(6.03, 78.03), (9.03, 78.03), (9.03, 80.03), (6.03, 80.03)]),
    ("a3", [(4.53, 76.53), (11.03, 76.53), (6.03, 79.03), (11.03, 82.03), (4.53, 82.03)]),
    ("a4", [(8.0, 80.0), (10.0, 80.0), (10.0, 82.0), (8.0, 82.0)]),
    ("a5", [(5.53, 80.03), (6.53, 80.03), (6.53, 81.03), (5.53, 81.03)]),
]

# dataset registry: id, source, variables, south, north, west, east, starts, ends, rank, prior, cost, needs auth
DATASETS = [
    ("d_click", "src0", ["click", "view"], 0.0, 30.0, 60.0, 100.0, None, None, 1, 0.9, 0.0, False),
    ("d_view", "src1", ["view"], 0.0, 6.0, 60.0, 100.0, None, None, 2, 0.8, 1.0, False),
    ("d_arch", "src2", ["click"], 0.0, 30.0, 60.0, 100.0, "2020-01-01", "2023-12-31", 1, 0.95, 0.0, False),
    ("d_paid", "src3", ["click"], 0.0, 30.0, 60.0, 100.0, "2020-01-01", None, 1, 0.7, 9.0, False),
    ("d_auth", "src4", ["click", "error"], 0.0, 30.0, 60.0, 100.0, None, None, 3, 0.85, 0.5, True),
    ("d_far", "src1", ["click"], -60.0, -10.0, 60.0, 100.0, None, None, 1, 0.9, 0.0, False),
    ("d_alt", "src2", ["click"], 5.0, 9.0, 70.0, 90.0, None, None, 1, 0.95, 0.0, False),
]
DATASET_SCHEMA = "dataset_id string, source_id string, variables array<string>, south double, north double, west double, east double, starts string, ends string, authority_rank int, reliability_prior double, cost double, requires_auth boolean"

# seasonal bans: id, jurisdiction, first month and day, last month and day, severity
BANS = [("east", "J0", 4, 15, 6, 14, "hard"), ("west", "J1", 6, 1, 7, 31, "hard"), ("winter", "J2", 11, 20, 1, 31, "soft"), ("all", "J3", 1, 1, 12, 31, "soft")]

# fixed values: cadence and grace of each source in hours
CADENCE_HOURS = {"src0": 24, "src1": 72, "src2": 240, "src3": 1, "src4": 120}


def ring_column(ring: list[tuple[float, float]]) -> str:
    """A ring as a SQL array of structs."""
    return "array(" + ", ".join(f"named_struct('lat', {a!r}D, 'lon', {b!r}D)" for a, b in ring) + ")"


def areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, [{"lat": a, "lon": b} for a, b in ring]) for i, ring in AREAS], "area_id string, ring array<struct<lat:double,lon:double>>")


def datasets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DATASETS, DATASET_SCHEMA)


def bans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BANS, "ban_id string, jurisdiction string, m1 int, d1 int, m2 int, d2 int, severity string")


def vessel_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VESSEL_CLASSES, "vessel_class string, caution_wave double, avoid_wave double, caution_wind double, avoid_wind double, min_period double")
