"""An archive of upstream payloads as a Spark data source with pushdown.

An archive holds text files of point payloads, one JSON object a line:

    {"source", "dataset_id", "license", "latitude", "longitude", "hourly_units": {field: unit},
     "hourly": {"time": [...], "issued": [...], "id": [...], field: [...]}}

in folders by source, day and tile, and a manifest with one row a file: what it covers. `spark.read.format("payloads")`
plans one partition a file. Filters on source, variable, lat, lon and valid_time are taken by pushFilters: the manifest is
read under them, so files that can't hold a match are never opened, and rows are held to them exactly, so Spark doesn't
filter again. What an upstream failed to give comes back as rows beside the records:

- `missing`: a variable was asked for that no file of a source has at all;
- `ended`: a source's archive ends before the window that was asked for;
- `refused`: a payload's field is in another unit than the variable's (`units` option, JSON), or a line isn't a payload.

Nulls in a payload's list are records of quality `missing`: a gap stays a gap.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from tidemark.functions.timeq import in_box

SCHEMA = (
    "status string, variable string, value double, unit string, lat double, lon double, valid_time timestamp_ntz, issued_time timestamp_ntz,"
    " record_id long, source string, dataset_id string, license string, quality string, archive_uri string, note string"
)
MANIFEST = "file string, source string, fields array<string>, south double, north double, west double, east double, starts timestamp_ntz, ends timestamp_ntz, payloads long"
PAYLOAD = "source string, dataset_id string, license string, latitude double, longitude double, hourly_units map<string,string>, hourly struct<time:array<string>>"
TILE = 30.0  # degrees of the tiles that an archive's files are dealt by
LINES = 20_000  # payloads a file
TIMES = "%Y-%m-%dT%H:%M:%S.%f"
RESERVED = ("time", "issued", "id")


# --- writing -------------------------------------------------------------------------------------------------------


def write_archive(observations: DataFrame, path: str, units: dict[str, str], tile: float = TILE) -> None:
    """Archive observations (source, dataset_id, variable, value, lat, lon, valid_time, issued_time, event_id) as payloads
    of one point, day and variable. Files are dealt by source, day and tile and hold LINES payloads at most."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    point = F.sort_array(F.collect_list(F.struct("valid_time", "issued_time", "event_id", "value")))
    days = observations.withColumn("day", F.to_date("valid_time"))
    rows = days.groupBy("source", "dataset_id", "day", "variable", "lat", "lon").agg(point.alias("p"))
    unit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in sorted(units.items()) for x in (k, v)]), F.col("variable")), F.lit("1"))
    values = F.transform("p", lambda x: F.coalesce(x["value"].cast("string"), F.lit("null")))
    quoted = lambda name: F.concat(F.lit('["'), F.array_join(F.transform("p", lambda x: stamp(x[name])), '","'), F.lit('"]'))
    head = F.to_json(F.struct("source", "dataset_id", F.lit("open").alias("license"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.create_map("variable", unit).alias("hourly_units")))
    ids = F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x["event_id"].cast("string")), ","), F.lit("]"))
    hourly = F.concat(F.lit('{"time":'), quoted("valid_time"), F.lit(',"issued":'), quoted("issued_time"), F.lit(',"id":'), ids, F.lit(',"'), F.col("variable"), F.lit('":['), F.array_join(values, ","), F.lit("]}"))
    at = F.concat_ws("_", F.floor(F.col("lat") / tile).cast("string"), F.floor(F.col("lon") / tile).cast("string"))
    made = rows.select("source", "day", at.alias("tile"), head.alias("h"), hourly.alias("y"))
    made = made.select("source", "day", "tile", F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"hourly":'), F.col("y"), F.lit("}")).alias("value"))
    made.repartition("source", "day", "tile").sortWithinPartitions("source", "day", "tile").write.option("maxRecordsPerFile", LINES).partitionBy("source", "day", "tile").text(path)
    write_manifest(observations.sparkSession, path)


def write_manifest(spark: SparkSession, path: str) -> None:
    """One row a payload file: its fields, box and times. Lines that aren't payloads cover nothing."""
    lines = spark.read.text(path, pathGlobFilter="part-*").select(F.col("_metadata.file_path").alias("f"), "value")
    made = F.from_json("value", PAYLOAD)
    times = F.col("j.hourly.time")
    rows = lines.select("f", made.alias("j")).select(
        "f", "j.source", F.map_keys("j.hourly_units").alias("fields"), F.col("j.latitude").alias("lat"), F.col("j.longitude").alias("lon"),
        F.try_to_timestamp(F.replace(F.array_min(times), F.lit("T"), F.lit(" "))).cast("timestamp_ntz").alias("s"), F.try_to_timestamp(F.replace(F.array_max(times), F.lit("T"), F.lit(" "))).cast("timestamp_ntz").alias("e"),
    )
    parts = F.split("f", "/")
    name = F.array_join(F.slice(parts, -4, 4), "/")  # source, day, tile, file
    files = rows.groupBy(name.alias("file")).agg(
        F.max("source").alias("source"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("fields")))).alias("fields"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"),
        F.min("s").alias("starts"), F.max("e").alias("ends"), F.count("*").alias("payloads"),
    )
    files.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


# --- what a source can serve ---------------------------------------------------------------------------------------


def descriptors(files: DataFrame) -> DataFrame:
    """What each source of an archive publishes: its variables, box, times, files and payloads."""
    return files.where("source IS NOT NULL").groupBy("source").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("fields")))).alias("variables"), F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east"),
        F.min("starts").alias("starts"), F.max("ends").alias("ends"), F.count("*").alias("files"), F.sum("payloads").alias("payloads"),
    )


def supports(sources: DataFrame, box: tuple[float, float, float, float], variables: Sequence[str]) -> DataFrame:
    """Add covers (the boxes overlap), unsupported (variables that the source doesn't publish) and supports (it could serve
    the whole request): decided from what the source declares, before anything is read."""
    south, north, west, east = box
    covers = (F.col("south") <= north) & (F.col("north") >= south) & (F.col("west") <= east) & (F.col("east") >= west)
    lacking = F.array_except(F.array(*map(F.lit, sorted(set(variables)))), "variables")
    return sources.withColumn("covers", covers).withColumn("unsupported", lacking).withColumn("supports", covers & (F.size(lacking) == 0))


# --- reading -------------------------------------------------------------------------------------------------------


@dataclass
class Asked:
    """The conditions that the reader has taken over."""

    sources: set[str] | None = None
    variables: set[str] | None = None
    low: dict[str, tuple] = field(default_factory=dict)  # column: (bound, bound itself allowed)
    high: dict[str, tuple] = field(default_factory=dict)

    RANGED = ("lat", "lon", "valid_time")

    def take(self, f: D.Filter) -> bool:
        """Whether this filter is ours from now on."""
        name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        if name in ("source", "variable"):
            if isinstance(f, D.IsNotNull):
                return True
            if isinstance(f, D.EqualTo | D.In):
                wanted = {f.value} if isinstance(f, D.EqualTo) else set(f.value)
                held = f"{name}s"
                setattr(self, held, wanted if getattr(self, held) is None else getattr(self, held) & wanted)
                return True
        if name in self.RANGED:
            if isinstance(f, D.IsNotNull):
                return True
            if isinstance(f, D.GreaterThan | D.GreaterThanOrEqual | D.EqualTo):
                new = (plain(f.value), not isinstance(f, D.GreaterThan))
                old = self.low.get(name)
                self.low[name] = new if old is None or new[0] > old[0] or (new[0] == old[0] and not new[1]) else old
            if isinstance(f, D.LessThan | D.LessThanOrEqual | D.EqualTo):
                new = (plain(f.value), not isinstance(f, D.LessThan))
                old = self.high.get(name)
                self.high[name] = new if old is None or new[0] < old[0] or (new[0] == old[0] and not new[1]) else old
            return isinstance(f, D.GreaterThan | D.GreaterThanOrEqual | D.LessThan | D.LessThanOrEqual | D.EqualTo)
        return False

    def holds(self, name: str, x: object) -> bool:
        low, high = self.low.get(name), self.high.get(name)
        return (low is None or x > low[0] or (low[1] and x == low[0])) and (high is None or x < high[0] or (high[1] and x == high[0]))

    def files(self) -> ds.Expression:
        """Which files can hold a match."""
        found = ds.field("file").is_valid()
        if self.sources is not None:
            found &= ds.field("source").isin(sorted(self.sources)) | ds.field("source").is_null()
        for name, (least, most) in {"lat": ("south", "north"), "lon": ("west", "east"), "valid_time": ("starts", "ends")}.items():
            kind = pa.timestamp("us") if name == "valid_time" else pa.float64()
            if name in self.low:
                found &= (ds.field(most) >= pa.scalar(self.low[name][0], kind)) | ds.field(most).is_null()
            if name in self.high:
                found &= (ds.field(least) <= pa.scalar(self.high[name][0], kind)) | ds.field(least).is_null()
        return found


def plain(x: object) -> object:
    """Decimals and zoned times as the reader compares them."""
    if isinstance(x, datetime):
        return x.replace(tzinfo=None)
    return float(x) if not isinstance(x, str) else x


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class PayloadFile(D.InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


class Report(D.InputPartition):
    """What no file can tell: rows (status, source, variable, note)."""

    def __init__(self, rows: list[tuple[str, str, str | None, str]]):
        super().__init__(rows)
        self.rows = rows


class Payloads(D.DataSource):
    """Options: path (of an archive), units (JSON: the unit of each variable; other units are refused)."""

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> PayloadReader:
        return PayloadReader(self.options["path"], json.loads(self.options.get("units") or "{}"))


class PayloadReader(D.DataSourceReader):
    def __init__(self, path: str, units: dict[str, str]):
        self.path, self.units, self.asked = path.rstrip("/"), units, Asked()

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            if not self.asked.take(f):
                yield f

    def partitions(self) -> list[D.InputPartition]:
        system, path = filesystem(self.path)
        files = ds.dataset(f"{path}/_manifest", filesystem=system, format="parquet", exclude_invalid_files=True)
        chosen = files.to_table(columns=["file", "fields"], filter=self.asked.files())
        wanted = self.asked.variables
        names = sorted(f for f, fields in zip(chosen["file"].to_pylist(), chosen["fields"].to_pylist(), strict=True) if wanted is None or not fields or wanted & set(fields))
        return [*map(PayloadFile, names), Report(self.lacking(files))]

    def lacking(self, files: ds.Dataset) -> list[tuple[str, str, str | None, str]]:
        """Per source: variables that it doesn't have, and whether it ended before the window. Two columns of the manifest
        are folded batch by batch."""
        has: dict[str, set[str]] = {}
        ends: dict[str, datetime] = {}
        for batch in files.to_batches(columns=["source", "fields", "ends"], filter=ds.field("source").is_valid()):
            for source, fields, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                has.setdefault(source, set()).update(fields or [])
                if end is not None:
                    ends[source] = max(ends.get(source, end), end)
        rows = []
        since = self.asked.low.get("valid_time")
        for source in sorted(has if self.asked.sources is None else set(has) & self.asked.sources):
            rows += [("missing", source, v, "no payload of this source has the variable") for v in sorted((self.asked.variables or set()) - has[source])]
            if since and source in ends and ends[source] < since[0]:
                rows.append(("ended", source, None, f"the archive ends {ends[source]:%Y-%m-%d}, before the window"))
        return rows

    def read(self, partition: D.InputPartition) -> Iterator[tuple]:
        if isinstance(partition, Report):
            for status, source, variable, note in partition.rows:
                yield (status, variable, *[None] * 7, source, None, None, None, None, note)
            return
        system, path = filesystem(self.path)
        uri = f"{self.path}/{partition.file}"
        with system.open_input_stream(f"{path}/{partition.file}") as raw:
            for line in lines(raw):
                yield from self.records(line, uri)

    def records(self, line: bytes, uri: str) -> Iterator[tuple]:
        try:
            made = json.loads(line)
            hourly = made["hourly"]
            times = [datetime.fromisoformat(t) for t in hourly["time"]]
            issued = [datetime.fromisoformat(t) for t in hourly.get("issued") or hourly["time"]]
            ids = hourly.get("id") or [None] * len(times)
            lat, lon, source = float(made["latitude"]), float(made["longitude"]), made.get("source")
            columns = {k: v for k, v in hourly.items() if k not in RESERVED}
            if any(len(v) != len(times) for v in (issued, ids, *columns.values())):
                raise ValueError("lists of different lengths")
            values = {k: [None if x is None else float(x) for x in v] for k, v in columns.items()}
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            yield ("refused", *[None] * 12, uri, f"not a payload: {type(e).__name__}")
            return
        asked = self.asked
        if (asked.sources is not None and source not in asked.sources) or not asked.holds("lat", lat) or not asked.holds("lon", lon):
            return
        inside = [i for i, t in enumerate(times) if asked.holds("valid_time", t)]
        tail = source, made.get("dataset_id"), made.get("license")
        for name, column in values.items():
            if asked.variables is not None and name not in asked.variables:
                continue
            unit = (made.get("hourly_units") or {}).get(name)
            if unit is not None and unit != self.units.get(name, unit):
                if inside:
                    yield ("refused", name, None, unit, lat, lon, None, None, None, *tail, None, uri, f"unit {unit} is not the expected {self.units[name]}")
                continue
            for i in inside:
                yield ("record", name, column[i], unit, lat, lon, times[i], issued[i], ids[i], *tail, "missing" if column[i] is None else "observed", uri, None)


def lines(raw: pa.NativeFile, block: int = 1 << 20) -> Iterator[bytes]:
    """Lines of a stream, a block at a time."""
    rest = b""
    while data := raw.read(block):
        *whole, rest = (rest + data).split(b"\n")
        yield from (x for x in whole if x)
    if rest:
        yield rest


def payload_session(spark: SparkSession) -> SparkSession:
    """A session of the same cluster that knows the format and lets it take filters; the given one stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    own.dataSource.register(Payloads)
    return own


def read_archive(spark: SparkSession, path: str, units: dict[str, str]) -> DataFrame:
    """All of an archive; filter it, and only what matches is read. Load it anew for each set of filters: Spark keeps with a
    loaded table which partitions were planned for it last."""
    return payload_session(spark).read.format("payloads").option("path", path).option("units", json.dumps(units)).load()


def fetch(spark: SparkSession, path: str, units: dict[str, str], box: tuple[float, float, float, float], start: str, end: str, variables: Sequence[str]) -> DataFrame:
    """One request, an inclusive box and a half-open window, answered by all sources: records, and beside them what they lack."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    within = (F.col("valid_time") >= at(start)) & (F.col("valid_time") < at(end)) & in_box(F.col("lat"), F.col("lon"), *box)
    return read_archive(spark, path, units).where(F.col("variable").isin(sorted(variables)) & within)


def outcome(fetched: DataFrame) -> DataFrame:
    """What a fetch came to by source: records, gaps among them, variables it lacks, and notes."""
    has = lambda s: F.col("status") == s
    return fetched.groupBy("source").agg(
        F.count_if(has("record")).alias("records"), F.count_if(has("record") & (F.col("quality") == "missing")).alias("gaps"),
        F.array_sort(F.collect_set(F.when(has("missing"), F.col("variable")))).alias("missing_variables"), F.array_sort(F.collect_set("note")).alias("warnings"),
    )

