"""The life of an alert: decided, sent, reported, committed or retired.

Events of a key (user, rule, hazard) are of two kinds. A `result` says how a rule came out; it is decided against what the
subscriber was last told. A `report` says whether a sent alert (by its identifier) reached a channel. What counts as told
moves only with a report of delivery: until then an alert is pending, and a failed one leaves no trace, so the next result
is sent again instead of being suppressed. A delivered cancellation retires the key, so the next occurrence is a new alert.
An alert that couldn't be built (its context lacks a slot) is recorded and never pending.

One Life serves both forms: a keyed fold over rows in order of time (batch), and transformWithState, where it is kept as a
ValueState and an event-time timer drops what can't matter any more.
Decisions go out through a sink that writes each micro-batch under its id, so a batch that runs again after a restart
replaces its own rows.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.alerts import RANKS
from tidemark.streaming.alerts import PRUNE_HOURS, decide

KEY = ["user_id", "rule", "hazard"]
IN = "user_id long, rule string, hazard string, at timestamp, seq long, kind string, outcome string, severity string, minutes double, built boolean, identifier string, delivered boolean"
OUT = "user_id long, rule string, hazard string, at timestamp, seq long, decision string, identifier string, supersedes string, send_count long, note string"
HOUR_MS = 3_600_000
SENDS = ("send_new", "send_escalation", "send_update", "send_cancel")

Told = tuple[int, str, str, float | None, int, str]  # microseconds, outcome, severity, minutes, sends, identifier


def identifier(user: object, rule: str, hazard: str, at: int) -> str:
    return "tm-" + hashlib.sha256(f"{user}|{rule}|{hazard}|{at}".encode()).hexdigest()[:16]


def micros(at: datetime) -> int:
    """Microseconds since 1970 of a moment in a frame or a row."""
    return at.value // 1000 if isinstance(at, pd.Timestamp) else math.floor(at.timestamp()) * 1_000_000 + at.microsecond


class Life:
    """What a key's subscriber was told, and what is on its way."""

    def __init__(self, told: Told | None = None, pending: dict[str, tuple[Told, str]] | None = None):
        self.told, self.pending = told, dict(pending or {})

    def expire(self, at: int) -> None:
        """Forget what is too old to matter at a moment."""
        old = at - PRUNE_HOURS * HOUR_MS * 1000
        if self.told is not None and self.told[0] < old:
            self.told = None
        self.pending = {k: v for k, v in self.pending.items() if v[0][0] >= old}

    def result(self, user: object, rule: str, hazard: str, at: int, outcome: str, severity: str, minutes: float | None, built: bool) -> tuple[str, str | None, str | None, int, str | None]:
        """decision, identifier, what it supersedes, sends, note"""
        self.expire(at)
        decision, _ = decide(self.told[:5] if self.told else None, at, rule, outcome, severity, minutes)
        count = self.told[4] if self.told else 0
        if decision not in SENDS:
            return decision, None, None, count, None
        if not built:
            return decision, None, None, count, "not built: a slot has no value"
        name = identifier(user, rule, hazard, at)
        self.pending[name] = (at, outcome, severity, minutes, count + 1, name), decision
        return decision, name, self.told[5] if self.told else None, count + 1, None

    def report(self, at: int, name: str, delivered: bool) -> tuple[str, str | None, str | None, int, str | None]:
        self.expire(at)
        sent = self.pending.pop(name, None)
        if sent is None:
            return "unknown_report", name, None, self.told[4] if self.told else 0, "nothing pending under this identifier"
        if not delivered:
            return "failed", name, None, self.told[4] if self.told else 0, "emitted but not delivered on any channel"
        record, decision = sent
        if decision == "send_cancel":
            self.told = None
            return "retired", name, None, 0, None
        if self.told is None or record[0] >= self.told[0]:  # reports may overtake each other
            self.told = record
        return "committed", name, None, self.told[4], None

    def step(self, key: tuple, row: Any) -> tuple:
        """One output row of an event."""
        at = micros(row.at)
        if row.kind == "report":
            made = self.report(at, row.identifier, bool(row.delivered))
        else:
            made = self.result(*key, at, row.outcome, row.severity, None if row.minutes is None or pd.isna(row.minutes) else float(row.minutes), bool(row.built))
        return (*key, row.at, row.seq, *made)


COLUMNS = [c.split()[0] for c in OUT.split(", ")]


OUT_ROW = Row(*COLUMNS)


def live_batch(events: DataFrame) -> DataFrame:
    """All events at once: sorted by key and time within partitions and folded in one pass; one key's life is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, life = None, Life()
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                key = (row.user_id, row.rule, row.hazard)
                if key != last:
                    last, life = key, Life()
                rows.append(life.step(key, row))
            yield pd.DataFrame(rows, columns=COLUMNS)

    return typed(events).repartition(*KEY).sortWithinPartitions(*KEY, "at", F.col("kind") == "report", "seq").mapInPandas(run, OUT)


def typed(events: DataFrame) -> DataFrame:
    return events.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in IN.split(", ")])


class AlertLife(StatefulProcessor):
    """A user's lives, one a rule and hazard, with their state in the store as one value, and a timer for the oldest of what
    was told and what is pending.

    Keys have few rows in a batch, and calls of the store cost more than all that is decided: so rows come one by one, not
    as a frame a key, and a user's keys are loaded and saved at once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lives = handle.getValueState("lives", "lives string, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        lives, timer = self.loaded()
        out = []
        for row in sorted(rows, key=lambda row: (row.at, row.kind == "report", row.seq)):  # results before reports
            one = (row.user_id, row.rule, row.hazard)
            out.append(OUT_ROW(*lives.setdefault(one[1:], Life()).step(one, row)))
        self.save(lives, timer)
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        lives, _ = self.loaded()
        for life in lives.values():
            life.expire(timerValues.getCurrentWatermarkInMs() * 1000)
        self.save(lives, None)  # the timer that has expired is gone
        return iter(())

    def loaded(self) -> tuple[dict[tuple, Life], int | None]:
        held = self.lives.get()
        if held is None:
            return {}, None
        kept = json.loads(held[0])
        return {(rule, hazard): Life(tuple(told) if told else None, {k: (tuple(v), x) for k, (v, x) in pending.items()}) for rule, hazard, told, pending in kept}, held[1]

    def save(self, lives: dict[tuple, Life], timer: int | None) -> None:
        """timer: the one that is set."""
        kept = [(*k, life.told, life.pending) for k, life in lives.items() if life.told is not None or life.pending]
        times = [r[0] for _, _, told, pending in kept for r in (told, *(record for record, _ in pending.values())) if r is not None]
        due = min(times) // 1000 + PRUNE_HOURS * HOUR_MS + 1 if times else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.lives.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.lives.update((json.dumps(kept), due))

    def close(self) -> None:
        pass


def live_stream(events: DataFrame) -> DataFrame:
    """The stream's decisions. events have a watermark on `at`; the session keeps state in RocksDB (lifecycle_session)."""
    return events.groupBy("user_id").transformWithState(AlertLife(), OUT, "append", "EventTime")


def lifecycle_session(spark: SparkSession) -> SparkSession:
    """A session of the same cluster whose streams keep their state in RocksDB; the given one stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    return own


def by_batch(out: str):
    """A foreachBatch function that commits by batch id: a batch that runs again replaces what it wrote before."""

    def put(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return put


def run_to_end(decisions: DataFrame, out: str, state: str) -> int:
    """Run a stream of decisions over all there is, from where its checkpoint stands; the number of batches of this run."""
    query = decisions.writeStream.outputMode("append").foreachBatch(by_batch(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"]])


def decisions_of(spark: SparkSession, out: str) -> DataFrame:
    """What the sink holds."""
    return spark.read.schema(f"{OUT}, batch long").parquet(out).drop("batch")
