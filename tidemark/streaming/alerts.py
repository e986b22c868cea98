"""The alert state machine: per (user, rule, hazard) what was last sent decides what is sent next.

One decision function serves both forms: a keyed fold over ordered rows (batch), and a stateful stream whose state ends by
an event-time timeout. Within a micro-batch rows are folded in event-time order, so both give the same decisions for rows
that arrive in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.alerts import RANKS

# fixed values: minutes within which an equal alert isn't sent again, by severity
WINDOW_MINUTES = {"Extreme": 5, "Severe": 15, "Moderate": 30, "Minor": 120, "Unknown": 60}
SHORTENED, PRUNE_HOURS = 0.5, 12
KEY = ["user_id", "rule", "hazard"]
IN = "user_id long, rule string, hazard string, at timestamp, outcome string, severity string, minutes double"
OUT = "user_id long, rule string, hazard string, at timestamp, outcome string, decision string, send_count long"
STATE = "sent string"  # of a user: JSON of (rule, hazard, State)

State = tuple[int, str, str, float | None, int]  # microseconds, outcome, severity, minutes, sends


def decide(state: State | None, at: int, rule: str, outcome: str, severity: str, minutes: float | None) -> tuple[str, State | None]:
    """The decision for one result and the state after it."""
    if state is not None and at - state[0] > PRUNE_HOURS * 3_600_000_000:
        state = None
    if RANKS[outcome] < RANKS["watch"]:  # not evaluated counts as clear
        if state is not None and state[2] in ("Extreme", "Severe"):
            return "send_cancel", None
        return "nothing_to_do", state
    sent = (at, outcome, severity, minutes, 1 + (state[4] if state else 0))
    if state is None:
        return "send_new", sent
    if RANKS[outcome] > RANKS[state[1]]:
        return "send_escalation", sent
    if rule == "geofence_drift" and minutes is not None and state[3] is not None and minutes <= SHORTENED * state[3]:
        return "send_update", sent
    if at - state[0] < WINDOW_MINUTES[severity] * 60_000_000:
        return "suppress_duplicate", state
    return "send_update", sent


def decide_batch(results: DataFrame) -> DataFrame:
    """All results at once: sorted by key and time within partitions, folded in one pass that carries the open key's state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for frame in frames:
            decisions, counts = [], []
            micros = frame["at"].to_numpy("datetime64[us]").astype("int64").tolist()
            for user, rule, hazard, at, outcome, severity, minutes in zip(frame["user_id"], frame["rule"], frame["hazard"], micros, frame["outcome"], frame["severity"], frame["minutes"]):
                if (user, rule, hazard) != last:
                    last, state = (user, rule, hazard), None
                decision, state = decide(state, at, rule, outcome, severity, None if pd.isna(minutes) else float(minutes))
                decisions.append(decision)
                counts.append(state[4] if state else 0)
            yield frame[[*KEY, "at", "outcome"]].assign(decision=decisions, send_count=counts)

    return results.select(*[c.split()[0] for c in IN.split(", ")]).repartition(*KEY).sortWithinPartitions(*KEY, "at", "outcome").mapInPandas(run, OUT)


def decide_stream(results: DataFrame) -> DataFrame:
    """results: a stream with a watermark on `at`. State that can't matter any more is dropped by event time.

    A group is a user with what was sent by rule and hazard: a frame a key would cost more than the decisions on its few rows.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(rule, hazard): tuple(sent) for rule, hazard, sent in json.loads(state.get[0])} if state.exists else {}
        watermark = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            held = {k: sent for k, sent in held.items() if _due(sent) > watermark}
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "outcome"], kind="stable")
            decisions, counts = [], []
            micros = rows["at"].to_numpy("datetime64[us]").astype("int64").tolist()
            for rule, hazard, at, outcome, severity, minutes in zip(rows["rule"], rows["hazard"], micros, rows["outcome"], rows["severity"], rows["minutes"]):
                decision, sent = decide(held.pop((rule, hazard), None), at, rule, outcome, severity, None if pd.isna(minutes) else float(minutes))
                if sent is not None:
                    held[rule, hazard] = sent
                decisions.append(decision)
                counts.append(sent[4] if sent else 0)
            yield rows[[*KEY, "at", "outcome"]].assign(decision=decisions, send_count=counts)
        if held:
            state.update((json.dumps([(*k, sent) for k, sent in held.items()]),))
            state.setTimeoutTimestamp(max(min(map(_due, held.values())), watermark + 1))
        elif state.exists:
            state.remove()

    return results.groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _due(sent: State) -> int:
    """Milliseconds from which on what was sent can't matter any more."""
    return sent[0] // 1000 + PRUNE_HOURS * 3_600_000


def tick_summary(decisions: DataFrame) -> DataFrame:
    """Counts of one run by decision."""
    return decisions.groupBy("decision").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
