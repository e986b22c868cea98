from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tidemark.functions.alerts import SEVERITY
from tidemark.streaming import lifecycle
from tidemark.streaming.lifecycle import Life

MINUTE = 60_000_000
T0 = datetime(2024, 1, 1)


def test_told_moves_only_with_a_delivery():
    life = Life()
    decision, first, before, count, _ = life.result(1, "wave_height", "", 0, "warning", "Severe", None, True)
    assert (decision, before, count) == ("send_new", None, 1)
    assert life.told is None and first in life.pending
    # not delivered: the next result is new again instead of suppressed
    assert life.report(MINUTE, first, False)[0] == "failed" and life.told is None and not life.pending
    decision, second, before, _, _ = life.result(1, "wave_height", "", 2 * MINUTE, "warning", "Severe", None, True)
    assert (decision, before) == ("send_new", None)
    assert life.report(3 * MINUTE, second, True)[0] == "committed"
    assert life.result(1, "wave_height", "", 4 * MINUTE, "warning", "Severe", None, True)[0] == "suppress_duplicate"
    decision, third, before, count, _ = life.result(1, "wave_height", "", 5 * MINUTE, "emergency", "Extreme", None, True)
    assert (decision, before, count) == ("send_escalation", second, 2)
    assert life.report(6 * MINUTE, third, True)[3] == 2


def test_a_delivered_cancellation_retires_the_key():
    life = Life()
    name = life.result(1, "r", "", 0, "emergency", "Extreme", None, True)[1]
    life.report(1, name, True)
    decision, gone, before, _, _ = life.result(1, "r", "", MINUTE, "clear", "Minor", None, True)
    assert (decision, before) == ("send_cancel", name) and life.told is not None
    assert life.report(2 * MINUTE, gone, True)[0] == "retired" and life.told is None
    assert life.result(1, "r", "", 3 * MINUTE, "watch", "Moderate", None, True)[0] == "send_new"
    assert life.report(4 * MINUTE, "tm-unknown", True)[0] == "unknown_report"


def test_an_undelivered_cancellation_is_sent_again():
    life = Life()
    life.report(1, life.result(1, "r", "", 0, "emergency", "Extreme", None, True)[1], True)
    gone = life.result(1, "r", "", MINUTE, "clear", "Minor", None, True)[1]
    life.report(2 * MINUTE, gone, False)
    assert life.result(1, "r", "", 3 * MINUTE, "clear", "Minor", None, True)[0] == "send_cancel"


def test_an_alert_without_its_slots_is_recorded_and_never_pending():
    life = Life()
    decision, name, _, count, note = life.result(1, "r", "", 0, "warning", "Severe", None, False)
    assert (decision, name, count) == ("send_new", None, 0) and "slot" in note and not life.pending


def test_a_drift_alert_is_renewed_when_the_time_has_halved():
    life = Life()
    life.report(1, life.result(1, "geofence_drift", "", 0, "warning", "Severe", 18.0, True)[1], True)
    assert life.result(1, "geofence_drift", "", MINUTE, "warning", "Severe", 10.0, True)[0] == "suppress_duplicate"
    assert life.result(1, "geofence_drift", "", 2 * MINUTE, "warning", "Severe", 9.0, True)[0] == "send_update"


def test_old_state_is_forgotten():
    life = Life()
    life.report(1, life.result(1, "r", "", 0, "warning", "Severe", None, True)[1], True)
    assert life.result(1, "r", "", 12 * 60 * MINUTE + 1, "clear", "Minor", None, True)[0] == "nothing_to_do"


def events(seed=2, n=400, users=6):
    """Results of random outcomes, and a report for each a minute later, as if all had been sent."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user, rule = rng.randrange(users), rng.choice(["wave_height", "geofence_drift"])
        at = T0 + timedelta(minutes=7 * i + rng.randrange(3))
        outcome = rng.choice(["clear", "clear", "watch", "warning", "emergency", "unevaluated"])
        minutes = rng.choice([None, 5.0, 12.0, 30.0])
        rows.append((user, rule, "", at, 2 * i, "result", outcome, SEVERITY[outcome], minutes, rng.random() < 0.9, None, None))
        micros = (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        rows.append((user, rule, "", at + timedelta(minutes=1), 2 * i + 1, "report", None, None, None, None, lifecycle.identifier(user, rule, "", micros), rng.random() < 0.7))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, lifecycle.IN)


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.fixture(scope="module")
def batch(spark):
    return key(lifecycle.live_batch(frame(spark, events()).repartition(5)).collect())


def test_batch_is_the_fold_in_order(batch):
    lives, want = {}, []
    for user, rule, hazard, at, seq, kind, outcome, severity, minutes, built, name, delivered in sorted(events(), key=lambda r: (r[3], r[5] == "report", r[4])):
        life = lives.setdefault((user, rule, hazard), Life())
        micros = (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        made = life.report(micros, name, delivered) if kind == "report" else life.result(user, rule, hazard, micros, outcome, severity, minutes, built)
        want.append((user, rule, hazard, at, seq, *made))
    assert batch == key(want)
    assert {r[5] for r in batch} >= {"send_new", "send_escalation", "send_update", "suppress_duplicate", "send_cancel", "committed", "failed", "retired"}


def test_a_stream_that_restarts_in_the_middle_gives_the_batchs_rows_once(spark, batch, tmp_path):
    own = lifecycle.lifecycle_session(spark)
    rows = sorted(events(), key=lambda r: r[3])
    out, state, source = (str(tmp_path / x) for x in ("out", "state", "events"))

    def run():
        stream = own.readStream.schema(lifecycle.IN).parquet(f"{source}/*").withWatermark("at", "3 hours")
        return lifecycle.run_to_end(lifecycle.live_stream(stream), out, state)

    thirds = [rows[i : i + len(rows) // 3 + 1] for i in range(0, len(rows), len(rows) // 3 + 1)]
    for k, part in enumerate(thirds):
        frame(spark, part).coalesce(2).write.parquet(f"{source}/{k}")
        assert run() == 1
    assert key(lifecycle.decisions_of(spark, out).collect()) == batch
    # the last batch once more, as after a crash between the sink's write and the checkpoint's commit
    import os

    last = max(int(x) for x in os.listdir(f"{state}/commits") if x.isdigit())
    while not any(r for r in [lifecycle.decisions_of(spark, f"{out}/batch={last}")] if r.count()):
        last -= 1
    for x in os.listdir(f"{state}/commits"):
        if x.strip(".").split(".")[0].isdigit() and int(x.strip(".").split(".")[0]) >= last:
            os.remove(f"{state}/commits/{x}")
    assert run() >= 0
    assert key(lifecycle.decisions_of(spark, out).collect()) == batch
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != own.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_a_users_keys_are_loaded_and_saved_at_once():
    from datetime import timezone

    from pyspark.sql import Row

    calls, held, timers = [], {}, set()

    class Store:
        def get(self):
            calls.append("get")
            return held.get("value")

        def update(self, value):
            calls.append("update")
            held["value"] = value

        def clear(self):
            held.clear()

    class Handle:
        getValueState = staticmethod(lambda *_: Store())
        registerTimer = staticmethod(lambda at: (calls.append("timer"), timers.add(at)))
        deleteTimer = staticmethod(timers.remove)

    made, user = [], events(users=1)
    rows = [Row(*[c.split()[0] for c in lifecycle.IN.split(", ")])(*r[:3], r[3].replace(tzinfo=timezone.utc), *r[4:]) for r in user]
    halves = rows[:401], rows[401:]  # something is pending where they meet
    for half in halves:
        calls.clear()
        own = lifecycle.AlertLife()
        own.init(Handle)
        made += own.handleInputRows((0,), iter(half[::-1]), None)
        assert len(calls) <= 3 and len(timers) == 1  # for two keys and 400 rows
    lives, want = {}, []
    for row in [x for half in halves for x in sorted(half, key=lambda r: (r.at, r.kind == "report", r.seq))]:
        one = (row.user_id, row.rule, row.hazard)
        want.append(lives.setdefault(one, Life()).step(one, row))
    assert [tuple(r) for r in made] == want
