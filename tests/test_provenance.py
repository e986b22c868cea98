from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import provenance as P

NODES = "run_id string, node_id string, kind string, label string, attributes map<string,string>"
EDGES = "run_id string, source_id string, target_id string, relation string"


def graph(run, leaf="a", extra=()):
    """Two payloads of one dataset, an agent over both, a formula over the agent, two outputs."""
    nodes = [(run, "d", "dataset", "d", {"x": "1", "y": None}), (run, "p1", "raw_payload", "p", {"sha256": leaf}), (run, "p2", "raw_payload", "p", {"sha256": "b"}), (run, "g", "agent", "g", {}), (run, "f", "formula", "f", {"formula_id": "f", "formula_version": "1"}), (run, "o1", "output", "o", {"v": "1"}), (run, "o2", "output", "o", {"v": "2"}), *extra]
    edges = [(run, a, b, "derives") for a, b in (("d", "p1"), ("d", "p2"), ("p1", "g"), ("p2", "g"), ("g", "f"), ("f", "o1"), ("p2", "o2"))]
    return nodes, edges


def hashed(spark, *graphs):
    nodes, edges = (sum((g[i] for g in graphs), []) for i in (0, 1))
    return P.merkle(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def test_a_changed_leaf_changes_exactly_what_derives_from_it(spark):
    rows = hashed(spark, graph("r1"), graph("r2"), graph("r3", leaf="z"))
    h = {(r.run_id, r.node_id): r.hash for r in rows.collect()}
    ids = [n[1] for n in graph("x")[0]]
    assert all(h["r1", i] == h["r2", i] for i in ids)
    assert {i for i in ids if h["r1", i] != h["r3", i]} == {"p1", "g", "f", "o1"}
    assert {r.node_id: r.level for r in rows.where("run_id = 'r1'").collect()} == {"d": 0, "p1": 1, "p2": 1, "g": 2, "f": 3, "o1": 4, "o2": 2}
    shared = {(r.kind, r.runs) for r in P.shared_subgraphs(rows).collect()}
    assert ("dataset", 3) in shared and ("formula", 2) in shared
    prints = {r.run_id: (r.nodes, r.fingerprint) for r in P.fingerprints(rows).collect()}
    assert prints["r1"] == prints["r2"] != prints["r3"] and prints["r1"][0] == 7


def test_order_of_attributes_and_separators_in_them(spark):
    rows = [("1", "n", "dataset", "l", {"a": "1", "b": "2"}), ("2", "n", "dataset", "l", {"b": "2", "a": "1"}), ("3", "n", "dataset", "l", {"a": "1;b=2"}), ("4", "n", "dataset", "l", {"a": "11:b1:2"}), ("5", "n", "dataset", "l", None), ("6", "n", "dataset", "l", {})]
    got = {r.run_id: r.hash for r in P.merkle(spark.createDataFrame(rows, NODES), spark.createDataFrame([], EDGES)).collect()}
    assert got["1"] == got["2"] and got["5"] == got["6"] and len(set(got.values())) == 4


def test_large_runs_by_levels_equal_small_ones_and_small_ones_meet_once(spark, monkeypatch):
    graphs = [graph(f"r{i}", leaf="az"[i % 2]) for i in range(4)] + [graph("big", extra=[("big", f"x{i}", "output", "x", {}) for i in range(40)])]
    graphs[0][1].append(("r0", "o2", "nowhere", "derives"))  # leads to no node: nothing derives from it
    whole = {tuple(r) for r in hashed(spark, *graphs).collect()}
    monkeypatch.setattr(P, "by_levels", None)
    assert {tuple(r) for r in hashed(spark, *graphs).collect()} == whole  # not by levels
    monkeypatch.undo()
    for most in (20, 0):
        monkeypatch.setattr(P, "SMALL", most)
        assert {tuple(r) for r in hashed(spark, *graphs).collect()} == whole
    assert len(whole) == 5 * 7 + 40


def test_cycles_are_errors(spark):
    nodes, edges = graph("r")
    with pytest.raises(ValueError, match="cycle"):
        P.merkle(spark.createDataFrame(nodes, NODES), spark.createDataFrame([*edges, ("r", "o1", "p1", "derives")], EDGES))


def test_node_issues(spark):
    rows = [("r", "a", "raw_payload", "l", {}), ("r", "b", "formula", "l", {"formula_id": "x"}), ("r", "", "dataset", "", {}), ("r", "c", "wish", "l", {}), ("r", "e", "dataset", "l", {}), ("r", "e", "dataset", "l", {}), ("q", "e", "dataset", "l", {})]
    got = {(r.node_id, r.issue) for r in P.node_issues(spark.createDataFrame(rows, NODES)).collect()}
    assert got == {("a", "raw_payload lacks sha256"), ("b", "formula lacks formula_version"), ("", "no id"), ("", "no label"), ("c", "unknown kind"), ("e", "id stands twice")}


def test_alert_graphs(spark):
    rows = [("t1", "u1", "wave_height", "warning", "3.1", "2", "class", "ab" * 32), ("t2", "u1", "geofence_drift", "clear", "x", "y", "z", None)]
    nodes, edges = P.alert_graphs(spark.createDataFrame(rows, "run_id string, user_id string, rule string, outcome string, observed string, threshold string, threshold_source string, payload_sha256 string"))
    kinds = {k: [r.kind for r in nodes.where(F.col("run_id") == k).orderBy(P.order_of(F.col("kind"))).collect()] for k in ("t1", "t2")}
    assert kinds == {"t1": list(P.KINDS), "t2": ["dataset", "agent", "formula", "output"]}  # no payload is made up
    assert {(r.source_id, r.target_id) for r in edges.where("run_id = 't2'").collect()} == {("dataset:imbl_1974_1976", "agent:alert_scheduler"), ("agent:alert_scheduler", "formula:geofence_drift"), ("formula:geofence_drift", "out:geofence_drift")}
    assert P.node_issues(nodes).count() == 0


def run_of(run, weights, peak=None, out=None, version="1"):
    body = {f"p{i}": f'{{"w":{w},"run":"{run}"}}' for i, w in enumerate(weights)}
    sha = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in body.items()}
    peak, out = max(weights) if peak is None else peak, sum(weights) if out is None else out
    nodes = [(run, "d", "dataset", "d", {}), *((run, k, "raw_payload", k, {"sha256": s}) for k, s in sha.items()), (run, "g", "agent", "g", {}), (run, "f", "formula", "f", {"formula_id": "peak", "formula_version": version, "value": str(float(peak))}), (run, "o", "output", "o", {"value": str(float(out))}), (run, "q", "output", "q", {"value": str(float(peak))})]
    edges = [(run, a, b, "derives") for k in sha for a, b in (("d", k), (k, "g"), (k, "f"))] + [(run, "g", "o", "derives"), (run, "f", "q", "derives")]
    return nodes, edges, [(sha[k], body[k].encode()) for k in sha]


def test_replay_names_the_first_node_that_differs(spark):
    runs = {
        "same": run_of("same", [3, 5]), "peak": run_of("peak", [3, 5], peak=6), "out": run_of("out", [3, 5], out=9), "gone": run_of("gone", [1, 2]),
        "bad": run_of("bad", [1, 2]), "old": run_of("old", [4], version="0"),
    }
    archive = [x for k, r in runs.items() if k != "gone" for x in (r[2] if k != "bad" else [(s, c + b" ") for s, c in r[2]])]
    nodes, edges = (spark.createDataFrame([x for r in runs.values() for x in r[i]], schema) for i, schema in ((0, NODES), (1, EDGES)))
    weight = F.get_json_object(F.decode("content", "UTF-8"), "$.w")
    got = {r.run_id: r for r in P.replay(nodes, edges, spark.createDataFrame(archive, "sha256 string, content binary"), weight, {"peak": F.max("_v")}, {"peak": "1"}).collect()}
    assert {k: (r.outcome, r.node) for k, r in got.items()} == {"same": ("identical", None), "peak": ("output_differs", "f"), "out": ("output_differs", "o"), "gone": ("evidence_unavailable", None), "bad": ("evidence_tampered", None), "old": ("formula_changed", None)}
    assert (got["peak"].was, got["peak"].now) == (6.0, 5.0) and got["same"].verified == 2 and got["gone"].verified == 0


def replayed(spark, runs, archive, formulas, versions):
    nodes, edges = (spark.createDataFrame([x for r in runs for x in r[i]], schema) for i, schema in ((0, NODES), (1, EDGES)))
    weight = F.get_json_object(F.decode("content", "UTF-8"), "$.w")
    return P.replay(nodes, edges, spark.createDataFrame(archive, "sha256 string, content binary"), weight, formulas, versions)


def deep(run, weights, wrong=None):
    """run_of() with three more levels of formulas; the last takes a formula's value and payloads' at once."""
    nodes, edges, archive = run_of(run, weights)
    values = {"x1": 2.0 * max(weights), "x2": 2.0 * max(weights) + sum(weights), "x3": 4.0 * max(weights) + sum(weights)}
    nodes += [(run, k, "output", k, {"formula_id": "twice" if k == "x1" else "", "value": str(v + (k == wrong))}) for k, v in values.items()]
    edges += [(run, a, b, "derives") for a, b in (("f", "x1"), ("x1", "x2"), ("x1", "x3"), ("x2", "x3"), *((f"p{i}", "x2") for i in range(len(weights))))]
    return nodes, edges, archive


def test_replay_brings_a_run_together_once_and_large_runs_replay_alike(spark, monkeypatch):
    runs = [deep("a", [3, 5]), deep("b", [2, 2, 7], "x1"), deep("c", [4], "x3"), deep("d", [1, 9], "x2"), run_of("old", [4], version="0"), run_of("gone", [6]), run_of("bad", [8]), ([("alone", "n", "dataset", "n", {"value": "1.0"})], [], [])]
    runs[0][1].append(("a", "p0", "nowhere", "derives"))  # leads to no node
    archive = [x for r in runs[:5] for x in r[2]] + [(runs[6][2][0][0], b"other"), runs[0][2][0], (runs[0][2][0][0], b"!")]
    formulas = {"peak": F.max("_v"), "twice": 2 * F.sum("_v")}
    monkeypatch.setattr(P, "by_levels", None)
    whole = {tuple(r) for r in replayed(spark, runs, archive, formulas, {"peak": "1"}).drop("was", "now").collect()}
    monkeypatch.undo()
    assert whole == {
        ("a", "identical", 2, None), ("b", "output_differs", 3, "x1"), ("c", "output_differs", 1, "x3"), ("d", "output_differs", 2, "x2"), ("old", "formula_changed", 1, None),
        ("gone", "evidence_unavailable", 0, None), ("bad", "evidence_tampered", 0, None), ("alone", "output_differs", 0, "n"),
    }
    for most in (13, 0):
        monkeypatch.setattr(P, "SMALL", most)
        assert {tuple(r) for r in replayed(spark, runs, archive, formulas, {"peak": "1"}).drop("was", "now").collect()} == whole
    monkeypatch.undo()
    with pytest.raises(ValueError, match="cycle"):
        replayed(spark, [(runs[0][0], [*runs[0][1], ("a", "x3", "x1", "derives")])], archive, formulas, {"peak": "1"})
