"""Responses to drift: what each rung claims and cites, routing after the ladder, and certificates."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from warrantlake.operators import drift as D
from warrantlake.operators import response as C
from warrantlake.plans.q_nullband import last_windows

W = "detector_id string, operating_point_id string, envelope_id string, recall double, recall_low double, recall_high double, fpr_high double, status string, expired boolean, stream string, live_envelope_id string"
V = "stream string, state string, driver string, unobserved array<string>, driven_by_smoothing boolean"
POLICY = C.Policy(min_recall=0.3, max_fpr=0.1)


def warrant(detector, envelope="home", recall=0.6, low=0.5, status="VALID", expired=False, stream=None, live="away", fpr=0.05):
    return (detector, "P", envelope, recall, low, recall + 0.1, fpr, status, expired, stream or detector, live)


def verdict(stream, state, driver="length", unobserved=(), smoothed=False):
    return (stream, state, driver, list(unobserved), smoothed)


def respond(spark, warrants, verdicts, policy=POLICY):
    rows = C.respond(spark.createDataFrame(warrants, W), spark.createDataFrame(verdicts, V), "stream", policy).collect()
    return {(r["detector_id"], r["envelope_id"]): r for r in rows}


def says(row, name):
    return any(n.startswith(C.UNCHECKED[name]) for n in row["unchecked"])


@pytest.mark.parametrize(
    ("status", "state", "expired", "after", "action", "cites", "low"),
    [
        ("VALID", "INSIDE", False, "VALID", "ALLOW", True, 0.5),
        ("VALID", "MODERATE", False, "STALE", "ESCALATE", True, 0.45),
        ("VALID", "SIGNIFICANT", False, "REVOKED", "ESCALATE", False, None),
        ("VALID", "INSUFFICIENT_DATA", False, "VALID", "ALLOW", True, 0.5),
        ("VALID", None, False, "VALID", "ALLOW", True, 0.5),
        ("VALID", "INSIDE", True, "STALE", "ESCALATE", True, 0.45),
        ("STALE", "INSUFFICIENT_DATA", False, "STALE", "ESCALATE", True, 0.45),
        ("REVOKED", "INSIDE", False, "VALID", "ALLOW", True, 0.5),
        ("REFUSED", "INSIDE", False, "REFUSED", "ESCALATE", False, None),
        ("REFUSED", "SIGNIFICANT", False, "REFUSED", "ESCALATE", False, None),
    ],
)
def test_each_rung_claims_what_it_may(spark, status, state, expired, after, action, cites, low):
    r = respond(spark, [warrant("D", status=status, expired=expired)], [verdict("D", state)] if state else [])[("D", "home")]
    assert (r["before"], r["after"], r["action"], r["cited"]) == (status, after, action, "D|P|home" if cites else None)
    assert r["claimed_recall_low"] == (pytest.approx(low) if low is not None else None)
    assert says(r, "widened") == (after == "STALE")
    assert says(r, "moved") == cites


def test_a_revoked_warrant_takes_the_replacement_of_the_live_envelope(spark):
    warrants = [
        warrant("A"), warrant("B", "away", 0.5, 0.4), warrant("C", "away", 0.6, 0.45), warrant("D", "away", 0.9, 0.8),
        warrant("E", "away", 0.9, 0.85, status="REFUSED"), warrant("F", "away", 0.95, 0.9, fpr=0.2), warrant("G", "away", 0.2, 0.1),
    ]
    calm = [verdict(x, "INSIDE") for x in "BCEFG"]
    r = respond(spark, warrants, [verdict("A", "SIGNIFICANT"), verdict("D", "SIGNIFICANT"), *calm])
    # D has the best bound, but the same windows revoked it; it can't replace A or itself.
    for key in (("A", "home"), ("D", "away")):
        assert (r[key]["cited"], r[key]["weakest"], r[key]["action"], r[key]["considered"]) == ("C|P|away", "VALID", "ALLOW", 6)
        assert (r[key]["claimed_recall"], r[key]["claimed_recall_low"]) == (0.6, 0.45)
    assert r[("B", "away")]["considered"] is None


def test_no_replacement_is_told_apart_from_an_envelope_that_is_not_there(spark):
    warrants = [warrant("A"), warrant("B", live="nowhere"), warrant("C", "away", 0.2, 0.1)]
    r = respond(spark, warrants, [verdict(x, "SIGNIFICANT") for x in "AB"])
    for key, considered, note, other in ((("A", "home"), 1, "uncovered", "off_axis"), (("B", "home"), 0, "off_axis", "uncovered")):
        assert (r[key]["cited"], r[key]["weakest"], r[key]["action"], r[key]["considered"]) == (None, "REVOKED", "ESCALATE", considered)
        assert says(r[key], note) and not says(r[key], other)
    blocked = respond(spark, warrants, [verdict("A", "SIGNIFICANT")], dataclasses.replace(POLICY, default="BLOCK"))
    assert blocked[("A", "home")]["action"] == "BLOCK"


def test_unchecked_names_what_was_not_seen_and_what_rests_on_empty_bins(spark):
    r = respond(spark, [warrant("A", live="home"), warrant("B", live="home")], [verdict("A", "INSIDE", "length", ["b", "a"], True), verdict("B", "INSIDE")])
    assert r[("A", "home")]["unchecked"] == [C.UNCHECKED["joint"], C.UNCHECKED["unobserved"] + "a, b", C.UNCHECKED["smoothing"] + "length"]
    assert r[("B", "home")]["unchecked"] == [C.UNCHECKED["joint"]]


def test_the_policy_hash_moves_with_every_setting():
    other = {"psi_stable": 0.2, "psi_significant": 0.5, "window": 9, "widen": 2.0, "min_recall": 0.5, "max_fpr": 0.5, "default": "BLOCK"}
    assert {f.name for f in dataclasses.fields(C.Policy)} == set(other)
    assert len({POLICY.digest, *(dataclasses.replace(POLICY, **{k: v}).digest for k, v in other.items())}) == len(other) + 1


def test_certificates_cite_what_they_claim(spark):
    told = C.respond(spark.createDataFrame([warrant("A"), warrant("B", "away"), warrant("C")], W), spark.createDataFrame([verdict("A", "SIGNIFICANT"), verdict("C", "MODERATE")], V), "stream", POLICY)
    request = "request_id long, session_id long, decided_at timestamp, elapsed double, budget double, detector_id string, operating_point_id string, envelope_id string"
    at = dt.datetime(2024, 1, 1)
    rows = [(n, 1, at, e, 50.0, d, "P", "home") for n, d, e in ((1, "A", 49.0), (2, "C", 51.0), (3, "Z", None), (4, "A", 50.0))]
    out = {r["request_id"]: r for r in C.certify(spark.createDataFrame(rows, request), told, POLICY).collect()}
    assert {n: r["warrants_relied_upon"] for n, r in out.items()} == {1: ["B|P|away"], 2: ["C|P|home"], 3: [], 4: ["B|P|away"]}
    assert {n: r["weakest"] for n, r in out.items()} == {1: "VALID", 2: "STALE", 3: "UNVALIDATED", 4: "VALID"}
    assert {n: r["rule_id"] for n, r in out.items()} == {1: "ladder-SIGNIFICANT", 2: "ladder-MODERATE", 3: "ladder-UNFILED", 4: "ladder-SIGNIFICANT"}
    assert {n: r["over_budget"] for n, r in out.items()} == {1: False, 2: True, 3: False, 4: False}
    assert out[3]["unchecked"] == [C.UNCHECKED["unfiled"]] and out[3]["action"] == "ESCALATE" and out[3]["claimed_recall"] is None
    assert len({r["certificate_id"] for r in out.values()}) == 4
    for r in out.values():
        assert (r["claimed_recall"] is None) == (not r["warrants_relied_upon"])


def test_the_last_window_decides(spark):
    rows = [("s", 1, "a", "SIGNIFICANT", "x", [], True), ("s", 2, "a", "INSIDE", "y", ["z"], False), ("t", 1, "b", "MODERATE", "x", [], False), ("t", 1, "c", "INSIDE", "x", [], False)]
    out = C.final_verdicts(spark.createDataFrame(rows, "stream string, ts int, id string, state string, driver string, unobserved array<string>, driven_by_smoothing boolean"), "stream", ["ts", "id"])
    assert {r["stream"]: r["state"] for r in out.collect()} == {"s": "INSIDE", "t": "INSIDE"}
    assert out.where(F.col("stream") == "s").first()["unobserved"] == ["z"]


def test_routing_reads_warrants_that_no_request_asks_for(spark):
    warrants, told = spark.createDataFrame([warrant("A"), warrant("B", "away")], W), spark.createDataFrame([verdict("A", "SIGNIFICANT")], V)
    asked = spark.createDataFrame([("A", "P", "home"), ("Z", "P", "home")], "detector_id string, operating_point_id string, envelope_id string")
    (only,) = C.respond(warrants, told, "stream", POLICY, asked).collect()
    assert only == C.respond(warrants, told, "stream", POLICY).where("detector_id = 'A'").first() and only["cited"] == "B|P|away"


def test_last_verdicts_are_those_of_the_last_rows(spark):
    rows = [(k, i // 2, i, None if i % 5 == 0 else (i * 7 + len(k)) % 3, (i // 9) % 2) for k, n in (("a", 40), ("bb", 12), ("ccc", 11), ("d", 1)) for i in range(n)]
    stream, sizes = spark.createDataFrame(rows, "shard string, ts int, event_id int, bin_x int, bin_y int"), {"x": 3, "y": 2}
    expected = D.expected_shares(stream.where("ts < 8"), sizes)
    every = D.verdicts(stream, "shard", F.col("ts"), ["ts", "event_id"], sizes, expected, 12)
    last = C.final_verdicts(every, "shard", ["ts", "event_id"])
    found = D.last_verdicts(stream, "shard", ["ts", "event_id"], sizes, expected, 12)
    assert sorted(found.select(last.columns).collect()) == sorted(last.collect()) and {r["state"] for r in last.collect()} > {"INSUFFICIENT_DATA"}


def test_responses_slide_no_frame_over_all_events(spark):
    found = last_windows(spark, "/root/testdata/sf0.001", F.col("user_id"), 60)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "RowFrame, -59" not in plan
