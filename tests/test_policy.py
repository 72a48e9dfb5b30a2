"""Policy bundles: every check by itself, all failures listed, what loads and what its rules may know."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from warrantlake.operators import policy as B
from warrantlake.plans import q_policy

NOW = dt.datetime(2024, 6, 1)
GOOD = {"detector_id": "D", "operating_point_id": "P", "envelope_id": "E", "n": 500, "issued_at": NOW - dt.timedelta(days=2), "expires_at": NOW + dt.timedelta(days=5), "threshold": 0.4, "status": "VALID", "recall": 0.3, "recall_low": 0.25, "fpr": 0.01, "fpr_high": 0.02, "target_flag_rate": 0.2, "flag_rate": 0.2, "flag_low": 0.17, "flag_high": 0.23}
NEED = {"bundle": "B", "number": 1, "detector_id": "D", "operating_point_id": "P", "envelope_id": "E", "max_age_days": 30, "min_recall": 0.2, "max_fpr": 0.05, "sensitivity": 0.25, "on_drift": "REFUSE"}
W = "detector_id string, operating_point_id string, envelope_id string, n long, issued_at timestamp, expires_at timestamp, threshold double, status string, recall double, recall_low double, fpr double, fpr_high double, target_flag_rate double, flag_rate double, flag_low double, flag_high double"
R = "bundle string, number int, detector_id string, operating_point_id string, envelope_id string, max_age_days int, min_recall double, max_fpr double, sensitivity double, on_drift string"


def check(spark, warrants, requirements):
    rows = lambda kind, base, changes: spark.createDataFrame([tuple((base | c)[k.split()[0]] for k in kind.split(", ")) for c in changes], kind)
    return B.checked(rows(R, NEED, requirements), rows(W, GOOD, warrants), F.lit(NOW))


def faults(spark, warrant=None, need=None):
    row = check(spark, [warrant or {}], [need or {}]).first()
    return [f.split(": ", 1)[1] for f in row["failures"]], row


@pytest.mark.parametrize(
    ("warrant", "need", "wrong"),
    [
        ({}, {}, []),
        ({}, {"envelope_id": "other"}, ["UNVALIDATED: no warrant was ever filed"]),
        ({"status": "REFUSED", "recall": None}, {}, ["REFUSED: measured and failed its controls"]),
        ({"status": "STALE"}, {}, ["STALE: not to be relied on"]),
        ({}, {"max_age_days": 1}, ["older than the profile allows"]),
        ({"expires_at": NOW}, {}, ["expired"]),
        ({"expires_at": NOW}, {"max_age_days": 1}, ["older than the profile allows"]),
        ({"recall": None, "recall_low": None}, {}, ["no recall claim on this envelope"]),
        ({"recall": 0.26, "recall_low": 0.18}, {}, ["recall bound below the floor"]),
        ({"recall_low": None, "recall": 0.21}, {}, []),
        ({"fpr": None, "fpr_high": None}, {}, ["ceiling declared, false positives unmeasured"]),
        ({"fpr": None, "fpr_high": None}, {"max_fpr": None}, []),
        ({"fpr_high": 0.06}, {}, ["false-positive bound above the ceiling"]),
        ({}, {"sensitivity": 0.05}, ["too few items for the declared sensitivity"]),
        ({"target_flag_rate": None}, {"sensitivity": 0.05}, []),
        ({"flag_low": 0.3, "flag_high": 0.4, "flag_rate": 0.35}, {}, ["calibration has drifted"]),
        ({"flag_low": 0.3, "recall_low": 0.1, "fpr_high": 0.9, "expires_at": NOW, "n": 3}, {}, ["expired", "recall bound below the floor", "false-positive bound above the ceiling", "too few items for the declared sensitivity"]),
    ],
)
def test_each_check(spark, warrant, need, wrong):
    found, row = faults(spark, warrant, need)
    if "flag_low" in warrant and "flag_high" not in warrant:
        assert set(wrong) <= set(found)
    else:
        assert found == wrong
    assert (row["budget_is"] is None) == (bool(wrong) or warrant.get("target_flag_rate", 1) is None)


def test_a_drifted_budget_is_refused_widened_or_ignored(spark):
    drifted = {"flag_low": 0.3, "flag_high": 0.4, "flag_rate": 0.35}
    _, wide = faults(spark, drifted, {"on_drift": "WIDEN_BUDGET"})
    assert (wide["budget"], wide["budget_low"], wide["budget_high"], wide["budget_is"]) == (0.35, 0.3, 0.4, "measured")
    assert "measured interval" in wide["notes"][0]
    _, kept = faults(spark, drifted, {"on_drift": "IGNORE"})
    assert (kept["budget"], kept["budget_low"], kept["budget_is"]) == (0.2, None, "declared") and "considered" in kept["notes"][0]
    _, unknown = faults(spark, {"flag_low": None}, {"max_fpr": None})
    assert [n.split(": ", 1)[1] for n in unknown["notes"]] == ["no false-positive ceiling is declared", "the budget is untested here"]
    _, loose = faults(spark, {"flag_low": 0.1})
    assert "unresolved" in loose["notes"][0]


def test_one_unmet_requirement_refuses_the_bundle_and_all_failures_are_listed(spark):
    needs = [{"bundle": "good", "number": 2, "detector_id": "E"}, {"bundle": "good"}, {"bundle": "bad"}, {"bundle": "bad", "number": 2, "envelope_id": "x"}, {"bundle": "bad", "number": 3, "min_recall": 0.9, "max_age_days": 1}]
    x = check(spark, [{}, {"detector_id": "E", "recall": 0.9, "recall_low": 0.8}], needs)
    told = {r["bundle"]: r for r in B.bundles(x).collect()}
    assert told["good"]["loads"] and told["good"]["failures"] == []
    assert not told["bad"]["loads"] and (told["bad"]["required"], told["bad"]["unmet"]) == (3, 2)
    assert told["bad"]["failures"] == ["D|P|x: UNVALIDATED: no warrant was ever filed", "D|P|E: older than the profile allows", "D|P|E: recall bound below the floor"]
    known = B.facts(x).collect()
    assert [(r["bundle"], r["weakest_status"], r["detector_id"], r["recall"]) for r in known] == [("good", "VALID", "D", 0.3)]
    requests = spark.createDataFrame([(1, 0.5), (2, 0.1)], "id int, score double")
    assert {(r["id"], r["action"]) for r in B.decided(requests, B.facts(x), F.lit("BLOCK")).collect()} == {(1, "BLOCK"), (2, "ALLOW")}


def test_every_kind_of_failure_and_note_is_seen_in_the_tables(spark):
    rows = q_policy._rows(spark, "/root/testdata/sf0.01").collect()
    seen = {f.split(": ", 1)[1] for r in rows for f in r["failures"].split("; ") if f}
    for kind in ("UNVALIDATED", "REFUSED", "STALE", "older", "expired", "no recall", "recall bound", "ceiling declared", "false-positive bound", "too few items", "calibration has drifted"):
        assert any(kind in f for f in seen), (kind, seen)
    noted = {n.split(": ", 1)[1] for r in rows for n in r["notes"].split("; ") if n}
    for kind in ("no false-positive ceiling", "untested", "measured interval", "unresolved"):
        assert any(kind in n for n in noted), (kind, noted)
    assert 0 < sum(r["loads"] for r in q_policy.QUERIES["jn06_policy_bundles"][0](spark, "/root/testdata/sf0.01").collect())
