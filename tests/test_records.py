"""Typed records: what is refused on the way in, what fails on the way out, and the chain that carries both."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from warrantlake.operators import ledger, records

WHEN = dt.datetime(2024, 5, 6, 7, 8, 9, 123456)
W = "warrant_id string, detector_id string, operating_point_id string, envelope_id string, n long, recall double, recall_low double, recall_high double, fpr_high double, status string, reasons array<string>, issued_at timestamp, more int"


def warrants(spark, *rows):
    base = ["w1", "D", "P", "E", 10, 0.5, 0.25, 0.75, 0.1, "VALID", ["a", "b"], WHEN, 7]
    return spark.createDataFrame([tuple(r.get(c.split()[0], v) for c, v in zip(W.split(", "), base, strict=True)) for r in rows], W)


def test_bodies_come_back_as_they_went_in(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = warrants(spark, {}, {"warrant_id": "w2", "recall": None, "reasons": None, "status": "REFUSED"})
    assert records.append_typed(spark, path, rows, "warrant") == 2
    certificate = spark.createDataFrame([("c1", "s1", "w1", "VALID", "ALLOW", WHEN)], records.SCHEMAS["certificate"])
    assert records.append_typed(spark, path, certificate, "certificate") == 3
    stored = spark.read.parquet(path)
    assert ledger.breaks(stored.withColumn("chain", F.lit(0)), "chain").count() == 0
    assert sorted(map(tuple, records.decode(stored, "warrant").collect())) == sorted(map(tuple, rows.drop("more").collect()))
    beside = {r["record_id"]: r for r in stored.collect()}
    assert (beside["w1"]["detector_id"], beside["w1"]["warrant_status"], beside["w1"]["session_id"]) == ("D", "VALID", None)
    assert (beside["c1"]["session_id"], beside["c1"]["warrant_id"], beside["c1"]["certificate_id"], beside["c1"]["detector_id"]) == ("s1", "w1", "c1", None)
    assert records.lookup(stored, spark.createDataFrame([("c1",)], "record_id string"), "certificate").first()["action"] == "ALLOW"
    with pytest.raises(ValueError, match="duplicate"):
        records.append_typed(spark, path, rows, "warrant")


def test_an_overrides_certificate_is_kept_beside_it(spark):
    row = spark.createDataFrame([("o1", "c9", "s", "none", "r", WHEN)], records.SCHEMAS["override"])
    assert records.encoded(row, "override").first()["certificate_id"] == "c9"


def test_rows_that_lack_something_are_refused(spark):
    with pytest.raises(ValueError, match="lack the columns status"):
        records.encoded(warrants(spark, {}).drop("status"), "warrant")
    with pytest.raises(ValueError, match="unknown kind"):
        records.encoded(warrants(spark, {}), "rumour")
    for lost in ("warrant_id", "status"):
        with pytest.raises(Exception, match=f"a warrant lacks {lost}"):
            records.encoded(warrants(spark, {lost: None}), "warrant").collect()


@pytest.mark.parametrize(
    ("body", "problem"),
    [(None, "no such record"), ("{broken", "broken body"), ("[]", "broken body"), ('{"warrant_id":"w1"}', "lacks"), ('{"warrant_id":"w2","detector_id":"D","operating_point_id":"P","envelope_id":"E","status":"VALID"}', "body of another record")],
)
def test_bad_bodies_are_errors_not_null_rows(spark, body, problem):
    held = spark.createDataFrame([("warrant", "w1", body)], "kind string, record_id string, body string")
    assert problem in records.decode(held, "warrant", strict=False).first()["problem"]
    with pytest.raises(Exception, match=problem):
        records.decode(held, "warrant").collect()


def test_a_missing_record_is_an_error(spark):
    held = records.encoded(warrants(spark, {}), "warrant")
    wanted = spark.createDataFrame([("w1",), ("nowhere",)], "record_id string")
    assert {r["record_id"]: r["problem"] for r in records.lookup(held, wanted, "warrant", strict=False).collect()} == {"w1": None, "nowhere": "no such record"}
    with pytest.raises(Exception, match="warrant nowhere: no such record"):
        records.lookup(held, wanted, "warrant").collect()
