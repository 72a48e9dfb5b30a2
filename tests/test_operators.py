"""What the SQL comparison can't show: golden values, tampering, refusals, streaming, ties and empty classes."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from warrantlake.functions import bounds, text
from warrantlake.operators import drift, ledger, matrix, metrics, probe, ranges, thresholds
from warrantlake.streaming import monitor


def items(spark, rows):
    return spark.createDataFrame(rows, "k string, label int, score double")


def test_exact_bounds_golden():
    assert bounds.upper(0, 200) == pytest.approx(0.014867039231272083, abs=1e-12)
    assert bounds.clopper_pearson(0, 200)[1] == pytest.approx(0.01827534035513584, abs=1e-12)
    assert bounds.upper(1, 200) == pytest.approx(0.0234984704, abs=1e-9)
    assert bounds.clopper_pearson(200, 200)[1] == 1.0
    for k, n in ((3, 20), (17, 40), (88, 200)):
        p = bounds.upper(k, n)
        assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(0.05, abs=1e-9)
    assert bounds.least_clean(0.05) == 59


def test_ties_and_missing_classes(spark):
    tied = items(spark, [("a", 1, 0.5), ("a", 0, 0.5), ("b", 1, 0.2), ("c", 0, 0.1)])
    area = {r["k"]: r["auroc"] for r in metrics.auroc(tied, ["k"]).collect()}
    assert area == {"a": 0.5, "b": None, "c": None}
    assert {r["k"]: r["threshold"] for r in thresholds.within_budget(tied, ["k"], 0.4).collect()} == {"a": None, "b": None, "c": None}


def test_curve_area_is_the_rank_statistic(spark):
    rng = np.random.default_rng(3)
    rows = [("a", int(y), float(round(s, 1))) for y, s in zip(rng.integers(0, 2, 300), rng.random(300), strict=True)]
    x = items(spark, rows)
    assert metrics.roc_area(x, ["k"]).first()["area"] == pytest.approx(metrics.auroc(x, ["k"]).first()["auroc"])


def test_nothing_flagged_has_precision_zero(spark):
    r = metrics.rates(metrics.confusion(items(spark, [("a", 1, 0.1)]), ["k"], 0.5)).first()
    assert (r["precision"], r["recall"], r["fpr"]) == (0.0, 0.0, None)


def test_ledger_chain_and_refusals(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = lambda *ids, kind="warrant": spark.createDataFrame([(kind, i, f"body {i}") for i in ids], "kind string, record_id string, body string")
    assert ledger.append(spark, path, rows("a", "b")) == 2
    assert ledger.append(spark, path, rows("c")) == 3
    stored = spark.read.parquet(path).withColumn("chain", F.lit(0))
    assert ledger.breaks(stored, "chain").count() == 0
    changed = stored.withColumn("body", F.when(F.col("seq") == 2, "other").otherwise(F.col("body")))
    assert [(r["seq"], r["reason"]) for r in ledger.breaks(changed, "chain").collect()] == [(2, "hash")]
    assert [r["seq"] for r in ledger.breaks(stored.where("seq <> 1"), "chain").collect()] == [2]
    for bad in (rows("a"), rows("z", kind="rumour"), rows("y", "y")):
        with pytest.raises(ValueError):
            ledger.append(spark, path, bad)
    with pytest.raises(ValueError):
        ledger.purge_summary(stored, datetime(2024, 1, 1), datetime(2024, 6, 1))


def test_psi_of_itself_is_zero_and_outside_values_are_kept(spark):
    ref = spark.range(1000).select(F.lit("a").alias("k"), (F.col("id") % 97).cast("double").alias("v"))
    env = drift.envelope(ref, ["k"], "v")
    assert drift.psi(ref, env, ["k"], "v").first()["psi"] == pytest.approx(0, abs=1e-9)
    far = drift.psi(ref.withColumn("v", F.col("v") + 500), env, ["k"], "v").first()
    assert far["psi"] > 0.25 and far["n_live"] == 1000
    constant = drift.envelope(ref.withColumn("v", F.lit(3.0)), ["k"], "v").collect()
    assert [(r["lo"], r["hi"]) for r in constant] == [(2.0, 4.0)]


def test_breach_is_revoked_and_latched(spark):
    x = spark.range(400).select(F.lit(0).alias("k"), F.col("id"), ((F.col("id") % 2 == 0) & (F.col("id") < 200)).alias("x"))
    rows = drift.e_process(x, "k", F.col("id"), ["id"], F.col("x"), 0.05).orderBy("id").collect()
    assert rows[199]["revoked"] and rows[399]["revoked"]


def test_routing_uses_bounds(spark):
    cells = spark.createDataFrame([("D1", "P", "E", "VALID", 0.4, 0.9, 0.1), ("D2", "P", "E", "VALID", 0.6, 0.7, 0.1), ("D3", "P", "F", "STALE", 0.9, 0.95, 0.1)], "detector_id string, operating_point_id string, envelope_id string, status string, recall_low double, recall_high double, fpr_high double")
    assert {r["envelope_id"]: r["detector_id"] for r in matrix.route(cells, 0.5, 0.2).collect()} == {"E": "D2", "F": "conservative-default"}


@pytest.mark.parametrize("words,kinds", [("9999 4105 7058", {"IN_AADHAAR"}), ("mail bob.k@okbank now", {"UPI_VPA"}), ("PAN ABCPE1234F.", {"IN_PAN"}), ("HDFC0001234 branch", {"IN_IFSC"}), ("XXXX XXXX 9812", {"IN_AADHAAR"}), ("", set()), (None, set())])
def test_spans(words, kinds):
    found = text.spans(words)
    assert {f["kind"] for f in found} >= kinds
    assert all(words[f["start"] : f["end"]] == f["text"] for f in found)
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:], strict=False))


def test_verhoeff_column_agrees(spark):
    numbers = [str(n) for n in range(100000, 100400)] + ["", "236", "2363"]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    got = {r["n"]: r["v"] for r in df.select("n", text.verhoeff_valid(F.col("n")).alias("v")).collect()}
    assert got == {n: text.verhoeff_plain(n) for n in numbers} and got["2363"]


def test_probe_separates_and_shuffled_does_not(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 4) + (i % 2) * 1.5], i % 2) for i in range(400)]
    x = spark.createDataFrame(rows, "vec_id long, vec array<double>, label int")
    c, model = probe.select_c(x.where("vec_id < 250"), x.where("vec_id >= 250"), [0.01, 1.0])
    area = metrics.auroc(probe.score(model, x.where("vec_id >= 250")).withColumn("k", F.lit(0)), ["k"]).first()["auroc"]
    assert area > 0.9 and c in (0.01, 1.0)
    null = probe.fit(probe.shuffled(x.where("vec_id < 250"), "vec_id", "s"), 1.0)
    assert abs(metrics.auroc(probe.score(null, x.where("vec_id >= 250")).withColumn("k", F.lit(0)), ["k"]).first()["auroc"] - 0.5) < 0.4


def test_stream_verdicts_and_ledger(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "in")
    events.orderBy("ts", "event_id").coalesce(1).write.parquet(folder)
    expected = {k: 0.2 for k in ("click", "error", "purchase", "signup", "view")}
    stream = monitor.verdicts(monitor.source(spark, folder, events.schema), expected, 50)
    query = stream.writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["event_id"]: (r["n"], round(r["psi"], 6)) for r in spark.table("verdicts").collect()}
    batch = drift.sliding_psi(events.withColumn("shard", F.col("user_id") % 4), "shard", F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"], list(expected), "event_type", expected, 50)
    assert got == {r["event_id"]: (r["n"], round(r["psi"], 6)) for r in batch.collect()}
    path = str(tmp_path / "ledger")
    sink = monitor.to_ledger(path)
    sink(spark.table("verdicts"), 0)
    n = spark.read.parquet(path).count()
    sink(spark.table("verdicts"), 0)
    assert spark.read.parquet(path).count() == n == spark.table("verdicts").where("state in ('MODERATE', 'SIGNIFICANT')").count()


def test_ranged_numbers_running_values_and_quantiles(spark):
    rng = np.random.default_rng(6)
    rows = [("ab"[i % 7 == 0], i, int(v), float(v) / 4) for i, v in enumerate(rng.integers(0, 400, 3000))]
    x = spark.createDataFrame(rows, "k string, id int, v int, f double").repartition(5)
    got = {r["id"]: r["nth"] for r in ranges.numbered(x, ["k"], F.col("v"), ["v", "id"]).collect()}
    for k in "ab":
        part = sorted((v, i) for key, i, v, _ in rows if key == k)
        assert all(got[i] == n + 1 for n, (_, i) in enumerate(part))
    most = {r["id"]: r["m"] for r in ranges.accumulated(ranges.ranged(x, ["k"], F.col("id")), ["k"], ["id"], {"m": F.col("v")}, F.max).collect()}
    upto = {"a": 0, "b": 0}
    for k, i, v, _ in rows:
        upto[k] = max(upto[k], v)
        assert most[i] == upto[k]
    q = {r["k"]: r for r in ranges.quantiles(x, ["k"], "f", {"low": 0.025, "mid": 0.5, "top": 1.0}).collect()}
    for k in "ab":
        values = [f for key, *_, f in rows if key == k]
        assert np.allclose([q[k]["low"], q[k]["mid"], q[k]["top"]], np.quantile(values, [0.025, 0.5, 1.0]))


def test_sliding_frames_reach_over_blocks(spark):
    rng = np.random.default_rng(8)
    kinds = rng.choice(["a", "b"], 700, p=[0.7, 0.3]).tolist()
    x = spark.createDataFrame([("s", i, k) for i, k in enumerate(kinds)], "k string, id long, kind string")
    blocks, own = ranges.framed(x, ["k"], F.col("id"), ["id"], 50, size=60)
    assert blocks.select("_block").distinct().count() > 5 and blocks.where(own).count() == 700
    got = {r["id"]: r["psi"] for r in drift.sliding_psi(x, "k", F.col("id"), ["id"], ["a", "b"], "kind", {"a": 0.5, "b": 0.5}, 50).collect()}
    for i in range(700):
        part = kinds[max(0, i - 49) : i + 1]
        shares = [max(part.count(c) / len(part), 1e-6) for c in "ab"]
        assert got[i] == pytest.approx(sum((a - 0.5) * np.log(a / 0.5) for a in shares))
