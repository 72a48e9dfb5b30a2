"""Guards, power and verdicts of several features: what the SQL comparison can't show."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from warrantlake.operators import drift, nullband
from warrantlake.streaming import session


def settings(spark, rows):
    return spark.createDataFrame(rows, "name string, probabilities array<double>, n int, n_reference int, stable double")


def test_a_noisy_setting_is_refused_by_its_own_false_alarms(spark):
    fine, noisy = ("fine", [0.2] * 5, 200, 2000, 0.1), ("noisy", [0.05] * 20, 100, 2000, 0.1)
    told = {r["name"]: r for r in nullband.guarded(settings(spark, [fine, noisy]), ["name"], repeats=100).collect()}
    assert told["fine"]["accepted"] and told["fine"]["false_alarm_rate"] <= 0.02
    assert not told["noisy"]["accepted"] and told["noisy"]["false_alarm_rate"] > 0.5
    nullband.refuse_noisy(settings(spark, [fine]), ["name"], repeats=100)
    with pytest.raises(ValueError, match="noisy"):
        nullband.refuse_noisy(settings(spark, [fine, noisy]), ["name"], repeats=100)
    # The null's mean is about (bins - 1) (1 / n + 1 / n_reference).
    assert abs(told["fine"]["p50"] - 4 * (1 / 200 + 1 / 2000)) < 0.01


def test_the_request_loop_refuses_a_noisy_window_before_it_starts(spark):
    warrants = spark.createDataFrame([("W", [0.05] * 20)], "warrant_id string, probabilities array<double>")
    with pytest.raises(ValueError, match="false alarms"):
        session.run(spark, None, None, warrants, 50, 0.05, "/nowhere", None, most_false_alarms=0.05)


def test_shapes_have_their_distributions(spark):
    x = spark.range(20_000).select(F.explode(F.array(*[F.lit(s) for s in nullband.SHAPES])).alias("s"), ((F.col("id") + 0.5) / 20_000).alias("u"), F.rand(5).alias("v")).select("s", nullband.shaped(F.col("s"), F.col("u"), F.col("v")).alias("x"))
    q = {r["s"]: (r["a"], r["b"]) for r in x.groupBy("s").agg(F.percentile("x", F.lit(0.25)).alias("a"), F.percentile("x", F.lit(0.75)).alias("b")).collect()}
    for shape, low in (("normal", -0.6745), ("logistic", -math.log(3)), ("beta2_2", 0.3264)):
        assert abs(q[shape][0] - low) < 0.03
    assert abs(sum(q["beta2_2"]) - 1) < 1e-6
    with pytest.raises(Exception, match="unknown shape"):
        spark.range(1).select(nullband.shaped(F.lit("cauchy"), F.lit(0.5), F.lit(0.5))).collect()


def test_power_rises_with_size_and_collapse_and_small_pilots_are_refused(spark):
    sizes = spark.createDataFrame([(8, 200), (60, 200)], "n int, n_reference int")
    grid = {(r["n"], r["collapse"]): r for r in nullband.power_grid(sizes, [1.0, 0.5, 0.2], 0.5, ("normal",), 200).collect()}
    assert abs(grid[(60, 1.0)]["power_recalibrated"] - 0.05) < 0.02
    assert grid[(8, 0.5)]["power_recalibrated"] < grid[(60, 0.5)]["power_recalibrated"] <= grid[(60, 0.2)]["power_recalibrated"]
    assert grid[(8, 1.0)]["false_alarm_rate"] > grid[(60, 1.0)]["false_alarm_rate"]
    with pytest.raises(ValueError, match="4 items"):
        nullband.iqr_ratios(spark.createDataFrame([(3, 200)], "n int, n_reference int"))


def test_the_driver_is_the_severest_feature_and_unobserved_ones_are_named(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, int(rng.integers(0, 4)), int(rng.integers(0, 3)) if i < 60 or i >= 150 else 2, None if i < 120 else 1) for i in range(220)]
    x = spark.createDataFrame(rows, "shard int, event_id long, bin_a int, bin_b int, bin_c int")
    sizes = {"a": 4, "b": 3, "c": 2, "d": 3}
    x = x.withColumn("bin_d", F.lit(None).cast("int"))
    expected = spark.createDataFrame([([0.25] * 4, [1 / 3] * 3, [0.5, 0.5], None)], "expected_a array<double>, expected_b array<double>, expected_c array<double>, expected_d array<double>")
    told = {r["event_id"]: r for r in drift.verdicts(x, "shard", F.col("event_id"), ["event_id"], sizes, expected, 50).collect()}
    assert len(told) == 220
    for i in range(220):
        r = told[i]
        if i < 49:
            assert (r["state"], r["driver"], r["unobserved"]) == ("INSUFFICIENT_DATA", None, ["a", "b", "c", "d"])
            continue
        frame = rows[i - 49 : i + 1]
        psi = {}
        for at, (name, shares) in enumerate((("a", [0.25] * 4), ("b", [1 / 3] * 3), ("c", [0.5, 0.5]))):
            seen = [f[2 + at] for f in frame if f[2 + at] is not None]
            if seen:
                psi[name] = sum((max(seen.count(k) / len(seen), 1e-6) - e) * math.log(max(seen.count(k) / len(seen), 1e-6) / e) for k, e in enumerate(shares))
        for name in "abcd":
            assert (r[f"psi_{name}"] is None) == (name not in psi) and (name not in psi or abs(r[f"psi_{name}"] - psi[name]) < 1e-9)
        severity = {n: 0 if v < 0.1 else 1 if v < 0.25 else 2 for n, v in psi.items()}
        assert r["driver"] == max(psi, key=lambda n: (severity[n], psi[n]))
        assert r["state"] == ("INSIDE", "MODERATE", "SIGNIFICANT")[max(severity.values())]
        assert r["unobserved"] == [n for n in "abcd" if n not in psi]
    assert {told[i]["driver"] for i in range(49, 220)} >= {"b", "c"}
