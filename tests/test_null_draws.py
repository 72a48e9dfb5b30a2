"""Simulated nulls: one draw serves all distributions, and falls into the bins that each of them has."""

import hashlib

from pyspark.sql import functions as F

from warrantlake.operators import nullband


def test_draws_fall_into_the_bins_of_every_distribution(spark):
    upto, sizes = {0: [0.25, 0.5, 1.0], 1: [0.1, 1.0], 2: [1.0]}, {0: 40, 1: 25, 2: 40}
    got = {(r["key"], r["rep"], r["bin"]): r["c"] for r in nullband.met_bins(upto, sizes, "ref", 3, spark).collect()}
    want = {}
    for key, cuts in upto.items():
        for rep in range(3):
            for i in range(sizes[key]):
                u = int(hashlib.md5(f"ref|{rep}|{i}".encode()).hexdigest()[:13], 16) / 2**52
                place = (key, rep, min(sum(c <= u for c in cuts), len(cuts) - 1))
                want[place] = want.get(place, 0) + 1
    assert got == want


def test_samples_of_one_shape_are_dealt_over_tasks(spark):
    cells = spark.createDataFrame([("logistic", 8)], "shape string, n int")
    dealt = nullband._spreads(cells, ["shape", "n"], "n", "pilot", 64)
    assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    assert dealt.count() == 64
