"""Draws of bootstraps: dealt over tasks, and the same replicates by matrix and by scores."""

import hashlib

from pyspark.sql import functions as F

from warrantlake.operators import resample as R


def _grain(spark, groups=5):
    rows = [("a", groups, i % groups, (i * 7) % 11 / 10, int(i % 3 == 0), int(i % 3 != 0)) for i in range(60) if i % groups != 2]
    return spark.createDataFrame(rows, "k string, groups long, g long, score double, pos long, neg long").groupBy("k", "groups", "g", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _drawn(seed, rep, n):
    return [int(hashlib.md5(f"{seed}|{rep}|{i}".encode()).hexdigest()[:13], 16) % n for i in range(n)]


def _area(rows):
    pairs = [(p * n, 2 * (a > b) + (a == b)) for a, p, _ in rows for b, _, n in rows]
    total = sum(w for w, _ in pairs)
    return sum(w * v for w, v in pairs) / (2 * total) if total else None


def test_draws_of_one_key_are_dealt_over_tasks(spark):
    groups = spark.createDataFrame([("a", i, 100) for i in range(100)], "k string, g long, groups long")
    drawn = R.draws(groups, ["k"], 64, "s")
    assert drawn.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    assert drawn.agg(F.sum("times")).first()[0] == 64 * 100


def test_matrix_and_scores_give_the_areas_of_the_drawn_rows(spark):
    grain = _grain(spark).cache()  # the third group has no rows
    held = {}
    for r in grain.collect():
        held.setdefault(r["g"], []).append((r["score"], r["pos"], r["neg"]))
    want = {rep: _area([row for g in _drawn("s", rep, 5) for row in held.get(g, [])]) for rep in range(30)}
    by_matrix = R._by_matrix(grain.drop("groups"), R.draws(grain, ["k"], 30, "s"), ["k"], [])
    by_scores = R._by_scores(grain, ["k"], [], 30, "s")
    for found in (by_matrix, by_scores):
        got = {r["rep"]: r["won"] / (2 * r["pos"] * r["neg"]) for r in found.where("pos > 0 and neg > 0").collect()}
        assert got.keys() == {rep for rep, v in want.items() if v is not None}
        assert all(abs(got[rep] - want[rep]) < 1e-12 for rep in got)


def test_replicates_sum_the_counts_of_drawn_groups(spark):
    n = 600  # more than two blocks
    groups = spark.createDataFrame([("a", i, n, i * i) for i in range(n)], "k string, g long, groups long, c long")
    got = {r["rep"]: r["c"] for r in R.replicates(groups, ["k"], 4, "s", ["c"]).collect()}
    assert got == {rep: sum(g * g for g in _drawn("s", rep, n)) for rep in range(4)}


def test_more_drawn_rows_are_dealt_over_more_tasks(spark, monkeypatch):
    few = R.drawn_items(_grain(spark), ["k"], 300, "s", ["score"])
    monkeypatch.setattr(R, "DEALT", 64)
    many = R.drawn_items(_grain(spark), ["k"], 300, "s", ["score"])
    tasks = lambda drawn: drawn.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks(few) <= R.TASKS < tasks(many)
    counted = [sorted(d.groupBy("rep", "score").count().collect()) for d in (few, many)]
    assert counted[0] == counted[1]
