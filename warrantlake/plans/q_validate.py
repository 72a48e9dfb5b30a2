"""The probe's validation over the given vectors: five of them in a row share a question."""

from __future__ import annotations

from pyspark.sql import functions as F

from warrantlake.operators import validation as V
from warrantlake.sources.shared import written
from warrantlake.sources.views import probe_items

BUDGET, REPS, LEAST_TEST = 0.3, 1000, 50


def _items(s, d):
    x = probe_items(s, d).select(F.col("vec_id").alias("id"), "vec", "label", F.floor(F.col("vec_id") / 5).alias("cluster"))
    return written(x, "vectors")


def _parts(s, d):
    dealt = V.splits(_items(s, d), "validate")
    return tuple(dealt.where(F.col("split") == x) for x in ("train", "validation"))


def _validate(s, d):
    """The metric block of a validated probe, with the warrant's status and what it was refused for."""
    v = V.validate(_items(s, d), BUDGET, REPS, min_recall=0.1, least_test=LEAST_TEST)
    status = "REFUSED" if v.reasons else "VALID"
    rounded = [F.round(c, 6).alias(c) for c in ("value", "ci_low", "ci_high")]
    return v.block.select("metric", "n", *rounded, F.lit(v.strength).alias("c"), F.round(F.lit(v.threshold), 6).alias("threshold"), F.lit(status).alias("status"), F.lit("; ".join(v.reasons)).alias("reasons"))


def _controls(s, d):
    train, validation = _parts(s, d)
    strength, probe, every = V.select(train, validation)
    threshold = V.frozen_threshold(validation, probe, BUDGET)
    found = V.run_controls(train, validation, strength, probe, threshold, V.canaries_of(train, validation, every, BUDGET))
    return s.createDataFrame([(i, c["control"], c["passed"], round(c["measured"], 6), c["detail"]) for i, c in enumerate(found)], "place int, control string, passed boolean, measured double, detail string")


def _coefficients(s, d):
    """Weights of the chosen probe by position, on the vectors' own scale, and its intercept (position -1)."""
    train, validation = _parts(s, d)
    _, probe, _ = V.select(train, validation)
    raw = probe.weights[0, :-1] / probe.scale
    rows = [(i, float(w)) for i, w in enumerate(raw)] + [(-1, float(probe.weights[0, -1] - raw @ probe.mean))]
    return s.createDataFrame(rows, "position int, weight double").select("position", F.round("weight", 6).alias("weight"))


def _frozen(s, d):
    """The chosen strength, the threshold frozen on validation, and the flag rates of both splits at it."""
    train, validation = _parts(s, d)
    strength, probe, _ = V.select(train, validation)
    threshold = V.frozen_threshold(validation, probe, BUDGET)
    both = V.score_many(train.unionByName(validation), probe).withColumn("score", F.col("scores")[0])
    return both.groupBy("split").agg(F.round(F.avg((F.col("score") >= F.lit(threshold)).cast("double")), 9).alias("flag_rate"), F.lit(strength).alias("c"), F.round(F.lit(threshold), 6).alias("threshold"))


def _null(s, d):
    """Areas of fits to permuted labels and to normal features: repeats, mean, spread, and what they show."""
    train, validation = _parts(s, d)
    rows = []
    for name, noise in (("label_shuffle", False), ("null_feature", True)):
        found, _ = V.null_control(train, validation, 0.01, 7, noise)
        rows.append((name, found["repeats"], round(found["mean"], 6), round(found["spread"], 6), found["needed"], found["verdict"]))
    return s.createDataFrame(rows, "control string, repeats int, mean double, spread double, needed int, verdict string")


def _rounded(block, *more):
    return block.select(*more, "metric", "n", *(F.round(c, 6).alias(c) for c in ("value", "ci_low", "ci_high")), "n_test", "status", "reasons")


def _best_c(s, d):
    """Every strength's validation area; the chosen one is that of the largest, of equal ones the smallest."""
    train, validation = _parts(s, d)
    strength, _, every = V.select(train, validation)
    found = V.areas(validation, every)
    return s.createDataFrame([(c, round(found[k], 9), c == strength) for k, c in enumerate(V.GRID)], "c double, auroc double, chosen boolean")


def _transfer(s, d):
    """A frozen probe and threshold on its own test split and on the same vectors scaled and shifted: blocks, controls, issue."""
    items = _items(s, d)
    dealt = V.splits(items, "validate")
    train, validation, test = (dealt.where(F.col("split") == x) for x in ("train", "validation", "test"))
    strength, probe, every = V.select(train, validation)
    threshold = V.frozen_threshold(validation, probe, BUDGET)
    controls = V.run_controls(train, validation, strength, probe, threshold, V.canaries_of(train, validation, every, BUDGET))
    moved = test.withColumn("vec", F.transform("vec", lambda v: v * 1.5 + 0.1))
    both = test.withColumn("envelope", F.lit("own")).unionByName(moved.withColumn("envelope", F.lit("moved")))
    scored = V.score_many(both, probe).select("envelope", "cluster", "label", F.col("scores")[0].alias("score"))
    return _rounded(V.warranted(scored, ["envelope"], threshold, REPS, "transfer", controls, LEAST_TEST, 0.1), "envelope")


def _ablation(s, d):
    """A probe for each set of leading dimensions, chosen, frozen and measured alike; without controls none is issued."""
    dealt, out = V.splits(_items(s, d), "validate"), None
    for name, n in (("first8", 8), ("first32", 32), ("all", 64)):
        train, validation, test = (dealt.where(F.col("split") == x).withColumn("vec", F.slice("vec", 1, n)) for x in ("train", "validation", "test"))
        strength, probe, _ = V.select(train, validation)
        threshold = V.frozen_threshold(validation, probe, BUDGET)
        scored = V.score_many(test, probe).select(F.lit(name).alias("variant"), "cluster", "label", F.col("scores")[0].alias("score"))
        part = _rounded(V.warranted(scored, ["variant"], threshold, REPS, "ablation", [], LEAST_TEST), "variant").withColumn("c", F.lit(strength))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "tk04_best_regularisation": (_best_c, None),
    "sr16_transfer": (_transfer, None),
    "sr18_ablation": (_ablation, None),
    "sr15_validate": (_validate, None),
    "ud10_controls": (_controls, None),
    "ud03_coefficients": (_coefficients, None),
    "ud04_frozen_probe": (_frozen, None),
    "st17_null_of_controls": (_null, None),
}
