"""Metric blocks, refusals, controls and the probe's validation; queries without SQL against plain Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from warrantlake.functions import text as T
from warrantlake.operators import evidence as E
from warrantlake.operators import validation as V
from warrantlake.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows_of(spark, name, sf=SF):
    return catalogue.QUERIES[name][0](spark, sf).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# --- identifiers: whole documents, one regular expression at a time


def matches(pattern, text):
    return [m.group() for m in re.finditer(pattern, text, re.I)]


def only_digits(s):
    return "".join(c for c in s if c in "0123456789")


def candidates(text):
    """(start, end, confidence) of everything that any shape finds."""
    shapes = [
        (T.UPI, lambda s: 0.88), (T.UPI_SPOKEN, lambda s: 0.66), (T.IFSC, lambda s: 0.85),
        (T.TWELVE, lambda s: (0.95 if T.verhoeff_plain(only_digits(s)) else 0.55) if len(only_digits(s)) == 12 else 0),
        (T.PAN, lambda s: 0.92 if re.sub(r"[ .\-]", "", s).upper()[3] in "PCHFATBLJG" else 0.5),
        (T.PHONE, lambda s: (0.8 if only_digits(s)[-10] in "6789" else 0.4) if 10 <= len(only_digits(s)) <= 13 else 0),
        *((p, lambda s, c=c: c) for p, c in T.OBFUSCATED),
    ]
    return [(m.start(), m.end(), c) for p, sure in shapes for m in re.finditer(p, text, re.I) if (c := sure(m.group())) >= T.LEAST_CONFIDENCE]


def test_identifier_scores_and_spans(spark, texts):
    found = {i: candidates(t) for i, t in texts.items()}
    scores = {r["doc_id"]: r["score"] for r in rows_of(spark, "tx08_pii_score")}
    assert scores == {i: max((c for *_, c in f), default=0.0) for i, f in found.items()}
    assert sum(s > 0 for s in scores.values()) > 5
    kept = {i: [] for i in texts}
    for r in rows_of(spark, "tx07_spans"):
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["text"]
        kept[r["doc_id"]].append((r["start"], r["end"], r["confidence"]))
    for i, all_of in found.items():
        assert set(kept[i]) <= set(all_of)
        spans = sorted(kept[i])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        for a, b, c in all_of:  # whatever was left out overlaps something at least as sure
            assert any(x < b and a < y and s >= c for x, y, s in kept[i])


def test_identifier_kinds(spark, texts):
    for r in rows_of(spark, "tx01_identifier_kinds"):
        t = texts[r["doc_id"]]
        twelve = [n for n in map(only_digits, matches(T.TWELVE, t)) if len(n) == 12]
        phones = [n for n in map(only_digits, matches(T.PHONE, t)) if 10 <= len(n) <= 13]
        assert tuple(r)[1:] == (len(twelve), sum(map(T.verhoeff_plain, twelve)), len(matches(T.PAN, t)), len(phones), sum(n[-10] in "6789" for n in phones))


def test_text_detector_rates(spark, texts):
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    score = {i: max((c for *_, c in candidates(t)), default=0.0) for i, t in texts.items()}
    for r in rows_of(spark, "sr17_text_detector"):
        ids = [i for i in marks if langs.get(i) == r["eval_set_id"]]
        flags = [(score[i] >= 0.5, marks[i] == 1) for i in ids]
        assert (r["tp"], r["fp"], r["tn"], r["fn"]) == tuple(flags.count(x) for x in ((True, True), (True, False), (False, False), (False, True)))


# --- metric blocks and refusals


def test_block_of_one_class_and_of_nothing_flagged(spark):
    items = [("benign", i, f"q{i}", 0, i / 40) for i in range(40)] + [("quiet", i, f"q{i}", i % 2, 0.01) for i in range(40)]
    df = spark.createDataFrame(items, "s string, item_id int, u string, label int, score double")
    rows = {(r["s"], r["metric"]): r for r in E.metric_block(df, ["s"], "u", 0.5, 200, "t").collect()}
    assert {m for s, m in rows if s == "benign"} == {"fpr_hard_negatives", "flag_rate", "confirmed_errors"}
    hard = rows["benign", "fpr_hard_negatives"]
    assert hard["value"] == 0.5 and hard["ci_low"] == 0.0 and 0.5 < hard["ci_high"] < 0.7
    nothing = rows["quiet", "precision"]
    assert (nothing["value"], nothing["ci_low"], nothing["ci_high"]) == (0.0, 0.0, 1.0)
    flat = rows["quiet", "flag_rate"]
    assert flat["ci_low"] == 0.0 and abs(flat["ci_high"] - (1 - 0.025 ** (1 / 40))) < 1e-9
    assert rows["quiet", "auroc"]["value"] == 0.5


def test_every_reason_of_a_refusal_occurs(spark):
    reasons = {x.partition(":")[0] for r in rows_of(spark, "sr14_refusals", "/root/testdata/sf0.01") for x in r["reasons"].split("; ")}
    assert reasons >= {"control", "control_suite", "n_test", "single_class_envelope", "auroc_lower_ci", "lift_lower_ci", "recall_undefined", "fpr_hard_negatives"}
    b = lambda v, lo, hi: (v, lo, hi, 100)
    schema = "m map<string,struct<value:double,ci_low:double,ci_high:double,n:bigint>>, k int"
    good = {"auroc": b(0.9, 0.8, 0.95), "recall": b(0.6, 0.5, 0.7), "precision": b(0.8, 0.7, 0.9), "flag_rate": b(0.1, 0.05, 0.2)}
    weak = good | {"recall": b(0.3, 0.15, 0.4)}
    hard = {"fpr_hard_negatives": b(0.3, 0.2, 0.7), "flag_rate": b(0.3, 0.2, 0.4)}
    df = spark.createDataFrame([(good, 1), (weak, 2), (hard, 3)], schema)
    none = F.array().cast("array<string>")
    got = {r["k"]: r["r"] for r in df.select("k", E.refusals(F.lit(300), none, F.lit(5), 200, F.when(F.col("k") < 3, 0.2), F.when(F.col("k") == 3, 0.6)).alias("r")).collect()}
    assert got == {1: [], 2: ["recall_lower_ci"], 3: ["fpr_hard_negatives_upper_ci"]}


# --- probes


def vectors(spark, n, d, lift, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, d)) * np.arange(1, d + 1) + lift * y[:, None] + 3
    rows = [(i, x[i].tolist(), int(y[i]), i // 3) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "id long, vec array<double>, label int, cluster long")


def test_fits_are_least_points_of_their_objectives(spark):
    x, y, df = vectors(spark, 300, 5, 1.0)
    other = (np.arange(300) % 3 == 0).astype(int)
    ys = F.array(F.col("label"), (F.col("id") % 3 == 0).cast("int"), F.col("label"))
    strengths = [0.5, 0.1, 0.001]
    probes = V.fit_many(df.repartition(4).select("id", "vec", ys.alias("ys")), strengths)
    z = np.hstack(((x - x.mean(0)) / x.std(0), np.ones((300, 1))))

    def objective(w, labels, c):
        p = 1 / (1 + np.exp(-z @ w))
        weight = np.where(labels == 1, 300 / (2 * labels.sum()), 300 / (2 * (300 - labels.sum())))
        return -c * (weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() + 0.5 * (w[:-1] ** 2).sum()

    for k, labels in enumerate((y, other, y)):
        least = objective(probes.weights[k], labels, strengths[k])
        for at in range(6):
            for step in (1e-3, -1e-3):
                moved = probes.weights[k].copy()
                moved[at] += step
                assert objective(moved, labels, strengths[k]) > least
    scores = {r["id"]: r["scores"] for r in V.score_many(df, probes).collect()}
    assert np.allclose([scores[i] for i in range(300)], 1 / (1 + np.exp(-z @ probes.weights.T)))


def test_permuted_labels_keep_their_number(spark):
    _, y, df = vectors(spark, 500, 2, 0.0)
    rows = V.permuted(df, [3, 4, 5], 9).collect()
    ys = np.array([r["ys"] for r in rows])
    assert (ys.sum(axis=0) == y.sum()).all() and not (ys[:, 0] == ys[:, 1]).all()


def test_null_summary():
    steady = V.null_summary([0.5 + 0.01 * (-1) ** k for k in range(8)])
    assert steady["verdict"] == "pass" and steady["needed"] == 1
    assert V.null_summary([0.6 + 0.01 * (-1) ** k for k in range(8)])["verdict"] == "fail"
    wide = V.null_summary([0.5 + 0.3 * (-1) ** k for k in range(8)])
    assert wide["verdict"] == "UNDERPOWERED" and wide["needed"] > 100 and wide["margin"] < 0


def test_controls_catch_planted_faults(spark):
    pairs = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [2.0, 3.0, 1.0])] * 3, "reference array<double>, left array<double>, right array<double>")
    assert V.padding_fault(pairs)["passed"]
    assert not V.padding_fault(pairs.withColumn("right", F.col("left")))["passed"] and not V.padding_fault(pairs.where("false"))["passed"]
    scored = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1)], "label int, score double")
    assert V.canary(scored, 0.5)["passed"] and not V.canary(scored, 0.85)["passed"] and not V.canary(scored.where("label = 0"), 0.5)["passed"]


def test_validation_issues_and_refuses(spark):
    _, _, apart = vectors(spark, 900, 4, 3.0)
    good = V.validate(apart, 0.3, 200, min_recall=0.2, least_test=100)
    assert [c["control"] for c in good.controls] == ["padding_fault", "label_shuffle", "null_feature", "canary", "determinism"]
    assert good.reasons == [] and good.metrics["auroc"]["ci_low"] > 0.8
    _, _, noise = vectors(spark, 600, 4, 0.0, 2)
    bad = V.validate(noise, 0.3, 200, min_recall=0.2, least_test=500)
    assert {"n_test", "auroc_lower_ci"} <= set(bad.reasons)
