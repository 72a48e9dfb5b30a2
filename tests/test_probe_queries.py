"""The probe's queries against plain numpy over every vector, wide fits, and unusable vectors."""

import numpy as np
import pytest

from warrantlake.operators import validation as V
from warrantlake.plans import catalogue, q_validate

SF = "/root/testdata/sf0.001"


def fitted(x, y, strength):
    """Weights of standardised, balanced logistic regression by Newton steps; the intercept is last."""
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    w, weight, ridge = np.zeros(z.shape[1]), len(y) / (2 * np.where(y == 1, y.sum(), len(y) - y.sum())), np.append(np.ones(x.shape[1]), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(strength * (z.T * (weight * p * (1 - p))) @ z + np.diag(ridge), strength * z.T @ (weight * (p - y)) + ridge * w)
    return lambda v: 1 / (1 + np.exp(-np.hstack(((v - mean) / scale, np.ones((len(v), 1)))) @ w)), w, mean, scale


def area(score, y):
    a, b = score[y == 1][:, None], score[y == 0][None, :]
    return float(((a > b) + 0.5 * (a == b)).mean())


def cut(score, budget):
    fine = [t for t in np.unique(score) if (score >= t).mean() <= budget]
    return min(fine) if fine else np.inf


@pytest.fixture(scope="module")
def parts(spark):
    rows = V.splits(q_validate._items(spark, SF), "validate").toPandas()
    return {k: (np.stack(g["vec"].to_list()), g["label"].to_numpy()) for k, g in rows.groupby("split")}


def chosen(parts, width=None):
    (x, y), (u, v) = ((parts[k][0][:, :width], parts[k][1]) for k in ("train", "validation"))
    found = {c: area(fitted(x, y, c)[0](u), v) for c in V.GRID}
    best = min(V.GRID, key=lambda c: (-found[c], c))
    return best, found, fitted(x, y, best), cut(fitted(x, y, best)[0](u), q_validate.BUDGET)


def rows(spark, name):
    return catalogue.QUERIES[name][0](spark, SF).collect()


def test_every_strength_and_the_chosen_one(spark, parts):
    best, found, _, _ = chosen(parts)
    got = {r["c"]: r for r in rows(spark, "tk04_best_regularisation")}
    assert {c: r["auroc"] for c, r in got.items()} == pytest.approx(found, abs=1e-8)
    assert [c for c, r in got.items() if r["chosen"]] == [best]


def measures(score, y, threshold):
    flag = score >= threshold
    out = {"auroc": area(score, y), "recall": flag[y == 1].mean(), "fpr": flag[y == 0].mean(), "flag_rate": flag.mean()}
    return out | {"precision": y[flag].mean() if flag.any() else 0.0, "confirmed_errors": float(y[flag].sum())}


def test_ablations_measure_as_numpy_does(spark, parts):
    got = rows(spark, "sr18_ablation")
    x, y = parts["test"]
    for name, width in (("first8", 8), ("first32", 32), ("all", 64)):
        best, _, probe, threshold = chosen(parts, width)
        mine = [r for r in got if r["variant"] == name]
        assert {r["metric"]: r["value"] for r in mine} == pytest.approx(measures(probe[0](x[:, :width]), y, threshold), abs=1e-6)
        assert {r["c"] for r in mine} == {best} and all("control_suite" in r["reasons"] and r["status"] == "REFUSED" for r in mine)


def test_transfer_refits_nothing(spark, parts):
    got = rows(spark, "sr16_transfer")
    x, y = parts["test"]
    _, _, probe, threshold = chosen(parts)
    for name, v in (("own", x), ("moved", x * 1.5 + 0.1)):
        mine = [r for r in got if r["envelope"] == name]
        assert {r["metric"]: r["value"] for r in mine} == pytest.approx(measures(probe[0](v), y, threshold), abs=1e-6)
        assert {r["n_test"] for r in mine} == {len(y)}
        assert all((r["status"] == "VALID") == (r["reasons"] == "") for r in mine)
        assert all(r["ci_low"] <= r["value"] <= r["ci_high"] for r in mine if r["metric"] != "confirmed_errors")


def test_coefficients_and_frozen_threshold(spark, parts):
    best, _, (score, w, mean, scale), threshold = chosen(parts)
    raw = w[:-1] / scale
    assert {r["position"]: r["weight"] for r in rows(spark, "ud03_coefficients")} == pytest.approx({-1: w[-1] - raw @ mean} | dict(enumerate(raw)), abs=2e-6)
    for r in rows(spark, "ud04_frozen_probe"):
        assert (r["c"], r["threshold"]) == (best, pytest.approx(threshold, abs=1e-6))
        assert r["flag_rate"] == pytest.approx((score(parts[r["split"]][0]) >= threshold - 1e-12).mean(), abs=1e-9)


def test_the_sweep_and_its_pivot(spark, parts):
    got = rows(spark, "tk03_best_setting")
    (x, y), (u, v) = parts["train"], parts["validation"]
    want = {(layer, c): area(fitted(x[:, 16 * layer : 16 * layer + 16], y, c)[0](u[:, 16 * layer : 16 * layer + 16]), v) for layer in range(4) for c in V.GRID}
    assert {(r["layer"], r["c"]): r["auroc"] for r in got} == pytest.approx(want, abs=1e-8)
    assert [(r["layer"], r["c"]) for r in got if r["best"]] == [min(want, key=lambda k: (-round(want[k], 9), *k))]
    names = {0.0001: "c_0_0001", 0.001: "c_0_001", 0.01: "c_0_01", 0.1: "c_0_1", 1.0: "c_1"}
    pivoted = {r["layer"]: r for r in rows(spark, "ag24_auroc_pivot")}
    assert all(pivoted[layer][names[c]] == pytest.approx(a, abs=1e-8) for (layer, c), a in want.items())


def test_ties_of_a_sweep_go_to_the_lowest_layer_and_smallest_strength():
    assert V.best_setting([(2, 0.1, 0.9), (1, 1.0, 0.9), (1, 0.1, 0.9), (0, 0.1, 0.8), (0, 0.01, None)]) == (1, 0.1, 0.9)
    with pytest.raises(ValueError, match="empty sweep"):
        V.best_setting([(0, 0.1, None)])


def made(spark, n, width, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    y = (x[:, 0] + x[:, 1] + rng.normal(size=n) > 0).astype(int)
    return x, y, spark.createDataFrame([(i, v.tolist(), int(k), [int(k), int(1 - k)]) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id long, vec array<double>, label int, ys array<int>")


def test_wide_vectors_send_gradients_alone(spark, monkeypatch):
    x, y, df = made(spark, 300, V.WIDE + 44)
    sent = []
    real = np.zeros

    def counted(shape, *more):
        sent.append(int(np.prod(shape)))
        return real(shape, *more)

    monkeypatch.setattr(V.np, "zeros", counted)
    got = V.fit_many(df, [0.01, 0.01])
    assert max(sent) <= 2 * (x.shape[1] + 2)
    monkeypatch.undo()
    assert np.abs(got.weights[0] - fitted(x, y, 0.01)[1]).max() < 1e-6
    assert np.abs(got.weights[1] - fitted(x, 1 - y, 0.01)[1]).max() < 1e-6


def test_both_ways_of_fitting_agree(spark, monkeypatch):
    _, _, df = made(spark, 400, 12)
    newton = V.fit_many(df, [0.1, 1.0])
    monkeypatch.setattr(V, "WIDE", 4)
    assert np.abs(V.fit_many(df, [0.1, 1.0]).weights - newton.weights).max() < 1e-7


@pytest.mark.parametrize("bad", [(None, 1), ([1.0, None], 1), ([1.0, float("nan")], 1), ([1.0], 1), ([1.0, 2.0], None)])
def test_unusable_vectors_are_refused(spark, bad):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1, 1), (2, *bad, 2), (3, [0.0, 1.0], 0, 3)], "id long, vec array<double>, label int, cluster long")
    with pytest.raises(ValueError, match="unusable component|components"):
        V.validate(df, 0.3, 10)
