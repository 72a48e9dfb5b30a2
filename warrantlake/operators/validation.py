"""A linear probe validated end to end: several fits at once by Newton steps, five controls, an issue or a refusal.

Standardised, class-balanced logistic regressions that differ in their labels, their strength or their features are
fitted together: each step is one pass over the training rows, in which every task adds up the gradients and
Hessians of all fits, and the sums, whose size doesn't depend on the rows, meet by a grouped aggregation. Vectors of
more than ``WIDE`` components send gradients and losses alone, so what meets grows with the width and not its square.
``pyspark.ml`` fits one label and strength at a time; ``operators/probe.py`` uses it where one fit is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warrantlake.functions.rng import uniform
from warrantlake.operators import evidence as E
from warrantlake.operators import metrics as M
from warrantlake.operators import thresholds as H
from warrantlake.sources.shared import written

#: Strengths to choose from, the band of a null result, and the repeats that show one.
GRID = (0.0001, 0.001, 0.01, 0.1, 1.0)
BAND, LEAST_REPEATS, MOST_REPEATS = (0.45, 0.55), 8, 200
MIN_COSINE, MAX_RELATIVE_L2, CANARIES, LEAST_TEST = 0.999, 0.1, 20, 200
#: Fits of one pass, Newton steps at most, buckets by which a hash's order statistic is found.
TOGETHER, STEPS, BUCKETS = 16, 30, 4096
#: Components beyond which Hessians stay unmade; passes, remembered steps and largest gradient of the descent used there.
WIDE, PASSES, MEMORY, SLOPE = 256, 400, 12, 1e-8


@dataclass
class Probes:
    """Fits over one standardisation: ``weights`` has a row for each, the intercept last. ``noise``: a seed for each
    fit whose features are standard normal draws by the row's id instead of its vector."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    noise: list[int] | None = None

    def features(self, ids: np.ndarray, x: np.ndarray, fit: int) -> np.ndarray:
        if self.noise is None:
            z = (x - self.mean) / self.scale
        else:
            z = np.stack([np.random.default_rng((self.noise[fit], int(i) & 0xFFFFFFFFFFFF)).normal(size=x.shape[1]) for i in ids]) if len(ids) else x
        return np.hstack((z, np.ones((len(z), 1))))

    def scores(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        fits = range(len(self.weights))
        shared = self.features(ids, x, 0) if self.noise is None else None
        return np.stack([1 / (1 + np.exp(-((shared if shared is not None else self.features(ids, x, k)) @ self.weights[k]).clip(-500, 500))) for k in fits], axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) != width * len(column):
        raise ValueError(f"a vector is null, holds nulls or hasn't {width} components")
    return np.asarray(flat).reshape(-1, width)


def refuse_unusable(items: DataFrame) -> None:
    """Raises if a label or vector is null, a component null or not finite, or widths differ."""
    odd = F.col("vec").isNull() | F.col("label").isNull() | F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = items.agg(F.count_if(odd).alias("odd"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    if r["odd"] or r["least"] != r["most"]:
        raise ValueError(f"{r['odd']} rows have a null label, no vector or an unusable component; vectors have {r['least']} to {r['most']} components")


class _Descent:
    """Limited-memory quasi-Newton steps of one fit, an evaluation at a time: ``at`` is where to evaluate next."""

    def __init__(self, size: int):
        self.at, self.done = np.zeros(size), False
        self.here = self.value = self.slope = self.way = None
        self.length, self.past = 1.0, []

    def told(self, value: float, slope: np.ndarray) -> None:
        if self.here is not None and value > self.value + 1e-4 * self.length * (self.slope @ self.way) + 1e-13 * abs(self.value):
            self.length /= 2
            self.done = self.length < 1e-12
            self.at = self.here if self.done else self.here + self.length * self.way
            return
        if self.here is not None:
            moved, bent = self.at - self.here, slope - self.slope
            if moved @ bent > 0:
                self.past = [*self.past[1 - MEMORY :], (moved, bent)]
        self.here, self.value, self.slope = self.at, value, slope
        self.done = bool(np.abs(slope).max() <= SLOPE)
        if not self.done:
            self.way, self.length = -self._scaled(slope), 1.0 if self.past else 1 / max(1.0, float(np.linalg.norm(slope)))
            self.at = self.here + self.length * self.way

    def _scaled(self, slope: np.ndarray) -> np.ndarray:
        out, parts = slope.copy(), []
        for moved, bent in reversed(self.past):
            part = (moved @ out) / (moved @ bent)
            parts.append(part)
            out -= part * bent
        if self.past:
            moved, bent = self.past[-1]
            out *= (moved @ bent) / (bent @ bent)
        for (moved, bent), part in zip(self.past, reversed(parts), strict=True):
            out += (part - (bent @ out) / (moved @ bent)) * moved
        return out


def fit_many(train: DataFrame, strengths: list[float], noise: list[int] | None = None) -> Probes:
    """Probes for rows (id, vec, ys), ``ys`` an array with a label for each fit.

    Each minimises its strength times the balanced log loss plus half the squared weights, the intercept left out.
    """
    stat = train.select(array_to_vector("vec").alias("v"), "ys").agg(
        Summarizer.mean(F.col("v")).alias("mean"), Summarizer.variance(F.col("v")).alias("variance"), F.count("*").alias("n"), F.array(*[F.sum(F.col("ys")[k]) for k in range(len(strengths))]).alias("positives")
    ).first()
    n, fits = stat["n"], len(strengths)
    mean, spread = stat["mean"].toArray(), np.sqrt(stat["variance"].toArray() * (n - 1) / max(1, n))
    probes = Probes(mean, np.where(spread > 0, spread, 1.0), np.zeros((fits, len(mean) + 1)), noise)
    positive = np.array(stat["positives"], float)
    balance = np.stack((n / (2 * np.maximum(1, n - positive)), n / (2 * np.maximum(1, positive))))
    upper, size = np.triu_indices(len(mean) + 1), len(mean) + 1
    penalty = np.append(np.ones(size - 1), 0.0)
    curved = len(mean) <= WIDE
    width = size + (len(upper[0]) if curved else 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((fits, width))
        for batch in batches:
            ids, x, y = np.asarray(batch.column("id")), _matrix(batch.column("vec"), size - 1), _matrix(batch.column("ys"), fits)
            p = probes.scores(ids, x)
            shared = probes.features(ids, x, 0) if noise is None else None
            for k in range(fits):
                z = shared if shared is not None else probes.features(ids, x, k)
                w = balance[y[:, k].astype(int), k]
                total[k, :size] += z.T @ (w * (p[:, k] - y[:, k]))
                if curved:
                    total[k, size:] += ((z * (w * p[:, k] * (1 - p[:, k]))[:, None]).T @ z)[upper]
                else:
                    lean = z @ probes.weights[k]
                    total[k, size] += w @ (np.logaddexp(0, lean) - y[:, k] * lean)
        cells = total.ravel()
        met = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(cells[met])], ["cell", "value"])

    rows = train.select("id", "vec", "ys")

    def evaluated() -> np.ndarray:
        found = rows.mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
        cells = np.zeros(fits * width)
        cells[found["cell"].to_numpy(int)] = found["value"].to_numpy()
        return cells.reshape(fits, -1)

    if not curved:
        paths = [_Descent(size) for _ in range(fits)]
        for _ in range(PASSES):
            cells = evaluated()
            for k, (path, strength) in enumerate(zip(paths, strengths, strict=True)):
                if not path.done:
                    w = probes.weights[k]
                    path.told(strength * cells[k, size] + penalty @ (w * w) / 2, strength * cells[k, :size] + penalty * w)
                    probes.weights[k] = path.at
            if all(path.done for path in paths):
                break
        return probes
    for _ in range(STEPS):
        cells, largest = evaluated(), 0.0
        for k, strength in enumerate(strengths):
            gradient = strength * cells[k, :size] + penalty * probes.weights[k]
            hessian = np.zeros((size, size))
            hessian[upper] = strength * cells[k, size:]
            hessian = hessian + np.triu(hessian, 1).T + np.diag(penalty + 1e-12)
            step = np.linalg.solve(hessian, gradient)
            probes.weights[k] -= step
            largest = max(largest, float(np.abs(step).max()))
        if largest < 1e-9:
            break
    return probes


def score_many(items: DataFrame, probes: Probes) -> DataFrame:
    """``items`` (id, vec, ...) with ``scores``, one of each fit."""

    @F.pandas_udf("array<double>")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, vectors in batches:
            x = np.stack(vectors.to_list()) if len(vectors) else np.empty((0, len(probes.mean)))
            yield pd.Series(list(probes.scores(ids.to_numpy(), x)))

    return items.withColumn("scores", scored("id", "vec"))


def areas(items: DataFrame, probes: Probes) -> dict[int, float | None]:
    """The rank statistic of each fit on labelled items."""
    long = score_many(items, probes).select("label", F.posexplode("scores").alias("fit", "score"))
    return {r["fit"]: r["auroc"] for r in M.auroc(long, ["fit"]).collect()}


def permuted(train: DataFrame, repeats: list[int], seed: int) -> DataFrame:
    """``ys``: for each repeat, as many positives as the labels have, given to the rows of the smallest hashes.

    The hash that parts them is an order statistic: counted by buckets first, then found inside one bucket.
    """
    positives = train.agg(F.sum("label")).first()[0] or 0
    hashed = train.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64("id", F.lit(r), F.lit(seed)).alias("h")) for k, r in enumerate(repeats)])).alias("x")).select("id", "x.*")
    bucket = F.floor(F.col("h") / 2 ** (64 - int(math.log2(BUCKETS))))
    hashed = hashed.withColumn("bucket", bucket)
    counts = hashed.groupBy("k", "bucket").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    edge = upto.where((F.col("upto") >= positives) & (F.col("upto") - F.col("c") < positives)).select("k", "bucket", (positives - F.col("upto") + F.col("c")).alias("nth"))
    inside = hashed.join(F.broadcast(edge), ["k", "bucket"]).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("h", "id")))
    cuts = {r["k"]: (r["h"], r["id"]) for r in inside.where("r = nth").select("k", "h", "id").collect()}

    def label(k: int, r: int) -> Column:
        h, last = cuts.get(k, (None, None))
        own = F.xxhash64("id", F.lit(r), F.lit(seed))
        return F.lit(0) if h is None else ((own < h) | ((own == h) & (F.col("id") <= last))).cast("int")

    return train.select("id", "vec", F.array(*[label(k, r) for k, r in enumerate(repeats)]).alias("ys"))


def null_summary(values: list[float], most: int = MOST_REPEATS) -> dict:
    """Whether the mean lies in the band, with a standard error of at most half the band's half-width."""
    low, high = BAND
    half = min(0.5 - low, high - 0.5)
    mean, spread = float(np.mean(values)), float(np.std(values, ddof=1)) if len(values) > 1 else math.inf
    error = spread / math.sqrt(len(values))
    powered = error <= half / 2
    margin = min(mean - low, high - mean)
    verdict = "UNDERPOWERED" if not powered else "pass" if low <= mean <= high else "fail"
    return {"repeats": len(values), "mean": mean, "spread": spread, "needed": 2 if spread <= 0 else min(most, math.ceil((2 * spread / half) ** 2)) if math.isfinite(spread) else most, "verdict": verdict, "margin": margin if powered else -abs(margin)}


def null_control(train: DataFrame, holdout: DataFrame, strength: float, seed: int, noise: bool, most: int = MOST_REPEATS) -> tuple[dict, list[float]]:
    """Areas on the true labels of fits to permuted labels, or to normal features; repeats until their spread is known well enough."""
    values: list[float] = []
    wanted = LEAST_REPEATS
    while len(values) < wanted:
        numbers = list(range(len(values), min(wanted, len(values) + TOGETHER)))
        rows = train.select("id", "vec", F.array(*[F.col("label")] * len(numbers)).alias("ys")) if noise else permuted(train, numbers, seed)
        found = areas(holdout, fit_many(rows, [strength] * len(numbers), [seed * 1000 + n for n in numbers] if noise else None))
        values += [found[k] for k in range(len(numbers))]
        wanted = max(wanted, min(most, null_summary(values, most)["needed"])) if len(values) >= wanted else wanted
    return null_summary(values, most), values


def padding_fault(pairs: DataFrame) -> dict:
    """Left-padded vectors have to equal their references, right-padded ones have to be rejected (reference, left, right)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)

    def same(other: str) -> Column:
        cosine = dot("reference", other) / F.greatest(F.sqrt(dot("reference", "reference")) * F.sqrt(dot(other, other)), F.lit(1e-12))
        apart = F.zip_with("reference", other, lambda x, y: x - y)
        length = F.sqrt(F.aggregate(apart, F.lit(0.0), lambda t, x: t + x * x)) / F.greatest(F.sqrt(dot("reference", "reference")), F.lit(1e-12))
        return (cosine >= MIN_COSINE) & (length <= MAX_RELATIVE_L2)

    r = pairs.agg(F.count("*").alias("n"), F.count_if(same("left")).alias("left"), F.count_if(same("right")).alias("right")).first()
    return {"passed": r["n"] > 0 and r["left"] == r["n"] and r["right"] == 0, "measured": r["left"] / max(1, r["n"]), "detail": f"{r['left']} of {r['n']} left-padded accepted, {r['right']} right-padded"}


def canary(scored: DataFrame, threshold: float) -> dict:
    """Recall on the canaries (label, score) has to be 1; without a positive the control fails."""
    r = scored.where("label = 1").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= threshold).alias("k")).first()
    return {"passed": r["n"] > 0 and r["k"] == r["n"], "measured": r["k"] / r["n"] if r["n"] else 0.0, "detail": f"{r['k']} of {r['n']} caught" if r["n"] else "no canaries"}


@dataclass
class Validation:
    strength: float
    threshold: float | None
    probe: Probes
    controls: list[dict]
    block: DataFrame
    reasons: list[str]
    metrics: dict


def splits(items: DataFrame, seed: str, fractions: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """``split``: clusters are dealt whole, by a hash."""
    u = uniform(F.lit(seed), "cluster")
    return items.withColumn("split", F.when(u < fractions[0], "train").when(u < sum(fractions), "validation").otherwise("test"))


def select(train: DataFrame, validation: DataFrame, grid: tuple[float, ...] = GRID) -> tuple[float, Probes, Probes]:
    """The strength of the largest validation area, of equal ones the smallest; its fit, and all fits."""
    every = fit_many(train.select("id", "vec", F.array(*[F.col("label")] * len(grid)).alias("ys")), list(grid))
    found = areas(validation, every)
    best = min(range(len(grid)), key=lambda k: (-(found.get(k) or 0.0), grid[k]))
    return grid[best], Probes(every.mean, every.scale, every.weights[best : best + 1]), every


def sweep(train: DataFrame, validation: DataFrame, layers: dict[int, Column], grid: tuple[float, ...] = GRID) -> list[tuple[int, float, float | None]]:
    """(layer, strength, validation area) of a fit for each; ``layers`` gives each layer's vector. A layer's fits share its passes."""
    out = []
    for layer, vector in sorted(layers.items()):
        a, b = (df.withColumn("vec", vector) for df in (train, validation))
        found = areas(b, fit_many(a.select("id", "vec", F.array(*[F.col("label")] * len(grid)).alias("ys")), list(grid)))
        out += [(layer, c, found.get(k)) for k, c in enumerate(grid)]
    return out


def best_setting(rows: list[tuple[int, float, float | None]]) -> tuple[int, float, float]:
    """That of the largest area; of equal ones the lowest layer, then the smallest strength. An empty sweep is refused."""
    known = [r for r in rows if r[2] is not None]
    if not known:
        raise ValueError("there is no winner of an empty sweep")
    return min(known, key=lambda r: (-r[2], r[0], r[1]))


def frozen_threshold(validation: DataFrame, probe: Probes, budget: float) -> float | None:
    scored = score_many(validation, probe).select(F.lit("all").alias("all"), "label", F.col("scores")[0].alias("score"))
    return H.within_budget(scored, ["all"], budget).first()["threshold"]


def canaries_of(train: DataFrame, validation: DataFrame, every: Probes, budget: float) -> DataFrame:
    """The training positives whose worst margin over all fits is largest and positive: (id, vec, label)."""
    long = score_many(validation, every).select("label", F.posexplode("scores").alias("fit", "score"))
    cuts = {r["fit"]: r["threshold"] for r in H.within_budget(long, ["fit"], budget).collect() if r["threshold"] is not None}
    if not cuts:
        return train.where("false").select("id", "vec", "label")
    margins = F.least(*[F.col("scores")[k] - F.lit(t) for k, t in cuts.items()], F.lit(1.0))
    worst = score_many(train.where("label = 1"), every).withColumn("margin", margins).where("margin > 0")
    return worst.orderBy(F.desc("margin"), "id").limit(CANARIES).select("id", "vec", "label")


def run_controls(train: DataFrame, holdout: DataFrame, strength: float, probe: Probes, threshold: float | None, canaries: DataFrame, seed: int = 7) -> list[dict]:
    """All five, in order, also after one has failed: control, passed, measured, detail."""
    rotated = F.concat(F.slice("vec", 2, F.size("vec") - 1), F.slice("vec", 1, 1))
    pairs = holdout.select(F.col("vec").alias("reference"), F.transform("vec", lambda x: x * 1.0001).alias("left"), rotated.alias("right"))
    out = [{"control": "padding_fault", **padding_fault(pairs)}]
    for name, noise in (("label_shuffle", False), ("null_feature", True)):
        found, _ = null_control(train, holdout, strength, seed, noise)
        out.append({"control": name, "passed": found["verdict"] == "pass", "measured": found["mean"], "detail": f"{found['verdict']} after {found['repeats']} repeats, spread {found['spread']:.4f}"})
    caught = canary(score_many(canaries, probe).select("label", F.col("scores")[0].alias("score")), threshold if threshold is not None else math.inf)
    out.append({"control": "canary", **caught})
    again = fit_many(train.repartition(3, "id").select("id", "vec", F.array("label").alias("ys")), [strength])
    apart = float(np.abs(again.weights - probe.weights).max())
    # Sums over rows dealt otherwise differ in the last bits.
    out.append({"control": "determinism", "passed": apart <= 1e-7, "measured": 0.0 if apart <= 1e-7 else apart, "detail": "a fit over rows dealt otherwise"})
    return out


def validate(items: DataFrame, budget: float, reps: int, min_recall: float | None = None, max_fpr: float | None = None, seed: str = "validate", least_test: int = LEAST_TEST) -> Validation:
    """Split by cluster, choose the strength, freeze a threshold on validation, run the controls, measure the test once, issue or refuse.

    ``items``: id, vec, label, cluster. The splits are written by the caller where reading them is dear.
    """
    refuse_unusable(items)
    dealt = splits(items, seed)
    train, validation, test = (dealt.where(F.col("split") == s) for s in ("train", "validation", "test"))
    strength, probe, every = select(train, validation)
    threshold = frozen_threshold(validation, probe, budget)
    controls = run_controls(train, validation, strength, probe, threshold, canaries_of(train, validation, every, budget))
    scored = written(score_many(test, probe).select(F.lit("test").alias("set"), "cluster", "label", F.col("scores")[0].alias("score")), "scored")
    block = written(E.metric_block(scored, ["set"], "cluster", threshold if threshold is not None else math.inf, reps, seed), "block")
    row = decided(scored, block, ["set"], controls, least_test, min_recall, max_fpr).first()
    return Validation(strength, threshold, probe, controls, block, list(row["r"]) if row else ["n_test"], dict(row["m"]) if row else {})


def decided(scored: DataFrame, block: DataFrame, keys: list[str], controls: list[dict], least_test: int, min_recall: float | None = None, max_fpr: float | None = None) -> DataFrame:
    """keys, n_test, ``m`` (see ``evidence.wide``) and ``r``: why the warrant of each key is refused."""
    failed = [c["control"] for c in controls if not c["passed"]]
    x = E.wide(block, keys).join(scored.groupBy(*keys).agg(F.count("*").alias("n_test")), keys)
    told = lambda v: F.lit(v).cast("double")
    reasons = E.refusals(F.col("n_test"), F.array(*[F.lit(f) for f in failed]).cast("array<string>"), F.lit(len(controls)), least_test, told(min_recall), told(max_fpr))
    return x.select(*keys, "n_test", "m", reasons.alias("r"))


def warranted(scored: DataFrame, keys: list[str], threshold: float | None, reps: int, seed: str, controls: list[dict], least_test: int, min_recall: float | None = None, max_fpr: float | None = None) -> DataFrame:
    """The metric block of scored items (keys, cluster, label, score) at a frozen threshold, each row with the key's status and reasons."""
    held = written(scored, "scored")
    block = written(E.metric_block(held, keys, "cluster", threshold if threshold is not None else math.inf, reps, seed), "block")
    told = decided(held, block, keys, controls, least_test, min_recall, max_fpr)
    return block.join(told.select(*keys, "n_test", F.when(F.size("r") == 0, "VALID").otherwise("REFUSED").alias("status"), F.concat_ws("; ", "r").alias("reasons")), keys)
