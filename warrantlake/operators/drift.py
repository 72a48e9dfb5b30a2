"""Reference envelopes, the population stability index, sliding windows, the ladder, and anytime-valid monitoring."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warrantlake.operators import ranges as G

EPSILON, STABLE, SIGNIFICANT = 1e-6, 0.10, 0.25


def edges(reference: DataFrame, keys: list[str], value: str, bins: int = 8) -> DataFrame:
    """Distinct quantile edges by group; constant data gets one bin around its value."""
    cuts = G.quantiles(reference, keys, value, {f"e{i}": i / bins for i in range(bins + 1)})
    e = cuts.select(*keys, F.array_distinct(F.array(*[f"e{i}" for i in range(bins + 1)])).alias("e"))
    return e.select(*keys, F.when(F.size("e") > 1, F.col("e")).otherwise(F.array(F.get("e", F.lit(0)) - 1, F.get("e", F.lit(0)) + 1)).alias("edges"))


def bin_of(value: Column, cuts: Column) -> Column:
    """0-based bin: inner edges open to the right; values outside lie in the end bins."""
    return F.greatest(F.lit(0), F.least(F.size(cuts) - 2, F.size(F.filter(cuts, lambda c: c <= value)) - 1))


def envelope(reference: DataFrame, keys: list[str], value: str, bins: int = 8) -> DataFrame:
    """Bins with edges, floored and renormalised probabilities, and the group's mean and population deviation."""
    cuts = edges(reference, keys, value, bins)
    stats = reference.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n_reference"))
    counted = reference.join(cuts, keys).groupBy(*keys, bin_of(F.col(value), F.col("edges")).alias("bin")).agg(F.count("*").alias("c"))
    all_bins = cuts.select(*keys, "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    p = all_bins.join(counted, [*keys, "bin"], "left").join(stats, keys).withColumn("raw", F.greatest(F.coalesce(F.col("c"), F.lit(0)) / F.col("n_reference"), F.lit(EPSILON)))
    whole = Window.partitionBy(*keys)
    return p.select(*keys, "bin", F.get("edges", F.col("bin")).alias("lo"), F.get("edges", F.col("bin") + 1).alias("hi"), (F.col("raw") / F.sum("raw").over(whole)).alias("p"), "mean", "std", "n_reference")


def psi(live: DataFrame, reference_bins: DataFrame, keys: list[str], value: str) -> DataFrame:
    """PSI of live values against an envelope, with how much of it rests on smoothed bins."""
    cuts = reference_bins.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("lo", "hi"))))).alias("edges"))
    counted = live.join(cuts, keys).groupBy(*keys, bin_of(F.col(value), F.col("edges")).alias("bin")).agg(F.count("*").alias("c"))
    n = live.groupBy(*keys).agg(F.count("*").alias("n"))
    x = reference_bins.join(counted, [*keys, "bin"], "left").join(n, keys).withColumns({"c": F.coalesce("c", F.lit(0))})
    a = F.greatest(F.col("c") / F.col("n"), F.lit(EPSILON))
    e = F.greatest(F.col("p"), F.lit(EPSILON))
    term = (a - e) * F.log(a / e)
    smoothed = (F.col("c") == 0) | (F.col("p") <= EPSILON)
    out = x.groupBy(*keys).agg(F.max("n").alias("n_live"), F.max("n_reference").alias("n_reference"), F.sum(term).alias("psi"), F.count_if(smoothed).alias("bins_smoothed"), F.sum(F.when(smoothed, term).otherwise(0.0)).alias("smoothed"))
    return out.withColumn("driven_by_smoothing", (F.col("bins_smoothed") > 0) & (F.coalesce(F.try_divide(F.col("smoothed"), F.col("psi")), F.lit(0.0)) > 0.5)).drop("smoothed")


def state(value: Column, n: Column | None = None, least: int = 0) -> Column:
    known = F.when(F.isnan(value), "SIGNIFICANT").when(value < STABLE, "INSIDE").when(value < SIGNIFICANT, "MODERATE").otherwise("SIGNIFICANT")
    return known if n is None else F.when(n < least, "INSUFFICIENT_DATA").otherwise(known)


def ladder(status: Column, verdict: Column) -> Column:
    """The next status of a warrant; refused stays, an inside window restores, too little data changes nothing."""
    return F.when((status == "REFUSED") | (verdict == "INSUFFICIENT_DATA"), status).when(verdict == "INSIDE", "VALID").when(verdict == "MODERATE", "STALE").otherwise("REVOKED")


def sliding_psi(stream: DataFrame, key: str, lead: Column, order: list[str], categories: list[str], category: str, expected: dict[str, float], window: int) -> DataFrame:
    """PSI over the last ``window`` rows of each key, by one conditional sum for each category over one frame.

    A key's rows are cut into blocks that overlap by the frame, so that few keys are many tasks; ``order`` begins
    with ``lead``.
    """
    blocks, own = G.framed(stream, [key], lead, order, window)
    frame = Window.partitionBy(key, "_block").orderBy("_nth").rowsBetween(1 - window, 0)
    x = blocks.withColumn("n", F.count("*").over(frame))
    for i, c in enumerate(categories):
        x = x.withColumn(f"c{i}", F.count_if(F.col(category) == c).over(frame))
    total = F.lit(0.0)
    for i, c in enumerate(categories):
        a, e = F.greatest(F.col(f"c{i}") / F.col("n"), F.lit(EPSILON)), F.lit(max(expected[c], EPSILON))
        total = total + (a - e) * F.log(a / e)
    return x.withColumn("psi", total).where(own).drop(*(f"c{i}" for i in range(len(categories))), "_block", "_own", "_nth")


def bets(p0: float, n: int = 40, low: float = 0.01) -> list[float]:
    """Log-spaced stakes up to min(10, 0.9 / p0)."""
    high = min(10.0, 0.9 / p0)
    return [low * (high / low) ** (i / (n - 1)) for i in range(n)]


def expected_shares(reference: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """One row: for each feature (column ``bin_<name>``) the shares of its bins among observed values; null if none was."""
    share = lambda name, i: F.try_divide(F.count_if(F.col(f"bin_{name}") == i), F.count(f"bin_{name}"))
    seen = lambda name: F.count(f"bin_{name}") > 0
    return reference.agg(*(F.when(seen(name), F.array(*[share(name, i) for i in range(n)])).alias(f"expected_{name}") for name, n in sizes.items()))


def verdicts(stream: DataFrame, key: str, lead: Column, order: list[str], sizes: dict[str, int], expected: DataFrame, window: int) -> DataFrame:
    """The verdict of each row's window over several features: PSI of each, the worst state, its driver, and what wasn't observed.

    Features are columns ``bin_<name>`` of bin numbers, null where a row lacks one; a window is of rows, and a feature
    counts by the values that it has there. All features share one frame. The driver is the feature of the severest
    state, of those the one of the largest index, then the first named, and ``driven_by_smoothing`` tells whether bins that one
    side leaves empty make over half of its index. Below ``window`` rows, or with no feature observed, there is no
    verdict.
    """
    blocks, own = G.framed(stream, [key], lead, order, window)
    frame = Window.partitionBy(key, "_block").orderBy("_nth").rowsBetween(1 - window, 0)
    x = blocks.withColumns({c: a.over(frame) for c, a in _window_counts(sizes).items()})
    return _judged(x.where(own), sizes, expected, window).drop("_block", "_own", "_nth")


def last_verdicts(stream: DataFrame, key: str, order: list[str], sizes: dict[str, int], expected: DataFrame, window: int) -> DataFrame:
    """What ``verdicts`` says of each key's last row, from the last ``window`` rows alone: a row a key."""
    latest = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    last = stream.withColumn("_back", F.row_number().over(latest)).where(F.col("_back") <= window)
    return _judged(last.groupBy(key).agg(*(a.alias(c) for c, a in _window_counts(sizes).items())), sizes, expected, window)


def _window_counts(sizes: dict[str, int]) -> dict[str, Column]:
    """``n``, a window's rows, and those of each feature's bins."""
    return {"n": F.count("*")} | {f"_c_{name}_{i}": F.count_if(F.col(f"bin_{name}") == i) for name, n in sizes.items() for i in range(n)}


def _judged(windows: DataFrame, sizes: dict[str, int], expected: DataFrame, window: int) -> DataFrame:
    """The indexes, state, driver and unobserved features of windows with the columns of ``_window_counts``."""
    x = windows.crossJoin(F.broadcast(expected))
    full = F.col("n") >= window
    for name, n in sizes.items():
        counts = [F.col(f"_c_{name}_{i}") for i in range(n)]
        seen = sum(counts[1:], counts[0])
        term, empty = F.lit(0.0), F.lit(0.0)
        for i, c in enumerate(counts):
            share = F.get(f"expected_{name}", F.lit(i))
            a, e = F.greatest(c / seen, F.lit(EPSILON)), F.greatest(share, F.lit(EPSILON))
            term = term + (a - e) * F.log(a / e)
            empty = empty + F.when((c == 0) | (share <= EPSILON), (a - e) * F.log(a / e)).otherwise(0.0)
        known = full & (seen > 0) & F.col(f"expected_{name}").isNotNull()
        x = x.withColumns({f"psi_{name}": F.when(known, term), f"_empty_{name}": F.when(known, empty)})
    severity = lambda v: F.when(v < STABLE, 0).when(v < SIGNIFICANT, 1).otherwise(2)
    scored = F.array_compact(F.array(*[F.when(F.col(f"psi_{name}").isNotNull(), F.struct(severity(F.col(f"psi_{name}")).alias("s"), F.col(f"psi_{name}").alias("psi"), F.lit(-at).alias("o"), F.lit(name).alias("name"), (2 * F.col(f"_empty_{name}") > F.col(f"psi_{name}")).alias("smoothed"))) for at, name in enumerate(sizes)]))
    top = F.array_max(scored)
    states = F.array(F.lit("INSIDE"), F.lit("MODERATE"), F.lit("SIGNIFICANT"))
    lacking = F.array_compact(F.array(*[F.when(F.col(f"psi_{name}").isNull(), F.lit(name)) for name in sizes]))
    x = x.withColumns({"state": F.coalesce(F.get(states, top["s"]), F.lit("INSUFFICIENT_DATA")), "driver": top["name"], "driven_by_smoothing": F.coalesce(top["smoothed"], F.lit(False)), "unobserved": lacking})
    return x.drop(*(f"_empty_{name}" for name in sizes), *(f"expected_{name}" for name in sizes), *(f"_c_{name}_{i}" for name, n in sizes.items() for i in range(n)))


@dataclass(frozen=True)
class Grid:
    """The stakes of a betting process. Counts belong to the grid that they were bet on."""

    p0: float
    low: float = 0.01
    stakes: int = 40

    @property
    def high(self) -> float:
        return min(10.0, 0.9 / self.p0)

    def bets(self) -> list[float]:
        return bets(self.p0, self.stakes, self.low)

    def fields(self) -> dict[str, float]:
        return {"p0": self.p0, "low": self.low, "high": self.high, "stakes": self.stakes}

    def check(self, recorded: dict, of: str) -> None:
        """Refuses to resume counts whose recorded grid is missing or isn't this one."""
        missing = sorted(name for name in self.fields() if recorded.get(name) is None)
        if missing:
            raise ValueError(f"the state of {of} is missing the betting grid ({', '.join(missing)}); it can't be resumed")
        changed = sorted(name for name, value in self.fields().items() if recorded[name] != value)
        if changed:
            raise ValueError(f"the betting grid of {of} has changed ({', '.join(changed)}); its counts can't be resumed")

    def log_wealth(self, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of the mixture of all stakes after ``k`` of ``n``."""
        b = np.array(self.bets())
        logs = k[:, None] * np.log1p(b * (1 - self.p0)) + (n - k)[:, None] * np.log1p(-b * self.p0)
        most = logs.max(axis=1)
        return most + np.log(np.exp(logs - most[:, None]).mean(axis=1))


def _with_wealth(run: DataFrame, p0: float, stakes: list[float]) -> DataFrame:
    """Adds log_wealth, the mixture of all stakes, to running counts k and n."""
    logs = F.array(*[F.col("k") * math.log1p(b * (1 - p0)) + (F.col("n") - F.col("k")) * math.log1p(-b * p0) for b in stakes])
    run = run.withColumn("logs", logs).withColumn("most", F.array_max("logs"))
    mixed = F.col("most") + F.log(F.aggregate(F.transform("logs", lambda v: F.exp(v - F.col("most"))), F.lit(0.0), lambda a, v: a + v) / len(stakes))
    return run.withColumn("log_wealth", mixed).drop("logs", "most")


def wagers(stream: DataFrame, key: str, lead: Column, order: list[str], x: Column, grid: Grid) -> DataFrame:
    """The state to store of each key: the grid, counts, highest log wealth and where it stands."""
    last = e_process(stream, key, lead, order, x, grid.p0, grid.stakes, latch=False)
    return last.groupBy(key).agg(F.max("n").alias("n"), F.max("k").alias("k"), F.max("log_wealth").alias("most")).withColumns({name: F.lit(value) for name, value in grid.fields().items()})


def resumed(stream: DataFrame, key: str, lead: Column, order: list[str], x: Column, grid: Grid, state: DataFrame) -> DataFrame:
    """``e_process`` of the rows after ``state``: its counts are offsets, as wealth is a function of running counts.

    A state without its grid, or of another one, is refused by an error of the job.
    """
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in grid.fields()]))
    changed = F.array_compact(F.array(*[F.when(F.col(c) != v, F.lit(c)) for c, v in grid.fields().items()]))
    fault = F.when(F.size(missing) > 0, F.concat(F.lit("the state is missing the betting grid: "), F.concat_ws(", ", missing))).when(F.size(changed) > 0, F.concat(F.lit("the betting grid has changed: "), F.concat_ws(", ", changed)))
    checked = state.select(key, *(F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(F.col(c)).alias(f"{c}0") for c in ("n", "k", "most")))
    run = G.accumulated(G.ranged(stream, [key], lead), [key], order, {"k": x.cast("long"), "n": F.lit(1).cast("long")}).join(checked, key, "left")
    run = run.withColumns({c: F.col(c) + F.coalesce(F.col(f"{c}0").cast("long"), F.lit(0)) for c in ("n", "k")})
    latched = G.accumulated(_with_wealth(run, grid.p0, grid.bets()), [key], order, {"most": F.col("log_wealth")}, F.max)
    return latched.withColumn("revoked", F.greatest("most", F.coalesce("most0", F.lit(float("-inf")))) >= math.log(20)).drop("most", "n0", "k0", "most0", "_range")


def e_process(stream: DataFrame, key: str, lead: Column, order: list[str], x: Column, p0: float, n_bets: int = 40, latch: bool = True) -> DataFrame:
    """log wealth of the mixture of bets after each row; the wealth is linear in running counts for every stake.

    ``revoked`` is latched: it holds once wealth has ever reached 1/0.05 in the key. Counts and the latch run in
    ranges of ``lead``, with which ``order`` begins.
    """
    run = G.accumulated(G.ranged(stream, [key], lead), [key], order, {"k": x.cast("long"), "n": F.lit(1).cast("long")})
    run = _with_wealth(run, p0, bets(p0, n_bets))
    if not latch:
        return run.drop("_range")
    latched = G.accumulated(run, [key], order, {"most": F.col("log_wealth")}, F.max)
    return latched.withColumn("revoked", F.col("most") >= math.log(20)).drop("most", "_range")
