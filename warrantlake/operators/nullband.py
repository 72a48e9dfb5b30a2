"""What an index does when nothing has changed: simulated nulls, guards that refuse a noisy setting, and power.

Draws come from hashes, so they don't depend on partitioning and SQL can repeat them. A sample of a distribution is
its inverse distribution function at uniform draws (the normal by Box and Muller).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.functions.rng import uniform
from warrantlake.operators.drift import EPSILON
from warrantlake.operators.resample import RUN, TASKS
from warrantlake.sources.shared import written

SHAPES = ("normal", "logistic", "beta2_2")
LEAST = 4


def met_bins(upto: dict[int, list[float]], sizes: dict[int, int], side: str, repeats: int, spark: SparkSession) -> DataFrame:
    """(key, rep, bin, c): where ``sizes[key]`` uniform draws fall among the cumulative shares ``upto[key]``.

    A draw depends on side, repeat and number alone, so it is made once for all keys: it is placed among the cuts of all
    of them and among their sizes, and counted by both places. What leaves the tasks doesn't grow with the draws.
    """
    cuts = sorted({c for key in upto for c in upto[key][:-1]})
    ends = sorted({n for n in sizes.values() if n > 0})
    if not ends:
        return spark.createDataFrame([], "key int, rep int, bin int, c long")
    runs = spark.range(repeats * -(-ends[-1] // RUN)).repartition(TASKS).select((F.col("id") % repeats).cast("int").alias("rep"), F.expr(f"id div {repeats}").alias("_run"))
    each = runs.withColumn("i", F.explode(F.sequence(F.col("_run") * RUN, F.least(F.lit(ends[-1]), (F.col("_run") + 1) * RUN) - 1))).withColumn("u", uniform(F.lit(side), "rep", "i"))
    counted = each.groupBy("rep", _place(F.col("u"), cuts).alias("_cut"), _place(F.col("i"), ends).alias("_end")).agg(F.count("*").alias("c"))
    rows = [(key, cut, end, min(sum(c <= cuts[cut - 1] for c in upto[key]) if cut else 0, len(upto[key]) - 1)) for key in upto for cut in range(len(cuts) + 1) for end in range(len(ends)) if sizes[key] >= ends[end]]
    told = spark.createDataFrame(rows, "key int, _cut int, _end int, bin int")
    return counted.join(F.broadcast(told), ["_cut", "_end"]).groupBy("key", "rep", "bin").agg(F.sum("c").alias("c"))


def _place(value: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``, by halving."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(cuts[middle]), within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(cuts))


def index_values(known: list[tuple[list[float], int, int]], repeats: int, spark: SparkSession, sides: tuple[str, str] = ("live", "ref")) -> DataFrame:
    """(key, rep, v): PSI of each repeat between ``n`` live and ``n_reference`` reference draws, by the place in ``known``.

    ``known``: cumulative shares, n and n_reference.
    """
    upto = {k: x[0] for k, x in enumerate(known)}
    parts = []
    for at, side in enumerate(sides):
        sizes = {k: x[1 + at] for k, x in enumerate(known)}
        table = spark.createDataFrame([(k, n) for k, n in sizes.items()], "key int, n long")
        parts.append(met_bins(upto, sizes, side, repeats, spark).join(F.broadcast(table), "key").select("key", "rep", "bin", (F.col("c") / F.col("n")).alias(side)))
    # A bin that neither side met adds nothing: both are the same floor.
    safe = lambda k: F.greatest(F.coalesce(k, F.lit(0.0)), F.lit(EPSILON))
    a, b = (safe(side) for side in sides)
    return parts[0].join(parts[1], ["key", "rep", "bin"], "full").groupBy("key", "rep").agg(F.sum((a - b) * F.log(a / b)).alias("v"))


def null_psi(settings: DataFrame, keys: list[str], repeats: int = 400) -> DataFrame:
    """p50, p95, p99 and ``false_alarm_rate`` of PSI between samples of one distribution, for each setting.

    ``settings``: keys, ``probabilities``, sizes ``n`` (live) and ``n_reference``, and the ``stable`` band. Both sides
    are drawn, as the reference's own error is part of the null. Distinct distributions and sizes, which are few, pass
    through the driver.
    """
    share = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p)
    upto = F.transform(F.sequence(F.lit(1), F.size("probabilities")), lambda i: F.aggregate(F.slice("probabilities", F.lit(1), i), F.lit(0.0), lambda a, p: a + p) / share)
    known = written(settings.select(*keys, upto.alias("upto"), F.col("n").cast("long").alias("_n"), F.col("n_reference").cast("long").alias("_ref"), F.col("stable").alias("_stable")), "settings")
    on = ["upto", "_n", "_ref"]
    spark = settings.sparkSession
    distinct = [(list(r["upto"]), r["_n"], r["_ref"]) for r in known.select(*on).distinct().collect()]
    named = spark.createDataFrame([(k, *x) for k, x in enumerate(distinct)], "key int, upto array<double>, _n long, _ref long")
    told = known.join(named, on).join(index_values(distinct, repeats, spark), "key")
    return told.groupBy(*keys).agg(*(F.percentile("v", F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)), F.avg((F.col("v") > F.col("_stable")).cast("double")).alias("false_alarm_rate"))


def guarded(settings: DataFrame, keys: list[str], most: float = 0.05, repeats: int = 400) -> DataFrame:
    """Each setting with its null, and whether it is accepted: its own false-alarm rate is no more than ``most``."""
    return null_psi(settings, keys, repeats).withColumn("accepted", F.col("false_alarm_rate") <= most)


def refuse_noisy(settings: DataFrame, keys: list[str], most: float = 0.05, repeats: int = 400) -> None:
    """Raises where a setting would report a shift too often on traffic that hasn't moved."""
    bad = guarded(settings, keys, most, repeats).where("not accepted").orderBy(*keys).limit(5).collect()
    if bad:
        told = "; ".join(f"{'|'.join(str(r[k]) for k in keys)}: {100 * r['false_alarm_rate']:.1f} % (p95 {r['p95']:.4f})" for r in bad)
        raise ValueError(f"false alarms on unmoved traffic above {100 * most:.1f} %: {told}; widen the window, use fewer bins, or raise the band")


def shaped(shape: Column, one: Column, two: Column) -> Column:
    """A draw of the named shape from two uniform draws, of which all but the normal use the first."""
    u, v = F.greatest(one, F.lit(2.0**-60)), two
    normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    beta = 0.5 + F.cos((F.acos(1 - 2 * u) + 4 * math.pi) / 3)
    return F.when(shape == "normal", normal).when(shape == "logistic", F.log(u / (1 - u))).when(shape == "beta2_2", beta).otherwise(F.raise_error(F.concat(F.lit("unknown shape "), shape)))


def _spreads(cells: DataFrame, keys: list[str], size: str, side: str, repeats: int) -> DataFrame:
    """(keys, rep, iqr) of samples of ``size`` draws, a sample in the task that its key and repeat are dealt to."""
    reps = cells.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_size", F.col(size).cast("long")).repartition(4 * TASKS, *keys, "rep")
    runs = reps.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_size - 1) div {RUN}"))))
    each = runs.withColumn("i", F.explode(F.sequence(F.col("_run") * RUN, F.least(F.col("_size"), (F.col("_run") + 1) * RUN) - 1)))
    x = each.select(*keys, "rep", shaped(F.col("shape"), uniform(F.lit(side), "rep", "i"), uniform(F.lit(f"{side}2"), "rep", "i")).alias("x"))
    return x.groupBy(*keys, "rep").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("_q")).select(*keys, "rep", (F.col("_q")[1] - F.col("_q")[0]).alias("iqr"))


def iqr_ratios(sizes: DataFrame, shapes: tuple[str, ...] = SHAPES, repeats: int = 1000) -> DataFrame:
    """(shape, n, n_reference, rep, ratio): interquartile range of a pilot over that of a reference, both of one shape.

    ``sizes``: pilots' ``n`` and one ``n_reference``; a pilot of fewer than four items has no such range and is refused.
    """
    if sizes.where((F.col("n") < LEAST) | (F.col("n_reference") < LEAST)).limit(1).count():
        raise ValueError(f"an interquartile range needs {LEAST} items at least")
    cells = sizes.withColumn("shape", F.explode(F.array(*[F.lit(s) for s in shapes])))
    pilots = _spreads(cells, ["shape", "n", "n_reference"], "n", "pilot", repeats)
    whole = _spreads(cells.select("shape", "n_reference").distinct(), ["shape", "n_reference"], "n_reference", "reference", repeats).withColumnRenamed("iqr", "whole")
    return pilots.join(whole, ["shape", "n_reference", "rep"]).select("shape", "n", "n_reference", "rep", (F.col("iqr") / F.col("whole")).alias("ratio"))


def power_grid(sizes: DataFrame, collapses: list[float], threshold: float, shapes: tuple[str, ...] = SHAPES, repeats: int = 1000) -> DataFrame:
    """By shape, n and collapse: the null band, false alarms, and power at the frozen and at the recalibrated threshold.

    A pilot whose spread has collapsed to a share of the reference's has that share of the ratio; the recalibrated
    threshold is the null's own 5th percentile at that n.
    """
    ratios = iqr_ratios(sizes, shapes, repeats)
    keys = ["shape", "n", "n_reference"]
    band = ratios.groupBy(*keys).agg(*(F.percentile("ratio", F.lit(p)).alias(name) for name, p in (("p2_5", 0.025), ("p5", 0.05), ("p50", 0.5), ("p95", 0.95), ("p97_5", 0.975))), F.avg((F.col("ratio") < threshold).cast("double")).alias("false_alarm_rate"))
    collapse = F.explode(F.array(*[F.lit(c) for c in collapses])).alias("collapse")
    fired = ratios.select("*", collapse).join(band.select(*keys, "p5"), keys)
    below = lambda t: F.avg((F.col("ratio") * F.col("collapse") < t).cast("double"))
    power = fired.groupBy(*keys, "collapse").agg(below(F.lit(threshold)).alias("power_frozen"), below(F.col("p5")).alias("power_recalibrated"))
    return power.join(band, keys)
