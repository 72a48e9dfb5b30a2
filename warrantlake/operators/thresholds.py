"""Rules that choose a threshold, and the arithmetic of lift, feasibility and review volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warrantlake.operators.metrics import confusion_at_every_score, rates, ratio, running, totals
from warrantlake.operators.ranges import quantiles

Z95 = 1.959963984540054


def within_budget(items: DataFrame, keys: list[str], budget: float) -> DataFrame:
    """The smallest score whose flag rate stays within the budget; null where the top tie alone exceeds it."""
    return within_budgets(items, keys, [budget]).drop("budget")


def within_budgets(items: DataFrame, keys: list[str], budgets: list[float]) -> DataFrame:
    """keys, budget, threshold: ``within_budget`` of each budget, all from one pass over the scores."""
    flags = rates(confusion_at_every_score(items, keys))
    found = flags.groupBy(*keys).agg(*(F.min(F.when(F.col("flag_rate") <= b, F.col("threshold"))).alias(f"_{i}") for i, b in enumerate(budgets)))
    return found.select(*keys, F.inline(F.array(*(F.struct(F.lit(b).alias("budget"), F.col(f"_{i}").alias("threshold")) for i, b in enumerate(budgets)))))


def probe_score(thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, probe_score, problem: a score between the two highest thresholds of a key's profiles (keys, threshold).

    It tells the most conservative profile from all others. Fewer than two thresholds, or two equal highest ones,
    give no score: no input could tell those profiles apart.
    """
    top = thresholds.groupBy(*keys, "threshold").agg(F.count("threshold").alias("c"))
    placed = top.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("threshold")))).where("r <= 2")
    at = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    x = placed.groupBy(*keys).agg(F.sum("c").alias("n"), at(1, "c").alias("ties"), at(1, "threshold").alias("first"), at(2, "threshold").alias("second"))
    problem = F.when(F.col("n") < 2, "fewer than two thresholds").when(F.col("ties") > 1, "the two highest thresholds are equal")
    return x.withColumn("problem", problem).select(*keys, F.when(F.col("problem").isNull(), (F.col("first") + F.col("second")) / 2).alias("probe_score"), "problem")


def kth_largest(items: DataFrame, keys: list[str], budget: float) -> DataFrame:
    """The k-th largest score, k = max(1, round-half-even(budget * n)); ties may exceed the budget."""
    grain = items.groupBy(*keys, "score").agg(F.count("*").alias("c"))
    counted = totals(running(grain, keys, {"upto": "c"}, descending=True), keys, {"n": "c"})
    k = F.greatest(F.lit(1), F.bround(F.lit(budget) * F.col("n"), 0).cast("long"))
    return counted.where(F.col("upto") >= k).groupBy(*keys).agg(F.max("score").alias("threshold"))


def quantile(items: DataFrame, keys: list[str], budget: float) -> DataFrame:
    return quantiles(items, keys, "score", {"threshold": 1 - budget})


def least_weighted_error(items: DataFrame, keys: list[str], w_fpr: float, w_fnr: float) -> DataFrame:
    """The threshold of the least weighted error over all distinct scores; of equal ones the lowest."""
    r = rates(confusion_at_every_score(items, keys)).withColumn("objective", F.round((w_fpr * F.col("fpr") + w_fnr * (1 - F.col("recall"))) / (w_fpr + w_fnr), 9))
    return r.where("objective is not null").groupBy(*keys).agg(F.min(F.struct("objective", "threshold")).alias("b")).select(*keys, "b.objective", "b.threshold")


def lift(recall: Column, flag_rate: Column) -> Column:
    return ratio(recall, flag_rate)


def lift_ceiling(base_rate: Column, flag_rate: Column) -> Column:
    return ratio(F.lit(1.0), F.greatest(base_rate, flag_rate))


def abstention_floor(error_rate: Column, risk: Column) -> Column:
    """The least share to abstain from for the rest to have that risk; null for a risk of one."""
    return F.when(risk < 1, F.greatest(F.lit(0.0), (error_rate - risk) / (1 - risk)))


def achieved_risk(error_rate: Column, recall: Column, flag_rate: Column) -> Column:
    return F.try_divide(error_rate * (1 - recall), 1 - flag_rate)


def review_volume(r: DataFrame, monthly: int) -> DataFrame:
    """Monthly flagged, correctly and wrongly flagged, and missed."""
    tp = F.col("base_rate") * F.col("recall") * monthly
    return r.withColumns({"flagged": F.col("flag_rate") * monthly, "true_flags": tp, "false_flags": F.greatest(F.lit(0.0), F.col("flag_rate") * monthly - tp), "missed": F.greatest(F.lit(0.0), F.col("base_rate") * monthly - tp)})


def sample_size(recall: Column, margin: float, design_effect: float) -> Column:
    return F.ceil(F.lit(Z95 * Z95) * recall * (1 - recall) / (margin * margin) * design_effect)
