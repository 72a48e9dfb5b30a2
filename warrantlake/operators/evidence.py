"""The metric block that a warrant carries, and the decision to issue or refuse one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warrantlake.functions import bounds as B
from warrantlake.operators import metrics as M
from warrantlake.operators import resample as R
from warrantlake.sources.shared import written

#: The bars of an issue.
MIN_AUROC_LOW, MIN_LIFT_LOW, CONTROLS = 0.55, 1.0, 5
#: An interval narrower than this has no width.
FLAT = 1e-12
RANKING, RATES = ("auroc", "recall", "precision"), ("fpr", "flag_rate")


def metric_block(items: DataFrame, keys: list[str], unit: str, threshold: float, reps: int, seed: str, level: float = 0.95) -> DataFrame:
    """keys, metric, kind, n, value, ci_low, ci_high: all that is measured of each key's items at a threshold.

    Intervals are percentiles of a bootstrap of units. Where that has no width, a rate takes the exact binomial
    interval instead. A key of one class has no ranking metrics; its false-positive rate is that of hard negatives,
    bounded on one side. With nothing flagged, precision is 0 with the interval [0, 1]. Confirmed errors are counted.
    Items, groups and the replicates' values are written once, as several parts read each.
    """
    items = written(items.select(*dict.fromkeys((*keys, unit, "label", "score"))), "items")
    counts = M.confusion(items, keys, threshold)
    groups = written(R.numbered_groups(items, keys, unit, threshold), "groups")
    sums = R.replicates(groups, keys, reps, seed, list(R.COUNTS))
    p, q = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    flagged = F.col("tp") + F.col("fp")
    counts = M.rates(counts).withColumns({"one_class": (p == 0) | (q == 0), "hard": p == 0}).join(M.auroc(items, keys), keys, "left")
    trials = {"recall": (F.col("tp"), p), "precision": (F.col("tp"), flagged), "fpr": (F.col("fp"), q), "flag_rate": (flagged, F.col("n"))}
    values = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), *(c.cast("long").alias(a) for a, c in zip(("k", "of"), trials.get(m, (F.lit(None), F.lit(None))), strict=True))) for m in (*RANKING, *RATES)]
    long = counts.select(*keys, "n", "one_class", "hard", F.explode(F.array(*values)).alias("m")).select(*keys, "n", "one_class", "hard", "m.*")
    long = long.where("value is not null and not (one_class and metric in ('auroc', 'recall', 'precision'))")
    drawn = sums.select(*keys, "rep", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("v")) for m, v in (("recall", R.recall()), ("precision", R.precision()), ("fpr", M.ratio(F.col("fp"), q)), ("flag_rate", R.flag_rate()))])).alias("m")).select(*keys, "rep", "m.*")
    drawn = drawn.unionByName(R.replicate_auroc(items, groups, keys, unit, reps, seed).withColumn("metric", F.lit("auroc")))
    drawn = written(drawn, "replicates")
    two = R.interval(drawn, [*keys, "metric"], F.col("v"), level)
    one = R.interval(drawn.where("metric = 'fpr'"), [*keys, "metric"], F.col("v"), level, one_sided=True).select(*keys, "metric", F.col("ci_high").alias("one_high"))
    exact = B.with_bounds(long, "k", "of", 1 - level)
    x = exact.join(two, [*keys, "metric"], "left").join(one, [*keys, "metric"], "left")
    flat = F.col("k").isNotNull() & F.coalesce(F.col("ci_high") - F.col("ci_low") < FLAT, F.lit(True))
    side = F.col("hard") & (F.col("metric") == "fpr")
    nothing = (F.col("metric") == "precision") & (F.col("of") == 0)
    low = F.when(nothing, 0.0).when(side, 0.0).when(flat, F.col("cp_low")).otherwise(F.col("ci_low"))
    high = F.when(nothing, 1.0).when(side, F.when(flat, F.col("cp_upper")).otherwise(F.col("one_high"))).when(flat, F.col("cp_high")).otherwise(F.col("ci_high"))
    name = F.when(side, "fpr_hard_negatives").otherwise(F.col("metric"))
    out = x.select(*keys, name.alias("metric"), F.lit("ESTIMATED").alias("kind"), "n", "value", F.least(low, "value").alias("ci_low"), F.greatest(high, "value").alias("ci_high"))
    none = F.lit(None).cast("double")
    errors = counts.select(*keys, F.lit("confirmed_errors").alias("metric"), F.lit("EXACT").alias("kind"), flagged.alias("n"), F.col("tp").cast("double").alias("value"), none.alias("ci_low"), none.alias("ci_high"))
    return out.unionByName(errors)


def wide(block: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: ``m``, a map from each metric's name to its value and bounds."""
    entry = F.struct("metric", F.struct("value", "ci_low", "ci_high", "n").alias("b"))
    return block.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))


def refusals(n_test: Column, failed: Column, reported: Column, least_n: int, min_recall: Column, max_fpr: Column) -> Column:
    """Why a warrant with the metrics of column ``m`` is refused: an array of criteria, empty if it is issued.

    ``failed``: an array of failed controls; ``min_recall`` and ``max_fpr``: what the profile declares, else null.
    """
    at = lambda name, field: F.col("m")[name][field]
    ranked, recall, rate, hard = F.col("m")["auroc"].isNotNull(), F.col("m")["recall"].isNotNull(), at("flag_rate", "value"), F.col("m")["fpr_hard_negatives"].isNotNull()
    has = lambda name: F.col("m")[name].isNotNull()
    low = lambda name: at(name, "ci_low")
    lift = F.try_divide(low("recall"), rate)
    return F.concat(
        F.transform(failed, lambda c: F.concat(F.lit("control:"), c)),
        F.array_compact(
            F.array(
                F.when(reported != CONTROLS, "control_suite"),
                F.when(n_test < least_n, "n_test"),
                F.when(~ranked & max_fpr.isNull(), "single_class_envelope"),
                F.when(ranked & F.coalesce(low("auroc") <= MIN_AUROC_LOW, F.lit(True)), "auroc_lower_ci"),
                F.when(recall & (rate > 0) & F.coalesce(lift <= MIN_LIFT_LOW, F.lit(True)), "lift_lower_ci"),
                F.when(min_recall.isNotNull() & ~recall, "recall_undefined"),
                F.when(min_recall.isNotNull() & recall & F.coalesce(low("recall") < min_recall, F.lit(True)), "recall_lower_ci"),
                F.when(max_fpr.isNotNull() & ~has("fpr_hard_negatives"), "fpr_hard_negatives"),
                F.when(max_fpr.isNotNull() & hard & (at("fpr_hard_negatives", "ci_high") > max_fpr), "fpr_hard_negatives_upper_ci"),
            )
        ),
    )
