"""The warrant matrix, routing over it, and the policy decisions that read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warrantlake.operators.metrics import ratio

STATUSES = ("REFUSED", "REVOKED", "UNVALIDATED", "STALE", "VALID")
ACTIONS = ("ALLOW", "REDACT", "CONFIRM", "ESCALATE", "BLOCK")
Z95 = 1.959963984540054


def wilson(k: Column, n: Column, sign: float) -> Column:
    """A bound of the score interval of k of n."""
    p, z2 = ratio(k, n), Z95 * Z95
    return (p + z2 / (2 * n) + sign * Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def issue(facts: DataFrame, *, least_n: int, min_recall: float, max_fpr: float) -> DataFrame:
    """Recall and FPR with intervals, all reasons to refuse, and VALID only where there is none."""
    x = facts.withColumns({"recall": ratio(F.col("hits"), F.col("n")), "recall_low": wilson(F.col("hits"), F.col("n"), -1), "recall_high": wilson(F.col("hits"), F.col("n"), 1), "fpr_high": wilson(F.col("false_flags"), F.col("n"), 1)})
    reasons = F.array_compact(F.array(F.when(F.col("n") < least_n, "too few items"), F.when(F.col("recall_low") < min_recall, "recall bound below minimum"), F.when(F.col("fpr_high") > max_fpr, "false-positive bound above ceiling")))
    return x.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "VALID").otherwise("REFUSED"))


def cell_status(warrants: DataFrame, now: str, days: int) -> DataFrame:
    """VALID past its expiry reads STALE."""
    late = F.lit(now).cast("timestamp") >= F.col("issued_at").cast("timestamp") + F.make_dt_interval(F.lit(days))
    return warrants.withColumn("status", F.when((F.col("status") == "VALID") & late, "STALE").otherwise(F.col("status")))


def full_matrix(cells: DataFrame, detectors: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Every detector on every envelope; what was never measured is UNVALIDATED. The axes are small dimensions."""
    axes = detectors.select("detector_id").distinct().crossJoin(envelopes.select("envelope_id").distinct())
    return axes.join(cells, ["detector_id", "envelope_id"], "left").withColumn("status", F.coalesce("status", F.lit("UNVALIDATED")))


def first_operating_point(cells: DataFrame) -> DataFrame:
    """One cell per detector and envelope: that of the detector's first populated operating point."""
    first = cells.groupBy("detector_id").agg(F.min("operating_point_id").alias("operating_point_id"))
    return cells.join(first, ["detector_id", "operating_point_id"], "left_semi")


def rank(options: tuple[str, ...], value: Column) -> Column:
    return F.array_position(F.array(*[F.lit(o) for o in options]), value)


def accepts(min_recall: float, max_fpr: float) -> tuple[Column, Column]:
    """(accepted, reason), judged by the bounds and not by the points."""
    reason = F.when(F.col("recall_low").isNull(), "recall not measured").when(F.col("recall_low") < min_recall, "recall bound too low").when(F.col("fpr_high") > max_fpr, "false-positive bound too high")
    return reason.isNull(), F.coalesce(reason, F.lit("accepted"))


def route(cells: DataFrame, min_recall: float, max_fpr: float) -> DataFrame:
    """The best eligible warrant of each envelope, or the conservative default; and what was considered."""
    ok, _ = accepts(min_recall, max_fpr)
    eligible = (F.col("status") == "VALID") & ok
    order = F.struct((-F.col("recall_low")).alias("a"), (F.col("recall_high") - F.col("recall_low")).alias("b"), F.col("detector_id").alias("d"), F.col("operating_point_id").alias("o"))
    best = cells.groupBy("envelope_id").agg(F.count("*").alias("considered"), F.min(F.when(eligible, order)).alias("best"))
    return best.select("envelope_id", "considered", F.coalesce("best.d", F.lit("conservative-default")).alias("detector_id"), F.col("best.o").alias("operating_point_id"))


def compose(verdicts: DataFrame, key: str, default: str) -> DataFrame:
    """One action for a request from all its detectors' verdicts (status, fired, action)."""
    valid, fired = F.col("status") == "VALID", F.col("fired")
    r = rank(ACTIONS, F.col("action"))
    x = verdicts.groupBy(key).agg(F.count_if(valid).alias("valid"), F.count_if(valid & fired).alias("valid_fired"), F.count_if(~valid & fired).alias("other_fired"), F.max(F.when(valid & fired, r)).alias("top"))
    default_rank = ACTIONS.index(default) + 1
    action = F.when(F.col("valid") == 0, default_rank).when(F.col("other_fired") > 0, F.greatest(F.coalesce("top", F.lit(1)), F.lit(default_rank))).when(F.col("valid_fired") == 0, 1).otherwise(F.col("top"))
    return x.select(key, "valid", "valid_fired", "other_fired", F.get(F.array(*[F.lit(a) for a in ACTIONS]), action.cast("int") - 1).alias("action"))


def decide(requests: DataFrame, rules: list[tuple[int, Column, str]], key: list[str]) -> DataFrame:
    """The action of the highest-priority rule that holds; ALLOW where none does."""
    held = F.array_compact(F.array(*[F.when(condition, F.struct(F.lit(priority).alias("priority"), F.lit(action).alias("action"))) for priority, condition, action in rules]))
    return requests.select(*key, F.coalesce(F.array_max(held)["action"], F.lit("ALLOW")).alias("action"), F.size(held).cast("long").alias("rules_held"))
