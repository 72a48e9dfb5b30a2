"""Loading policy bundles: every requirement against the warrant matrix, all failures listed, a bundle loads whole or not.

A requirement names a warrant (detector, operating point, envelope) and what it has to hold: a largest age, a floor of
recall, a ceiling of false positives, a sensitivity, and what a drifted calibration means. Bounds are compared, not
points. A requirement that isn't met by a VALID warrant has no further checks; all others are checked in full. The
matrix may be any size: requirements are joined with it by their three-part key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["detector_id", "operating_point_id", "envelope_id"]
REFUSE, WIDEN, IGNORE = "REFUSE", "WIDEN_BUDGET", "IGNORE"
#: From the weakest on.
WEAKEST = ("REFUSED", "REVOKED", "UNVALIDATED", "STALE", "VALID")


def n_to_detect(target: Column, sensitivity: Column, z: float = 1.96) -> Column:
    """Items needed to tell a flag rate that is off by the share ``sensitivity`` from ``target``."""
    off = target * (1 + sensitivity)
    return F.greatest(F.lit(1), F.ceil(F.lit(z * z) * off * (1 - off) / ((off - target) * (off - target)))).cast("long")


def calibration(warrants: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Adds ``calibration`` and ``resolved``: whether the target lies in the realised interval, and the interval in the band.

    Without a target or an interval it is UNKNOWN, which isn't a pass.
    """
    t, low, high = F.col("target_flag_rate"), F.col("flag_low"), F.col("flag_high")
    known = t.isNotNull() & low.isNotNull() & high.isNotNull()
    state = F.when(known & t.between(low, high), "CALIBRATED").when(known, "DRIFTED").otherwise("UNKNOWN")
    return warrants.withColumns({"calibration": state, "resolved": known & (t * (1 - tolerance) <= low) & (high <= t * (1 + tolerance))})


def _presence() -> Column:
    return F.when(F.col("status").isNull(), "UNVALIDATED: no warrant was ever filed").when(F.col("status") == "REFUSED", "REFUSED: measured and failed its controls").when(F.col("status") != "VALID", F.concat("status", F.lit(": not to be relied on")))


def _failures(now: Column) -> Column:
    """All that is wrong with a requirement, in the order of the checks."""
    key, age = F.concat_ws("|", *KEY), F.timestamp_diff("SECOND", F.col("issued_at"), now)
    aged = F.when(age > F.col("max_age_days") * 86_400, "older than the profile allows").when(now >= F.col("expires_at"), "expired")
    recall = F.when(F.col("recall").isNull(), "no recall claim on this envelope").when(F.coalesce("recall_low", "recall") < F.col("min_recall"), "recall bound below the floor")
    fpr = F.when(F.col("max_fpr").isNotNull(), F.when(F.col("fpr").isNull(), "ceiling declared, false positives unmeasured").when(F.coalesce("fpr_high", "fpr") > F.col("max_fpr"), "false-positive bound above the ceiling"))
    power = F.when(n_to_detect(F.col("target_flag_rate"), F.col("sensitivity")) > F.col("n"), "too few items for the declared sensitivity")
    drifted = F.when((F.col("calibration") == "DRIFTED") & (F.col("on_drift") == REFUSE), "calibration has drifted")
    found = F.when(F.col("absent").isNotNull(), F.array("absent")).otherwise(F.array_compact(F.array(aged, recall, fpr, power, drifted)))
    return F.transform(found, lambda f: F.concat(key, F.lit(": "), f))


def _notes() -> Column:
    key, declared = F.concat_ws("|", *KEY), F.col("max_fpr").isNotNull()
    verdict = (
        F.when(F.col("calibration") == "UNKNOWN", "the budget is untested here")
        .when((F.col("calibration") == "DRIFTED") & (F.col("on_drift") == WIDEN), "drifted: the measured interval is quoted for the budget")
        .when(F.col("calibration") == "DRIFTED", "drifted: considered and ignored")
        .when(~F.col("resolved"), "calibrated, but the interval leaves the band: unresolved")
    )
    return F.transform(F.array_compact(F.array(F.when(~declared, "no false-positive ceiling is declared"), verdict)), lambda n: F.concat(key, F.lit(": "), n))


def checked(requirements: DataFrame, warrants: DataFrame, now: Column) -> DataFrame:
    """Each requirement (bundle, number, key, terms) with its warrant, ``failures``, ``notes`` and the budget it may claim.

    A drifted budget that the profile widens is the measured interval; else it is the declared target. Requirements
    that fail have neither notes nor budget.
    """
    x = requirements.join(calibration(warrants), KEY, "left").withColumn("absent", _presence()).withColumn("failures", _failures(now))
    met, widened = F.size("failures") == 0, (F.col("calibration") == "DRIFTED") & (F.col("on_drift") == WIDEN)
    claim = {
        "budget": F.when(met, F.when(widened, F.col("flag_rate")).otherwise(F.col("target_flag_rate"))),
        "budget_low": F.when(met & widened, F.col("flag_low")),
        "budget_high": F.when(met & widened, F.col("flag_high")),
        "budget_is": F.when(met, F.when(widened, "measured").when(F.col("target_flag_rate").isNotNull(), "declared")),
    }
    return x.withColumns({**claim, "notes": F.when(met, _notes()).otherwise(F.array().cast("array<string>"))}).drop("absent")


def bundles(requirements: DataFrame) -> DataFrame:
    """Each bundle of ``checked``: whether it loads, all its failures and its notes, in the order of its requirements."""
    listed = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("number", c))), lambda r: r[c]))
    out = requirements.groupBy("bundle").agg(F.count("*").alias("required"), F.count_if(F.size("failures") > 0).alias("unmet"), listed("failures").alias("failures"), listed("notes").alias("notes"))
    loads = F.col("unmet") == 0
    return out.withColumns({"loads": loads, "notes": F.when(loads, F.col("notes"))})


def facts(requirements: DataFrame) -> DataFrame:
    """What rules may know of each bundle that loads: the weakest status of all its warrants, and its first requirement."""
    rank = F.array_position(F.array(*[F.lit(s) for s in WEAKEST]), F.coalesce("status", F.lit("UNVALIDATED")))
    told = F.struct(*KEY, "n", "recall", "recall_low", "threshold", "target_flag_rate", "budget", "budget_is")
    by = requirements.groupBy("bundle").agg(F.count_if(F.size("failures") > 0).alias("unmet"), F.min(rank).alias("weakest"), F.min_by(told, "number").alias("primary"))
    weakest = F.get(F.array(*[F.lit(s) for s in WEAKEST]), F.col("weakest").cast("int") - 1)
    return by.where("unmet = 0").select("bundle", weakest.alias("weakest_status"), "primary.*")


def decided(requests: DataFrame, known: DataFrame, action: Column) -> DataFrame:
    """One action a request and bundle: the bundle's on a score at its primary threshold, ESCALATE without a valid warrant.

    ``known`` are the facts of the few bundles that judge the same requests.
    """
    x = requests.crossJoin(F.broadcast(known))
    flagged = F.col("score") >= F.col("threshold")
    return x.withColumns({"flagged": flagged, "action": F.when(F.col("weakest_status") != "VALID", "ESCALATE").when(flagged, action).otherwise("ALLOW")})
