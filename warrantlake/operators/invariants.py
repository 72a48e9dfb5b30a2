"""Record invariants as predicates: each is true for a row that breaks its rule, so a clean table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(name: str) -> Column:
    return F.col(name)


def metric() -> Column:
    """EXACT carries no interval; ESTIMATED carries a finite one around its value; blended names are refused."""
    missing = _c("ci_low").isNull() | _c("ci_high").isNull()
    exact = (_c("kind") == "EXACT") & (_c("ci_low").isNotNull() | _c("ci_high").isNotNull())
    estimated = (_c("kind") == "ESTIMATED") & (missing | F.isnan("ci_low") | F.isnan("ci_high") | (_c("ci_low") > _c("value")) | (_c("value") > _c("ci_high")) | (_c("n") <= 0))
    return F.coalesce(exact | estimated | F.lower("name").rlike("^f(1|beta|_score)"), F.lit(True))


def ranking_partly_present(names: list[str]) -> Column:
    present = sum((_c(n).isNotNull().cast("int") for n in names[1:]), _c(names[0]).isNotNull().cast("int"))
    return (present > 0) & (present < len(names))


def warrant() -> Column:
    """A failed control refuses; other than VALID needs a reason; expiry after issue; UNVALIDATED is no record."""
    failed = F.exists("controls", lambda x: ~x["passed"] & x["applicable"])
    return (failed & (_c("status") != "REFUSED")) | ((_c("status") != "VALID") & (F.coalesce("reason", F.lit("")) == "")) | (_c("expires_at") <= _c("issued_at")) | (_c("status") == "UNVALIDATED")


def control() -> Column:
    """A margin's sign agrees with the verdict; what isn't applicable has passed with margin zero."""
    return F.when(_c("applicable"), (_c("margin") >= 0) != _c("passed")).otherwise(~_c("passed") | (_c("margin") != 0))


def certificate() -> Column:
    return F.size(F.array_except("triggering", "findings")) > 0


def resolution() -> Column:
    return (_c("action") != "ALLOW") & ((F.size("triggering") == 0) | (F.coalesce("rationale", F.lit("")) == ""))


def override() -> Column:
    p = _c("selection_probability")
    return ~_c("stratum").isin("boundary", "random") | p.isNull() | (p <= 0) | (p > 1) | ((_c("ruling") == "UPHELD") != (_c("direction") == "none")) | ~_c("score").between(0, 1)


def envelope() -> Column:
    """Edges strictly increasing, one more than probabilities, which sum to one."""
    flat = F.exists(F.zip_with(F.slice("edges", F.lit(1), F.size("edges") - 1), F.slice("edges", F.lit(2), F.size("edges") - 1), lambda a, b: b <= a), lambda x: x)
    return flat | (F.size("probabilities") != F.size("edges") - 1) | (F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-6)


def match_result() -> Column:
    return (_c("max_psi") != F.array_max(F.map_values("psi"))) | F.coalesce(~F.array_contains(F.map_keys("psi"), _c("driver")), F.lit(True))


def operating_point() -> Column:
    return ~F.coalesce(_c("selected_on").isin("validation", "train", "calibration"), F.lit(False))


def finding() -> Column:
    return ~_c("confidence").between(0, 1) | (F.size("spans") < 1) | F.exists("spans", lambda s: (s["start"] < 0) | (s["end"] < s["start"]))


def item() -> Column:
    return ~F.coalesce(_c("label").isin(0, 1), F.lit(False)) | ~F.coalesce(_c("split").isin("train", "validation", "test"), F.lit(True))


def parallel_arrays(names: list[str]) -> Column:
    return (F.size(names[0]) < 1) | sum(((F.size(n) != F.size(names[0])).cast("int") for n in names[1:]), F.lit(0)).cast("int").__gt__(0)


def not_finite(vector: str) -> Column:
    return (F.size(vector) == 0) | F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def one_class(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups without both labels, or with others."""
    x = rows.groupBy(*keys).agg(F.count_if(_c("label") == 1).alias("pos"), F.count_if(_c("label") == 0).alias("neg"), F.count("*").alias("n"))
    return x.where("pos = 0 or neg = 0 or pos + neg <> n")
