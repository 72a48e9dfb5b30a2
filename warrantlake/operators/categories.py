"""What the labels of an evaluation set mean, and whether a detector may be measured against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What marks a stand-in for a set.
SUFFIXES = ("-synthetic", "-fixture")


def category_of(sets: DataFrame, declared: DataFrame) -> DataFrame:
    """eval_set_id, category and whether one is declared, for distinct ids; ``declared``: eval_set_id, category.

    A set's own entry comes first; else that of the id without its suffixes. A null category is declared: a set of
    one class, which any detector may be measured on.
    """
    tried = [F.col("eval_set_id")]
    for suffix in SUFFIXES:
        tried.append(F.regexp_replace(tried[-1], f"{suffix}$", ""))
    x = sets.select("eval_set_id").distinct().select("eval_set_id", F.posexplode(F.array(*tried)).alias("at", "_key"))
    known = declared.select(F.col("eval_set_id").alias("_key"), "category", F.lit(True).alias("_known"))
    found = x.join(known, "_key", "left").groupBy("eval_set_id").agg(F.min(F.when(F.col("_known"), F.struct("at", "category"))).alias("f"))
    return found.select("eval_set_id", "f.category", F.col("f").isNotNull().alias("declared"))


def compatible(pairs: DataFrame, declared: DataFrame) -> DataFrame:
    """``pairs`` (detector_category, eval_set_id, ...) with ``category`` and ``outcome``: compatible, undeclared or mismatch."""
    x = pairs.join(category_of(pairs, declared), "eval_set_id", "left")
    outcome = F.when(~F.coalesce("declared", F.lit(False)), "undeclared").when(F.col("detector_category") != F.col("category"), "mismatch").otherwise("compatible")
    return x.withColumn("outcome", outcome).drop("declared")
