"""Pooling of token vectors under masks: mean, last token, and the largest of overlapping means; violations instead of divisions by nought.

Positions are rows (sequence, position, selected, vector), so a sequence is never one row, and pooling is aggregation
by sequence and component with partial sums. A sequence whose mask selects nothing, whose mask is missing somewhere,
whose positions have gaps or repeats, or whose vectors differ in length has no pooled vector: it is a violation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("mean_pool", "last_token", "max_rolling_means")
PROBLEMS = ("positions have gaps or repeats", "the mask does not cover every position", "vectors differ in length", "the mask selects no position")


def checked(positions: DataFrame, key: str) -> DataFrame:
    """Each sequence with its length, how many positions its mask selects, and the first problem, null if there is none."""
    by = positions.groupBy(key).agg(
        F.count("*").alias("length"), F.count_if(F.col("selected")).alias("selected"), F.count("selected").alias("masked"), F.min("pos").alias("first"), F.max("pos").alias("last"),
        F.count_distinct("pos").alias("distinct"), F.min(F.size("vec")).alias("narrow"), F.max(F.size("vec")).alias("wide"),
    )
    whole = (F.col("first") == 0) & (F.col("last") == F.col("length") - 1) & (F.col("distinct") == F.col("length"))
    problem = (
        F.when(~F.coalesce(whole, F.lit(False)), PROBLEMS[0])
        .when(F.col("masked") < F.col("length"), PROBLEMS[1])
        .when((F.col("narrow") != F.col("wide")) | (F.col("narrow") < 1), PROBLEMS[2])
        .when(F.col("selected") == 0, PROBLEMS[3])
    )
    return by.select(key, "length", "selected", problem.alias("problem"))


def violations(positions: DataFrame, key: str) -> DataFrame:
    return checked(positions, key).where("problem is not null")


def _starts(i: Column, n: Column, window: int, stride: int) -> Column:
    """The windows that selected position ``i`` of ``n`` lies in, by their first position; the last window ends with the sequence."""
    first, last = F.greatest(F.lit(0), F.floor((i - window) / stride) + 1), F.least(F.floor(i / stride), F.floor((n - window) / stride))
    regular = F.when(first <= last, F.transform(F.sequence(first, last), lambda s: s * stride)).otherwise(F.array().cast("array<bigint>"))
    trailing = F.when(((n - window) % stride != 0) & (i >= n - window), F.array(n - window)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n <= window, F.array(F.lit(0).cast("long"))).otherwise(F.concat(regular, trailing))


def pooled(positions: DataFrame, key: str, strategy: str, window: int = 4, stride: int = 2) -> DataFrame:
    """(key, dim, value) of every sequence without a violation."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known are {', '.join(STRATEGIES)}")
    if window < 1 or stride < 1 or stride > window:
        raise ValueError(f"a stride of {stride} over windows of {window} leaves positions in no window")
    sound = checked(positions, key).where("problem is null").select(key, F.col("selected").cast("long").alias("n"))
    kept = positions.where("selected").select(key, "pos", "vec").join(sound, key)
    if strategy == "last_token":
        return kept.groupBy(key).agg(F.max_by("vec", "pos").alias("vec")).select(key, F.posexplode("vec").alias("dim", "value"))
    if strategy == "mean_pool":
        return kept.select(key, F.posexplode("vec").alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("value"))
    nth = (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).cast("long")
    placed = kept.withColumn("i", nth).withColumn("start", F.explode(_starts(F.col("i"), F.col("n"), window, stride)))
    means = placed.select(key, "start", F.posexplode("vec").alias("dim", "x")).groupBy(key, "start", "dim").agg(F.avg("x").alias("mean"))
    return means.groupBy(key, "dim").agg(F.max("mean").alias("value"))
