"""Group splits by hash rank, their relationships and integrity, and deduplication that keeps a stated row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warrantlake.functions.rng import draw
from warrantlake.operators import ranges as G

SPLITS = ("train", "validation", "test")


def by_group(items: DataFrame, group: str, seed: str, fractions: tuple[float, float, float], strata: list[str] | None = None) -> DataFrame:
    """Whole groups into splits: by the rank of their hash, cut at rounded shares of their number (of a stratum)."""
    strata = strata or []
    groups = items.select(group, *strata).distinct().withColumn("h", draw(F.lit(seed), group))
    sizes = groups.groupBy(*strata).agg(F.count("*").alias("n"))
    placed = G.numbered(groups, strata, F.col("h"), ["h", group], "r")
    ranked = placed.join(sizes, strata) if strata else placed.crossJoin(F.broadcast(sizes))
    first, second = F.floor(F.col("n") * fractions[0] + 0.5), F.floor(F.col("n") * (fractions[0] + fractions[1]) + 0.5)
    split = F.when(F.col("r") <= first, SPLITS[0]).when(F.col("r") <= second, SPLITS[1]).otherwise(SPLITS[2])
    return items.join(ranked.select(group, *strata, split.alias("split")), [group, *strata])


def relationship(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: how the test sets of two splits lie to each other, and what leaks between splits."""
    x = old.select(key, F.col("split").alias("a")).join(new.select(key, F.col("split").alias("b")), key, "full")
    test = lambda c: F.coalesce(F.col(c) == "test", F.lit(False))
    train = lambda c: F.coalesce(F.col(c) == "train", F.lit(False))
    out = x.agg(
        F.count_if(test("a") & test("b")).alias("paired"),
        F.count_if(test("a") & ~test("b")).alias("only_old"),
        F.count_if(~test("a") & test("b")).alias("only_new"),
        F.count_if(train("a") & test("b")).alias("old_train_in_new_test"),
        F.count_if(test("a") & train("b")).alias("new_train_in_old_test"),
    )
    return out.withColumns({"is_promotion": F.col("only_old") == 0, "usable": F.col("paired") >= 200})


def broken_integrity(items: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found in more than one split; none, if the splits are disjoint."""
    return items.groupBy(*keys).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def first_of(items: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the smallest ``order`` of each key, and how many rows it stands for."""
    rest = [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r"), F.count("*").alias("copies")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest), "copies")
