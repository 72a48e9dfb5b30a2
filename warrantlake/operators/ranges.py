"""Numbering, running values and sliding frames for few keys of many rows.

A window by such a key would be one task. Here a key's rows are cut into ranges at approximate percentiles of a
leading value; windows run within a range, and each range starts from the exact totals of those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 32


def ranged(rows: DataFrame, keys: list[str], lead: Column, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``_range``, which rises with ``lead``; equal values share one."""
    known = rows.withColumn("_lead", lead)
    cuts = known.groupBy(*keys).agg(F.percentile_approx("_lead", [i / buckets for i in range(1, buckets)], 1000).alias("_cuts"))
    joined = known.join(cuts, keys) if keys else known.crossJoin(F.broadcast(cuts))
    return joined.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_lead")))).drop("_cuts", "_lead")


def accumulated(cut: DataFrame, keys: list[str], order: list[Column | str], values: dict[str, Column], fold=F.sum) -> DataFrame:
    """Running ``fold`` (sum or max) of each value along ``order``, the row included; ``cut`` has ``_range``."""
    known = cut.withColumns({f"_{n}": v for n, v in values.items()})
    totals = known.groupBy(*keys, "_range").agg(*(fold(f"_{n}").alias(f"_{n}") for n in values))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_range", *(fold(f"_{n}").over(before).alias(f"_before_{n}") for n in values))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    join = (lambda a, b: F.coalesce(a + b, b)) if fold is F.sum else (lambda a, b: F.greatest(a, b))
    out = known.join(offsets, [*keys, "_range"]).withColumns({n: join(F.col(f"_before_{n}"), fold(f"_{n}").over(within)) for n in values})
    return out.drop(*(f"_{n}" for n in values), *(f"_before_{n}" for n in values))


def numbered(rows: DataFrame, keys: list[str], lead: Column, order: list[Column | str], name: str = "nth") -> DataFrame:
    """``name``: the row's place from 1 in its key, along ``order``, which begins with ``lead``."""
    return accumulated(ranged(rows, keys, lead), keys, order, {name: F.lit(1).cast("long")}).drop("_range")


def framed(rows: DataFrame, keys: list[str], lead: Column, order: list[Column | str], window: int, size: int = 20_000) -> tuple[DataFrame, Column]:
    """Rows in blocks of ``size`` along ``order``, the last ``window - 1`` of each also in the next one.

    Gives the rows with ``_block``, and the condition by which a row counts there; a frame of ``window`` rows that
    ends at such a row lies in its block.
    """
    size = max(size, window)
    placed = numbered(rows, keys, lead, order, "_nth").withColumn("_own", F.floor((F.col("_nth") - 1) / size))
    late = (F.col("_nth") - 1) % size >= size - window + 1
    blocks = F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    return placed.withColumn("_block", F.explode(blocks)), F.col("_block") == F.col("_own")


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles by key, from counts of distinct values: ``shares`` maps names to shares."""
    grain = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    upto = accumulated(ranged(grain, keys, F.col("_v")), keys, ["_v"], {"_upto": F.col("_c")})
    n = grain.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    known = upto.join(n, keys) if keys else upto.crossJoin(F.broadcast(n))

    def at(share: float) -> Column:
        place = F.lit(share) * (F.col("_n") - 1)
        rank = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v").cast("double")))
        return F.struct(rank(F.floor(place)).alias("low"), rank(F.ceil(place)).alias("high"), F.max(place - F.floor(place)).alias("part"))

    found = known.groupBy(*keys).agg(*(at(s).alias(f"_{i}") for i, s in enumerate(shares.values())))
    return found.select(*keys, *((F.col(f"_{i}.low") + (F.col(f"_{i}.high") - F.col(f"_{i}.low")) * F.col(f"_{i}.part")).alias(name) for i, name in enumerate(shares)))
