"""An append-only log of test scorings: every one keeps its number, and a log that can't be trusted is never appended to.

There is one writer at a time. A log is a Parquet folder; an append adds files and never rewrites one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.operators import ranges as G

COLUMNS = {"test_set": "string", "scoring": "bigint", "record": "string"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log; refused unless the scorings of every test set are numbered 1, 2, ... without gap or repeat."""
    log = spark.read.parquet(path)
    if dict(log.dtypes) != COLUMNS:
        raise ValueError(f"{path} isn't a log of scorings: {log.dtypes}")
    x = log.groupBy("test_set").agg(F.count("*").alias("n"), F.count_distinct("scoring").alias("d"), F.min("scoring").alias("lo"), F.max("scoring").alias("hi"))
    broken = x.where("lo is null or lo <> 1 or hi <> n or d <> n").orderBy("test_set").limit(3).collect()
    if broken:
        raise ValueError(f"{path} is corrupt: scorings of {', '.join(repr(r['test_set']) for r in broken)} were lost or repeated")
    return log


def append(records: DataFrame, path: str, lead: Column, order: list[str], first: bool = False) -> None:
    """Adds ``records`` (test_set, record and the columns of ``order``, which begins with ``lead``) after those in the log.

    ``first`` starts a log, where there mustn't be one; otherwise it has to exist and to be sound.
    """
    numbered = G.numbered(records, ["test_set"], lead, order, "scoring")
    if not first:
        done = read(records.sparkSession, path).groupBy("test_set").agg(F.max("scoring").alias("_done"))
        numbered = numbered.join(done, "test_set", "left").withColumn("scoring", F.col("scoring") + F.coalesce("_done", F.lit(0)))
    numbered.select(*(F.col(c).cast(kind) for c, kind in COLUMNS.items())).write.mode("errorifexists" if first else "append").parquet(path)


def counts(log: DataFrame) -> DataFrame:
    return log.groupBy("test_set").agg(F.count("*").alias("n_scorings"))
