"""Split assignments as Parquet: required columns on writing and reading, and integrity asserted again on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.operators.splits import SPLITS

#: Columns of a split table and their types.
COLUMNS = {"item_id": "bigint", "group": "string", "aliases": "array<string>", "split": "string"}


def _lacking(df: DataFrame) -> list[str]:
    found = dict(df.dtypes)
    return [f"{c} is missing" if c not in found else f"{c} is {found[c]}, not {kind}" for c, kind in COLUMNS.items() if found.get(c) != kind]


def save(items: DataFrame, path: str) -> None:
    """Writes the required columns alone; never over another table."""
    wrong = _lacking(items)
    if wrong:
        raise ValueError(f"can't be saved as splits: {'; '.join(wrong)}")
    items.select(*COLUMNS).write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, with empty lists for null aliases; a ValueError names what is wrong with it.

    Columns are checked before any row is read. Rows have to name an item, a group and a known split, an item may
    occur once, and a group may lie in one split only: a table left by other settings would train on what it tests.
    """
    found = spark.read.parquet(path)
    wrong = _lacking(found)
    if wrong:
        raise ValueError(f"{path}: {'; '.join(wrong)}")
    unnamed = F.col("item_id").isNull() | F.col("group").isNull() | F.coalesce(~F.col("split").isin(*SPLITS), F.lit(True))
    rows = found.agg(F.count_if(unnamed).alias("n")).first()["n"]
    twice = found.groupBy("item_id").agg(F.count("*").alias("c")).where("c > 1").count()
    torn = found.groupBy("group").agg((F.min("split") != F.max("split")).alias("torn")).where("torn").count()
    faults = [f"{n} {what}" for n, what in ((rows, "rows without item, group or known split"), (twice, "items more than once"), (torn, "groups in several splits")) if n]
    if faults:
        raise ValueError(f"{path}: {'; '.join(faults)}")
    return found.select(*COLUMNS).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
