"""What the operators share: reading a table, the shared folder, and cutting lineage by a written table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a join key from which on it is salted.
HOT = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is missing, a local session gets a temporary folder in its place; a cluster has none to give.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="warrantlake-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/warrantlake-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut there, and lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, how: str = "left", hot: int = HOT) -> DataFrame:
    """``left`` joined with ``right``, which has one row of each key; ``counts`` (key, n): how often keys are in ``left``.

    A key of more rows than ``hot`` (or than a ten-thousandth of all, so that such keys are few enough to broadcast)
    is salted: its rows are dealt over several places, and its row of ``right`` is copied to each.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(hot, -(-total // 10_000))
    salts = F.broadcast(counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("long").alias("_salts")))
    count = F.coalesce("_salts", F.lit(1))
    dealt = left.join(salts, key, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), count)).drop("_salts")
    copied = right.join(salts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).drop("_salts")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")


def crc_of_id(column: str):
    """crc32 of an id's decimal text, as folds use it; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
