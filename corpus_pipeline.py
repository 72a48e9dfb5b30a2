"""The text pipeline: stages over ``documents``, each calling one operator of ``warrantlake.llm``.

Every stage works on all that its predecessor kept. The filtering stages return rows of ``documents`` as they
are, extra columns included; the last returns the packed sequences. A stage reads the learned tables (labels,
benchmark) from ``sf_dir`` and learns from documents that it was given. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.llm import decontaminate, language, packing, simhash, toxicity
from warrantlake.llm.common import crc_of_id, written


def _kept(docs: DataFrame, judged, keep) -> DataFrame:
    """Rows for which ``keep`` of the operator's column holds. Their columns travel in one, so no name clashes."""
    whole = docs.select(F.struct("*").alias("row"), judged)
    return whole.where(keep).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; labels of one fold are never learned from."""
    learned = docs.where(crc_of_id("doc_id") % 3 != 1)
    index = toxicity.fit(docs, learned, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.toxicity_column(F.col("text"), index, spark)
    return _kept(docs, scored.alias("found"), F.col("found.score") < toxicity.THRESHOLD)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score above the calibrated threshold."""
    model = language.fit(docs.where(~language.held_out(4, 2)))
    found = language.language_column(F.col("text"), model, spark)
    return _kept(docs, found.alias("found"), ~F.col("found.rejected"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that of the smallest id, and of rows of equal id the first by row key.

    Ids may be repeated or null, so rows are told apart by a key of their own, written once with them. The keys to
    keep grow with the corpus, so they are never broadcast: both sides are dealt by key, whatever their size, and
    the keys alone are hashed, so that texts are moved once and not sorted.
    """
    keyed = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_key")), "keyed")
    ordered = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("id"), "row_key")
    found = simhash.near_duplicates(keyed.select(ordered.alias("doc_id"), F.col("row.text").alias("text")))
    keep = found.where(F.col("doc_id.row_key") == F.col("component_id.row_key")).select(F.col("doc_id.row_key").alias("row_key"))
    return keyed.join(written(keep, "kept").hint("shuffle_hash"), "row_key", "left_semi").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = docs.select(F.struct("*").alias("row"), "text")
    found = decontaminate.judged(decontaminate.find_contamination(whole, benchmark))
    return found.where(~F.col("contaminated")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as sequences of at most 2048 tokens, a row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned models, tokenizers and a genetic algorithm have no SQL; tests/llm compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return written(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
