"""The given tables, and the views over them that the measurement operators read.

Each view has a DataFrame builder and the same view as SQL text (a common table expression) for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored, labelled item per labelled document: its score is its share of 20,000 characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    marks = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    return docs.join(marks, "doc_id").select(
        F.col("doc_id").alias("item_id"),
        F.col("lang").alias("eval_set_id"),
        F.concat_ws("|", "lang", "source").alias("question_id"),
        F.col("toxic").cast("int").alias("label"),
        F.col("quality").cast("int").alias("hard"),
        (F.col("n_chars").cast("double") / 20000).alias("score"),
    )


SCORED = """scored AS (
  SELECT d.doc_id AS item_id, d.lang AS eval_set_id, d.lang || '|' || d.source AS question_id,
         CAST(l.toxic AS INTEGER) AS label, CAST(l.quality AS INTEGER) AS hard, CAST(d.n_chars AS DOUBLE) / 20000 AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def traffic(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """Events in arrival order (ts, event_id); the first half of January is the reference, the rest is live.

    ``more``: columns made of an event's own, such as one of its ``props``.
    """
    live = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", live.alias("live"), *(c.alias(name) for name, c in more.items()))


TRAFFIC = """traffic AS (
  SELECT event_id, ts, user_id, event_type, value, ts >= TIMESTAMP '2024-01-16' AS live FROM events)"""


def ledger_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an append-only ledger: ``seq`` is the order key; kind, session and body come from the order."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.lower(F.regexp_extract("o_orderpriority", "[A-Z]+", 0)).alias("kind"),
        F.col("o_custkey").alias("session_id"),
        F.concat(F.lit("K-"), (F.col("o_orderkey") % 97).cast("string")).alias("record_key"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("warrant_status"),
        F.concat(F.lit("0."), (F.col("o_orderkey") % 3).cast("string"), F.lit(".0,1"), F.lit("0."), (F.col("o_custkey") % 2).cast("string"), F.lit(".0")).alias("detector_versions"),
        F.col("o_totalprice").alias("amount"),
        F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("body"),
    )


LEDGER = """ledger AS (
  SELECT o_orderkey AS seq, lower(regexp_extract(o_orderpriority, '[A-Z]+')) AS kind, o_custkey AS session_id,
         'K-' || CAST(o_orderkey % 97 AS VARCHAR) AS record_key, o_orderdate AS created_at, o_orderstatus AS warrant_status,
         '0.' || CAST(o_orderkey % 3 AS VARCHAR) || '.0,10.' || CAST(o_custkey % 2 AS VARCHAR) || '.0' AS detector_versions,
         o_totalprice AS amount,
         CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority AS body
  FROM orders)"""


def warrant_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items summed into warrants: supplier is the detector, return flag the operating point, month the envelope."""
    li = table(spark, sf_dir, "lineitem")
    groups = li.groupBy("l_suppkey", "l_returnflag", F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month")).agg(
        F.count("*").alias("n"),
        F.count_if(F.expr("l_quantity >= 25")).alias("hits"),
        F.count_if(F.expr("l_discount >= 0.08")).alias("false_flags"),
        F.max("l_shipdate").alias("issued_at"),
    )
    return groups.select(
        F.concat(F.lit("D"), F.col("l_suppkey").cast("string")).alias("detector_id"),
        F.concat(F.lit("P-"), F.col("l_returnflag")).alias("operating_point_id"),
        F.concat(F.lit("E"), F.date_format("month", "yyyy-MM")).alias("envelope_id"),
        "n",
        "hits",
        "false_flags",
        "issued_at",
    )


WARRANTS = """warrants AS (
  SELECT 'D' || CAST(l_suppkey AS VARCHAR) AS detector_id, 'P-' || l_returnflag AS operating_point_id,
         'E' || strftime(l_shipdate, '%Y-%m') AS envelope_id, count(*) AS n,
         count(*) FILTER (l_quantity >= 25) AS hits, count(*) FILTER (l_discount >= 0.08) AS false_flags, max(l_shipdate) AS issued_at
  FROM lineitem GROUP BY 1, 2, 3)"""


def probe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"), (F.col("label") < 5).cast("int").alias("label"))
