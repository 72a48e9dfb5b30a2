"""The append-only ledger: filters, latest per key, hash chains and their verification, retention, overrides."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "GENESIS"
KINDS = ("certificate", "warrant", "override", "validation_run", "retention_event")


def query(ledger: DataFrame, *, kind=None, session_id=None, since=None, until=None, detector_version=None, warrant_status=None, limit: int | None = None) -> DataFrame:
    """Conjunction of the filters that are given, in ``seq`` order; [since, until) is half open.

    ``detector_version`` is looked for anywhere in the joined versions, so ``0.1.0`` also finds ``10.1.0``;
    ``with_version`` asks for a whole one.
    """
    out = ledger
    for column, value in (("kind", kind), ("session_id", session_id), ("warrant_status", warrant_status)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.where(F.col("created_at") < F.lit(until).cast("timestamp"))
    if detector_version is not None:
        out = out.where(F.col("detector_versions").contains(detector_version))
    return out.orderBy("seq") if limit is None else out.orderBy("seq").limit(limit)


def with_version(ledger: DataFrame, version: str) -> DataFrame:
    return ledger.where(F.array_contains(F.split("detector_versions", ","), version))


def overrides_of(ledger: DataFrame, certificates: DataFrame) -> DataFrame:
    """Overrides with the certificate that their body names, joined on it; those that name none or an unknown one are left out."""
    named = ledger.where("kind = 'override'").withColumn("certificate_id", F.get_json_object("body", "$.certificate_id"))
    return named.join(certificates, "certificate_id")


def latest(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the largest ``seq`` of each key, by one aggregation."""
    rest = [c for c in ledger.columns if c not in keys]
    top = ledger.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    return top.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def chained(ledger: DataFrame, chain: str) -> DataFrame:
    """prev_hash and self_hash = sha256(prev_hash || body) along each chain, in ``seq`` order.

    Building a chain is serial by definition, so a chain is folded where its rows meet; verifying is not.
    """
    bodies = ledger.groupBy(chain).agg(F.array_sort(F.collect_list(F.struct("seq", "body"))).alias("rows"))
    empty = F.array().cast("array<struct<seq:bigint,body:string,prev_hash:string,self_hash:string>>")

    def step(done: Column, row: Column) -> Column:
        previous = F.when(F.size(done) == 0, F.lit(GENESIS)).otherwise(F.get(done, F.size(done) - 1)["self_hash"])
        return F.concat(done, F.array(F.struct(row["seq"].alias("seq"), row["body"].alias("body"), previous.alias("prev_hash"), F.sha2(F.concat(previous, row["body"]), 256).alias("self_hash"))))

    return bodies.select(chain, F.inline(F.aggregate("rows", empty, step)))


def head(ledger: DataFrame, chain: str) -> DataFrame:
    """Number of records and the last hash of each chain, folded in ``seq`` order."""
    bodies = ledger.groupBy(chain).agg(F.array_sort(F.collect_list(F.struct("seq", "body"))).alias("rows"))
    return bodies.select(chain, F.size("rows").cast("long").alias("records"), F.aggregate("rows", F.lit(GENESIS), lambda h, r: F.sha2(F.concat(h, r["body"]), 256)).alias("head_hash"))


def breaks(records: DataFrame, chain: str, anchors: DataFrame | None = None) -> DataFrame:
    """Rows whose hash isn't that of their body, or whose prev_hash isn't their predecessor's hash.

    A chain may begin at an anchor hash that a retention event declares (``anchors``: chain, anchor).
    """
    order = Window.partitionBy(chain).orderBy("seq")
    x = records.withColumns({"expected": F.lag("self_hash").over(order), "first": F.row_number().over(order) == 1})
    if anchors is not None:
        x = x.join(anchors, chain, "left")
    else:
        x = x.withColumn("anchor", F.lit(None).cast("string"))
    start_ok = (F.col("prev_hash") == GENESIS) | F.coalesce(F.col("prev_hash") == F.col("anchor"), F.lit(False))
    link = F.when(F.when(F.col("first"), start_ok).otherwise(F.col("prev_hash").eqNullSafe(F.col("expected"))), None).otherwise("link")
    body = F.when(F.sha2(F.concat("prev_hash", "body"), 256) != F.col("self_hash"), "hash")
    return x.withColumn("reason", F.concat_ws("+", body, link)).where("reason <> ''").select(chain, "seq", "reason")


def purge_summary(ledger: DataFrame, cutoff: datetime, now: datetime, retention_days: int = 365) -> DataFrame:
    """What a purge before ``cutoff`` would take; refused for a cutoff within the retention."""
    if (now - cutoff).days < retention_days:
        raise ValueError("the cutoff lies within the retention")
    gone = ledger.where(F.col("created_at") < F.lit(cutoff.isoformat(sep=" ")).cast("timestamp"))
    return gone.agg(F.count("*").alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by(F.sha2("body", 256), "seq").alias("last_hash_removed"))


def override_summary(overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of rulings, and both directions weighted by the inverse probability of having been chosen."""
    w = 1 / F.col("selection_probability")
    return overrides.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.expr("direction = 'none'")).alias("upheld"),
        F.count_if(F.expr("direction <> 'none'")).alias("overridden"),
        F.round(F.coalesce(F.sum(F.when(F.col("direction") == "false_negative", w)), F.lit(0.0)), 6).alias("weighted_false_negatives"),
        F.round(F.coalesce(F.sum(F.when(F.col("direction") == "false_positive", w)), F.lit(0.0)), 6).alias("weighted_false_positives"),
    )


def append(spark, path: str, records: DataFrame, retention_days: int = 365) -> int:
    """Appends (kind, record_id, body) rows in the order of ``record_id`` after the stored head; a single writer.

    Further columns are kept beside the body.

    Unknown kinds and (kind, record_id) pairs already stored are refused as a whole. Returns the last ``seq``.
    """
    if retention_days < 365:
        raise ValueError("records are kept for 365 days at least")
    if records.where(~F.col("kind").isin(*KINDS)).limit(1).count():
        raise ValueError("unknown kind")
    if records.groupBy("kind", "record_id").count().where("count > 1").limit(1).count():
        raise ValueError("duplicate record")
    seq, previous = 0, GENESIS
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        stored = spark.read.parquet(path)
        if records.join(stored, ["kind", "record_id"], "left_semi").limit(1).count():
            raise ValueError("duplicate record")
        last = stored.orderBy(F.desc("seq")).limit(1).first()
        if last is not None:
            seq, previous = last["seq"], last["self_hash"]
    beside = [c for c in records.columns if c not in ("kind", "record_id", "body")]
    names = ["seq", "kind", "record_id", "body", *beside, "prev_hash", "self_hash"]
    kinds = {"seq": "long", "prev_hash": "string", "self_hash": "string"} | {c: k for c, k in records.dtypes if c not in ("seq",)}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = previous, seq
        for batch in batches:
            hashes = [last]
            for body in batch.column("body").to_pylist():
                hashes.append(hashlib.sha256((hashes[-1] + (body or "")).encode()).hexdigest())
            last = hashes[-1]
            made = {"seq": pa.array(range(at + 1, at + len(hashes)), pa.int64()), "prev_hash": pa.array(hashes[:-1], pa.string()), "self_hash": pa.array(hashes[1:], pa.string())}
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([made.get(c) if c in made else batch.column(c) for c in names], names)

    # One task, as each hash needs the one before it; it holds a batch at a time.
    ordered = records.select("kind", "record_id", "body", *beside).repartition(1).sortWithinPartitions("kind", "record_id")
    ordered.mapInArrow(fold, ", ".join(f"`{c}` {kinds[c]}" for c in names)).write.mode("append").parquet(path)
    return spark.read.parquet(path).agg(F.max("seq")).first()[0] or 0
