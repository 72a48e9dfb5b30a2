"""Typed records of the ledger: a schema for each kind of body, columns that repeat what is asked for, decoding that fails loudly.

A record is (kind, record_id, body) with the body as JSON of the kind's schema, and ``PROJECTED`` columns beside it,
taken from the body, so that filters never parse JSON. Readers decode bodies into columns; a body that isn't of its
schema, lacks a required field, or isn't there at all is an error, never a null row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from warrantlake.operators import matrix as X
from warrantlake.operators.ledger import append

#: Bodies by kind. The first field is the record's id; it and those in ``REQUIRED`` may not be null.
SCHEMAS = {
    "warrant": "warrant_id string, detector_id string, operating_point_id string, envelope_id string, n long, recall double, recall_low double, recall_high double, fpr_high double, status string, reasons array<string>, issued_at timestamp",
    "certificate": "certificate_id string, session_id string, warrant_id string, warrant_status string, action string, created_at timestamp",
    "override": "override_id string, certificate_id string, session_id string, direction string, reviewer string, created_at timestamp",
    "validation_run": "run_id string, detector_id string, envelope_id string, verdict string, created_at timestamp",
}
REQUIRED = {"warrant": ["detector_id", "operating_point_id", "envelope_id", "status"], "certificate": ["session_id", "action"], "override": ["certificate_id", "direction"], "validation_run": ["detector_id", "envelope_id"]}
#: Columns beside the body, and the field of each kind that they repeat.
PROJECTED = {
    "session_id": {"certificate": "session_id", "override": "session_id"},
    "detector_id": {"warrant": "detector_id", "validation_run": "detector_id"},
    "envelope_id": {"warrant": "envelope_id", "validation_run": "envelope_id"},
    "warrant_id": {"warrant": "warrant_id", "certificate": "warrant_id"},
    "certificate_id": {"certificate": "certificate_id", "override": "certificate_id"},
    "warrant_status": {"warrant": "status", "certificate": "warrant_status"},
}
OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "mode": "PERMISSIVE"}


def _fields(kind: str) -> list[str]:
    if kind not in SCHEMAS:
        raise ValueError(f"unknown kind {kind!r}")
    return StructType.fromDDL(SCHEMAS[kind]).names


def _lacking(kind: str, at) -> Column:
    """The required fields that are null, as a list."""
    return F.array_compact(F.array(*[F.when(at(c).isNull(), F.lit(c)) for c in [_fields(kind)[0], *REQUIRED[kind]]]))


def encoded(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, record_id, body, ``PROJECTED``) of rows with the columns of the kind; others are left out, missing ones refused."""
    schema = StructType.fromDDL(SCHEMAS[kind]) if kind in SCHEMAS else None
    absent = [c for c in _fields(kind) if c not in rows.columns]
    if absent:
        raise ValueError(f"{kind} records lack the columns {', '.join(absent)}")
    lacking = _lacking(kind, F.col)
    checked = rows.withColumn("_id", F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit(f"a {kind} lacks "), F.concat_ws(", ", lacking))).cast("string")).otherwise(F.col(schema.names[0]).cast("string")))
    body = F.to_json(F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)), OPTIONS)
    beside = [(F.col(of[kind]).cast("string") if kind in of else F.lit(None).cast("string")).alias(name) for name, of in PROJECTED.items()]
    return checked.select(F.lit(kind).alias("kind"), F.col("_id").alias("record_id"), body.alias("body"), *beside)


def append_typed(spark: SparkSession, path: str, rows: DataFrame, kind: str) -> int:
    """Appends rows of one kind to the chained ledger at ``path``, with the columns beside the body; the last ``seq``."""
    return append(spark, path, encoded(rows, kind))


def _decoded(records: DataFrame, kind: str) -> DataFrame:
    known = records.withColumn("_b", F.from_json("body", SCHEMAS[kind], OPTIONS))
    lacking = _lacking(kind, lambda c: F.col(f"_b.{c}"))
    other = F.col("record_id") != F.col(f"_b.{_fields(kind)[0]}")
    problem = (
        F.when(F.col("body").isNull(), "no such record")
        .when(F.col("_b").isNull() | (F.size(lacking) == 1 + len(REQUIRED[kind])), "broken body")
        .when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.concat_ws(", ", lacking)))
        .when(other, "body of another record")
    )
    return known.withColumn("problem", problem)


def decode(records: DataFrame, kind: str, strict: bool = True) -> DataFrame:
    """The bodies of one kind as columns. ``strict``: a bad body fails the job; else it is a row with its ``problem``."""
    _fields(kind)
    x = _decoded(records.where(F.col("kind") == kind), kind)
    if not strict:
        return x.select("record_id", "problem", "_b.*")
    first, *rest = _fields(kind)
    sound = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit(f"{kind} "), F.col("record_id"), F.lit(": "), F.col("problem"))).cast("string")).otherwise(F.col(f"_b.{first}"))
    return x.select(sound.alias(first), *(F.col(f"_b.{c}").alias(c) for c in rest))


def lookup(records: DataFrame, wanted: DataFrame, kind: str, strict: bool = True) -> DataFrame:
    """The decoded record of each ``record_id`` in ``wanted``; one that isn't there is a problem like a broken body."""
    held = records.where(F.col("kind") == kind).select("record_id", "body")
    found = wanted.select("record_id").join(held, "record_id", "left").withColumn("kind", F.lit(kind))
    return decode(found, kind, strict)


def matrix_from(records: DataFrame, now: str, days: int) -> DataFrame:
    """The full matrix from decoded warrants: expired ones read STALE, what was never filed UNVALIDATED."""
    cells = X.cell_status(decode(records, "warrant"), now, days)
    key = ["detector_id", "operating_point_id", "envelope_id"]
    return X.full_matrix(X.first_operating_point(cells).select(*key, "status"), cells, cells)
