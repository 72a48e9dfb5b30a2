"""Warrants through typed ledger records: the matrix from decoded bodies, and lookups among broken and missing ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.operators import records as T
from warrantlake.plans.q_matrix import DAYS, ISSUED, KEY, NOW, _issued
from warrantlake.sources.shared import written
from warrantlake.sources.views import table


def _records(s: SparkSession, d: str) -> DataFrame:
    rows = _issued(s, d).withColumn("warrant_id", F.concat_ws("|", *KEY)).withColumn("issued_at", F.col("issued_at").cast("timestamp"))
    return T.encoded(rows, "warrant")


def _matrix(s: SparkSession, d: str) -> DataFrame:
    held = written(_records(s, d), "ledger")
    return T.matrix_from(held, NOW, DAYS).select("detector_id", "envelope_id", "operating_point_id", "status")


def _lookups(s: SparkSession, d: str) -> DataFrame:
    """Every supplier's warrant of one month: some bodies are cut off, some lack their status, some aren't there."""
    x = _records(s, d)
    number = F.regexp_extract("record_id", "^D([0-9]+)", 1).cast("int")
    body = F.when(number % 7 == 3, F.expr("left(body, length(body) - 9)")).when(number % 5 == 2, F.regexp_replace("body", '"status":"[A-Z]+",', "")).when(number % 11 == 4, F.regexp_replace("body", '"warrant_id":"D', '"warrant_id":"X')).otherwise(F.col("body"))
    held = written(x.withColumn("body", body), "ledger")
    wanted = table(s, d, "supplier").select(F.concat(F.lit("D"), F.col("s_suppkey").cast("string"), F.lit("|P-N|E1996-03")).alias("record_id"))
    found = T.lookup(held, wanted, "warrant", strict=False)
    sound = F.col("problem").isNull()
    return found.select("record_id", "problem", *(F.when(sound, F.col(c)).alias(c) for c in ("detector_id", "envelope_id", "n", "status")), F.when(sound, F.round("recall_low", 9)).alias("recall_low"))


QUERIES = {
    "pl03_ledger_matrix": (_matrix, f"WITH {ISSUED} SELECT * FROM full_m"),
    "io05_typed_lookup": (
        _lookups,
        f"""WITH {ISSUED}, w AS (SELECT s_suppkey AS k, 'D' || CAST(s_suppkey AS VARCHAR) AS detector_id FROM supplier),
        p AS (SELECT w.detector_id || '|P-N|E1996-03' AS record_id, CASE WHEN i.n IS NULL THEN 'no such record' WHEN k % 7 = 3 THEN 'broken body' WHEN k % 5 = 2 THEN 'lacks status' WHEN k % 11 = 4 THEN 'body of another record' END AS problem, i.detector_id, i.envelope_id, i.n, i.first_status, i.recall_low
          FROM w LEFT JOIN (SELECT * FROM st WHERE operating_point_id = 'P-N' AND envelope_id = 'E1996-03') i ON i.detector_id = w.detector_id)
        SELECT record_id, problem, {", ".join(f"CASE WHEN problem IS NULL THEN {c} END AS {c}" for c in ("detector_id", "envelope_id", "n"))}, CASE WHEN problem IS NULL THEN first_status END AS status, CASE WHEN problem IS NULL THEN round(recall_low, 9) END AS recall_low FROM p""",
    ),
}
