"""Policy bundles over warrants made of line items: suppliers' nations are detectors, years are envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.operators import matrix as X
from warrantlake.operators import policy as B
from warrantlake.sources.views import table

NOW, FAR = "1998-11-01", 700


def _warrants(s: SparkSession, d: str) -> DataFrame:
    """Measured claims by nation, return flag and year; some without recall, without false positives, or of another status."""
    supplier = table(s, d, "supplier").select("s_suppkey", "s_nationkey")
    item = table(s, d, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    keys = item.groupBy("s_nationkey", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("detector_id"), F.concat(F.lit("P-"), F.col("l_returnflag")).alias("operating_point_id"), F.concat(F.lit("E"), F.year("l_shipdate").cast("string")).alias("envelope_id"))
    x = keys.agg(F.count("*").alias("n"), F.count_if(F.expr("l_quantity >= 25")).alias("hits"), F.count_if(F.expr("l_discount >= 0.08")).alias("false_flags"), F.max("l_shipdate").cast("timestamp").alias("issued_at"), F.avg("l_quantity").alias("threshold"))
    single, unmeasured = F.col("s_nationkey") % 9 == 8, F.col("s_nationkey") % 5 == 4
    point = F.col("operating_point_id")
    return x.select(
        *B.KEY, "n", "issued_at", F.round("threshold", 6).alias("threshold"), (F.col("issued_at") + F.make_dt_interval(F.lit(600))).alias("expires_at"),
        F.when(F.col("n") % 17 == 0, "REFUSED").when(F.col("n") % 13 == 0, "STALE").when(F.col("n") % 19 == 0, "REVOKED").otherwise("VALID").alias("status"),
        F.when(~single, F.col("hits") / F.col("n")).alias("recall"), F.when(~single, X.wilson(F.col("hits"), F.col("n"), -1)).alias("recall_low"),
        F.when(~unmeasured, F.col("false_flags") / F.col("n")).alias("fpr"), F.when(~unmeasured, X.wilson(F.col("false_flags"), F.col("n"), 1)).alias("fpr_high"),
        F.when(point == "P-A", 0.5).when(point == "P-N", 0.65).alias("target_flag_rate"),
        (F.col("hits") / F.col("n")).alias("flag_rate"), X.wilson(F.col("hits"), F.col("n"), -1).alias("flag_low"), X.wilson(F.col("hits"), F.col("n"), 1).alias("flag_high"),
    )


def _requirements(s: SparkSession, d: str) -> DataFrame:
    """Two or three requirements of a bundle for each customer nation and market segment."""
    c = table(s, d, "customer").select("c_nationkey", F.ascii("c_mktsegment").alias("a")).distinct()
    x = c.withColumn("number", F.explode(F.sequence(F.lit(1), 2 + F.col("c_nationkey") % 2))).withColumn("k", F.col("c_nationkey") + F.col("a") + F.col("number"))
    return x.select(
        F.concat_ws("-", F.lit("B"), F.col("c_nationkey").cast("string"), F.col("a").cast("string")).alias("bundle"), "number",
        F.concat(F.lit("N"), (F.col("k") % 27).cast("string")).alias("detector_id"), F.get(F.array(F.lit("P-A"), F.lit("P-N"), F.lit("P-R")), F.col("k") % 3).alias("operating_point_id"),
        F.concat(F.lit("E"), (1995 + F.col("k") % 4).cast("string")).alias("envelope_id"),
        F.when(F.col("k") % 4 == 0, FAR).otherwise(5000).alias("max_age_days"), F.when(F.col("k") % 7 == 0, 0.5).otherwise(0.2).alias("min_recall"), F.when(F.col("k") % 2 == 0, 0.5).when(F.col("k") % 5 == 0, 0.2).alias("max_fpr"),
        F.when(F.col("k") % 6 == 0, 0.1).otherwise(0.9).alias("sensitivity"), F.get(F.array(F.lit(B.REFUSE), F.lit(B.WIDEN), F.lit(B.IGNORE)), F.col("c_nationkey") % 3).alias("on_drift"),
    )


def _checked(s: SparkSession, d: str) -> DataFrame:
    return B.checked(_requirements(s, d), _warrants(s, d), F.lit(NOW).cast("timestamp"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.concat_ws("; ", c).alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes))


def _rows(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_checked(s, d).select("bundle", "number", *B.KEY, "failures", "notes", "calibration", "budget", "budget_low", "budget_high", "budget_is"))


def _decisions(s: SparkSession, d: str) -> DataFrame:
    """The same requests under the three loaded bundles of the smallest names: how many get which action from each."""
    known = B.facts(_checked(s, d)).orderBy("bundle").limit(3)
    requests = table(s, d, "conversations").select("conv_id", "turn", (F.length("text") % 60).alias("score"))
    action = F.when(F.col("operating_point_id") == "P-A", "BLOCK").when(F.col("operating_point_id") == "P-N", "REDACT").otherwise("CONFIRM")
    return B.decided(requests, known, action).groupBy("bundle", "operating_point_id", "weakest_status", "action").agg(F.count("*").alias("requests"))


def _w(sign: str, k: str) -> str:
    z = f"{X.Z95!r}::DOUBLE"
    return f"(({k}::DOUBLE / n + {z} * {z} / (2 * n) {sign} {z} * sqrt({k}::DOUBLE / n * (1 - {k}::DOUBLE / n) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n))"


_RESOLVED = f"""wf AS (SELECT s_nationkey AS nk, 'N' || CAST(s_nationkey AS VARCHAR) AS detector_id, 'P-' || l_returnflag AS operating_point_id, 'E' || CAST(year(l_shipdate) AS VARCHAR) AS envelope_id, count(*) AS n, count(*) FILTER (l_quantity >= 25) AS hits,
  count(*) FILTER (l_discount >= 0.08) AS false_flags, max(l_shipdate)::TIMESTAMP AS issued_at, round(avg(l_quantity), 6) AS threshold FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3, 4),
w0 AS (SELECT detector_id, operating_point_id, envelope_id, n, issued_at, threshold, issued_at + INTERVAL 600 DAY AS expires_at, CASE WHEN n % 17 = 0 THEN 'REFUSED' WHEN n % 13 = 0 THEN 'STALE' WHEN n % 19 = 0 THEN 'REVOKED' ELSE 'VALID' END AS status,
  CASE WHEN nk % 9 <> 8 THEN hits::DOUBLE / n END AS recall, CASE WHEN nk % 9 <> 8 THEN {_w("-", "hits")} END AS recall_low, CASE WHEN nk % 5 <> 4 THEN false_flags::DOUBLE / n END AS fpr, CASE WHEN nk % 5 <> 4 THEN {_w("+", "false_flags")} END AS fpr_high,
  CASE operating_point_id WHEN 'P-A' THEN 0.5::DOUBLE WHEN 'P-N' THEN 0.65::DOUBLE END AS t, hits::DOUBLE / n AS flag_rate, {_w("-", "hits")} AS flag_low, {_w("+", "hits")} AS flag_high FROM wf),
w AS (SELECT *, CASE WHEN t IS NULL THEN 'UNKNOWN' WHEN t BETWEEN flag_low AND flag_high THEN 'CALIBRATED' ELSE 'DRIFTED' END AS calibration, coalesce(t * 0.75::DOUBLE <= flag_low AND flag_high <= t * 1.25::DOUBLE, false) AS resolved FROM w0),
rq AS (SELECT 'B-' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(a AS VARCHAR) AS bundle, number, 'N' || CAST(k % 27 AS VARCHAR) AS detector_id, ['P-A', 'P-N', 'P-R'][k % 3 + 1] AS operating_point_id,
  'E' || CAST(1995 + k % 4 AS VARCHAR) AS envelope_id, CASE WHEN k % 4 = 0 THEN {FAR} ELSE 5000 END AS max_age, CASE WHEN k % 7 = 0 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS min_recall,
  CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE WHEN k % 5 = 0 THEN 0.2::DOUBLE END AS max_fpr, CASE WHEN k % 6 = 0 THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END AS sensitivity, ['REFUSE', 'WIDEN_BUDGET', 'IGNORE'][c_nationkey % 3 + 1] AS on_drift
  FROM (SELECT c_nationkey, a, number, c_nationkey + a + number AS k FROM (SELECT *, unnest(range(1, 3 + c_nationkey % 2)) AS number FROM (SELECT DISTINCT c_nationkey::INTEGER AS c_nationkey, ascii(c_mktsegment) AS a FROM customer)))),
jn AS (SELECT rq.*, rq.detector_id || '|' || rq.operating_point_id || '|' || rq.envelope_id || ': ' AS name, n, issued_at, expires_at, threshold, status, recall, recall_low, fpr, fpr_high, t, flag_rate, flag_low, flag_high, calibration, resolved, TIMESTAMP '{NOW}' AS now, t * (1 + sensitivity) AS off
  FROM rq LEFT JOIN w ON w.detector_id = rq.detector_id AND w.operating_point_id = rq.operating_point_id AND w.envelope_id = rq.envelope_id),
fl AS (SELECT *, list_transform(CASE WHEN status IS NULL THEN ['UNVALIDATED: no warrant was ever filed'] WHEN status = 'REFUSED' THEN ['REFUSED: measured and failed its controls'] WHEN status <> 'VALID' THEN [status || ': not to be relied on']
  ELSE list_filter([CASE WHEN date_diff('second', issued_at, now) > max_age * 86400 THEN 'older than the profile allows' WHEN now >= expires_at THEN 'expired' END,
    CASE WHEN recall IS NULL THEN 'no recall claim on this envelope' WHEN recall_low < min_recall THEN 'recall bound below the floor' END,
    CASE WHEN max_fpr IS NOT NULL AND fpr IS NULL THEN 'ceiling declared, false positives unmeasured' WHEN fpr_high > max_fpr THEN 'false-positive bound above the ceiling' END,
    CASE WHEN greatest(1, ceil((1.96 * 1.96)::DOUBLE * off * (1 - off) / ((off - t) * (off - t)))) > n THEN 'too few items for the declared sensitivity' END,
    CASE WHEN calibration = 'DRIFTED' AND on_drift = 'REFUSE' THEN 'calibration has drifted' END], lambda f: f IS NOT NULL) END, lambda f: name || f) AS failures FROM jn),
ck AS (SELECT *, len(failures) = 0 AS met, coalesce(calibration = 'DRIFTED' AND on_drift = 'WIDEN_BUDGET', false) AS widened, CASE WHEN len(failures) > 0 THEN [] ELSE list_transform(list_filter([CASE WHEN max_fpr IS NULL THEN 'no false-positive ceiling is declared' END,
    CASE WHEN calibration = 'UNKNOWN' THEN 'the budget is untested here' WHEN calibration = 'DRIFTED' AND on_drift = 'WIDEN_BUDGET' THEN 'drifted: the measured interval is quoted for the budget' WHEN calibration = 'DRIFTED' THEN 'drifted: considered and ignored'
      WHEN NOT resolved THEN 'calibrated, but the interval leaves the band: unresolved' END], lambda f: f IS NOT NULL), lambda f: name || f) END AS notes FROM fl),
cl AS (SELECT *, CASE WHEN met THEN CASE WHEN widened THEN flag_rate ELSE t END END AS budget, CASE WHEN met AND widened THEN flag_low END AS budget_low, CASE WHEN met AND widened THEN flag_high END AS budget_high, CASE WHEN met AND widened THEN 'measured' WHEN met AND t IS NOT NULL THEN 'declared' END AS budget_is FROM ck),
bd AS (SELECT bundle, count(*) AS required, count(*) FILTER (NOT met) AS unmet, flatten(list(failures ORDER BY number)) AS failures, flatten(list(notes ORDER BY number)) AS notes, min(list_position(['REFUSED', 'REVOKED', 'UNVALIDATED', 'STALE', 'VALID'], coalesce(status, 'UNVALIDATED'))) AS weakest FROM cl GROUP BY 1),
fa AS (SELECT b.bundle, ['REFUSED', 'REVOKED', 'UNVALIDATED', 'STALE', 'VALID'][weakest] AS weakest_status, detector_id, operating_point_id, envelope_id, n, recall, recall_low, threshold, t AS target_flag_rate, budget, budget_is FROM bd b JOIN cl ON cl.bundle = b.bundle AND number = 1 WHERE unmet = 0)"""

QUERIES = {
    "sr13_requirement_checks": (_rows, f"WITH {_RESOLVED} SELECT bundle, number::INTEGER AS number, detector_id, operating_point_id, envelope_id, array_to_string(failures, '; ') AS failures, array_to_string(notes, '; ') AS notes, calibration, round(budget, 9) AS budget, round(budget_low, 9) AS budget_low, round(budget_high, 9) AS budget_high, budget_is FROM cl"),
    "jn06_policy_bundles": (lambda s, d: _rounded(B.bundles(_checked(s, d))), f"WITH {_RESOLVED} SELECT bundle, required, unmet, array_to_string(failures, '; ') AS failures, CASE WHEN unmet = 0 THEN array_to_string(notes, '; ') ELSE '' END AS notes, unmet = 0 AS loads FROM bd"),
    "df09_rule_facts": (lambda s, d: _rounded(B.facts(_checked(s, d))), f"WITH {_RESOLVED} SELECT bundle, weakest_status, detector_id, operating_point_id, envelope_id, n, round(recall, 9) AS recall, round(recall_low, 9) AS recall_low, threshold, target_flag_rate, round(budget, 9) AS budget, budget_is FROM fa"),
    "pl07_one_decision": (_decisions, f"""WITH {_RESOLVED}, three AS (SELECT * FROM fa ORDER BY bundle LIMIT 3)
        SELECT bundle, operating_point_id, weakest_status, CASE WHEN weakest_status <> 'VALID' THEN 'ESCALATE' WHEN length(text) % 60 >= threshold THEN CASE operating_point_id WHEN 'P-A' THEN 'BLOCK' WHEN 'P-N' THEN 'REDACT' ELSE 'CONFIRM' END ELSE 'ALLOW' END AS action, count(*) AS requests
        FROM conversations, three GROUP BY 1, 2, 3, 4"""),
}
